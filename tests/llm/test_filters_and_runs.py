"""Filter audit, periodic runs and quality rules against brute force, on odd tables and as registered queries."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest

from footfall.llm import audit, quality, queries, runs
from pyspark.sql import functions as F

NOT_SPACE = r"[^\x20\x09-\x0D]+"


def split(text):
    return (text or "").encode().split()


# Filter audit


def failures(rows):
    """The letters each of (id, text) fails."""
    smallest = {}
    for i, t in rows:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    out = []
    for i, t in rows:
        t = t or ""
        w = re.findall(NOT_SPACE, t)
        failed = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w))
        failed += "C" * (100 * len(re.findall("[A-Z]", t)) > 2 * len(t)) + "D" * bool(re.search("[#$%&*|]", t))
        out.append(failed + "E" * (i is not None and i > smallest[t]))
    return out


def audited(rows, parts, good, toxic):
    """What the operator returns, one document at a time."""
    failed = failures(rows)
    out = {}
    for order in map("".join, itertools.permutations("ABCDE")):
        for step, letter in enumerate(order, 1):
            for part in set(parts):
                out[part, order, step] = collections.Counter()
            for (i, _), part, f in zip(rows, parts, failed):
                count = out[part, order, step]
                gone, fails = bool(set(order[: step - 1]) & set(f)), letter in f
                count["kept"] += not gone and not fails
                count["removed"] += fails and not gone
                count["redundant"] += fails and gone
                count["unique_fails"] += f == letter
                count["good_lost"] += fails and not gone and i in good
                count["toxic_lost"] += fails and not gone and i in toxic
    for part in set(parts):
        for letter in "ABCDE":
            own = [(p, o, s) for p, o, s in out if p == part and o[s - 1] == letter]
            total = sum(out[key]["removed"] for key in own)
            for key in own:
                out[key]["shapley"] = total
    return out


NAMES = (*audit.COUNTS, "shapley")


def compared(found, expected):
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[name] for name in NAMES) for r in found.collect()}
    assert got == {key: tuple(int(count[name]) for name in NAMES) for key, count in expected.items()}


def test_audit_equals_counting(spark, table, texts):
    # Copies whose first row comes late, repeated and null ids, and a text of capitals and symbols.
    odd = texts + ["A* " * 250, "a|b", "a|b", "a|b", "a|b", None, ""]
    ids = list(range(len(odd)))[::-1]
    ids[3], ids[8], ids[-3], ids[-4] = None, ids[9], ids[-5], None
    docs = table(odd, ids)
    kept = {r["id"]: r for r in docs.select(F.col("doc_id").alias("id")).collect()}
    assert None in kept
    rows = docs.select("doc_id", "text", F.coalesce("source", F.lit("")).alias("part")).collect()
    labels = [(k, k % 2, k % 3 // 2) for k in range(0, 90, 3)] + [(6, 1, 1), (None, 1, 1)]
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    found = audit.filter_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    compared(found, audited([(r[0], r[1]) for r in rows], [r[2] for r in rows], good, toxic))


def test_audit_of_own_filters(spark, docs, texts):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    long, spaced = F.length("text") > 100, F.col("text").contains(" ")
    found = audit.filter_audit(docs, labels, {"L": long, "S": spaced}, copies=None, part_col="lang").collect()
    assert {(r["filter_order"], r["step"]) for r in found} == {("LS", 1), ("LS", 2), ("SL", 1), ("SL", 2)}
    removed = sum(r["removed"] for r in found if r["filter_order"] == "LS")
    assert removed == sum(len(t or "") > 100 or " " in (t or "") for t in texts)  # a null condition passes
    with pytest.raises(ValueError):
        audit.filter_audit(docs, labels, {c: long for c in "ABCDEFG"})


def test_audit_query(spark, folder, docs):
    rows = docs.select("doc_id", "text", F.coalesce("source", F.lit("")).alias("part")).collect()
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    good, toxic = ({r[0] for r in labels if r[0] is not None and r[k] == 1} for k in (1, 2))
    compared(queries.op11_filter_audit(spark, folder), audited([(r[0], r[1]) for r in rows], [r[2] for r in rows], good, toxic))


def test_audit_of_an_empty_table(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.filter_audit(empty, labels).count() == 0


# Periodic runs


def runs_of(words, least=24, power=3):
    """All runs by trying all periods, and the words that stay."""
    n, found = len(words), {}
    for period in range(1, n // power + 1):
        at = 0
        while at + period < n:
            end = at
            while end + period < n and words[end] == words[end + period]:
                end += 1
            length = end - at + period
            if end > at and length >= max(least, power * period):
                found.setdefault((at, length), period)
            at = max(at + 1, end)
    rows = sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))
    gone = {i for s, length, q in rows for i in range(s + q, s + length)}
    return rows, [w for i, w in enumerate(words) if i not in gone]


@pytest.mark.parametrize("seed", range(8))
def test_runs_equal_trying_all_periods(seed):
    rng, texts = random.Random(seed), []
    for _ in range(25):
        n, kinds = rng.choice([0, 1, 5, 23, 24, 25, 72, 150, 400]), rng.choice([1, 2, 3, 50])
        words = [str(rng.randrange(kinds)).encode() for _ in range(n)]
        for _ in range(rng.randrange(3)):
            if n:
                begin, period = rng.randrange(n), 1 + rng.randrange(n // 3 + 1)
                for i in range(begin, min(n, begin + period * rng.randrange(1, 9))):
                    words[i] = words[begin + (i - begin) % period]
        texts.append(words)
    for words, (found, collapsed) in zip(texts, runs._treated(texts, runs.LEAST, runs.POWER)):
        rows, left = runs_of(words)
        assert [tuple(r.values()) for r in found] == rows
        assert collapsed == b" ".join(left)


def test_runs_of_fibonacci_words():
    # Full of squares and of runs that overlap.
    one, two = "a", "ab"
    while len(two) < 1500:
        one, two = two, two + one
    words = [c.encode() for c in two]
    for least in (3, 24):
        (found, _), = runs._treated([words], least, 3)
        assert [tuple(r.values()) for r in found] == runs_of(words, least)[0]


def test_extensions_equal_comparing():
    rng = random.Random(3)
    import numpy as np

    words = np.array([rng.randrange(2) for _ in range(700)] + [7] + [1] * 300 + [8])
    extensions = runs.Extensions(words)
    pairs = [tuple(rng.sample(range(1000), 2)) for _ in range(3000)] + [(701, 702), (0, 999), (702, 701)]
    one, two = (np.array(x) for x in zip(*pairs))
    for a, b, n in zip(one, two, extensions.common(one, two)):
        assert n == next(k for k in itertools.count() if max(a, b) + k >= len(words) or words[a + k] != words[b + k])


def altered(i, words):
    """A tenth of the documents with words repeated from some place on."""
    h = zlib.crc32(str(i).encode())
    if i is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    begin = g % n
    period = 1 + (n - begin) // (3 + g % 8)
    return words[:begin] + [words[begin + (k - begin) % period] for k in range(begin, n)]


def expected_runs(i, text):
    rows, left = runs_of(altered(i, split(text)))
    best = max(rows, key=lambda r: (r[1] * 10**9 // r[2], -r[0], -r[2]), default=(None,) * 3)
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in rows)
    milli = best[1] * 1000 // best[2] if rows else None
    return (i, len(rows), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(left)).hexdigest())


def test_runs_query(spark, folder, texts, tmp_path):
    # Ids among which enough are altered; a third of the texts has repetitions of its own.
    short = [t for t in texts if len(t or "") < 60_000 and len(split(t)) < 2000]
    rows = [(k, short[k % len(short)]) for k in range(400)] + [(None, "a " * 60), (7, "b c " * 30), (7, "b c " * 30), (8, "x\ty " * 12 + "z")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()]
    assert collections.Counter(got) == collections.Counter(expected_runs(i, t) for i, t in rows)
    assert sum(r[1] > 0 for r in got) > 8


def test_runs_of_odd_rows(docs, texts, empty):
    found = {r["id"]: r for r in runs.find_runs(docs).collect()}
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        words = split(text)
        assert found[i]["n_words"] == len(words)
        if len(words) < 2000:
            rows, left = runs_of(words)
            assert [tuple(r) for r in found[i]["runs"]] == rows and found[i]["collapsed"].encode() == b" ".join(left)
    assert runs.find_runs(empty).count() == 0


def test_runs_of_few_words_at_once(docs, texts, monkeypatch):
    whole = {r["id"]: r for r in runs.find_runs(docs).collect()}
    monkeypatch.setattr(runs, "BATCH_WORDS", 50)
    assert {r["id"]: r for r in runs.find_runs(docs).collect()} == whole


# Quality rules


def counted(text):
    text = text or ""
    words = re.findall(NOT_SPACE, text)
    lines = [line for line in text.split("\n") if re.search(NOT_SPACE, line)]
    windows = collections.defaultdict(list)
    for k in range(len(words) - 4):
        windows[tuple(words[k : k + 5])].append(k)
    covered = {k + j for places in windows.values() if len(places) > 1 for k in places for j in range(5)}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_capitals": len(re.findall("[A-Z]", text)), "n_letters": len(re.findall("[A-Za-z]", text)),
        "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
    }


MORE = [
    "a\na\n\n \n a\na", "one two three four five six seven eight nine ten\n" * 4, "x y z w v " * 9, "# $ % words & more | of < these > here *",
    "ALL OF THESE WORDS ARE LOUD AND THERE ARE MORE THAN TEN", "\n", "a\r\na\r\n", "é ü ß 漢字 words of many kinds and more than ten of them",
    "a" * 400 + " b c d e f g h i j k",
]


def test_counts_equal_counting(table, texts):
    own = texts + MORE
    names = tuple(counted(""))
    rows = quality.judge(table(own), order=[r.name for r in quality.RULES], counts=names).collect()
    assert len(rows) == len(own)
    for r in rows:
        assert {name: r[name] for name in names} == counted(own[r["id"]])


@pytest.mark.parametrize("counts", [(), ("n_words", "n_repeat_words")])
def test_verdict_does_not_depend_on_the_order(table, texts, counts):
    own = texts + MORE
    docs = table(own)
    names = [r.name for r in quality.RULES]
    failing = {}
    for i, text in enumerate(own):
        c = counted(text)
        failing[i] = {
            name for name, fails in {
                "few_words": c["n_words"] < 10, "repeated_words": 100 * c["n_repeat_words"] > 20 * c["n_words"],
                "symbols": 10 * c["n_symbols"] > c["n_words"], "repeated_lines": 100 * c["n_dup_lines"] > 30 * c["n_lines"],
                "short_or_long_words": not 2 * c["n_words"] <= c["word_chars"] <= 12 * c["n_words"],
                "capitals": 2 * c["n_capitals"] > c["n_letters"],
            }.items() if fails
        }
    for order in (names, names[::-1], None):
        rows = quality.judge(docs, order=order, counts=counts).collect()
        assert {r["id"]: r["kept"] for r in rows} == {i: not f for i, f in failing.items()}
        if order:
            first = {i: next((name for name in order if name in f), None) for i, f in failing.items()}
            assert {r["id"]: r["failed"] for r in rows} == first


def test_later_rules_see_only_what_is_left(docs, texts):
    def refuse(c):
        if len(c.texts) and (c["n_words"] < 10).any():
            raise AssertionError("a text that an earlier rule rejected")
        return c["n_words"] < 0

    rules = (quality.RULES[0], quality.Rule("refuse", refuse))
    rows = quality.judge(docs, rules, order=["few_words", "refuse"]).collect()
    assert sum(r["kept"] for r in rows) == sum(len(split(t)) >= 10 for t in texts)


def test_estimate_puts_cheap_and_strict_rules_first(docs, empty):
    def slow(c):
        return sum(range(2_000_000)) < 0 or c["n_words"] < 10

    rules = (quality.Rule("slow", slow), quality.Rule("never", lambda c: c["n_words"] < 0), quality.RULES[0])
    found = quality.estimate(docs, rules)
    assert [e.rule for e in found] == ["few_words", "slow", "never"]
    assert found[0].rejected == found[1].rejected > 0 and found[2].worth == 0
    assert 0 < found[0].documents <= quality.SAMPLE_ROWS * 3
    assert {e.documents for e in quality.estimate(empty)} == {0}
    assert quality.judge(empty).count() == 0


def test_quality_query(spark, folder, texts):
    rows = queries.op13_quality_rules(spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        c = counted(texts[r["doc_id"]])
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        assert [r[n] for n in names] == [c[n] for n in names]
        assert r["base_failed"] == (c["n_words"] < 10 or 100 * c["n_repeat_words"] > 20 * c["n_words"])
        assert not (r["base_failed"] and r["kept"])
