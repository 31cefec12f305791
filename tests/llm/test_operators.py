"""Every operator against a brute-force version on a small table full of edge cases, and on an empty one."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from footfall.llm import components, exact, hilbert, jaccard, licenses, lm, mixing, packing, sampling, toxicity, urls
from footfall.llm.hashing import words
from footfall.llm.queries import tokenizer_file
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"


def split(text):
    return (text or "").encode().lower().split()


def test_hashes_tell_words_apart(texts):
    found = words(pa.array(texts))
    seen = {}
    hashes = found.hashes()
    for k, text in enumerate(texts):
        own = split(text)
        got = hashes[found.first[k] : found.first[k + 1]].tolist()
        assert len(got) == len(own)
        assert all(seen.setdefault(w, h) == h for w, h in zip(own, got))
    assert len(set(seen.values())) == len(seen)


# Exact dedup


def normal(text):
    out = "".join(" " if c in SPACE else c for c in text or "")
    while "  " in out:
        out = out.replace("  ", " ")
    return out


@pytest.mark.parametrize("digest", [exact.sha256, lambda c: F.substring(exact.sha256(c), 1, 1)], ids=["sha256", "colliding"])
def test_exact_duplicates(docs, texts, digest):
    rows = exact.exact_duplicates(docs, digest=digest, files_per_batch=1).collect()
    groups = collections.defaultdict(list)
    for i, t in enumerate(texts):
        groups[normal(t)].append(i)
    assert len(rows) == len(texts)
    for r in rows:
        group = groups[normal(texts[r.id])]
        assert (r.keep_id, r.group_size, r.kept) == (min(group), len(group), r.id == min(group))


def test_exact_keeps_one_of_repeated_rows(table):
    docs = table(["same"] * 5 + ["other"], [3, 3, 3, None, 9, None])
    rows = exact.exact_duplicates(docs).collect()
    assert sum(r.kept for r in rows) == 2 and {r.keep_id for r in rows} == {3, None}
    left = exact.without_duplicates(docs)
    assert sorted(r.text for r in left.collect()) == ["other", "same"] and left.columns == docs.columns


# Packing


def one_by_one(lengths, sequence):
    bins = []
    for length in sorted(lengths, reverse=True):
        fits = [(left, k) for k, left in enumerate(bins) if left >= length]
        if fits:
            bins[min(fits)[1]] -= length
        else:
            bins.append(sequence - length)
    return sorted(bins)


def test_plan_packs_like_one_by_one():
    rng = random.Random(3)
    for _ in range(200):
        sequence = rng.choice([7, 16, 50])
        lengths = [rng.randint(1, sequence) for _ in range(rng.randint(0, 60))]
        plan = packing.best_fit(collections.Counter(lengths), sequence)
        used = collections.defaultdict(list)
        for length, n in collections.Counter(lengths).items():
            for rank in range(n):
                _, first, copies, bin_, offset = [p for p in plan if p[0] == length and p[1] <= rank][-1]
                used[bin_ + (rank - first) // copies].append((offset + (rank - first) % copies * length, length))
        for rows in used.values():
            assert [o for o, _ in sorted(rows)] == list(itertools.accumulate([0] + [n for _, n in sorted(rows)]))[:-1]
        assert sorted(sequence - sum(n for _, n in rows) for rows in used.values()) == one_by_one(lengths, sequence)


def test_packed_documents_come_back(docs, texts):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(tokenizer_file())
    rows = packing.pack_documents(docs, tokenizer_file(), sequence=128, with_ids=True).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(r.ids)
    for i, text in enumerate(texts):
        ids = reference.encode(text or "", add_special_tokens=False).ids + [0]
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert b"".join(p.ids for p in pieces) == np.array(ids, "<u4").tobytes()
        assert [p.start for p in pieces] == list(range(0, len(ids), 128))
    for rows in by_sequence.values():
        assert [o for o, _ in sorted(rows)] == list(itertools.accumulate([0] + [n for _, n in sorted(rows)]))[:-1]
        assert sum(n for _, n in rows) <= 128
    assert sorted(128 - sum(n for _, n in rows) for rows in by_sequence.values()) == one_by_one([r.length for rows in by_doc.values() for r in rows], 128)


def test_more_words_at_once_than_are_kept(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "CACHED_WORDS", 5)
    reference, encoder = Tokenizer.from_file(tokenizer_file()), packing.WordEncoder(tokenizer_file())
    many = " ".join(f"own{k} {'xyz'[k % 3] * (k + 1)}, 0x{k:04x}" for k in range(40))
    for texts in (["ka lo mi"], ["ka lo", many], [many, "ru"], [None, ""], ["mi te. ka"]):
        want = [np.array(reference.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert encoder([None if t is None else t.encode() for t in texts]) == want


class CountedTokenizer:
    """The tokenizer, with the units asked of its model and the words given to it whole."""

    def __init__(self, tokenizer):
        self.tokenizer, self.model, self.units, self.whole = tokenizer, self, [], []

    def tokenize(self, unit):
        self.units.append(unit)
        return self.tokenizer.model.tokenize(unit)

    def encode_batch_fast(self, words, **options):
        self.whole += words
        return self.tokenizer.encode_batch_fast(words, **options)


def test_model_is_asked_once_for_a_unit_in_any_case_and_before_any_marks():
    from tokenizers import Tokenizer

    reference, encoder = Tokenizer.from_file(tokenizer_file()), packing.WordEncoder(tokenizer_file())
    encoder.tokenizer = counted = CountedTokenizer(reference)
    texts = ["Kalo kalo KALO, kalo!!", "kalo### Été été. ÉTÉ!! lomi###", "it's x7 lomi, KaLo"]
    want = [np.array(reference.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert [encoder([t.encode()])[0] for t in texts] == want
    assert len(counted.units) == len(set(counted.units)) == 3 + 4  # kalo, été, lomi; four kinds of marks
    assert sorted(counted.whole) == ["it's", "x7"]


def test_ids_of_odd_words_are_the_tokenizers():
    import string

    from tokenizers import Tokenizer

    reference, encoder = Tokenizer.from_file(tokenizer_file()), packing.WordEncoder(tokenizer_file())
    letters = string.ascii_letters + "".join(map(chr, range(0xAA, 0x180)))
    texts = [f"{a}{b} x{a}y{b}.{b}" for b in string.punctuation + "\u0301\u00a0" for a in letters]
    texts += [f"a{a} s{a}'s '{a}" for a in string.punctuation]
    texts += [f"{c}ka{c}{c}lo{c}" for c in map(chr, [*range(33), 0x7F, 0x85, 0xA0, 0x2028, 0x3000])]
    texts += [None, "", " ", "<|endoftext|>", "ka<|startoftext|>!", "ka <|x|>", "ka</w>", "don'T. I'LL!", "ß ẞ. İ! ſ's"]
    want = [np.array(reference.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    raw = [None if t is None else t.encode() for t in texts]
    assert encoder(raw) == want
    assert [encoder([t])[0] for t in reversed(raw)] == want[::-1] and encoder([]) == []


# Mixing


def test_mix_meets_targets(docs, texts):
    rows = mixing.taken_by_document(docs).collect()
    again = mixing.taken_by_document(docs).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again)) and len(rows) == len(texts)
    sources = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    size = collections.Counter()
    for r in rows:
        assert r["size"] == len(split(texts[r.id])) and r.taken <= 2 * r["size"]
        size[sources[r.id]] += r["size"]
    names = sorted([s for s in size if s is not None]) + [None] * (None in size)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(size.values())
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * size[s]}
        if not full:
            break
        for s in full:
            target[s] = 2.0 * size[s]
            left -= target[s]
        open_ -= full
    target |= {s: level * weight[s] for s in open_}
    taken = collections.Counter()
    for r in rows:
        taken[sources[r.id]] += r.taken
        assert math.isclose(r.target, target[sources[r.id]], rel_tol=1e-9) and r.source_size == size[sources[r.id]]
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    got = collections.Counter()
    for r in mixed.collect():
        got[r.doc_id] += len(split(r.text))
    assert got == collections.Counter({r.id: r.taken for r in rows if r.taken})


def test_split_keeps_margins():
    rng = np.random.default_rng(0)
    quotas = np.array([0, 7, 100, 3])
    shards = np.array([28, 28, 27, 27])
    table = mixing.split_quotas(quotas, shards, rng)
    assert (table.sum(axis=1) == quotas).all() and (table.sum(axis=0) == shards).all() and (table >= 0).all()


def test_takes_fill_shards_evenly(docs):
    takes = mixing.mix_plan(docs, shards=4).selectExpr("explode(takes) t").select("t.shard").groupBy("shard").count().collect()
    counts = [r["count"] for r in takes]
    assert len(counts) == 4 and max(counts) - min(counts) <= 1 and None not in [r.shard for r in takes]


def test_draws_beyond_what_numpy_takes(monkeypatch):
    monkeypatch.setattr(mixing, "MOST_DRAWN", 50)
    rng = np.random.default_rng(1)
    quotas, shards = np.array([0, 7, 1000, 3, 333]), np.array([500, 500, 343])
    table = mixing.split_quotas(quotas, shards, rng)
    assert (table.sum(axis=1) == quotas).all() and (table.sum(axis=0) == shards).all() and (table >= 0).all()


def test_draw_of_billions():
    drawn = mixing.draw(np.array([3 * 10**9, 10**9, 5]), 2 * 10**9, np.random.default_rng(1))
    assert drawn.sum() == 2 * 10**9 and abs(drawn[0] - 1.5 * 10**9) < 10**6


def test_mixed_shards_hold_what_was_taken(spark, docs, tmp_path):
    rows = {r.id: r.taken for r in mixing.taken_by_document(docs).collect() if r.taken}
    mixing.write_shards(docs, f"{tmp_path}/mix", shards=4)
    written = spark.read.parquet(f"{tmp_path}/mix").collect()
    words = collections.Counter()
    for r in written:
        words[r.id] += len(split(r.text))
    assert dict(words) == rows
    blocks = collections.Counter(r["shard"] for r in written)
    assert len(blocks) == 4 and max(blocks.values()) - min(blocks.values()) <= 1
    places = mixing.mix_plan(docs, shards=4).selectExpr("id", "block", "explode(takes) t").selectExpr("id", "block", "t.*").collect()
    assert collections.Counter((r.id, r.block, r.shard) for r in places) == collections.Counter((r.id, r.block, r.shard) for r in written)


def test_mix_keeps_columns_with_its_own_names(docs):
    names = ["_row", "_words", "_text", "_passes", "_size", "row", "took", "words", "texts", "repeats", "runs", "takes"]
    named = docs.select("doc_id", "text", "source", *(F.concat(F.lit(f"{name}-"), "doc_id").alias(name) for name in names))
    plain = collections.Counter((r.doc_id, r.text) for r in mixing.mixed_documents(docs).collect())
    rows = mixing.mixed_documents(named).collect()
    assert collections.Counter((r.doc_id, r.text) for r in rows) == plain
    assert all(r[name] == f"{name}-{r.doc_id}" for r in rows for name in names)


# Language model


def test_lm_scores(docs, texts, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 50)  # some words are joined, not broadcast
    made, of = [], lm.Smoothing.of
    monkeypatch.setattr(lm.Smoothing, "of", lambda *args: made.append(of(*args)) or made[-1])
    rows = lm.score_documents(docs, F.col("doc_id") % 5 != 0).collect()
    tokens = {i: [*split(t), None] for i, t in enumerate(texts)}
    learnt = [i for i in tokens if i % 5]
    count = collections.Counter(w for i in learnt for w in tokens[i])
    pairs = collections.Counter(p for i in learnt for p in zip([None, *tokens[i]], tokens[i]))
    n, v = sum(count.values()), len(count)
    assert len(rows) == len(texts)
    for r in rows:
        own = tokens[r.id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(count[w] > 0 for w in own), n)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
        levels = sum(math.log10(level_probability(count[h], pairs[h, w], count[w], count.values(), made[0])) for h, w in zip([None, *own], own))
        assert abs(r.score - levels) <= 0.03 * len(own)  # but for what is found by mistake


def level_counts(n):
    """All counts with the level of n."""
    same = [c for c in range(n, 3 * n + 3) if lm.levels(np.array([c]))[0] == lm.levels(np.array([n]))[0]]
    return [c for c in range(1, n) if lm.levels(np.array([c]))[0] == lm.levels(np.array([n]))[0]] + same


_LEAST_GREATEST = {}


def level_probability(history, pair, word, counts, smoothing):
    def ends(n):
        if n not in _LEAST_GREATEST:
            own = level_counts(n)
            _LEAST_GREATEST[n] = own[0], own[-1], 1 if n == 1 else lm.LEVEL_BASE ** (int(lm.levels(np.array([n]))[0]) - 0.5)
        return _LEAST_GREATEST[n]

    total = sum(ends(n)[2] for n in counts) + len(counts) + 1
    assert math.isclose(total, smoothing.norm)
    follows = ends(pair)[0] / max(1, ends(history)[1] * (1 + smoothing.rate) + smoothing.mistaken) if pair and history else 0
    return (1 - lm.BACK) * follows + lm.BACK * ((ends(word)[2] if word else 0) + 1) / total


def test_probabilities_sum_to_at_most_one():
    # Over the whole vocabulary and one unknown word, after several hundred histories, through a real filter.
    rng = np.random.default_rng(8)
    tokens = np.minimum(rng.zipf(1.3, 60_000), 3000)
    words, counts = np.unique(tokens, return_counts=True)
    pairs, pair_counts = np.unique(tokens[:-1] * 10_000 + tokens[1:], return_counts=True)
    history_counts = dict(zip(*np.unique(tokens[:-1], return_counts=True)))
    key = lambda values, side: lm.mix(np.asarray(values, np.uint64) * np.uint64(2) + np.uint64(side))
    keys, n = np.concatenate([key(words, 0), key(pairs, 1)]), np.concatenate([counts, pair_counts])
    made = lm.make_filter(keys, n)
    model = lm.CountFilter([len(made)], made)
    at = lambda k: model.level_in(np.zeros(len(k), np.int64), k)
    filled = np.unpackbits(np.frombuffer(made, np.uint8)).mean()
    smoothing = lm.Smoothing.of(lm.level_value(lm.levels(counts)).sum(), len(words), filled**lm.PROBES)
    word = at(key(np.append(words, 9999), 0))
    sums, hits = [], []
    for h in rng.choice(list(history_counts), 400, replace=False):
        history = np.full(len(word), at(key([h], 0))[0])
        pair = at(key(h * 10_000 + np.append(words, 9999), 1))
        sums.append(smoothing.probabilities(history, pair, word).sum())
        hits.append((pair > 0).sum() - len(set(tokens[1:][tokens[:-1] == h])))
    assert max(sums) <= 1.0 and min(sums) > lm.BACK
    assert 0 < max(hits) <= smoothing.mistaken  # pairs found by mistake are as many as was reckoned with


def test_lm_scores_do_not_depend_on_where_the_filter_is(docs, texts, monkeypatch):
    learnt = F.col("doc_id") % 5 != 0
    shared = {r.id: r for r in lm.score_documents(docs, learnt).collect()}
    monkeypatch.setattr(lm, "MOST_FILTER_MB", 0)
    monkeypatch.setattr(lm, "BUCKET_BYTES", 20_000, raising=False)
    monkeypatch.setattr(lm, "PROBED_BYTES", 1_000, raising=False)
    joined = {r.id: r for r in lm.score_documents(docs, learnt).collect()}
    assert set(joined) == set(shared) and len(joined) == len(texts)
    for i, r in joined.items():
        assert r[:5] == shared[i][:5] and math.isclose(r.base_score, shared[i].base_score, rel_tol=1e-9)
        assert math.isclose(r.score, shared[i].score, rel_tol=1e-9)


def test_filter_never_forgets():
    keys = lm.mix(np.arange(1, 5001, dtype=np.uint64))
    counts = np.arange(1, 5001) % 40 + 1
    order = np.argsort(keys)
    cuts = np.searchsorted(keys[order] >> np.uint64(62), np.arange(5, dtype=np.uint64))
    segments = [lm.make_filter(keys[order][a:b], counts[order][a:b], 1 << 20) for a, b in zip(cuts, cuts[1:])]
    made = lm.CountFilter([len(s) for s in segments], b"".join(segments))
    levels = made.level(keys)
    assert (levels >= lm.levels(counts)).all() and (levels > lm.levels(counts)).mean() < 0.1
    assert (made.level(lm.mix(np.arange(10_000, 20_000, dtype=np.uint64))) > 0).mean() < 0.1


# Toxicity


def test_marginals_match_enumeration():
    rng = np.random.default_rng(1)
    transition, first = rng.normal(size=(2, 2)), np.array([0, 3, 3, 4, 9])
    odds = rng.normal(size=9)
    got, _, log_z = toxicity.marginals(odds, first, transition)
    for d, (a, b) in enumerate(zip(first, first[1:])):
        total, marginal = 0.0, np.zeros(b - a)
        for tags in itertools.product((0, 1), repeat=int(b - a)):
            weight = math.exp(sum(o * t for o, t in zip(odds[a:b], tags)) + sum(transition[s, t] for s, t in zip((0, *tags), tags)))
            total, marginal = total + weight, marginal + weight * np.array(tags)
        assert np.allclose(marginal / total, got[a:b])
        assert b == a or math.isclose(math.log(total), log_z[d])


def test_toxicity_on_held_out(spark, table):
    rng = random.Random(2)
    plain = [f"w{k}" for k in range(300)]
    texts = [" ".join(rng.choice(plain) for _ in range(rng.randint(20, 200))) for _ in range(400)]
    bad = ["vilest", "grubword", "nastyfoo"]
    toxic = [k % 8 == 0 for k in range(400)]
    for k in range(400):
        if toxic[k]:
            own = texts[k].split()
            for _ in range(4):
                own.insert(rng.randrange(len(own)), rng.choice(bad))
            texts[k] = " ".join(own)
    docs = table([*texts, None, ""])
    labels = spark.createDataFrame([(k, int(t)) for k, t in enumerate(toxic)] + [(0, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, F.col("doc_id") % 3 != 1)
    rows = toxicity.score_documents(docs.select("doc_id", "text"), model).collect()
    assert len(rows) == 402
    held = [r for r in rows if r.doc_id < 400 and r.doc_id % 3 == 1]
    assert all((r.toxic_score >= 0.7) == toxic[r.doc_id] for r in held)
    for r in held:
        found = {r.text.encode()[s.begin : s.end].decode() for s in r.toxic_spans}
        assert not toxic[r.doc_id] or {w for s in found for w in s.split()} & set(bad)
    assert all(0 <= r.toxic_score < 0.5 and not r.toxic_spans for r in rows if r.doc_id >= 400)


def test_toxicity_without_labels(spark, docs, texts):
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))
    scores = [r.toxic_score for r in toxicity.score_documents(docs.select("text"), model).collect()]
    assert len(scores) == len(texts) and max(scores) < 1e-6


# Hilbert shards


@pytest.mark.parametrize("n,bits", [(2, 3), (3, 2), (4, 2)])
def test_curve_visits_neighbours(n, bits):
    table, cells = hilbert.curve_table(n), {}
    for cell in itertools.product(range(1 << bits), repeat=n):
        state, place = 0, 0
        for plane in range(bits - 1, -1, -1):
            found = table[state * (1 << n) + sum((c >> plane & 1) << k for k, c in enumerate(cell))]
            state, place = found >> n, place * (1 << n) + (found & ((1 << n) - 1))
        cells[place] = cell
    assert sorted(cells) == list(range(1 << n * bits))
    assert all(sum(abs(a - b) for a, b in zip(cells[k], cells[k + 1])) == 1 for k in range(len(cells) - 1))


def test_shards_are_even_and_gapless(docs, texts):
    rows = hilbert.shards(docs, 7).collect()
    by_shard = collections.defaultdict(list)
    for r in rows:
        by_shard[r.shard].append(r)
        raw = (texts[r.id] or "").encode()
        assert (r["size"], r.crc) == (len(raw) + 16, zlib.crc32(raw))
    counts = [len(v) for v in by_shard.values()]
    assert len(rows) == len(texts) and set(by_shard) == set(range(7)) and max(counts) - min(counts) <= 1
    ordered = [sorted(by_shard[s], key=lambda r: r.slot) for s in range(7)]
    assert all([r.slot for r in rows] == list(range(len(rows))) for rows in ordered)
    curve = [r.curve for rows in ordered for r in rows]
    assert curve == sorted(curve)


def test_written_shards_keep_order_and_columns(spark, docs, texts, tmp_path):
    named = docs.drop("shard").withColumn("_row", F.lit("mine")).withColumn("slot", F.lit("mine"))
    hilbert.write_shards(named, f"{tmp_path}/shards", 5)
    placed = {r.id: r for r in hilbert.shards(named, 5).collect()}
    written = spark.read.parquet(f"{tmp_path}/shards")
    assert set(written.columns) == {*named.columns, "shard"}
    rows = written.collect()
    assert sorted(r.doc_id for r in rows) == sorted(placed) and all(r["_row"] == r.slot == "mine" for r in rows)
    assert all(r["shard"] == placed[r.doc_id].shard for r in rows)
    with pytest.raises(ValueError):
        hilbert.write_shards(docs, f"{tmp_path}/other", 5)


def test_sources_with_a_common_beginning_are_told_apart(spark, tmp_path):
    rows = [(k, "text", "en", f"https://common.crawl/{k % 16:02}", 4) for k in range(1600)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    metadata = docs.select(F.col("doc_id").alias("row"), "source", "doc_id")
    levels = hilbert.quantised(metadata, ["source", "doc_id"]).groupBy("source").agg(
        F.min("level_source").alias("low"), F.max("level_source").alias("high")
    ).orderBy("source").collect()
    assert all(r.low == r.high for r in levels)
    assert [r.low for r in levels] == sorted(r.low for r in levels) and len({r.low for r in levels}) >= 14
    # Files of a shard hold few sources each.
    by_shard = collections.defaultdict(set)
    for r in hilbert.shards(docs, 40).join(docs.select(F.col("doc_id").alias("id"), "source"), "id").collect():
        by_shard[r.shard].add(r.source)
    assert max(map(len, by_shard.values())) <= 8


def test_levels_of_texts_are_percentiles_of_all_rows(spark):
    name = F.format_string("s%06d", F.col("id"))
    rows = spark.range(20_000).select(
        F.col("id").alias("row"), name.alias("source"), F.when(F.col("id") >= 10_000, name).otherwise("a").alias("lang"),
        F.when(F.col("id") % 2 == 0, F.lit("\U0001f600")).when(F.col("id") % 4 == 1, F.lit("\uffff")).alias("odd"),
        F.lit(None).cast("string").alias("none"),
    )
    for r in hilbert.quantised(rows, ["source", "lang", "odd", "none"]).collect():
        level = max(0, (r.row - 1) // 1250)
        assert r.level_source == level and r.level_lang == (level if r.row >= 10_000 else 0)
        # Two thirds are U+1F600, which comes last in bytes; a null has the lowest level.
        assert r.level_odd == (5 if r.odd == "\U0001f600" else 0) and r.level_none == 0


# N-gram join


def similar(texts):
    sets = []
    for t in texts:
        w = split(t)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = collections.defaultdict(set)
    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            up[y] = x
            if sets[a] != sets[b]:
                links[a].add(frozenset(sets[b]))
                links[b].add(frozenset(sets[a]))
    return [(len(sets[i]), root(i), len(links[i])) for i in range(len(texts))]


@pytest.mark.parametrize("block,paired", [(512, 32), (3, 2)], ids=["whole", "in blocks"])
def test_ngram_join(docs, texts, monkeypatch, block, paired):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "PAIRED", paired)
    monkeypatch.setattr(jaccard, "COMMON", 2)
    rows = jaccard.similar_documents(docs).collect()
    assert {r.id: (r.n_shingles, r.component_id, r.n_links) for r in rows} == dict(enumerate(similar(texts)))
    left = jaccard.first_of_each(docs)
    assert sorted(r.doc_id for r in left.collect()) == sorted({root if n else i for i, (n, root, _) in enumerate(similar(texts))})
    assert left.columns == docs.columns


def test_first_of_each_goes_by_texts_not_ids(table):
    group = lambda name: [" ".join([*(f"{name}{k}" for k in range(40)), end]) for end in ("x", "y", "z")]
    a, b, c, d = map(group, "abcd")
    texts = [*a, *b, *c, d[0], "", None, "", "alone"]
    ids = [1, 5, 6, 1, 7, None, None, None, None, 1, 1, 1, None, None]
    left = jaccard.first_of_each(table(texts, ids)).collect()
    kept = [(r.doc_id, r.text) for r in left if (r.text or "")[:1] not in ("", "c")]
    assert sorted(kept, key=lambda k: k[1]) == [(1, a[0]), (None, "alone"), (1, b[0]), (1, d[0])]
    assert [r.text in c for r in left].count(True) == 1
    assert sorted(repr((r.doc_id, r.text)) for r in left if not r.text) == ["(1, '')", "(1, None)", "(None, '')"]


def test_ngrams_of_a_slice_of_few_words(table):
    for n in range(1, 5):
        text = " ".join("abcd"[:n])
        for size in range(1, 7):
            alone = list(jaccard.sets_of(pa.array([text]), size))
            beside = list(jaccard.sets_of(pa.array([text, "x y z x y z x"]), size))
            assert len(alone[0]) == max(1, n - size + 1) and alone[0].tolist() == beside[0].tolist()
    long = " ".join(f"w{k % 1000}" for k in range(500_000))  # more than a slice, so the text before it stands alone
    rows = jaccard.similar_documents(table(["a b", long]).coalesce(1)).collect()
    assert sorted((r.id, r.n_shingles, r.component_id, r.n_links) for r in rows) == [(0, 1, 0, 0), (1, 1000, 1, 0)]


def test_trie_finds_what_comparison_finds():
    rng = random.Random(4)
    sets = []
    for _ in range(60):
        base = rng.sample(range(1000), rng.randint(1, 120))
        sets += [np.array(sorted(set(base)), np.uint64), np.array(sorted({*base[rng.randint(0, 5) :], rng.randrange(1000)}), np.uint64)]
    trie = jaccard.Trie(sets)
    for asked in sets:
        want = {k for k, s in enumerate(sets) if 100 * len(set(s) & set(asked)) >= 75 * len(set(s) | set(asked))}
        assert set(trie.look_up(asked, 75).tolist()) == want


def test_components(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, k) for k in range(200, 230)] + [(7, 7), (300, 301)]
    rows = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    roots = {r.v: r.root for r in rows}
    assert len({roots[k] for k in range(51)}) == 1 and len(set(roots.values())) == 3


# Fingerprints


def weighted(a, b):
    a, b = (collections.Counter(t.split() or [""]) for t in (a, b))
    return sum(min(a[k], b[k]) for k in a) / sum(max(a[k], b[k]) for k in {*a, *b})


def test_fingerprints(docs, texts):
    rows = {r.id: r for r in sampling.fingerprint_documents(docs).withColumns({
        "near_edited": sampling.agreement(F.col("samples"), F.col("edited_samples")),
        "near_next": sampling.agreement(F.col("samples"), F.col("next_samples")),
    }).collect()}
    assert len(rows) == len(texts)
    off = []
    for i, t in enumerate(texts):
        text, after = t or "", texts[i - 1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert rows[i].n_chars == len(text)
        assert rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert rows[i].next_samples == rows[i - 1 if i else len(texts) - 1].samples
        off.append(rows[i].near_edited - weighted(text, edited))
        off.append(rows[i].near_next - weighted(text, after))
    # Of every pair, not of their mean: what 64 independent samples would give, or less.
    assert abs(np.mean(off)) < 0.05 and np.sqrt(np.mean(np.square(off))) < 0.12 and np.abs(off).max() < 0.4
    for a, b in itertools.combinations(range(len(texts)), 2):
        if texts[a] == texts[b]:
            assert rows[a].samples == rows[b].samples


# URLs


def test_urls(spark):
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es", "block"), ("", "/x/y", "block")]
    found = [
        None, "", "no scheme", "http://", "HTTP://A.COM", "http://a.com/", "http://EXAMPLE.com/en/1?q=/en/", "http://m.www.example.com/en/",
        "http://a.net/espresso", "http://net/e", "http://q.org/x/yes", "http://q.org/x", "x://y://z.net/es", "http://a.com?/en/", "http://notexample.com/en/",
    ]
    pages = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(found)], "page_id long, url string, rule string")
    judged = urls.filter_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for r in judged:
        host = path = ""
        if "://" in (r.url or ""):
            rest = r.url.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
            host, path = rest[:cut].translate(low), rest[cut:].split("?")[0].split("#")[0]
        fits = [x for x in rules if (not x[0] or host == x[0] or host.endswith("." + x[0])) and path.startswith(x[1])]
        best = max(fits, key=lambda x: len(x[0] + x[1]), default=None)
        assert (r.url_host, r.url_path) == (host, path)
        assert (r.url_rule, r.url_verdict) == ((best[0] + best[1], best[2]) if best else (None, "allow"))


# Licenses


LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def license_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def rising(pairs):
    """Length of a longest chain of (pos, at) that rises in both."""
    best = {}
    for pos, at in sorted(pairs, key=lambda p: (p[0], -p[1])):
        best[at] = max(best.get(at, 0), 1 + max((n for other, n in best.items() if other < at), default=0))
    return max(best.values(), default=0)


def license_coverage(own, template, k):
    """The best coverage of a template near any one diagonal."""
    runs = [template[j : j + k] for j in range(len(template) - k + 1)]
    met = [(i, j) for i in range(len(own) - k + 1) for j, run in enumerate(runs) if own[i : i + k] == run]
    near = ([m for m in met if abs(m[0] - m[1] - d) <= licenses.NEAR] for d in {i - j for i, j in met})
    return max((rising(pairs) / len(runs) for pairs in near), default=0.0)


PARAGRAPH = license_words(next(iter(licenses.PARAGRAPHS)))
LICENSED = [
    "cc by " * 5, "public license " * 6, "general public license " * 3, "the mit license " * 3, "the mit license under released",
    " ".join(PARAGRAPH), " ".join(PARAGRAPH[:30] + ["well", "then"] + PARAGRAPH[30:]), " ".join(PARAGRAPH[55:] + PARAGRAPH[8:55]),
    " ".join(PARAGRAPH[8:60]), " ".join(PARAGRAPH[:40] + PARAGRAPH[43:]), " ".join(PARAGRAPH * 2), "Licensed under the Apache-License, Version 2.0",
    "licensed under the very apache license version 2 0", "all rights reserved " * 40, "released under the \u212a mit license", "cc \u00c9 by",
]


def test_licenses(table, texts):
    own_texts = texts + LICENSED
    spans, per_row = licenses.scan_licenses(table(own_texts))
    rows = per_row.collect()
    assert len(rows) == len(own_texts)
    kinds = [(licenses.SENTENCES, 2), (licenses.PARAGRAPHS, licenses.PARAGRAPH_WORDS)]
    for r in rows:
        own = license_words(own_texts[r.id])
        places = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(own)) if own[i : i + len(phrase.split())] == phrase.split()]
        starts = [i for i, _ in places]
        assert (r.n_words, r.n_base) == (len(own), len(places))
        assert (r.first_word, r.last_word) == ((min(starts), max(starts)) if starts else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
        found = [(1.0, label) for _, label in places]
        found += [(license_coverage(own, license_words(t), k), label) for listed, k in kinds for t, label in listed.items()]
        found = [(c, label) for c, label in found if c >= licenses.COVERED]
        assert r.labels == ",".join(sorted({label for _, label in found}))
        assert r.score == pytest.approx(max((c for c, _ in found), default=0.0))
    by_id = {r.id - len(texts): r.labels for r in rows}
    assert [by_id[k] for k in range(5)] == ["cc-by", "", "gpl", "", ""]
    assert by_id[5] == by_id[6] == by_id[9] == "mit" and by_id[7] == by_id[8] == ""
    for r in spans.filter("label = 'mit'").collect():
        assert r.end > r.start >= 0 and r.coverage >= licenses.COVERED


# Empty tables


def test_empty_tables(spark, empty):
    assert exact.exact_duplicates(empty).count() == 0
    assert packing.pack_documents(empty, tokenizer_file()).count() == 0
    assert mixing.taken_by_document(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    assert lm.score_documents(empty, F.lit(True)).count() == 0
    assert hilbert.shards(empty).count() == 0
    assert jaccard.similar_documents(empty).count() == 0 and jaccard.first_of_each(empty).count() == 0
    assert sampling.fingerprint_documents(empty).count() == 0
    assert licenses.scan_licenses(empty)[1].count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score_documents(empty.select("text"), toxicity.train(empty, labels, F.lit(True))).count() == 0
    assert urls.filter_urls(spark.createDataFrame([], "url string"), spark.createDataFrame([], "host string, path string, verdict string")).count() == 0


def test_known_levels_of_the_filter_are_not_asked_for(monkeypatch):
    from footfall.llm import lm

    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(1, 1 << 63, 4000).astype(np.uint64))
    counts = np.concatenate([rng.integers(1, 4, len(keys) - 500), rng.integers(1000, 900_000, 500)])
    model = lm.CountFilter([0, 1 << 15], lm.make_filter(keys, counts, 1 << 15).ljust(1 << 15, b"\0"))
    asked = np.concatenate([keys, rng.integers(1, 1 << 63, 4000).astype(np.uint64)])
    segment = np.ones(len(asked), np.int64)
    hashed, halves = [], lm._halves
    monkeypatch.setattr(lm, "_halves", lambda k, level: hashed.append(len(k)) or halves(k, level))
    plain = model.level_in(segment, asked)
    before = sum(hashed)
    sure = lm.least_levels(np.concatenate([counts, np.zeros(4000, np.int64)]))
    assert (model.level_in(segment, asked, sure) == plain).all() and (plain >= sure).all()
    assert sum(hashed) - before < before / 1.5
    # What a task remembers is what it was told, for those keys that kept their places.
    remembered = lm.Remembered(256)
    assert not remembered.least(asked).any()
    remembered.keep(asked, plain)
    found = remembered.least(asked)
    assert ((found == 0) | (found == plain)).all() and np.count_nonzero(found) > 100
    assert (model.level_in(segment, asked, found) == plain).all()


def test_scores_do_not_depend_on_what_is_known_beforehand(spark, monkeypatch):
    from footfall.llm import lm

    rng = random.Random(8)
    vocabulary = [f"w{n}" for n in range(60)]
    rows = [(n if n % 9 else None, " ".join(rng.choices(vocabulary, range(1, 61), k=rng.randint(0, 80)))) for n in range(300)] + [(400, None), (1, "w1 w2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    training = F.col("doc_id") % 4 != 1
    score = lambda: sorted((r.id or -1, r.n_tokens, r.n_known, round(r.score, 6)) for r in lm.score_documents(docs, training).collect())
    found = score()
    monkeypatch.setattr(lm, "MOST_FILTER_MB", 0)  # the other way asks for all levels
    assert found == score()
