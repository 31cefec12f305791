"""The registered queries' own columns, and the pipeline stage by stage against brute force."""

import collections
import hashlib
import math
import zlib

import corpus_pipeline
import pytest
from footfall.llm import queries
from pyspark.sql import functions as F
from test_operators import normal, similar, split


def rest(i, by):
    return zlib.crc32(str(i).encode()) % by if i is not None else None


def test_exact_dedup_query(spark, folder, texts):
    groups = collections.defaultdict(list)
    for i, text in enumerate(texts):
        groups[normal(text)].append(i)
    for r in queries.op1_exact_dedup(spark, folder).collect():
        own = normal(texts[r.doc_id])
        assert (r.keep_id, r.group_size, r.kept) == (groups[own][0], len(groups[own]), r.doc_id == groups[own][0])
        assert r.text_sha256 == hashlib.sha256(own.encode()).hexdigest()


def test_packing_query(spark, folder, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_file())
    rows = collections.defaultdict(list)
    sequences = collections.defaultdict(list)
    for r in queries.op2_best_fit_packing(spark, folder).collect():
        rows[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(rows) == set(range(len(texts)))
    for i, text in enumerate(texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for r in sorted(rows[i], key=lambda r: r.piece):
            own = ids[r.start : r.start + r.length]
            assert r.start == 2048 * r.piece and len(own) == r.length
            assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in own))
        assert sum(r.length for r in rows[i]) == len(ids)
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for own in rows.values() for r in own)
    assert len(sequences) <= 1 + math.ceil(11 / 9 * total / 2048)


def test_mixing_query(spark, folder, texts):
    rows = queries.op3_source_mixing(spark, folder).collect()
    assert len(rows) == len(texts) and all(r["size"] == len(split(texts[r.doc_id])) and 0 <= r.taken <= 2 * r["size"] for r in rows)
    assert {"doc_id", "size", "source_size", "target", "taken"} <= set(rows[0].asDict())


def test_scoring_query(spark, folder, texts):
    rows = {r.doc_id: r for r in queries.op4_lm_scoring(spark, folder).collect()}
    assert set(rows) == set(range(len(texts)))
    learnt = sum(len(split(t)) + 1 for i, t in enumerate(texts) if rest(i, 7) != 2)
    for i, r in rows.items():
        assert (r.held_out, r.n_tokens, r.train_tokens) == (rest(i, 7) == 2, len(split(texts[i])) + 1, learnt)
        assert r.score < 0 and r.base_score < 0


def test_toxicity_query(spark, folder, texts):
    rows = queries.op5_toxicity_crf(spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.held_out == (rest(r.doc_id, 3) == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


def test_sharding_query(spark, folder, texts):
    rows = queries.op6_hilbert_sharding(spark, folder).collect()
    assert len(rows) == len(texts) and {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}
    shards = collections.defaultdict(list)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
        shards[r.shard].append(r.slot)
    counts = [len(shards[k]) for k in range(40)]
    assert max(counts) - min(counts) <= 1 and set(shards) <= set(range(40))
    assert all(sorted(slots) == list(range(len(slots))) for slots in shards.values())


def test_ngram_join_query(spark, folder, texts):
    expected = similar(texts)
    for r in queries.op7_ngram_jaccard_join(spark, folder).collect():
        assert (r.n_shingles, r.component_id, r.n_links) == expected[r.doc_id]


def test_fingerprint_query(spark, folder, texts):
    rows = {r.doc_id: r for r in queries.op8_consistent_weighted_sampling(spark, folder).collect()}
    by_text = collections.defaultdict(set)
    for i, r in rows.items():
        by_text[texts[i] or ""].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and isinstance(r.edited_fingerprint, str)
        if (texts[i] or "") == (texts[i - 1] or ""):
            assert r.near_next == 1
    assert all(len(own) == 1 for own in by_text.values())


def test_url_query_and_licenses_have_their_columns(spark, folder):
    found = queries.op10_license_diagonals(spark, folder).columns
    assert found == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


# The pipeline


@pytest.fixture(scope="module")
def stages(spark, docs, tmp_path_factory):
    """What each stage got and gave, with no document toxic."""
    folder = str(tmp_path_factory.mktemp("stages"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    seen, now = {}, docs
    for name, function in corpus_pipeline.STAGES:
        out = function(spark, now, folder)
        if name != "best_fit_packing":
            assert out.columns == docs.columns and all(r["row"] == "clash" for r in out.select("row").collect())
        out.write.parquet(f"{folder}/{name}")
        given, now = now, spark.read.parquet(f"{folder}/{name}")
        seen[name] = given, now
    return seen


def ids_and_texts(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def key(pair):
    return pair[0], pair[1] or ""


def test_nothing_is_toxic_without_labels(stages):
    before, after = map(ids_and_texts, [df.fillna({"text": ""}) for df in stages["toxicity"]])
    assert before == after


def test_one_document_of_each_text_stays(stages):
    before, after = ([(r.doc_id, r.text) for r in df.collect()] for df in stages["exact_dedup"])
    first = {}
    for i, text in sorted(before, key=key):
        first.setdefault(normal(text), i)
    assert sorted(i for i, _ in after) == sorted(first.values())
    assert dict(after) == {i: t for i, t in before if i in set(first.values())}


def test_one_document_of_each_near_group_stays(stages):
    before, after = ([(r.doc_id, r.text) for r in df.collect()] for df in stages["ngram_jaccard_join"])
    before.sort(key=key)
    found = similar([text for _, text in before])
    roots = {root for n, root, _ in found if n}
    stay = {before[k][0] for k, (n, root, _) in enumerate(found) if not n or k == root}
    assert {i for i, _ in after} == stay and len(after) == len(stay) and len(roots) < len(before)


def test_mixed_rows_are_cut_from_their_documents(stages):
    given, mixed = stages["source_mixing"]
    whole = {r.doc_id: (r.text, r.source) for r in given.collect()}
    size, taken = collections.Counter(), collections.Counter()
    for i, (text, source) in whole.items():
        size[source] += len(split(text))
    for r in mixed.collect():
        text, source = whole[r.doc_id]
        own = split(r.text)
        assert r.source == source and 0 < len(own) <= len(split(text)) and set(own) <= set(split(text)) and r.n_chars == len(r.text)
        taken[source] += len(own)
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) <= len(size)
    assert all(taken[s] <= 2 * size[s] for s in size)


def test_packed_sequences_hold_all_mixed_tokens(stages):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_file())
    mixed, packed = stages["best_fit_packing"]
    tokens = sum(len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in mixed.collect())
    rows = packed.collect()
    assert sum(r.length for r in rows) == tokens
    ends = collections.defaultdict(list)
    for r in rows:
        ends[r.sequence_id].append((r.offset, r.offset + r.length))
    for own in ends.values():
        own.sort()
        assert own[0][0] == 0 and own[-1][1] <= 2048 and all(a[1] == b[0] for a, b in zip(own, own[1:]))


def test_run_drops_toxic_documents(spark, tmp_path):
    bad = ["vilest", "grubword", "nastyfoo"]
    plain = [f"w{k}" for k in range(200)]
    texts = [" ".join(plain[(7 * k + 3 * j) % 200] for j in range(40 + k % 9)) for k in range(240)]
    toxic = [k % 6 == 0 for k in range(240)]
    texts = [f"{t} {' '.join(bad)} {bad[0]} {t}" if own else t for t, own in zip(texts, toxic)]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(t)) for k, t in enumerate(toxic)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, queries.documents(spark, str(tmp_path)), str(tmp_path)).collect()}
    assert not {k for k in left if toxic[k]} and left == {k for k in range(240) if not toxic[k]}
    assert corpus_pipeline.run(spark, str(tmp_path)).where(F.col("doc_id") % 6 == 0).count() == 0
