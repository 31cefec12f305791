"""The registered queries of the operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from footfall.llm import (
    audit, exact, hilbert, jaccard, licenses, lm, mixing, packing, quality, runs, sampling, toxicity, urls,
)
from footfall.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The rules that the query judges by.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return build(configure(spark), folder)

    QUERIES[build.__name__] = run
    return run


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = exact.exact_duplicates(documents(spark, folder))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


ORACLE_SQL["op1_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""


@query
def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack_documents(documents(spark, folder), tokenizer_file())
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op3_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.taken_by_document(documents(spark, folder)).withColumnRenamed("id", "doc_id")


@query
def op4_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))
    scored = lm.score_documents(documents(spark, folder), ~held_out).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op9_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    judged = urls.filter_urls(pages, rules)
    return judged.select(
        "page_id", F.col("url_host").alias("host"), F.col("url_path").alias("path"),
        F.col("url_rule").alias("rule"), F.col("url_verdict").alias("verdict"),
    )


_RULES_SQL = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in URL_RULES)
ORACLE_SQL["op9_url_filters"] = rf"""
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {_RULES_SQL}),
p AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
),
best AS (
  SELECT page_id, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         max_by(rule_verdict, length(rule_host || rule_path)) AS verdict
  FROM p JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN best USING (page_id)
"""


@query
def op7_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    found = jaccard.similar_documents(documents(spark, folder))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "n_links")


@query
def op5_toxicity_crf(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"), ~held_out)
    scored = toxicity.score_documents(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", held_out.alias("held_out"), F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= 0.7).cast("int").alias("predicted"), F.col("toxic_spans").alias("spans"),
    )


@query
def op6_hilbert_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = hilbert.shards(documents(spark, folder))
    return placed.select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve",
    )


@query
def op8_consistent_weighted_sampling(spark: SparkSession, folder: str) -> DataFrame:
    made = sampling.fingerprint_documents(documents(spark, folder))
    return made.select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256",
        sampling.as_text(F.col("samples")).alias("fingerprint"), sampling.as_text(F.col("edited_samples")).alias("edited_fingerprint"),
        sampling.agreement(F.col("samples"), F.col("edited_samples")).alias("near_edited"),
        sampling.agreement(F.col("samples"), F.col("next_samples")).alias("near_next"),
    )


@query
def op10_license_diagonals(spark: SparkSession, folder: str) -> DataFrame:
    _, per_row = licenses.scan_licenses(documents(spark, folder))
    return per_row.drop("row").withColumnRenamed("id", "doc_id")


@query
def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit.filter_audit(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


ORACLE_SQL["op11_filter_audit"] = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels GROUP BY doc_id),
w AS (
  SELECT d.*, coalesce(good, false) AS good, coalesce(bad, false) AS bad,
    regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(d.doc_id) OVER (PARTITION BY t) AS first_id
  FROM d LEFT JOIN l USING (doc_id)
),
f AS (
  SELECT part, good, bad, concat(
    CASE WHEN len(ws) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' END,
    CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' END,
    CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END, CASE WHEN doc_id > first_id THEN 'E' END) AS failed
  FROM w
),
cell AS (SELECT part, failed, count(*) AS n, count_if(good) AS g, count_if(bad) AS b FROM f GROUP BY ALL),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
),
walk AS (
  SELECT o, step, substr(o, step, 1) AS x, substr(o, 1, step - 1) AS earlier FROM orders, (SELECT unnest(range(1, 6)) AS step)
),
counted AS (
  SELECT part, o AS filter_order, step, x,
    sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN failed = x THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN hit AND NOT gone THEN g ELSE 0 END) AS good_lost, sum(CASE WHEN hit AND NOT gone THEN b ELSE 0 END) AS toxic_lost
  FROM (SELECT *, contains(failed, x) AS hit, translate(earlier, failed, '') <> earlier AS gone FROM cell, walk)
  GROUP BY ALL
)
SELECT part, filter_order, cast(step AS INTEGER) AS step, cast(kept AS BIGINT) AS kept, cast(removed AS BIGINT) AS removed,
  cast(redundant AS BIGINT) AS redundant, cast(unique_fails AS BIGINT) AS unique_fails, cast(good_lost AS BIGINT) AS good_lost,
  cast(toxic_lost AS BIGINT) AS toxic_lost, cast(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM counted
"""


def with_repetitions(docs: DataFrame) -> DataFrame:
    """Every tenth document by checksum of its id with words from some place on repeated, as the contract of op12 has it."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = h % 10 == 0
    words = F.array_remove(F.split(F.coalesce(F.col("text"), F.lit("")), r"[\x20\x09-\x0D]+"), "")
    parts = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(chosen, words).alias("words"))
    n = F.size("words").cast("long")
    begin = F.col("g") % n
    period = 1 + F.floor((n - begin) / (3 + F.col("g") % 8))
    placed = parts.select("doc_id", "text", "words", F.when(n > 0, begin).alias("begin"), F.when(n > 0, period).alias("period"))
    repeated = F.transform("words", lambda word, i: F.when(i < F.col("begin"), word).otherwise(
        F.get("words", (F.col("begin") + (i - F.col("begin")) % F.col("period")).cast("int"))
    ))
    text = F.when(F.col("begin").isNotNull(), F.array_join(repeated, " ")).otherwise(F.col("text"))
    return placed.select("doc_id", text.alias("text"))


@query
def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = runs.find_runs(with_repetitions(documents(spark, folder)))
    best = found.withColumn("best", runs.greatest(F.col("runs")))
    return best.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(runs.as_lines(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def op13_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    judged = quality.judge(documents(spark, folder), counts=base)
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return judged.select(F.col("id").alias("doc_id"), *base, base_failed.alias("base_failed"), "kept")


ORACLE_SQL["op13_quality_rules"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
),
line AS (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d),
lines AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines
  FROM line WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r
),
win AS (SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS x FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM d)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM win) WHERE n > 1),
repeats AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM again, (SELECT unnest(range(5)) AS k) GROUP BY r),
counted AS (
  SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS n_letters
  FROM d LEFT JOIN lines USING (r) LEFT JOIN repeats USING (r)
),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 12 * n_words
    OR 100 * n_dup_lines > 30 * n_lines OR 2 * n_capitals > n_letters) AS kept
FROM judged
"""
