"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every document is cut into blocks of at most ``BLOCK_WORDS`` words. A source's target gives whole
passes over its blocks plus one part pass, which takes blocks in a pseudo-random order until the target
is met to the word (the last block is cut). That fixes the exact number of blocks each source owes. A
tree over the output shards then splits these quotas in two, again and again: the left half gets a
multivariate-hypergeometric draw from the vector of quotas, the right half the rest, until each shard
has its quota of each source. Shards take disjoint runs of the source's block order and shuffle
what they got locally. What the mix takes of a document is the sum of its blocks' takes, each of which has a shard.

All randomness follows from hashes of the seed, the id, the text and the block number, so reruns agree
and a lost task gives the same rows again. Sources are dealt into ``GROUPS`` groups: the tree first
splits the group totals (a vector of fixed length, on the driver), then each group splits its own sources
in a task, which is the same distribution by conditioning. Block orders are counted in ``BINS`` parts
of each source, so that no task ranks a whole source.

Defined cases: a null text has no words and is never taken; a null source is a source of its own, last in
the order; repeated rows count as often as they occur, and rows that agree in id and text are ordered by row number; a source without words
has the target 0; a very long text is as many blocks as it needs, dealt like any others; an empty table gives no rows; columns other than id,
text and source are not read and keep their values, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from footfall.llm.rows import addressed, free_name, row_number
from footfall.session import stage

BLOCK_WORDS = 128
GROUPS = 256
BINS = 256
SHARDS = 16
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
SPACES = r"[\x20\x09-\x0D]+"
#: numpy draws from fewer than 10**9 items.
MOST_DRAWN = 10**9 - 1


def words_of(text) -> F.Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def sources_with_targets(
    sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """``source, source_size, target`` from rows of ``source, size``.

    A source gets ``min(most * size, level * weight)`` with one level for all: handing the excess of
    capped sources to the others by weight ends there. The level follows from running sums over the
    sources in the order of ``most * size / weight``.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    ordered = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    position = (F.row_number().over(ordered) - 1) % len(weights)
    weighted = by_source.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (position + 1).cast("int")))
    capped = weighted.withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = Window.orderBy("ratio", "source").rowsBetween(Window.unboundedPreceding, -1)
    level = (
        (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    )
    # Up to the first source that its level doesn't fill, levels rise; from there on they fall.
    levels = capped.withColumn("level", level)
    chosen = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything)
    target = F.least("cap", F.coalesce(chosen * F.col("weight"), F.col("cap")))
    return levels.select("source", "source_size", target.alias("target"))


def draw(quotas: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """A multivariate-hypergeometric draw; of more items than numpy takes, one from each half of every quota."""
    total = int(quotas.sum())
    if total <= MOST_DRAWN:
        return rng.multivariate_hypergeometric(quotas, size, method="marginals")
    one = quotas // 2
    first = min(int(one.sum()), size * int(one.sum()) // total)
    return draw(one, first, rng) + draw(quotas - one, size - first, rng)


def split_quotas(quotas: np.ndarray, shards: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Quotas by source to a table by source and shard; rows sum to ``quotas``, columns to ``shards``."""
    if len(shards) == 1:
        return quotas[:, None]
    half = len(shards) // 2
    left = draw(quotas, int(shards[:half].sum()), rng)
    return np.hstack([split_quotas(left, shards[:half], rng), split_quotas(quotas - left, shards[half:], rng)])


def shard_quotas(owed: DataFrame, shards: int, seed: int) -> DataFrame:
    """``source, shard, first, quota`` from ``source, owed``; ``first`` counts the source's earlier shards."""
    grouped = owed.withColumn("part", F.pmod(F.xxhash64("source"), F.lit(GROUPS)).cast("int"))
    totals = np.zeros(GROUPS, np.int64)
    for row in grouped.groupBy("part").agg(F.sum("owed").alias("n")).collect():
        totals[row["part"]] = row["n"]
    each = np.full(shards, totals.sum() // shards) + (np.arange(shards) < totals.sum() % shards)
    by_group = split_quotas(totals, each, np.random.default_rng(seed))

    def split(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("source", na_position="last")
        part = key[0]
        table = split_quotas(rows["owed"].to_numpy(np.int64), by_group[part], np.random.default_rng([seed, part]))
        first = np.cumsum(table, axis=1) - table
        return pd.DataFrame({
            "source": np.repeat(rows["source"].to_numpy(object), shards),
            "shard": np.tile(np.arange(shards, dtype=np.int32), len(rows)),
            "first": first.ravel(), "quota": table.ravel(),
        })

    return grouped.groupBy("part").applyInPandas(split, "source string, shard int, first long, quota long")


def blocks_of(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str, block_words: int) -> DataFrame:
    """One row per block, with its place in the source's pseudo-random order (``bin``, then ``draw``)."""
    size = F.size(words_of(F.col(text_col))).cast("long")
    sized = addressed(docs).select(
        F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"), size.alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("key"), row_number().alias("row"),
    )
    last = F.floor((F.greatest("size", F.lit(1)) - 1) / block_words)
    return (
        sized.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
        .withColumn("words", F.least(F.col("size") - F.col("block") * block_words, F.lit(block_words)))
        .withColumn("draw", F.xxhash64("key", "block"))
        .withColumn("bin", F.shiftrightunsigned("draw", 64 - BINS.bit_length() + 1).cast("int"))
    )


def mix_plan(
    docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, shards: int = SHARDS,
    seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Every block of ``docs`` with what the mix takes of it.

    ``id, row, source, size, source_size, target, block, words`` (of the block), ``passes`` (whole takes),
    ``part`` (words of the part pass) and ``takes``: an array of ``shard, place, words`` per take, the part pass last.
    """
    blocks = stage(blocks_of(docs, seed, id_col, text_col, source_col, block_words), "mix-blocks")
    targets = sources_with_targets(blocks.select("source", F.col("words").alias("size")), weights, share, most)
    targets = targets.withColumn("passes", F.floor(F.col("target") / F.greatest("source_size", F.lit(1))))
    targets = stage(
        targets.withColumn("part_target", F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long")), "mix-targets"
    )
    filled = blocks.filter("words > 0")
    counts = filled.groupBy("source", "bin").agg(F.sum("words").alias("bin_words"), F.count("*").alias("bin_blocks"))
    earlier = Window.partitionBy("source").orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "source", "bin",
        F.coalesce(F.sum("bin_words").over(earlier), F.lit(0)).alias("words_before"),
        F.coalesce(F.sum("bin_blocks").over(earlier), F.lit(0)).alias("blocks_before"),
    )
    offsets = offsets.join(targets, offsets.source.eqNullSafe(targets.source)).drop(targets.source)
    within = Window.partitionBy("source", "bin").orderBy(F.col("draw").desc(), "id", "row", "block")
    earlier_words = F.coalesce(F.sum("words").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ordered = filled.withColumn("earlier", earlier_words).withColumn("nth", F.row_number().over(within) - 1)
    same = ordered.source.eqNullSafe(offsets.source) & (ordered.bin == offsets.bin)
    placed = ordered.join(offsets, same).drop(offsets.source, offsets.bin)
    left = F.col("part_target") - F.col("words_before") - F.col("earlier")
    placed = stage(
        placed.select(
            "id", "row", "source", "size", "source_size", "target", "block", "words", "passes", "draw",
            (F.col("blocks_before") + F.col("nth")).alias("order"),
            F.greatest(F.lit(0), F.least("words", left)).alias("part"),
        ),
        "mix-order",
    )
    owed = placed.groupBy("source").agg(
        F.max("passes").alias("passes"), F.count("*").alias("blocks"),
        F.sum(F.col("passes") + (F.col("part") > 0).cast("long")).alias("owed"),
    )
    runs = shard_quotas(owed.select("source", "owed"), shards, seed).groupBy("source").agg(
        F.sort_array(F.collect_list(F.struct("first", "quota", "shard"))).alias("runs")
    )
    runs = runs.join(owed.withColumnRenamed("source", "owing"), F.col("source").eqNullSafe(F.col("owing"))).select("source", "runs", "blocks")
    runs = runs.withColumnRenamed("source", "run_source")
    # Takes are numbered pass by pass in the block order; a shard holds one run of these numbers.
    passes = F.filter(F.sequence(F.lit(0).cast("long"), F.col("passes")), lambda p: (p < F.col("passes")) | (F.col("part") > 0))
    def find(n):
        return F.element_at(F.filter("runs", lambda r: (r["first"] <= n) & (n < r["first"] + r["quota"])), 1)["shard"]

    def take(p):
        n = p * F.col("blocks") + F.col("order")
        words = F.when(p < F.col("passes"), F.col("words")).otherwise(F.col("part"))
        return F.struct(find(n).alias("shard"), F.xxhash64(F.lit(seed), "draw", n).alias("place"), words.alias("words"))

    joined = placed.join(runs, placed.source.eqNullSafe(runs.run_source))
    return joined.select(
        "id", "row", "source", "size", "source_size", "target", "block", "words", "passes", "part",
        F.filter(F.transform(passes, take), lambda t: t["shard"].isNotNull()).alias("takes"),
    )


def _words_taken() -> F.Column:
    return F.aggregate("takes", F.lit(0).cast("long"), lambda sum_, t: sum_ + t["words"])


def taken_by_document(docs: DataFrame, **options) -> DataFrame:
    """``id, size, source_size, target, taken`` of every document, also of those without words."""
    id_col, source_col, text_col = (options.get(k, d) for k, d in (("id_col", "doc_id"), ("source_col", "source"), ("text_col", "text")))
    plan = mix_plan(docs, **options)
    took = plan.groupBy("id", "row").agg(
        F.first("size").alias("size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"),
        F.sum(_words_taken()).alias("taken"),
    ).drop("row")
    # A document without words has no block; its source may have none at all.
    empty = docs.filter(F.size(words_of(F.col(text_col))) == 0).select(F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("own"))
    known = plan.groupBy("source").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    none = empty.join(known, F.col("own").eqNullSafe(F.col("source")), "left").select(
        "id", F.lit(0).cast("long").alias("size"), F.coalesce("source_size", F.lit(0).cast("long")).alias("source_size"),
        F.coalesce("target", F.lit(0.0)).alias("target"), F.lit(0).cast("long").alias("taken"),
    )
    return took.unionByName(none)


def mixed_documents(docs: DataFrame, n_chars_col: str | None = "n_chars", **options) -> DataFrame:
    """The mix as documents with the columns of ``docs``: one row per take of a document.

    Whole passes repeat the row as it is; the part pass has the taken blocks' words, a space between
    them, or the whole text if it took all.
    """
    docs = addressed(docs)
    text_col, step = options.get("text_col", "text"), options.get("block_words", BLOCK_WORDS)
    row, took, words, texts = (free_name(docs, name) for name in ("row", "took", "words", "texts"))
    # The tree dealt out each take of a block: all whole ones, then perhaps a part.
    of_block = mix_plan(docs, **options).select(
        "row", "block", F.size(F.filter("takes", lambda t: t["words"] == F.col("words"))).alias("whole"),
        F.aggregate("takes", F.lit(0).cast("long"), lambda n, t: F.greatest(n, F.when(t["words"] < F.col("words"), t["words"]).otherwise(0))).alias("cut"),
        "words",
    )
    # Blocks of a document differ in at most one whole take: what all have is a repetition of the row, the rest is cut out of it.
    least = F.min("whole")
    by_row = of_block.groupBy("row").agg(
        least.alias("repeats"), F.sort_array(F.collect_list(F.struct("block", "whole", "cut", "words"))).alias("blocks")
    )
    runs = F.filter(
        F.transform("blocks", lambda b: F.struct(
            b["block"].alias("block"), F.when(b["whole"] > F.col("repeats"), b["words"]).otherwise(b["cut"]).cast("int").alias("count")
        )), lambda b: b["count"] > 0,
    )
    by_row = by_row.select(F.col("row").alias(row), F.struct("repeats", runs.alias("runs")).alias(took))
    taken = F.col(took)
    cut = F.array_join(
        F.flatten(F.transform(taken["runs"], lambda r: F.slice(words, (r["block"] * step + 1).cast("int"), r["count"]))), " "
    )
    repeated = F.concat(
        F.array_repeat(F.col(text_col), taken["repeats"]),
        F.when(F.size(taken["runs"]) > 0, F.array(cut)).otherwise(F.array().cast("array<string>")),
    )
    joined = docs.withColumn(row, row_number()).join(by_row, row).withColumn(words, words_of(F.col(text_col)))
    out = joined.withColumn(texts, repeated).withColumn(text_col, F.explode(texts))
    if n_chars_col in docs.columns:
        out = out.withColumn(n_chars_col, F.length(text_col).cast(docs.schema[n_chars_col].dataType))
    return out.select(docs.columns)


def write_shards(docs: DataFrame, folder: str, **options) -> None:
    """The mix as files: a folder per shard, its blocks (id, source, block, text) in the shard's own random order."""
    docs = addressed(docs)
    text_col, step = options.get("text_col", "text"), options.get("block_words", BLOCK_WORDS)
    takes = mix_plan(docs, **options).select("row", "id", "source", "block", F.explode("takes").alias("take"))
    texts = docs.select(row_number().alias("row"), words_of(F.col(text_col)).alias("all"))
    cut = F.array_join(F.slice("all", (F.col("block") * step + 1).cast("int"), F.col("take.words").cast("int")), " ")
    rows = takes.join(texts, "row").select("id", "source", "block", cut.alias("text"), F.col("take.shard").alias("shard"), F.col("take.place").alias("place"))
    rows.repartitionByRange("shard", "place").sortWithinPartitions("shard", "place").write.partitionBy("shard").parquet(folder)
