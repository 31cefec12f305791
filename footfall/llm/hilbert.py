"""Shards along a Hilbert curve over document metadata, for files that several columns can prune.

Source, language, size and id are quantised by their percentiles into ``2**BITS`` levels each, so levels keep the
order that file statistics have. All rows count: the percentiles of numbers are approximate, those of text columns exact, from the counts
of their distinct values; whole strings are compared, however long a beginning they share. The levels' place on the
Hilbert curve comes from a small table, one look-up per bit. Rows in the order of curve, hash and id are
numbered without sorting all of them in one place: counts per (curve, hash) bucket are summed up first over
coarse curve ranges (at most ``2**COARSE`` rows), then within each range, then rows within a bucket. A third
of all rows in one cell is still spread over ``2**SPREAD`` buckets. Runs of equal row counts are the shards.

Defined cases: a null text has size 0 (and ``OVERHEAD``) and the checksum of an empty text; a null in any dimension
takes its lowest level; rows that agree in curve, hash, id and text are ordered by row number, so repeated rows get slots of their own; a very
long text counts by its size alone; with fewer rows than shards some shards are empty;
an empty table gives no rows. Equal texts need not share a shard, as the law is on row counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from footfall.llm.rows import addressed, free_name, row_number
from footfall.session import stage

SHARDS = 40
BITS = 4
COARSE = 8
SPREAD = 10
OVERHEAD = 16


def _rotate(x: int, by: int, n: int) -> int:
    by %= n
    return ((x >> by) | (x << (n - by))) & ((1 << n) - 1)


def curve_table(n: int) -> list[int]:
    """For state and cell of one bit plane: the next state and the digit on the curve, in one number.

    A state is the corner where the curve enters and the axis along which it leaves. Digits follow the reflected Gray code,
    turned and mirrored by the state.
    """
    cells = 1 << n
    table = []
    for state in range(cells * n):
        entry, axis = divmod(state, n)
        for cell in range(cells):
            gray = _rotate(cell ^ entry, axis + 1, n)
            digit, shift = gray, 1
            while shift < n:
                digit ^= digit >> shift
                shift *= 2
            before = 2 * ((digit - 1) // 2) if digit else 0
            step = _rotate(before ^ (before >> 1), -(axis + 1), n)
            ones = (digit if digit % 2 else digit - 1) if digit else 0
            turn = 0
            while ones & 1:
                turn, ones = turn + 1, ones >> 1
            table.append(((entry ^ step) * n + (axis + turn % n + 1) % n) * cells + digit)
    return table


def curve_index(levels: list[Column], bits: int = BITS) -> Column:
    """Place on the Hilbert curve of a cell given by ``bits``-wide levels."""
    n = len(levels)
    table = F.array(*map(F.lit, curve_table(n)))
    place, found = F.lit(0).cast("long"), F.lit(0)
    for plane in range(bits - 1, -1, -1):
        cell = sum((F.shiftright(level, plane).bitwiseAND(1) * (1 << k) for k, level in enumerate(levels)), F.lit(0))
        state = F.shiftright(found, n)
        found = F.get(table, state * (1 << n) + cell)
        place = place * (1 << n) + found.bitwiseAND((1 << n) - 1)
    return place


def text_cuts(rows: DataFrame, dimension: str, n: int) -> list[str]:
    """The ``n - 1`` texts at equal steps through a column in order, nulls left out; nothing else comes to the driver.

    Distinct texts with their counts are dealt into ranges, and the counts summed up over the ranges, then within each.
    """
    counted = rows.filter(F.col(dimension).isNotNull()).groupBy(F.col(dimension).alias("value")).agg(F.count("*").alias("n"))
    ranged = stage(counted.repartitionByRange("value").select("value", "n", F.spark_partition_id().alias("range")), "texts")
    total = ranged.agg(F.sum("n")).first()[0]
    if not total:
        return []
    ranges = ranged.groupBy("range").agg(F.sum("n").alias("n")).select(
        "range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before")
    )
    within = Window.partitionBy("range").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("before") + F.coalesce(F.sum("n").over(within), F.lit(0))
    places = [k * total // n for k in range(1, n)]
    held = F.filter(F.array(*map(F.lit, places)), lambda place: (place >= F.col("first")) & (place < F.col("first") + F.col("n")))
    placed = ranged.join(F.broadcast(ranges), "range").select("value", "n", first.alias("first"))  # as many ranges as partitions
    found = placed.select("value", held.alias("places")).filter(F.size("places") > 0).collect()
    at = {place: r["value"] for r in found for place in r["places"]}
    return [at[place] for place in places]


def quantised(rows: DataFrame, dimensions: list[str], bits: int = BITS) -> DataFrame:
    """``rows`` with ``level_<dimension>`` by percentiles; only these come to the driver."""
    n = 1 << bits
    texts = [d for d in dimensions if isinstance(rows.schema[d].dataType, T.StringType)]
    numbers = [d for d in dimensions if d not in texts]
    cuts = dict.fromkeys(dimensions, [])
    if numbers:
        found = rows.agg(*(F.percentile_approx(d, [k / n for k in range(1, n)]).alias(d) for d in numbers)).first()
        cuts |= {d: found[d] or [] for d in numbers}
    cuts |= {d: text_cuts(rows, d, n) for d in texts}
    levels = {}
    for d in dimensions:
        kind = rows.schema[d].dataType
        bounds = F.array(*(F.lit(c) for c in cuts[d])).cast(T.ArrayType(kind))
        levels[f"level_{d}"] = F.greatest(F.lit(0), F.size(F.filter(bounds, _below(F.col(d)))))
    return rows.withColumns(levels)


def _below(value: Column) -> Callable[[Column], Column]:
    return lambda bound: bound < value


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (with curve, spread, id, row) and ``rank`` in that order."""
    buckets = rows.groupBy("curve", "spread").agg(F.count("*").alias("n"))
    coarse = F.shiftright("curve", 4 * BITS - COARSE)
    before = Window.unboundedPreceding, -1
    ranges = buckets.groupBy(coarse.alias("range")).agg(F.sum("n").alias("n")).select(
        "range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(*before)), F.lit(0)).alias("range_before")
    )
    inside = Window.partitionBy("range").orderBy("curve", "spread").rowsBetween(*before)
    offsets = (
        buckets.withColumn("range", coarse)
        .withColumn("bucket_before", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(F.broadcast(ranges), "range")  # at most 2**COARSE rows
        .select("curve", "spread", (F.col("range_before") + F.col("bucket_before")).alias("before"))
    )
    within = Window.partitionBy("curve", "spread").orderBy("id", "crc", "row")
    return (
        rows.withColumn("nth", F.row_number().over(within) - 1)
        .join(offsets, ["curve", "spread"])
        .withColumn("rank", F.col("before") + F.col("nth"))
    )


def shards(
    docs: DataFrame, n_shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", lang_col: str = "lang",
) -> DataFrame:
    """``row, id, size, crc, curve, shard, slot`` of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    metadata = stage(
        addressed(docs).select(
            row_number().alias("row"), F.col(id_col).cast("long").alias("id"),
            (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"),
            F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"),
        ),
        "metadata",
    )
    dimensions = ["source", "lang", "size", "id"]
    placed = quantised(metadata, dimensions).select(
        "row", "id", "size", "crc", curve_index([F.col(f"level_{d}") for d in dimensions]).alias("curve"),
        F.shiftrightunsigned(F.xxhash64("id"), 64 - SPREAD).alias("spread"),
    )
    placed = stage(placed, "curve")
    total = placed.count()
    # Whole numbers only: a quotient in floating point could miss a boundary.
    shard = F.expr(f"cast((rank * {n_shards}) div {max(total, 1)} as int)")
    first = F.expr(f"(shard * {total}L + {n_shards - 1}) div {n_shards}")
    return numbered(placed).withColumn("shard", shard).select(
        "row", "id", "size", "crc", "curve", "shard", (F.col("rank") - first).alias("slot")
    )


def write_shards(docs: DataFrame, folder: str, n_shards: int = SHARDS, **columns: str) -> None:
    """Write ``docs`` as one folder ``shard=N`` per shard, each in the order of the curve. ``docs`` may not have a column ``shard``."""
    if "shard" in docs.columns:
        raise ValueError("shard is a column already")
    docs = addressed(docs)
    row, slot = free_name(docs, "row"), free_name(docs, "slot")
    places = shards(docs, n_shards, **columns).select(F.col("row").alias(row), "shard", F.col("slot").alias(slot))
    rows = docs.withColumn(row, row_number()).join(places, row).drop(row)
    rows.repartitionByRange("shard", slot).sortWithinPartitions("shard", slot).drop(slot).write.partitionBy("shard").parquet(folder)
