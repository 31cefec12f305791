"""What filters do to each other: every order in which they can be applied, step by step.

A row of the table is reduced to a mask, one bit for each filter that it fails, and rows are counted by part and mask:
at most ``2**n`` cells a part, whatever the size of the table. Each cell then walks through all orders of the filters, a
constant array in the expression that every task holds: ``transform`` over the orders, ``aggregate`` along each of them.
That gives one struct per order and step (600 for five filters), weighted by the cell's counts, and the cells of a part are
merged by elementwise sums.

One filter may ask for copies: a row fails it if its text equals that of a row with a smaller id anywhere in the table,
whether that one is removed or not. Texts are compared by SHA-256. Rows are counted by text, part and id before texts
meet, so a text that a third of all rows share is a few rows by then; no list of a text's rows is made, and no text is shuffled.

Defined cases: a null or empty text has no words and is a text like any other (its copies fail the copies filter); an
empty table gives no rows; a null part and an empty one are the same part; a null id is no copy of anything and has no copies; rows
with the same id and text are not copies of each other, as neither id is smaller; several label rows of an id count as good, or toxic,
if one of them does; ids without labels are neither; a very long text is one row as any other; a null in a filter's condition counts as
passed; other columns of the tables are not read, so their names don't matter.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window, functions as F

from footfall.operators.lookup import sized

#: 720 orders of six filters are 4320 structs a part.
MOST_FILTERS = 6
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
STEP = "struct<" + ",".join(f"{name}:bigint" for name in COUNTS) + ">"


def text_filters(text: Column) -> dict[str, Column]:
    """The conditions under which a text fails: few words, few different words, capitals, symbols."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n_words = F.size(words).cast("long")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    return {
        "A": n_words < 200,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 50 * n_words,
        "C": 100 * capitals > 2 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def masks(
    docs: DataFrame, labels: DataFrame, filters: dict[str, Column], id_col: str, text_col: str, part_col: str
) -> DataFrame:
    """``id, part, digest, mask, good, toxic`` of every row."""
    failed = sum((F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(filters.values())), F.lit(0))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"),
        F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("digest"), failed.alias("mask"),
    )
    known = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    ).filter("id IS NOT NULL AND (good OR toxic)")
    none = F.lit(False)
    return rows.join(sized(known), "id", "left").withColumns({"good": F.coalesce("good", none), "toxic": F.coalesce("toxic", none)})


def cells(rows: DataFrame, copies_bit: int | None) -> DataFrame:
    """``part, mask, n, good, toxic``: rows counted by mask, the copies' bit included."""
    same = ["digest", "part", "mask", "good", "toxic"]
    by_id = rows.groupBy(*same, "id").agg(F.count("*").alias("n"))
    # The rows of the smallest id are no copies, however many there are of them.
    by_text = by_id.groupBy(*same).agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("without_id"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("low"),
    )
    # A text has few rows by now: one for each part and kind of labels.
    met = by_text.withColumn("first_id", F.min("low.id").over(Window.partitionBy("digest")))
    not_copies = F.col("without_id") + F.when(F.col("low.id") == F.col("first_id"), F.col("low.n")).otherwise(0)
    copies = F.when(F.col("first_id").isNotNull(), F.col("n") - not_copies).otherwise(0)
    copies = copies if copies_bit is not None else F.lit(0)
    both = F.array(
        F.struct(F.col("mask").alias("mask"), (F.col("n") - copies).alias("n")),
        F.struct((F.col("mask") + (1 << (copies_bit or 0))).alias("mask"), copies.alias("n")),
    )
    counted = met.select("part", "good", "toxic", F.explode(both).alias("cell")).select("part", "good", "toxic", "cell.*")
    return counted.filter("n > 0").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"),
    )


def _walk(cell: Column, order: Column) -> Column:
    """The steps of one cell along one order."""
    zero = F.lit(0).cast("long")

    def step(state: Column, number: Column) -> Column:
        bit = F.call_function("shiftleft", F.lit(1), number)
        fails, gone = cell["mask"].bitwiseAND(bit) != 0, state["gone"]
        count = lambda condition, n: F.when(condition, n).otherwise(zero)
        here = fails & ~gone
        struct = F.struct(
            count(~fails & ~gone, cell["n"]).alias("kept"), count(here, cell["n"]).alias("removed"),
            count(fails & gone, cell["n"]).alias("redundant"), count(cell["mask"] == bit, cell["n"]).alias("unique_fails"),
            count(here, cell["good"]).alias("good_lost"), count(here, cell["toxic"]).alias("toxic_lost"),
        )
        return F.struct((gone | fails).alias("gone"), F.array_append(state["steps"], struct).alias("steps"))

    start = F.struct(F.lit(False).alias("gone"), F.array().cast(f"array<{STEP}>").alias("steps"))
    return F.aggregate(order, start, step, lambda state: state["steps"])


def filter_audit(
    docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, copies: str | None = "E",
    id_col: str = "doc_id", text_col: str = "text", part_col: str = "source",
) -> DataFrame:
    """``part, filter_order, step``, the counts of ``COUNTS`` and ``shapley`` for every order of the filters.

    ``filters`` maps a letter to the condition of failing it, ``copies`` is the letter of the copies filter, if there is to be
    one. ``shapley`` sums what the step's filter removes over all orders.
    """
    filters = text_filters(F.col(text_col)) if filters is None else filters
    letters = [*filters, *([copies] if copies else [])]
    if not 0 < len(letters) <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters, not {len(letters)}")
    counted = cells(masks(docs, labels, filters, id_col, text_col, part_col), len(filters) if copies else None)
    numbers = list(permutations(range(len(letters))))
    orders = F.from_json(F.lit(str([list(order) for order in numbers])), "array<array<int>>")
    walked = F.from_json(F.lit(str([k for order in numbers for k in order])), "array<int>")
    names = F.split(F.lit(",".join("".join(letters[k] for k in order) for order in numbers)), ",")

    # A part has at most one cell for each mask.
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    zero = F.array_repeat(F.struct(*(F.lit(0).cast("long").alias(name) for name in COUNTS)), len(numbers) * len(letters))
    add = lambda a, b: F.struct(*((a[name] + b[name]).alias(name) for name in COUNTS))
    steps = F.aggregate(
        "cells", zero, lambda sums, cell: F.zip_with(sums, F.flatten(F.transform(orders, lambda order: _walk(cell, order))), add)
    )
    removed = lambda k: F.aggregate(
        F.zip_with("steps", walked, lambda s, number: F.when(number == k, s["removed"]).otherwise(0)), F.lit(0).cast("long"), lambda a, n: a + n
    )
    merged = parts.select("part", steps.alias("steps"))
    summed = merged.select("part", "steps", F.array(*(removed(k) for k in range(len(letters)))).alias("shapley"))
    place = F.col("pos")
    return summed.select("part", "shapley", F.posexplode("steps").alias("pos", "s")).select(
        "part", F.get(names, F.floor(place / len(letters)).cast("int")).alias("filter_order"),
        (place % len(letters) + 1).cast("int").alias("step"), "s.*",
        F.get("shapley", F.get(walked, place)).alias("shapley"),
    )
