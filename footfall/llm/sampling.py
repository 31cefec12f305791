"""Document fingerprints by consistent weighted sampling.

A text's terms are its words, weighted by how often they occur. Every term draws from its own hash ``r`` and
``c`` (gamma distributed with shape 2, as minus the logarithm of a product of two uniforms) and a uniform ``b``;
with weight ``S`` it gets ``t = floor(ln S / r + b)`` and the value ``ln c - r * (t - b) - r``. A hash deals the terms into
``SLOTS`` slots, and in each the term with the least value is the sample, together with ``t``. Two texts agree
in a slot with a probability equal to the generalised Jaccard similarity of the slot's weights, so the share of
equal samples among the slots that either text fills estimates that of the whole. One draw for a term serves
all slots; drawing for every pair of term and sample took more than twice the time there is.

Documents are dealt into runs of ids; each run also gets the first document of the run after it. So one
shuffle of the texts serves both the next document's text and all terms of a text: everything after it
happens where the rows lie.

Defined cases: a null or empty text, or one of white space, has the empty word as its one term; documents
with the same id follow each other in a fixed order; null ids come last; a single document is its own
successor; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from footfall.llm.rows import addressed, row_number
from footfall.session import stage

SLOTS = 64
RUN_ROWS = 256
MOST_RUNS = 4096
SPACES = r"[\x20\x09-\x0D]+"


def terms_of(text: Column) -> Column:
    return F.split(text, SPACES)


def with_draws(rows: DataFrame, term: str, weight_log: str) -> DataFrame:
    """``slot`` and ``value`` of each row, from a term's hash and the logarithm of its weight.

    ``value`` holds the drawn value in its upper half, for the order, and a hash of term and ``t`` in the lower.
    """
    keep = rows.columns
    rows = rows.select("*", F.expr(f"xxhash64({term}, 1) AS h"), F.expr(f"xxhash64({term}, 2) AS g"))
    rows = rows.select(
        *keep,
        F.expr(f"-ln(((h & 4294967295) + 0.5D) * (shiftrightunsigned(h, 32) + 0.5D) * {2.0**-64!r}D) AS r"),
        F.expr(f"ln(-ln(((g & 2097151) + 0.5D) * ((shiftright(g, 21) & 2097151) + 0.5D) * {2.0**-42!r}D)) AS lnc"),
        F.expr(f"((shiftrightunsigned(g, 42) & 2097151) + 0.5D) * {2.0**-21!r}D AS b"),
    )
    rows = rows.select("*", F.expr(f"floor({weight_log} / r + b) AS t"))
    value = F.expr(f"""
        shiftleft(cast(least(greatest(lnc - r * (t - b + 1) + 100, 0), 120) * 16777216 as bigint), 32)
        | (xxhash64({term}, t) & 4294967295)
    """)
    return rows.select(*keep, F.expr(f"pmod(xxhash64({term}, 3), {SLOTS}) AS slot"), value.alias("value"))


def fingerprints(terms: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, samples`` (slot and sample in one number each, sorted) from a row per occurrence of a term's hash."""
    weights = terms.groupBy(*keys, "term").agg(F.count("*").alias("n"))
    weights = weights.select(*keys, "term", F.expr("ln(cast(n as double)) AS w"))
    least = with_draws(weights, "term", "w").groupBy(*keys, "slot").agg(F.min("value").alias("value"))
    sample = F.expr("shiftleft(slot, 32) | (value & 4294967295)")
    return least.select(*keys, sample.alias("s")).groupBy(*keys).agg(F.sort_array(F.collect_list("s")).alias("samples"))


def agreement(one: Column, other: Column) -> Column:
    """The share of equal samples among the slots that either has."""
    def slots(samples: Column) -> Column:
        return F.transform(samples, lambda s: F.shiftright(s, 32))

    return F.size(F.array_intersect(one, other)) / F.size(F.array_union(slots(one), slots(other)))


def as_text(samples: Column) -> Column:
    return F.array_join(F.transform(samples, lambda s: F.lpad(F.lower(F.hex(s)), 10, "0")), "")


def runs_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every row with its run, and once more (``copy``) the first row of each run in the run before it."""
    docs = addressed(docs).select(
        row_number().alias("row"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    ids = stage(docs.select("row", "id"), "ids")
    count = ids.count()
    runs = min(MOST_RUNS, max(1, count // RUN_ROWS))
    cuts = ids.agg(F.percentile_approx("id", [k / runs for k in range(1, runs)] or [0.5]).alias("c")).first()["c"] or []
    # Runs count downwards, as documents are read by descending id; null ids are in the last one.
    bounds = F.array(*(F.lit(c).cast("long") for c in sorted(set(cuts)))).cast("array<bigint>")
    number = F.when(F.col("id").isNull(), F.lit(0)).otherwise(F.size(F.filter(bounds, lambda c: c < F.col("id"))))
    first = ids.withColumn("run", number).groupBy("run").agg(
        F.min(F.struct(F.col("id").isNull().alias("missing"), (-F.col("id")).alias("down"), "row")).alias("f")
    )
    after = Window.orderBy("run")  # one row per run, of which there are at most MOST_RUNS
    heads = first.select(
        F.col("f.row").alias("head"), F.coalesce(F.lead("run").over(after), F.first("run").over(after)).alias("into")
    )
    places = F.array_compact(F.array(
        F.struct(number.alias("run"), F.lit(0).alias("copy")),
        F.when(F.col("into").isNotNull(), F.struct(F.col("into").alias("run"), F.lit(1).alias("copy"))),
    ))
    return (
        docs.join(F.broadcast(heads), docs["row"] == heads["head"], "left")
        .select("row", "id", "text", F.explode(places).alias("p"))
        .select("p.run", "p.copy", "row", "id", "text")
    )


def fingerprint_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id, n_chars, edited, samples, edited_samples, next_samples`` of every row.

    ``edited`` is the text whose last half is replaced by the beginning of the next document, by descending id.
    """
    order = Window.partitionBy("run").orderBy("copy", F.col("id").desc_nulls_last(), "row")
    rows = runs_of(docs, id_col, text_col).withColumn("next_text", F.lead("text").over(order))
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    edited = F.expr("concat(substring(text, 1, int(n_chars - n_chars div 2)), substring(coalesce(next_text, ''), 1, int(n_chars div 2)))")
    rows = rows.select("run", "copy", "row", "id", "n_chars", "text", edited.alias("edited"))
    versions = F.array(F.struct(F.lit(0).alias("version"), F.col("text").alias("t")), F.struct(F.lit(1).alias("version"), F.col("edited").alias("t")))
    words = rows.select("run", "copy", "row", F.explode(versions).alias("v")).filter("copy = 0 OR v.version = 0")
    listed = words.select("run", "copy", "row", "v.version", terms_of(F.col("v.t")).alias("words"))
    listed = listed.withColumn("words", F.array_remove("words", ""))
    listed = listed.withColumn("words", F.when(F.size("words") > 0, F.col("words")).otherwise(F.array(F.lit(""))))
    terms = listed.select("run", "copy", "row", "version", F.explode("words").alias("word")).select("run", "copy", "row", "version", F.xxhash64("word").alias("term"))
    made = fingerprints(terms, ["run", "copy", "row", "version"])
    both = made.groupBy("run", "copy", "row").agg(
        F.first(F.when(F.col("version") == 0, F.col("samples")), True).alias("samples"),
        F.first(F.when(F.col("version") == 1, F.col("samples")), True).alias("edited_samples"),
    )
    known = rows.select("run", "copy", "row", "id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    return (
        known.join(both, ["run", "copy", "row"])
        .withColumn("next_samples", F.lead("samples").over(order))
        .filter("copy = 0")
        .select("row", "id", "n_chars", "edited_sha256", "samples", "edited_samples", "next_samples")
    )
