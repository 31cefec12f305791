"""From raw documents to packed training sequences, in five stages that each keep what the next one works on.

Defined cases: null and empty texts are not toxic unless their score says so; as one text they leave one document, which the n-gram join
keeps and the mix never takes. Of equal or similar texts the smallest id stays, of one id the first in row order; null ids come last. Repeated rows
are copies. Very long texts go through whole. Columns beyond those of documents keep their values up to the packing, whatever
their names. Without labels nothing is rejected; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from footfall.llm import exact, jaccard, mixing, packing, toxicity
from footfall.llm.queries import documents, tokenizer_file
from footfall.session import configure, stage

#: Documents with at least this score are rejected.
TOXIC_SCORE = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold; the field is taught by two thirds of the labels."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold != 1)
    score, spans = (_free(docs, name) for name in ("toxic_score", "toxic_spans"))
    scored = toxicity.score_documents(docs, model, score_col=score, spans_col=spans)
    return scored.filter(F.col(score) < TOXIC_SCORE).select(docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact.without_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similarity 0.75 or more hold together."""
    return jaccard.first_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as far, as the target weights of their sources take them."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences."""
    packed = packing.pack_documents(docs, tokenizer_file())
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def _free(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name += "_"
    return name


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: The field, the components and the packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; every stage's rows are written and read again."""
    docs = documents(configure(spark), sf_dir)
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
