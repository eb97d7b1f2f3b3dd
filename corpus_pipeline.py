"""A corpus pipeline of five operators: toxicity, line dedup, near-copy dedup, mixing to target weights, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonolith.llm import linededup, mixing, packing, simhash
from sonolith.llm import toxicity as toxic
from sonolith.llm.common import materialise, table, with_ids

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network takes for toxic go; it learns from `documents` and `labels` (never held-out rows)."""
    net = toxic.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxic.score(docs, net).where(F.col("score") < toxic.THRESHOLD).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of each source go; every document stays, with its n_chars as its text now is.

    Long lines go from three pages on, in sources of any size; op2 itself drops by share alone."""
    return linededup.dedup_lines(docs, min_site_pages=1, long_words=linededup.LONG_WORDS).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group stays (one row of it); rows without a doc_id all stay.

    Operator 10 in its form for five-word shingles: its pigeonring index proposes what lies within two bits, min-hash keys
    what lies further apart, and a pair counts from a Jaccard likeness of 0.8 on."""
    found = simhash.near_copies(docs).where("doc_id = component_id").select("doc_id")
    kept = with_ids(docs, found, "doc_id")
    again = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1)
    if not again.isEmpty():
        row = F.struct(*[F.col(c) for c in COLUMNS])
        kept = kept.groupBy("doc_id").agg(F.min(row).alias("row")).select("row.*")
    return kept.unionByName(docs.where("doc_id IS NULL")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated as often as the mix takes them."""
    sized = docs.withColumn("size", mixing.words(F.col("text")))
    return mixing.repeated(mixing.mix(sized)).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences over all rows; copies of a document are rows of their own (`row`)."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: A trained network, Newton steps and a tokenizer are beyond SQL; tests compare stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialise(docs, name)
    return docs
