"""From raw documents to packed training sequences.

Five stages, each on all rows that the one before it kept: toxic documents go; of
each group of near-duplicates one stays; personal data is redacted; sources are
mixed to target weights; what is left is packed. Each stage's rows are written as
Parquet to the shared folder and read again, and deleted once the next stage's are.

A document is told apart by its doc_id and a hash of its text, so rows that share
a doc_id, or have none, are decided one by one. Only the columns of ``documents``
are used; others are dropped by the first stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionmill.llm.mixing import mix
from sessionmill.llm.near_dedup import near_duplicates
from sessionmill.llm.packing import pack
from sessionmill.llm.pii import detect, fit, redacted
from sessionmill.llm.queries import SEED, WEIGHTS, WORD_VOCABULARY, domain
from sessionmill.llm.session import discard, prepare, stored
from sessionmill.llm.toxicity import toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Of all tokens that reach the mixing stage, the share that it takes, each document once at most.
MIX_SHARE = 0.6

# SQL can express neither the fitted models nor the packing; the stages are tested against brute force.
ORACLE_SQL = None


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS).withColumn("text_key", F.xxhash64("text"))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of keyed ``docs`` that are not among the (doc_id, text_key) of ``gone``."""
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key"))
    return docs.join(gone, docs.doc_id.eqNullSafe(gone.gone_id) & (docs.text_key == gone.gone_key), "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    docs = _keyed(docs)
    scored = toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=("text_key",))
    return _without(docs, scored.where("predicted = 1")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group stays; of rows equal in doc_id and text, one."""
    docs = _keyed(docs)
    decided = near_duplicates(docs, carry=("text_key",))
    return _without(docs, decided.where("NOT kept")).dropDuplicates(["doc_id", "text_key"]).select(*COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text."""
    prepare(spark)
    docs = docs.select(*COLUMNS)
    clean = redacted(detect(docs, fit(docs)))
    length = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.withColumn("n_chars", length).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that fill the sources' budgets, whole and once each; none of an empty table.

    Texts of a repeated doc_id are chosen one by one; rows equal in both are one document by now.
    """
    docs = _keyed(docs)
    chosen = mix(docs, domain(), WEIGHTS, MIX_SHARE, epochs=1, seed=SEED, carry=("text_key",)).select(F.col("doc_id").alias("chosen_id"), F.col("text_key").alias("chosen_key")).distinct()
    return docs.join(chosen, docs.doc_id.eqNullSafe(chosen.chosen_id) & (docs.text_key == chosen.chosen_key), "left_semi").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 4096 tokens; a null text is one token, an empty table gives none."""
    return pack(docs, WORD_VOCABULARY)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
