"""From raw documents to packed training sequences, one operator a stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm import decontaminate, packing, secrets, shingles, toxicity
from turnwise.llm.common import Staged, kept, scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grades reject go; the model is learned from `labels`.

    Rows are judged one by one: null and empty texts stay, repeated rows go or stay together. Without
    labels, or on an empty table, every row stays.
    """
    return toxicity.keep_clean(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group whose five-word shingles overlap by 0.8 or more one document stays, that of the smallest id.

    Rows with a null id come after all others, and of rows with the same id one stays, so repeated
    rows leave one. Null, empty and wordless texts are one group. An empty table stays empty.
    """
    return shingles.without_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of `benchmark` go, by their text: null ids and ids that repeat make no difference.

    Null texts stay, and so does every row where the benchmark is empty.
    """
    return decontaminate.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by marks; every document stays, with n_chars of the new text. Null texts and their n_chars of null stay null."""
    found = secrets.redact(docs)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each stretch of each document goes in the training sequences; null and empty texts are an end mark alone."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: Most stages are beyond SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's rows are written and read again by the next."""
    docs = _table(spark, sf_dir, "documents")
    before: Staged | None = None
    for name, stage in STAGES:
        with scratch():  # what the stage staged for itself goes with it
            rows = stage(spark, docs, sf_dir)
            with kept():
                written = Staged(rows, name.replace(" ", "_"))
        docs = written.read()
        if before is not None:
            before.drop()
        before = written
    return docs
