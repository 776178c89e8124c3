"""One query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from turnwise.llm import audit, chat, covers, decontaminate, fim, langid, mtree, packing, render, secrets, simhash, suffixes, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


ORACLES["op1_decontaminate"] = decontaminate.oracle_sql()


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


@query
def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(_table(spark, sf_dir, "documents")))


@query
def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs.where(~langid.held_out())))


@query
def op5_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(suffixes.remove_repeats(_table(spark, sf_dir, "documents")))


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.grade(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


@query
def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.preference_pairs(chat.replaced_replies(_table(spark, sf_dir, "conversations"))))


ORACLES["op9_chat"] = chat.ORACLE_SQL


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


@query
def op6_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(_table(spark, sf_dir, "embeddings"))


ORACLES["op6_mtree"] = mtree.ORACLE_SQL


@query
def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.extract(_table(spark, sf_dir, "pages"))


@query
def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(fim.arrange(_table(spark, sf_dir, "documents")))


ORACLES["op11_fim"] = fim.ORACLE_SQL


@query
def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(audit.cells(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")))


ORACLES["op12_audit"] = audit.ORACLE_SQL


@query
def op13_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covers.digest(covers.remove_repeats(_table(spark, sf_dir, "documents")))
