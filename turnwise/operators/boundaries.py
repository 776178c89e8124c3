"""Abbreviations learned from a corpus without labels, and sentences that don't end at them.

A type is a token without its last period. Types that have a period behind them far more often than
tokens do by chance are abbreviations: the likelihood ratio of the two is weighed down for long types
and for those that also stand without a period, and up for periods within (Kiss and Strunk, 2006).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.functions import text as T

#: What counts as sure to have a period, and the least score of an abbreviation.
SURE, LEAST_SCORE = 0.99, 0.3
#: A pattern takes so many abbreviations at most, those of the highest scores.
MOST = 1000


def types(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, type, n_period, n_plain): how often each type stands with a period behind it and without; types have a letter and none but letters, marks and periods."""
    tokens = docs.select(F.col(lang_col).alias("lang"), F.explode(F.split(F.lower(F.regexp_replace(F.col(text_col), r"""[\s"“”()\[\],;:!?…]+""", " ")), " ")).alias("token"))
    rows = tokens.where(F.col("token").rlike(r"^[\p{L}][\p{L}'’.-]*$")).select("lang", F.regexp_replace("token", r"\.$", "").alias("type"), F.endswith("token", F.lit(".")).alias("period"))
    return rows.groupBy("lang", "type").agg(F.count_if("period").alias("n_period"), F.count_if(~F.col("period")).alias("n_plain"))


def abbreviations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: float = LEAST_SCORE) -> DataFrame:
    """(lang, type, n_period, n_plain, score) of each language's abbreviations in documents(lang, text); null texts have none.

    Counts go by type in one shuffle, and totals, a row for each language, join them again.
    """
    counts = types(docs, text_col, lang_col)
    totals = counts.groupBy(F.col("lang").alias("of_lang")).agg(F.sum("n_period").alias("all_period"), F.sum(F.col("n_period") + F.col("n_plain")).alias("all"))
    rows = counts.where("n_period > 0").join(F.broadcast(totals), F.col("lang").eqNullSafe(F.col("of_lang")))
    k, n, p = F.col("n_period"), F.col("n_period") + F.col("n_plain"), F.col("all_period") / F.col("all")
    likely = lambda q: k * F.log(q) + (n - k) * F.log(1 - q)
    inner = F.regexp_count("type", F.lit(r"\."))
    letters = F.length("type") - inner
    ratio = F.when(p < SURE, 2 * (likely(F.lit(SURE)) - likely(p))).otherwise(0.0)
    score = ratio * F.exp(-letters) * (inner + 1) * F.pow(letters, -F.col("n_plain"))
    return rows.select("lang", "type", "n_period", "n_plain", score.alias("score")).where(F.col("score") >= least)


def pattern(found: DataFrame, most: int = MOST) -> str:
    """A pattern of the gaps between sentences for T.sentences(), of the `most` abbreviations(type, score) of the highest scores."""
    rows = found.groupBy("type").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "type").limit(most).collect()
    return gaps([r.type for r in rows])


def gaps(known: list[str]) -> str:
    """White space behind an end mark, but not behind a known abbreviation or the initial of a name, nor before a small letter; and line breaks."""
    names = "|".join(re.escape(t) for t in sorted(known))
    but = rf"(?<!(?iu:(?<![\p{{L}}\p{{N}}])(?:{names}))\.)" if known else ""
    return rf"(?<=[.?!][\"”)]?){but}(?<!(?<![\p{{L}}\p{{N}}.])\p{{Lu}}\.)\s+(?!\p{{Ll}})|\n+"


def sentences(docs: DataFrame, how: str, text_col: str = "text") -> DataFrame:
    """`docs` with `sentences`, by a pattern of gaps."""
    return docs.withColumn("sentences", T.sentences(F.col(text_col), how))
