"""How five filters of documents interact: what each removes, alone and behind others, in every order.

Each document gets a mask with a bit for each filter that it fails. Documents are counted by part
and mask, so what any order of the filters does follows from 32 counts for each part.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import Staged

# The least words, the least share of distinct words and the most capitals in percent, the characters that none may have, white space.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 50, 65, 5, r"[#$%&*|]"
SPACE = r"[\x20\x09-\x0D]+"
FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]


def bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def text_mask(text: Column) -> Column:
    """The bits of the filters A to D, which judge a text by itself."""
    words = F.filter(F.split(text, SPACE, -1), lambda w: w != "")
    counts = F.get(F.transform(F.array(words), lambda w: F.struct(F.size(w).cast("long").alias("all"), F.size(F.array_distinct(w)).cast("long").alias("distinct"))), F.lit(0))
    flag = lambda condition, letter: F.when(condition, bit(letter)).otherwise(0)
    by_words = F.get(F.transform(F.array(counts), lambda n: flag(n["all"] < LEAST_WORDS, "A") + flag(n["distinct"] * 100 < n["all"] * LEAST_DISTINCT, "B")), F.lit(0))
    capitals = F.regexp_count(text, F.lit("[A-Z]")).cast("long")
    return by_words + flag(capitals * 100 > F.length(text).cast("long") * MOST_CAPITALS, "C") + flag(text.rlike(SYMBOLS), "D")


def cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents, those of quality 1 and those that are toxic, by part and failure mask.

    Filter E fails where a smaller id has the same text (by SHA-256) anywhere in the table. A null
    text is empty, a null part is the empty string. A row with a null id has no smaller id, is none
    itself, and has no labels. Rows that repeat an id count each; they are not smaller than each
    other. A document is good or toxic if any of its labels says so. Other columns are ignored; an
    empty table has no cells.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("same"), text_mask(F.col("text")).alias("mask"))
    # Rows are narrow from here on, and repeats of one id and text meet before they are dealt out.
    rows = rows.groupBy("doc_id", "part", "same", "mask").agg(F.count("*").alias("n"))
    marked = labels.select(F.col(id_col).alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    marked = marked.groupBy("doc_id").agg(F.coalesce(F.max("good"), F.lit(False)).alias("good"), F.coalesce(F.max("toxic"), F.lit(False)).alias("toxic")).where("good or toxic")
    rows = rows.join(marked.hint("merge"), "doc_id", "left").fillna(False, ["good", "toxic"])
    # Of each text in a part: how many rows, its smallest id, and how many rows have that.
    texts = rows.groupBy("same", "mask", "part", "good", "toxic").agg(F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("at_least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnumbered"))
    texts = Staged(texts, "distinct_texts").read()
    firsts = texts.groupBy("same").agg(F.min("least").alias("first"))
    texts = texts.join(firsts.hint("merge"), "same")
    first = F.col("unnumbered") + F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0)
    split = F.filter(F.array(F.struct(F.lit(0).alias("e"), first.alias("n")), F.struct(F.lit(bit("E")).alias("e"), (F.col("n") - first).alias("n"))), lambda x: x["n"] > 0)
    found = texts.select("part", "mask", "good", "toxic", F.explode(split).alias("x")).select("part", (F.col("mask") + F.col("x.e")).alias("mask"), "good", "toxic", "x.n")
    of = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return found.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good"), of("toxic"))


def interactions(cells: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): a row for each part, order of the filters and step.

    kept and removed are after and by the step's filter; redundant fail it but went before;
    unique_fails fail it and no other; good_lost and toxic_lost are among the removed; shapley is
    what the filter removes summed over all orders, at whatever step.
    """
    rows = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    rows = rows.select("part", "cells", F.explode(F.array(*map(F.lit, ORDERS))).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    of = lambda letter: F.pow(F.lit(2), F.ascii(letter) - ord(FILTERS[0])).cast("int")
    before = F.aggregate(F.sequence(F.lit(1), F.lit(len(FILTERS))), F.lit(0), lambda s, i: s + F.when(i < F.col("step"), of(F.substring("filter_order", i, F.lit(1)))).otherwise(0))
    rows = rows.withColumn("own", of(F.substring("filter_order", F.col("step"), F.lit(1)))).withColumn("before", before)
    fails = lambda c: c["mask"].bitwiseAND(F.col("own")) > 0
    went = lambda c: c["mask"].bitwiseAND(F.col("before")) > 0
    removed = lambda c: fails(c) & ~went(c)

    def total(condition, value=lambda c: c["n"]) -> Column:
        return F.aggregate(F.filter("cells", condition), F.lit(0).cast("long"), lambda s, c: s + value(c))

    # Of all orders, a document that fails k filters is removed by each of them in a k-th.
    share = total(fails, lambda c: (c["n"] * len(ORDERS) / F.bit_count(c["mask"])).cast("long"))
    return rows.select(
        "part", "filter_order", "step", total(lambda c: ~fails(c) & ~went(c)).alias("kept"), total(removed).alias("removed"), total(lambda c: fails(c) & went(c)).alias("redundant"),
        total(lambda c: c["mask"] == F.col("own")).alias("unique_fails"), total(removed, lambda c: c["good"]).alias("good_lost"), total(removed, lambda c: c["toxic"]).alias("toxic_lost"), share.alias("shapley"),
    )


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
least_id AS (SELECT text, min(doc_id) AS first FROM d GROUP BY text),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, FALSE)) AS good, bool_or(coalesce(toxic = 1, FALSE)) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT d.part, coalesce(l.good, FALSE) AS good, coalesce(l.toxic, FALSE) AS toxic,
    (len(words) < 50)::INT + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT + 4 * (100 * len(regexp_extract_all(d.text, '[A-Z]')) > 5 * length(d.text))::INT
    + 8 * regexp_matches(d.text, '[#$%&*|]')::INT + 16 * coalesce(d.doc_id > least_id.first, FALSE)::INT AS mask
  FROM d JOIN least_id ON least_id.text = d.text LEFT JOIN l ON l.doc_id = d.doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, mask),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS t(letter, bit)),
o AS (
  SELECT a.letter || b.letter || x.letter || y.letter || z.letter AS filter_order, a.bit AS b1, b.bit AS b2, x.bit AS b3, y.bit AS b4, z.bit AS b5
  FROM f a, f b, f x, f y, f z WHERE a.bit + b.bit + x.bit + y.bit + z.bit = 31 AND a.bit | b.bit | x.bit | y.bit | z.bit = 31),
s AS (
  SELECT filter_order, 1 AS step, 0 AS before, b1 AS own FROM o UNION ALL SELECT filter_order, 2, b1, b2 FROM o UNION ALL SELECT filter_order, 3, b1 + b2, b3 FROM o
  UNION ALL SELECT filter_order, 4, b1 + b2 + b3, b4 FROM o UNION ALL SELECT filter_order, 5, b1 + b2 + b3 + b4, b5 FROM o),
r AS (
  SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (mask & (before | own) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & own > 0 AND mask & before = 0), 0) AS removed,
    coalesce(sum(n) FILTER (mask & own > 0 AND mask & before > 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = own), 0) AS unique_fails,
    coalesce(sum(good) FILTER (mask & own > 0 AND mask & before = 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (mask & own > 0 AND mask & before = 0), 0) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
"""
