"""Joins in time: the latest row at or before each, and rows within intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, right_columns: list[str], bucket: str = "30 days") -> DataFrame:
    """`left` with `right_columns` of the latest row of `right` of the same keys at or before its time, null without one.

    Both sides go through one shuffle, by keys and bucket of time, where the last row before each is
    carried along; a bucket that has none before a row takes the last of the buckets before, of which
    there is a row for each. So a key with very many rows is dealt out by its buckets. Of rows of
    `right` at one time the largest in order of `right_columns` counts. Null keys meet nothing, and
    null times are before nothing.
    """
    span = F.expr(f"unix_micros(timestamp_seconds(0) + interval {bucket})").alias("span")
    width = left.sparkSession.range(1).select(span).first().span
    of = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / width)
    own = left.columns
    found = F.struct(*[F.col(c) for c in right_columns])
    a = left.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(left_time).cast("timestamp").alias("_t"), of(left_time).alias("_b"), F.lit(1).alias("_side"), F.lit(None).cast(right.select(found).schema[0].dataType).alias("_r"), F.struct(*own).alias("_l"))
    b = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(right_time).cast("timestamp").alias("_t"), of(right_time).alias("_b"), F.lit(0).alias("_side"), found.alias("_r"), F.lit(None).cast(left.select(F.struct(*own)).schema[0].dataType).alias("_l"))
    b = b.where(F.col("_t").isNotNull())
    named = [f"_k{i}" for i in range(len(keys))]
    for k in named:
        b = b.where(F.col(k).isNotNull())
    within = Window.partitionBy(*named, "_b").orderBy("_t", "_side", "_r")
    rows = a.unionByName(b).withColumn("_here", F.last("_r", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0))).where("_side = 1")
    ends = b.groupBy(*named, "_b").agg(F.max_by("_r", F.struct("_t", "_r")).alias("_end"))
    # The buckets that left rows are in, each with the last row of those before it.
    asked = a.where(F.col("_b").isNotNull()).select(*named, "_b").distinct()
    before = asked.withColumn("_end", F.lit(None).cast(ends.schema["_end"].dataType)).withColumn("_side", F.lit(0)).unionByName(ends.withColumn("_side", F.lit(1)))
    carried = before.withColumn("_before", F.last("_end", ignorenulls=True).over(Window.partitionBy(*named).orderBy("_b", "_side").rowsBetween(Window.unboundedPreceding, 0))).where("_side = 0")
    rows = rows.join(carried.select(*named, "_b", "_before"), [*named, "_b"], "left").withColumn("_found", F.coalesce("_here", "_before"))
    return rows.select(*[F.col(f"_l.{c}").alias(c) for c in own], *[F.col(f"_found.{c}").alias(c) for c in right_columns])


def within(points: DataFrame, intervals: DataFrame, time: str, start: str, end: str, bucket: str = "1 day") -> DataFrame:
    """Pairs of `points` and `intervals` whose [start, end) has the point's time; both sides keep their columns, which must differ.

    An interval is dealt to each bucket of time that it touches, and a point to its own, so the pairs
    come of an equi-join; points of one moment are split as any join's. Intervals that end before they
    start, and null times, meet nothing.
    """
    at = lambda c: F.window(c, bucket)["start"]
    held = intervals.where(F.col(start) < F.col(end))
    first = F.date_trunc("microsecond", at(F.col(start)))
    last = at(F.col(end) - F.expr("interval 1 microsecond"))
    held = held.withColumn("_bucket", F.explode(F.sequence(first, last, F.expr(f"interval {bucket}"))))
    dealt = points.where(F.col(time).isNotNull()).withColumn("_bucket", at(F.col(time)))
    return dealt.join(held, "_bucket").where((F.col(time) >= F.col(start)) & (F.col(time) < F.col(end))).drop("_bucket")
