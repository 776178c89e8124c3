"""Sampling, merging, contamination and other set operations of dataset curation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnwise.functions import text as T


def hash_sample(rows: DataFrame, key: str, fraction: float) -> DataFrame:
    """Rows whose key's hash lies below the fraction: the same rows in each run, and nested in the fraction."""
    return rows.where(T.hash_fraction(F.col(key)) < fraction)


def nested_subsample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """The n rows first in a seeded hash order; smaller samples are within larger ones."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    return rows.orderBy(order, key).limit(n)


def merge_last_wins(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Of the rows of each key the last in `order`; partial aggregation, so a hot key costs no task its rows."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last")).select(*keys, *[F.col("last")[c].alias(c) for c in rest])


def _held(train_text: str, held: DataFrame, held_text: str) -> tuple[DataFrame, Column]:
    texts = held.select(F.col(held_text).alias("held_text")).distinct().withColumn("held_sha", F.sha2("held_text", 256))
    return texts, (F.sha2(F.col(train_text), 256) == F.col("held_sha")) & (F.col(train_text) == F.col("held_text"))


def limit_in_order(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in their order, say that of lines in files."""
    return rows.orderBy(*order).limit(n)


def not_done(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys are not among those done, so that a job can be run again."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def contaminated(train: DataFrame, held: DataFrame, train_text: str = "text", held_text: str = "text") -> DataFrame:
    """Training rows whose exact text is in the held-out set. Texts meet by their hash, and are compared where it is equal."""
    return train.join(*_held(train_text, held, held_text), "left_semi")


def clean(train: DataFrame, held: DataFrame, train_text: str = "text", held_text: str = "text") -> DataFrame:
    """Training rows whose exact text is not in the held-out set; null texts are in none."""
    return train.join(*_held(train_text, held, held_text), "left_anti")


def require_unique(rows: DataFrame, key: str) -> DataFrame:
    """The keys that occur more than once, with their counts."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def unique_by(rows: DataFrame, key: str) -> DataFrame:
    """One row for each key, the least in order of its other columns; partial results are taken before rows are dealt out."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min(F.struct(*rest)).alias("r")).select(key, "r.*").select(*rows.columns)


def validate_notices(notices: DataFrame, prefix: str, genres: list[str]) -> DataFrame:
    """(notice_id, problems array<string>): what of each notice is not as its metadata says."""
    text = F.col("notice_text")
    problems = F.array(
        F.when(~F.startswith("notice_id", F.lit(prefix)), "id"),
        F.when(~F.col("genre").isin(genres), "genre"),
        F.when(F.col("deadline").isNotNull() & ~F.contains(text, F.col("deadline")), "deadline"),
        F.when(~F.forall("amounts", lambda a: F.contains(text, a)), "amounts"),
        F.when(F.col("rare_term").isNotNull() & ~F.contains(F.lower(text), F.lower("rare_term")), "rare_term"),
        F.when(F.col("outer_date").isNotNull() & ~F.contains(text, F.col("outer_date")), "outer_date"),
    )
    return notices.select("notice_id", F.filter(problems, lambda p: p.isNotNull()).alias("problems"))


def side_by_side(summary: DataFrame, base: str, tuned: str, metrics: list[str]) -> DataFrame:
    """(metric, base, tuned, change): two models' metrics as rows."""
    pair = summary.where(F.col("model").isin(base, tuned))
    long = pair.select("model", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("x")).select("model", "x.*")
    wide = long.groupBy("metric").agg(F.max(F.when(F.col("model") == base, F.col("value"))).alias("base"), F.max(F.when(F.col("model") == tuned, F.col("value"))).alias("tuned"))
    return wide.withColumn("change", F.bround(F.col("tuned") - F.col("base"), 6))


def markdown_table(rows: DataFrame, columns: list[str], *order: str) -> DataFrame:
    """(place, line): a markdown table in order, header and rule line first. For summaries: places are given in one task."""
    heads = ["| " + " | ".join(columns) + " |", "| " + " | ".join("---" for _ in columns) + " |"]
    head = rows.sparkSession.range(1).select(F.explode(F.array(*[F.struct(F.lit(i - 2).alias("place"), F.lit(x).alias("line")) for i, x in enumerate(heads)])).alias("x")).select("x.*")
    place = (F.row_number().over(Window.orderBy(*order)) - 1).alias("place")
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return head.union(rows.select(place, F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line")))


def grid(scenarios: DataFrame, models: list[str], strategies: list[str]) -> DataFrame:
    """A row for each model, strategy and scenario to run; models and strategies are short lists."""
    names = lambda xs: F.explode(F.array(*map(F.lit, xs)))
    return scenarios.withColumn("model", names(models)).withColumn("strategy", names(strategies))


def with_scenario(records: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Records with their scenario; a record without one keeps its id and an empty notice."""
    found = scenarios.select(F.col("id").alias("scenario_id"), "category", "notice_text")
    return records.join(found, "scenario_id", "left").withColumn("category", F.coalesce("category", F.lit("clean"))).withColumn("notice_text", F.coalesce("notice_text", F.lit("")))


def weighted_choice(key: Column, seed: int, weights: dict[str, int]) -> Column:
    """A name drawn by weight from the hash of the key, the same in each run."""
    at = T.hash_fraction(F.concat(F.lit(f"{seed}:"), key.cast("string"))) * sum(weights.values())
    total, chosen = 0, None
    for name, w in weights.items():
        total += w
        chosen = F.when(at < total, name) if chosen is None else chosen.when(at < total, name)
    return chosen.otherwise(name)


def contrast_pairs(n: int) -> int:
    """Pairs of contrast twins in a plan of n dialogs: 17.5 % of it in twos, at least one from 6 dialogs on."""
    pairs = int(round(0.175 * n)) // 2
    return max(pairs, 1) if n >= 6 else pairs


def contrast_pairs_of(n: Column) -> Column:
    """contrast_pairs() of a column of plan sizes."""
    pairs = F.floor(F.bround(n * 0.175, 0) / 2)
    return F.when(n >= 6, F.greatest(pairs, F.lit(1))).otherwise(pairs).cast("long")


def broken_twins(turns: DataFrame) -> DataFrame:
    """Contrast groups in which the term is not in a follow-up of exactly the twin that uses it.

    turns(contrast_group, contrast_role, contrast_term, turn, text) of the user.
    """
    used = turns.where("turn > 0").withColumn("has", F.contains(F.lower("text"), F.lower("contrast_term")))
    by = used.groupBy("contrast_group").agg(F.bool_or(F.when(F.col("contrast_role") == "used", F.col("has"))).alias("in_used"), F.bool_or(F.when(F.col("contrast_role") == "absent", F.col("has"))).alias("in_absent"))
    return by.where("not coalesce(in_used, false) or coalesce(in_absent, false)").select("contrast_group")


def bait_top_up(dialogs: DataFrame, share: float = 0.30, seed: int = 0, may: Column | None = None) -> DataFrame:
    """dialogs(dialog_id, n_turns, bait) with `change`: how many more need bait, first in hash order
    of those without, and where `may` holds.

    `replace` puts it in place of the last turn where there are 4 or more, `append` behind it.
    """
    n = dialogs.agg(F.count("*").alias("n"), F.count_if("bait").alias("baits"))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("dialog_id").cast("string")), 256)
    need = n.select(F.greatest(F.bround(F.col("n") * share, 0) - F.col("baits"), F.lit(0)).cast("long").alias("need")).first()["need"]
    may_be = dialogs.where(~F.col("bait")).where(may if may is not None else F.lit(True)).select("dialog_id", order.alias("at"))
    # Whole buckets of the hash order are taken by their counts; only the bucket that the limit cuts is sorted.
    bucket = F.conv(F.substring("at", 1, 3), 16, 10).cast("int")
    counts = sorted((r.bucket, r.n) for r in may_be.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).collect())
    cut, before = 0, 0
    for cut, rows in counts:
        if before + rows >= need:
            break
        before += rows
    last = may_be.where(bucket == cut).orderBy("at", "dialog_id").limit(int(need - before))
    chosen = may_be.where(bucket < cut).unionByName(last).select(F.col("dialog_id").alias("chosen_id"))
    joined = dialogs.join(chosen, F.col("dialog_id") == F.col("chosen_id"), "left")
    change = F.when(F.col("chosen_id").isNotNull(), F.when(F.col("n_turns") >= 4, "replace").otherwise("append"))
    return joined.withColumn("change", change).drop("chosen_id")


def rate_panel(events: DataFrame, gap_seconds: int = 1800) -> DataFrame:
    """Sessions of users by gaps in their events: (user_id, session, n_events, started, ended)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = (F.col("ts").cast("double") - F.lag(F.col("ts").cast("double")).over(w)) > gap_seconds
    marked = events.withColumn("new", F.coalesce(gap.cast("int"), F.lit(0)))
    numbered = marked.withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("user_id", "session").agg(F.count("*").alias("n_events"), F.min("ts").alias("started"), F.max("ts").alias("ended"))
