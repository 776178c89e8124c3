"""Roll-ups of verdicts: turn, conversation, model and strategy, and against human labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions import text as T


def counted(violations: Column) -> Column:
    """map<rule, long> of an array of violations, by rule."""
    rules = F.transform(violations, lambda v: v["rule"])
    return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(rules)), lambda r: F.struct(r, F.size(F.filter(rules, lambda x: x == r)).cast("long"))))


def per_100_words(n: Column, words: Column) -> Column:
    return F.bround(n * F.lit(100.0) / F.greatest(words, F.lit(1)), 2)


def reply_metrics(checked: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Counts and density of each checked reply, with the columns `keep`; advisory flags are counted apart and don't fail it."""
    n = F.size("violations").cast("long")
    return checked.select(
        "conv_id", "turn", *(keep or ()), "word_count", n.alias("n_violations"), per_100_words(n, F.col("word_count")).alias("per_100_words"), counted(F.col("violations")).alias("by_rule"),
        F.size("advisory").cast("long").alias("n_advisory"), counted(F.col("advisory")).alias("advisory_by_rule"), "quoted_ratio", (n == 0).alias("strict_pass"),
    )


def merged(maps: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Sum of map<string, long> columns by key: (keys, column)."""
    counts = maps.select(*keys, F.explode(column).alias("k", "n")).groupBy(*keys, "k").agg(F.sum("n").alias("n"))
    return counts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(column))


def conversation_series(conversations: DataFrame, metrics: DataFrame) -> DataFrame:
    """Totals of each conversation of `conversations`(conv_id); one without replies passes, with 1 word."""
    sums = metrics.groupBy("conv_id").agg(
        F.sum("word_count").alias("words"), F.sum("n_violations").alias("violations"), F.sum("n_advisory").alias("advisory"), F.bool_and("strict_pass").alias("strict_pass"), F.count("*").alias("n_replies")
    )
    rows = conversations.select("conv_id").distinct().join(sums, "conv_id", "left")
    words = F.greatest(F.coalesce("words", F.lit(0)), F.lit(1)).cast("long")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return rows.select(
        "conv_id", zero("n_replies").alias("n_replies"), words.alias("total_words"), zero("violations").alias("total_violations"), zero("advisory").alias("total_advisory"),
        per_100_words(zero("violations"), words).alias("per_100_words"), F.coalesce("strict_pass", F.lit(True)).alias("strict_pass"),
    )


def conversation_records(checked: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """strict_pass, per_100_words, by_rule and advisory_by_rule of each checked conversation, with its columns `carry`, in one shuffle."""
    together = lambda c: F.flatten(F.collect_list(c))  # noqa: E731  of one conversation
    sums = checked.groupBy("conv_id").agg(F.sum("word_count").alias("words"), together("violations").alias("violations"), together("advisory").alias("advisory"), *[F.first(c).alias(c) for c in carry or ()])
    n = F.size("violations").cast("long")
    return sums.select(
        "conv_id", *(carry or ()), (n == 0).alias("strict_pass"), per_100_words(n, F.col("words")).alias("per_100_words"), counted(F.col("violations")).alias("by_rule"), counted(F.col("advisory")).alias("advisory_by_rule")
    )


def aggregate(records: DataFrame) -> DataFrame:
    """Summary of (model, strategy) from conversation records
    (model, strategy, category, strict_pass, per_100_words, by_rule, advisory_by_rule, judged, judge_pass).

    The density is the mean of the conversations' own, rounded. Rates without a base are null.
    """
    keys = ["model", "strategy"]
    hard = F.col("category") == "adversarial"
    of = lambda m, rule: F.coalesce(F.try_element_at(m, F.lit(rule)), F.lit(0))
    # One pass: each record gives a row of its measures, without a rule, and a row for each of its rules.
    measures = F.struct(
        F.lit(1).alias("n"), F.col("strict_pass").cast("int").alias("n_pass"), hard.cast("int").alias("n_adv"), (hard & F.col("strict_pass")).cast("int").alias("n_adv_pass"),
        F.col("per_100_words").cast("decimal(20,2)").alias("density"), (of("by_rule", "softened_modal") + of("advisory_by_rule", "softened_modal")).alias("softened"),
        (of("by_rule", "paraphrased_anchor") + of("by_rule", "missing_operative_deadline")).alias("anchor_breaks"),
        F.coalesce(F.col("judged"), F.lit(False)).cast("int").alias("n_judged"), F.coalesce(F.col("judged") & F.col("judge_pass"), F.lit(False)).cast("int").alias("n_judge_pass"),
    )
    names = ["n", "n_pass", "n_adv", "n_adv_pass", "density", "softened", "anchor_breaks", "n_judged", "n_judge_pass"]
    rows = records.withColumn("m", measures).select(*keys, "m", F.explode_outer(F.concat(F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit(0).cast("long").alias("value"))), F.map_entries("by_rule"))).alias("r"))
    own = F.col("r.key").isNull()
    by_rule = rows.groupBy(*keys, F.col("r.key").alias("rule")).agg(F.sum("r.value").alias("v"), *[F.sum(F.when(own, F.col(f"m.{c}"))).alias(c) for c in names])
    listed = F.when(F.col("rule").isNotNull(), F.struct("rule", "v"))
    sums = by_rule.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in names], F.map_from_entries(F.collect_list(listed)).alias("all"))
    mean = F.bround(F.col("density").cast("double") / F.col("n"), 2).alias("mean_per_100_words")
    joined = sums.select(*keys, "n", "n_pass", "n_adv", "n_adv_pass", mean, "softened", "anchor_breaks", "n_judged", "n_judge_pass", T.histogram(F.col("all"), 3).alias("top_violations"))
    rate = lambda a, b, name: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")).alias(name)
    return joined.select("*", rate("n_pass", "n", "adherence"), rate("n_adv_pass", "n_adv", "robustness"), rate("n_judge_pass", "n_judged", "judge_pass_rate"))


def roll_up(records: DataFrame, levels: list[str] | None = None) -> DataFrame:
    """Counts and passes of records(strict_pass, per_100_words, and the columns of the levels) at every level of a hierarchy, from each group to all, in one pass.

    `level` is how many of the last levels are summed over; their columns are null there, and a null
    value of a record is a group of its own.
    """
    levels = levels or ["model", "strategy", "category"]
    zeros = F.lit(0).cast("long")
    sums = records.rollup(*levels).agg(
        F.bit_count(F.grouping_id()).cast("int").alias("level"), F.count("*").alias("n"), F.count_if("strict_pass").alias("n_pass"),
        F.coalesce(F.sum(F.aggregate(F.map_values("by_rule"), zeros, lambda s, n: s + n)), zeros).alias("violations"), F.sum(F.col("per_100_words").cast("decimal(20,2)")).alias("density"),
    )
    mean = F.bround(F.col("density").cast("double") / F.col("n"), 2).alias("mean_per_100_words")
    return sums.select(*levels, "level", "n", "n_pass", F.bround(F.col("n_pass") / F.col("n"), 4).alias("adherence"), "violations", mean)


def daily_sketches(events: DataFrame, value: str, user: str, time: str = "ts") -> DataFrame:
    """(day, n, users, values): sketches of each day's distinct users and of its values, to be stored and merged."""
    return events.groupBy(F.to_date(time).alias("day")).agg(F.count("*").alias("n"), F.hll_sketch_agg(user, F.lit(12)).alias("users"), F.kll_sketch_agg_double(F.col(value).cast("double")).alias("values"))


def merged_sketches(days: DataFrame, *by, ranks: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """(by..., n, users, quantiles) of stored daily sketches: distinct users and quantiles of values over all days of a group, without their events.

    Distinct counts are off by 1.6 % in two of three cases, ranks of quantiles by 1.3 % at most in 99 of 100.
    """
    sums = days.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("users").alias("all_users"), F.kll_merge_agg_double("values").alias("all_values"))
    keys = [c for c in sums.columns if c not in ("n", "all_users", "all_values")]
    return sums.select(*keys, "n", F.hll_sketch_estimate("all_users").alias("users"), F.kll_sketch_get_quantile_double("all_values", F.array(*map(F.lit, ranks))).alias("quantiles"))


def by_turn_index(metrics: DataFrame) -> DataFrame:
    """Share of strict passes at each place among the replies of a conversation."""
    return metrics.groupBy("reply_index").agg(F.count("*").alias("n"), F.count_if("strict_pass").alias("n_pass"), F.bround(F.avg(F.col("strict_pass").cast("int")), 4).alias("pass_rate"))


def confusion(rows: DataFrame, flagged: str, actual: str) -> DataFrame:
    """Counts and rates of a flag against the human label, false positive and negative by all rows; one row."""
    f, a = F.col(flagged), F.col(actual)
    counts = rows.agg(F.count("*").alias("n"), F.count_if(f & a).alias("tp"), F.count_if(f & ~a).alias("fp"), F.count_if(~f & a).alias("fn"), F.count_if(~f & ~a).alias("tn"))
    rate = lambda x, name: F.bround(F.try_divide(x.cast("double"), F.col("n")), 4).alias(name)
    return counts.select("*", rate(F.col("fp"), "fp_rate"), rate(F.col("fn"), "fn_rate"), rate(F.col("tp") + F.col("tn"), "agreement"), F.bround(F.try_divide(F.col("fp").cast("double"), F.col("tp") + F.col("fp")), 4).alias("fp_of_flagged"))


def gate(counts: DataFrame, most: float = 0.05) -> DataFrame:
    """Whether the false positives of a confusion row are under the limit; null without rows."""
    return counts.select("n", "fp", F.try_divide(F.col("fp").cast("double"), F.col("n")).alias("fp_share"), (F.try_divide(F.col("fp").cast("double"), F.col("n")) < most).alias("passed"))


def disagreements(rows: DataFrame, before: str, after: str, actual: str) -> DataFrame:
    """How a second version of a flag differs from labels where the first did, or newly: counts by class."""
    b, f, a = F.col(before), F.col(after), F.col(actual)
    kind = F.when((b != a) & (f == a), "resolved").when((b & ~a) & (f & ~a), "residual_fp").when((~b & a) & (~f & a), "still_fn").when((b == a) & (f != a), "new").otherwise("agree")
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def rule_precision(flags: DataFrame, actual: str) -> DataFrame:
    """Of each rule's flags (a row each), how many rows are labelled so."""
    return flags.groupBy("rule").agg(F.count("*").alias("flags"), F.count_if(F.col(actual)).alias("true_flags"), F.count_if(~F.col(actual)).alias("false_flags"))


def build_stats(dialogs: DataFrame) -> DataFrame:
    """One row of rates over dialogs(accepted, discard_reason, first_passed, first_checked, repairs,
    repairs_tried, bait, contrast_group, api_calls). Repairs count discarded dialogs too.
    """
    rate = lambda a, b, name: F.bround(F.try_divide(F.col(a).cast("double"), F.col(b)), 4).alias(name)
    sums = dialogs.agg(
        F.count("*").alias("planned"), F.count_if("accepted").alias("accepted"), F.sum("first_checked").alias("first_checked"), F.sum("first_passed").alias("first_passed"), F.sum("repairs").alias("repairs"),
        F.sum("repairs_tried").alias("repairs_tried"), F.count_if("bait").alias("bait"), F.countDistinct("contrast_group").alias("contrast_groups"), F.sum("api_calls").alias("api_calls"),
    )
    return sums.select("*", rate("accepted", "planned", "acceptance"), rate("first_passed", "first_checked", "first_pass_rate"), rate("repairs", "repairs_tried", "repair_rate"))


def first_pass_histogram(verdicts: DataFrame) -> DataFrame:
    """(rule, n): the violations of the first attempts at replies, verdicts(violations), of all dialogs, discarded ones too."""
    return verdicts.select(F.explode("violations").alias("v")).groupBy("v.rule").agg(F.count("*").alias("n"))


def untrainable(rows: DataFrame, labels: str = "labels") -> DataFrame:
    """(n, dropped): rows, and those of them without any label to train on, which are dropped; -100 is masked. Null labels have none."""
    idle = F.coalesce(F.forall(labels, lambda x: x == -100), F.lit(True))
    return rows.agg(F.count("*").alias("n"), F.count_if(idle).alias("dropped"))


def trainable(rows: DataFrame, labels: str = "labels") -> DataFrame:
    """The rows with a label to train on."""
    return rows.where(F.exists(labels, lambda x: x != -100))


def strata(rows: DataFrame, minimums: dict[str, int], column: str = "category") -> DataFrame:
    """Counts by category against the least that each must have; categories without rows count 0."""
    spark = rows.sparkSession
    wanted = spark.createDataFrame(sorted(minimums.items()), f"{column} string, minimum int")
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    return wanted.join(counts, column, "left").select(column, "minimum", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) >= F.col("minimum")).alias("enough"))


def loss_curve(log: DataFrame, run: str = "run") -> DataFrame:
    """First, last and least loss of each run's log(run, step, loss, elapsed_s), steps and seconds a step."""
    rows = log.groupBy(run).agg(
        F.count("*").alias("steps"), F.min_by("loss", "step").alias("first_loss"), F.max_by("loss", "step").alias("last_loss"), F.min("loss").alias("least_loss"), F.max("elapsed_s").alias("wall_s")
    )
    return rows.withColumn("s_per_step", F.try_divide("wall_s", "steps"))
