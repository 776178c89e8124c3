"""Queries over rule verdicts and their roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnwise.functions import text as T
from turnwise.operators import curation, metrics, rules, turns
from turnwise.plans import derived
from turnwise.plans.derived import DUCK
from turnwise.plans.registry import query
from turnwise.sources.tables import table

_TEXT_OF = "array_join(transform({0}, x -> {1}), '; ')"


@query("SELECT conv_id, turn, CAST(greatest(1, len(regexp_extract_all(text, '[A-Za-z][A-Za-z''’-]*'))) AS BIGINT) AS word_count, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS reply_index FROM conversations WHERE role = 'assistant'")
def word_count_by_turn(spark, sf):
    return turns.reply_index(table(spark, sf, "conversations")).select("conv_id", "turn", T.word_count(F.col("text")).alias("word_count"), "reply_index")


@query(DUCK + "SELECT conv_id, turn, v.rule AS rule, v.detail AS detail FROM (SELECT conv_id, turn, unnest(violations) AS v FROM d_checked)")
def reply_violations(spark, sf):
    return derived.checked(spark, sf).select("conv_id", "turn", F.explode("violations").alias("v")).select("conv_id", "turn", "v.rule", "v.detail")


def _rule(name):
    return DUCK + f"SELECT conv_id, turn, v.detail AS detail FROM (SELECT conv_id, turn, unnest(violations) AS v FROM d_checked) WHERE v.rule = '{name}'"


def _one_rule(df, expression):
    return df.select("conv_id", "turn", F.explode(expression).alias("v")).select("conv_id", "turn", "v.detail")


def _replies(spark, sf):
    return derived.replies(spark, sf)


@query(_rule("advice_given"))
def advice_tripwire(spark, sf):
    return _one_rule(_replies(spark, sf), rules.advice(F.col("text")))


@query(_rule("missing_scaffold"))
def scaffold_first_reply(spark, sf):
    return _one_rule(_replies(spark, sf), rules.scaffold(F.col("text"), F.col("first_reply")))


@query(_rule("missing_banner"))
def banner_first_reply(spark, sf):
    return _one_rule(_replies(spark, sf), rules.banner(F.col("text"), F.col("first_reply"), F.col("adverse")))


@query(_rule("missing_operative_deadline"))
def deadline_verbatim(spark, sf):
    return _one_rule(_replies(spark, sf), rules.deadline(F.col("text"), F.col("deadline")))


@query(_rule("fabricated_quote"))
def fabricated_quotes(spark, sf):
    return _one_rule(_replies(spark, sf), F.filter(rules.quotes(F.col("text"), F.col("notice_text")), lambda v: v["rule"] == "fabricated_quote"))


@query(_rule("paraphrased_anchor"))
def anchor_diff(spark, sf):
    return _one_rule(_replies(spark, sf), rules.anchors(F.col("text"), F.col("known_anchors")))


@query(
    DUCK
    + "SELECT conv_id, kind, anchor FROM ("
    + " UNION ALL ".join(f"SELECT conv_id, '{k}' AS kind, unnest(regexp_extract_all(notice_text, {rx})) AS anchor FROM d_notices" for k, rx in derived.DUCK_ANCHORS.items())
    + ")"
)
def anchor_extract(spark, sf):
    return derived.notices(spark, sf).select("conv_id", F.explode(T.anchors(F.col("notice_text"))).alias("a")).select("conv_id", "a.*")


@query(DUCK + "SELECT conv_id, turn, unnest(contents) AS content FROM d_quotes")
def quote_spans(spark, sf):
    return _replies(spark, sf).select("conv_id", "turn", F.explode(T.quote_contents(F.col("text"))).alias("content"))


@query(DUCK + "SELECT conv_id, turn, quoted, quoted_ratio FROM d_checked")
def quote_ratio(spark, sf):
    return _replies(spark, sf).select("conv_id", "turn", T.quoted_chars(F.col("text")).alias("quoted"), F.bround(T.quote_ratio(F.col("text")), 4).alias("quoted_ratio"))


@query(DUCK + "SELECT conv_id, turn, unnest(advisory) AS anchor FROM d_checked")
def modal_advisory(spark, sf):
    rows = _replies(spark, sf)
    return rows.select("conv_id", "turn", F.explode(rules.modals(F.col("text"), F.col("bound_anchors"))).alias("v")).select("conv_id", "turn", F.col("v.detail").alias("anchor"))


@query(
    DUCK
    + "SELECT conv_id, turn, word_count, n_violations, per_100_words, n_advisory, quoted_ratio, strict_pass, coalesce(array_to_string(list_sort(list_transform(list_distinct(rule_list), lambda r: r || ':' || len(list_filter(rule_list, lambda x: x = r)))), '; '), '') AS by_rule FROM d_metrics"
)
def reply_metrics(spark, sf):
    m = metrics.reply_metrics(derived.checked(spark, sf)).drop("advisory_by_rule")
    entries = F.transform(F.map_entries("by_rule"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
    return m.withColumn("by_rule", F.array_join(F.array_sort(entries), "; "))


@query(DUCK + "SELECT conv_id, n_replies, total_words, total_violations, total_advisory, per_100_words, strict_pass FROM d_series")
def conversation_series(spark, sf):
    """Flagship: every conversation's strict pass and densities."""
    return metrics.conversation_series(derived.notices(spark, sf).select("conv_id"), metrics.reply_metrics(derived.checked(spark, sf)))


@query(
    """WITH r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, coalesce(text, '') AS t FROM conversations WHERE role = 'assistant'),
c AS (SELECT conv_id, greatest(1, len(regexp_extract_all(t, '[A-Za-z][A-Za-z''’-]*'))) AS w,
  CASE WHEN i = 1 AND NOT (contains(t, 'What this letter says') AND contains(t, 'What it asks you to do') AND contains(t, 'By when')) THEN 1 ELSE 0 END AS bad FROM r),
s AS (SELECT conv_id, count(*) AS n, CAST(sum(w) AS BIGINT) AS w, CAST(sum(bad) AS BIGINT) AS bad FROM c GROUP BY conv_id)
SELECT c.conv_id, coalesce(n, 0) AS n_replies, CAST(greatest(1, coalesce(w, 0)) AS BIGINT) AS total_words, coalesce(bad, 0) AS total_violations, coalesce(bad, 0) = 0 AS strict_pass FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s USING (conv_id)"""
)
def conversations_without_replies(spark, sf):
    """Conversations without a notice: of those without an assistant turn each passes, with 1 word; first replies of others lack the section markers."""
    said = table(spark, sf, "conversations")
    replies = turns.user_texts_before(said).select("*", F.lit("").alias("notice_text"), F.lit(None).cast("string").alias("deadline"), F.lit(False).alias("adverse"))
    checked = rules.check_replies(replies)
    return metrics.conversation_series(said, metrics.reply_metrics(checked)).select("conv_id", "n_replies", "total_words", "total_violations", "strict_pass")


_SUMMARY = (
    DUCK
    + """, d_top AS (SELECT model, strategy, array_to_string(list(k || ':' || n ORDER BY n DESC, k)[1:3], '; ') AS top FROM (
  SELECT model, strategy, k, count(*) AS n FROM (SELECT model, strategy, unnest(rule_list) AS k FROM d_records) GROUP BY ALL) GROUP BY model, strategy),
d_summary AS (SELECT model, strategy, count(*) AS n, count(*) FILTER (strict_pass) AS n_pass, count(*) FILTER (category = 'adversarial') AS n_adv,
  count(*) FILTER (category = 'adversarial' AND strict_pass) AS n_adv_pass, round_even(CAST(sum(CAST(per_100_words AS DECIMAL(20,2))) AS DOUBLE) / count(*), 2) AS mean_per_100_words,
  CAST(sum(total_advisory) AS BIGINT) AS softened, CAST(sum(len(list_filter(rule_list, lambda x: x IN ('paraphrased_anchor', 'missing_operative_deadline')))) AS BIGINT) AS anchor_breaks,
  count(*) FILTER (judged) AS n_judged, count(*) FILTER (judged AND judge_pass) AS n_judge_pass,
  n_pass / n AS adherence, n_adv_pass / nullif(n_adv, 0) AS robustness, n_judge_pass / nullif(n_judged, 0) AS judge_pass_rate FROM d_records GROUP BY model, strategy)
"""
)


@query(_SUMMARY + "SELECT d_summary.*, coalesce(top, 'none') AS top_violations FROM d_summary LEFT JOIN d_top USING (model, strategy)")
def strict_pass_by_group(spark, sf):
    return metrics.aggregate(derived.records(spark, sf))


@query(_SUMMARY + "SELECT model, strategy, coalesce(top, 'none') AS top_violations FROM d_summary LEFT JOIN d_top USING (model, strategy)")
def top3_violations(spark, sf):
    return metrics.aggregate(derived.records(spark, sf)).select("model", "strategy", "top_violations")


_LONG = " UNION ALL ".join(f"SELECT '{m}' AS metric, model, CAST(sum({m}) AS DOUBLE) AS value FROM d_summary GROUP BY model" for m in ("n", "n_pass", "softened", "anchor_breaks"))


@query(_SUMMARY + f", l AS ({_LONG}) SELECT metric, max(value) FILTER (model = 'base') AS base, max(value) FILTER (model = 'tuned') AS tuned, max(value) FILTER (model = 'tuned') - max(value) FILTER (model = 'base') AS change FROM l GROUP BY metric")
def side_by_side(spark, sf):
    names = ["n", "n_pass", "softened", "anchor_breaks"]
    by_model = metrics.aggregate(derived.records(spark, sf)).groupBy("model").agg(*[F.sum(m).alias(m) for m in names])
    return curation.side_by_side(by_model, "base", "tuned", names)


@query(
    _SUMMARY
    + """SELECT CAST(row_number() OVER (ORDER BY model, strategy) - 1 AS INTEGER) AS place, '| ' || model || ' | ' || strategy || ' | ' || n || ' | ' || n_pass || ' | ' || softened || ' | ' || anchor_breaks || ' |' AS line FROM d_summary
UNION ALL SELECT -2, '| model | strategy | n | n_pass | softened | anchor_breaks |' UNION ALL SELECT -1, '| --- | --- | --- | --- | --- | --- |'"""
)
def summary_markdown(spark, sf):
    """The summary as a markdown table, by model and strategy."""
    return curation.markdown_table(metrics.aggregate(derived.records(spark, sf)), ["model", "strategy", "n", "n_pass", "softened", "anchor_breaks"], "model", "strategy")


@query(DUCK + "SELECT CAST(reply_index AS INTEGER) AS reply_index, count(*) AS n, count(*) FILTER (strict_pass) AS n_pass, round_even(avg(CAST(strict_pass AS INTEGER)), 4) AS pass_rate FROM d_metrics GROUP BY reply_index")
def drift_by_turn_index(spark, sf):
    return metrics.by_turn_index(metrics.reply_metrics(derived.checked(spark, sf), ["reply_index"]))


@query(DUCK + "SELECT rule, count(*) AS flags, count(*) FILTER (adverse) AS true_flags, count(*) FILTER (NOT adverse) AS false_flags FROM (SELECT conv_id, unnest(violations).rule AS rule FROM d_checked) JOIN (SELECT conv_id, adverse FROM d_notices) USING (conv_id) GROUP BY rule")
def rule_precision(spark, sf):
    rows = derived.checked(spark, sf).select(F.explode("violations").alias("v"), "adverse").select("v.rule", "adverse")
    return metrics.rule_precision(rows, "adverse")
