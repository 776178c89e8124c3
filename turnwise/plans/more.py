"""Queries over single functions and small steps: word forms, places, policies, prompts, completions."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnwise.functions import text as T
from turnwise.functions import wordforms as W
from turnwise.operators import curation, infer, lexicon, metrics, repair, rules, turns
from turnwise.plans import derived
from turnwise.plans.corpus import _TOP
from turnwise.plans.derived import DUCK, _sql
from turnwise.plans.registry import query
from turnwise.sources import files, staging
from turnwise.sources.tables import table

_MARKED = "CASE conv_id % 4 WHEN 0 THEN '<think>a plan</think>  ' || text || ' ' WHEN 1 THEN '<THINK>x</THINK>' || text WHEN 2 THEN text || ' <think>' ELSE text END"


@query(f"SELECT conv_id, turn, CASE WHEN NOT regexp_matches(r, '</?think>') THEN regexp_replace(r, '^\\s+|\\s+$', '', 'g') END AS stripped FROM (SELECT conv_id, turn, regexp_replace({_MARKED}, '(?s)<think>.*?</think>\\s*', '', 'g') AS r FROM conversations)")
def training_think_strip(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.strip_thinking(F.expr(_MARKED)).alias("stripped"))


@query(
    DUCK
    + ", p AS (SELECT conv_id, turn, lower(text) AS t FROM d_said WHERE regexp_matches(text, '(?i)\\bbenefit\\b')) SELECT conv_id, turn, CAST(instr(t, 'benefit') - 1 AS INTEGER) AS first_start, CAST(instr(t, 'benefit') + 6 AS INTEGER) AS first_end, CAST(len(regexp_extract_all(t, '\\bbenefit\\b')) AS INTEGER) AS n FROM p"
)
def word_places(spark, sf):
    """Where replies have a word as a whole word."""
    spans = T.word_spans(F.lit("benefit"), F.col("text"))
    rows = derived.replies(spark, sf).select("conv_id", "turn", spans.alias("s")).where("size(s) > 0")
    return rows.select("conv_id", "turn", F.col("s")[0]["start"].alias("first_start"), F.col("s")[0]["end"].alias("first_end"), F.size("s").alias("n"))


@query(_TOP + " SELECT lang, rank, regexp_replace(word || chr(39) || CASE WHEN rank % 2 = 0 THEN 's' ELSE '' END, '[''’]s$|[''’]$', '') AS bare FROM top WHERE rank <= 200")
def possessive_strip(spark, sf):
    top = lexicon.top_words(table(spark, sf, "documents"), 200)
    return top.select("lang", "rank", T.strip_possessive(F.concat("word", F.when(F.col("rank") % 2 == 0, "'s").otherwise("'"))).alias("bare"))


_CUT1 = "left(word, length(word) - 1)"
_IS_Y = "(ends_with(word, 'y') AND NOT regexp_matches(word, '[aeiou]y$'))"
_BASE = f"CASE WHEN regexp_matches(word, '^[^aeiou]*[aeiou][^aeiouwxy]$') THEN word || right(word, 1) WHEN ends_with(word, 'e') THEN {_CUT1} ELSE word END"
_INFLECTED = (
    f"[word, CASE WHEN {_IS_Y} THEN {_CUT1} || 'ies' WHEN regexp_matches(word, '(s|x|z|ch|sh)$') THEN word || 'es' ELSE word || 's' END, "
    f"CASE WHEN {_IS_Y} THEN {_CUT1} || 'ied' ELSE ({_BASE}) || 'ed' END, CASE WHEN ends_with(word, 'ee') THEN word ELSE {_BASE} END || 'ing']"
)


@query(_TOP + f", few AS (SELECT DISTINCT word FROM top WHERE rank <= 300) SELECT DISTINCT word, unnest({_INFLECTED}) AS form FROM few")
def inflected_forms(spark, sf):
    top = lexicon.top_words(table(spark, sf, "documents"), 300).select("word").distinct()
    return top.select("word", F.explode(W.inflections(F.col("word"))).alias("form"))


@query(_TOP + f", few AS (SELECT DISTINCT word FROM top WHERE rank <= 300), f AS (SELECT DISTINCT word, unnest({_INFLECTED}) AS form FROM few) SELECT DISTINCT word, {derived.duck_lemma('form')} AS family FROM f")
def word_families(spark, sf):
    top = lexicon.top_words(table(spark, sf, "documents"), 300).select("word").distinct()
    return top.select("word", F.explode(W.inflections(F.col("word"))).alias("form")).select("word", W.lemma(F.col("form")).alias("family")).distinct()


_PAIRS = "(VALUES " + ", ".join(f"('{w}', [{', '.join(_sql(f) for f in forms)}])" for w, forms in W.BRITISH_WORDS.items()) + ") t(word, forms)"
_BASES = "[" + ", ".join(map(_sql, [*W.BRITISH_WORDS, "cat"])) + "]"


@query(f"SELECT p_partkey, word, unnest(forms) AS form FROM (SELECT p_partkey, {_BASES}[p_partkey % {len(W.BRITISH_WORDS) + 1} + 1] AS word FROM part) JOIN {_PAIRS} USING (word)")
def british_word_pairs(spark, sf):
    """Spellings of the word that each part is given; the last of them has none."""
    given = table(spark, sf, "part").select("p_partkey", derived.pick([*W.BRITISH_WORDS, "cat"], F.col("p_partkey") % (len(W.BRITISH_WORDS) + 1)).alias("word"))
    return given.join(W.british_words(given), "word").select("p_partkey", "word", "form")


_IZE = "('izations', 'isations'), ('ization', 'isation'), ('izing', 'ising'), ('izes', 'ises'), ('ized', 'ised'), ('ize', 'ise'), ('izers', 'isers'), ('izer', 'iser'), ('yzing', 'ysing'), ('yzes', 'yses'), ('yzed', 'ysed'), ('yze', 'yse')"


@query(
    _TOP
    + f", few AS (SELECT DISTINCT word FROM top WHERE rank <= 100), f AS (SELECT DISTINCT unnest({_INFLECTED}) AS word FROM few) SELECT word FROM f "
    "UNION SELECT left(word, length(word) - length(x.a)) || x.b FROM f, (VALUES ('eled', 'elled'), ('eling', 'elling'), ('eler', 'eller'), ('elers', 'ellers')) x(a, b) WHERE ends_with(word, x.a) AND length(word) > length(x.a) + 2 "
    f"UNION SELECT left(word, length(word) - length(x.a)) || x.b FROM f, (VALUES {_IZE}) x(a, b) WHERE ends_with(word, x.a) AND length(word) > length(x.a) + 1 "
    "UNION SELECT unnest(['not', 'will', 'are', 'have', 'am', 'would', 'can', 'shall', 'us', 'is', 'medicaid'])"
)
def allowed_list(spark, sf):
    """The list built from the most common words; no other word is known, so none is derived from them."""
    top = lexicon.top_words(table(spark, sf, "documents"), 100).select("word").distinct()
    return lexicon.allowed(top, top, ["medicaid"])


@query(_TOP + f" SELECT DISTINCT lower(w) AS word FROM (SELECT unnest(regexp_extract_all({derived._BANNER}, '[A-Za-z]+')) AS w) WHERE lower(w) NOT IN (SELECT word FROM top WHERE lang = 'en' AND rank <= 1000)")
def banner_uncovered(spark, sf):
    """Words of the banner that are not among the most common ones of English documents."""
    return lexicon.uncovered(rules.BANNER, lexicon.top_words(table(spark, sf, "documents"), 1000).where("lang = 'en'"))


@query(DUCK + "SELECT DISTINCT conv_id AS notice_id, notice_text, deadline FROM d_said")
def unique_notices(spark, sf):
    """The notices that replies are about, each once."""
    said = derived.replies(spark, sf).select(F.col("conv_id").alias("notice_id"), "notice_text", "deadline")
    return curation.unique_by(said, "notice_id")


@query(
    "WITH v AS (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 5 AND l_discount < 0.09) SELECT (SELECT count(*) FROM lineitem) AS read, (SELECT count(*) FROM lineitem WHERE l_quantity < 5) AS few, "
    "(SELECT count(*) FROM lineitem WHERE l_discount >= 0.09) AS cheap, count(*) AS valid, count(DISTINCT l_orderkey) AS written, count(*) - count(DISTINCT l_orderkey) AS repeated FROM v"
)
def checked_write(spark, sf):
    """What came of each row of a write with rules and keys, told by the write itself."""
    path = staging.new_folder(spark, "checked")
    found = files.write_checked(table(spark, sf, "lineitem"), path, ["l_orderkey"], {"few": F.col("l_quantity") >= 5, "cheap": F.col("l_discount") < 0.09})
    # The figures beside what was written, whose keys are counted again as a check.
    rows = spark.read.parquet(path).agg(F.countDistinct("l_orderkey").alias("written"))
    return rows.select(*[F.lit(found[c]).cast("long").alias(c) for c in ("read", "few", "cheap", "valid")], "written", F.lit(found["repeated"]).cast("long").alias("repeated"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') AS missing, json_type(props) = 'OBJECT' AS whole, json_extract(props, '$.k') IS NOT NULL AS has_k FROM events")
def event_properties(spark, sf):
    """Fields of records whose keys no schema names."""
    record = F.try_parse_json("props")
    found = files.fields(record, {"k": ("$.k", "bigint"), "missing": ("$.none", "string")})
    return table(spark, sf, "events").select("event_id", *found, F.schema_of_variant(record).startswith("OBJECT").alias("whole"), F.variant_get(record, "$.k", "variant").isNotNull().alias("has_k"))


_SPEC = "['hf', 'api', 'local'][event_id % 3 + 1] || ':' || event_type || CASE WHEN event_id % 2 = 0 THEN ':v' || user_id ELSE '' END"


@query(
    f"SELECT event_id, split_part({_SPEC}, ':', 1) AS provider, substr({_SPEC}, instr({_SPEC}, ':') + 1) AS model, CASE WHEN event_id % 4 = 0 THEN event_id % 100 / 4.0 END AS wait_s, "
    "CASE WHEN event_id % 5 = 0 THEN '<|eot_id|>' ELSE '<|im_end|>' END AS end_mark FROM events"
)
def subjects_and_waits(spark, sf):
    """Provider and model of a specification, the wait that a message asks for, and the mark that ends a model's turns."""
    e, k = table(spark, sf, "events"), F.col("event_id")
    spec = F.concat(derived.pick(["hf", "api", "local"], k % 3), F.lit(":"), "event_type", F.when(k % 2 == 0, F.concat(F.lit(":v"), F.col("user_id").cast("string"))).otherwise(F.lit("")))
    message = F.when(k % 4 == 0, F.concat(F.lit("busy, retry in "), (k % 100 / 4.0).cast("string"), F.lit("s"))).otherwise(F.lit("failed"))
    model = F.when(k % 5 == 0, F.lit("Meta-Llama-3")).when(k % 5 == 1, F.lit("llama-qwen")).otherwise(F.lit("other"))
    return e.select("event_id", T.subject(spec)["provider"].alias("provider"), T.subject(spec)["model"].alias("model"), T.retry_seconds(message).alias("wait_s"), T.markers(model)["end"].alias("end_mark"))


@query(DUCK + "SELECT conv_id, turn, array_to_string(list_transform(violations, lambda v: '- ' || v.rule || ': ' || v.detail), chr(10)) AS prompt FROM d_checked WHERE len(violations) > 0")
def repair_prompts(spark, sf):
    """What each failed reply is asked to mend."""
    return derived.checked(spark, sf).where("size(violations) > 0").select("conv_id", "turn", repair.repair_prompt(F.col("violations")).alias("prompt"))


@query(DUCK + "SELECT model, v AS rule, count(*) AS n FROM (SELECT model, unnest(rule_list) AS v FROM d_records) GROUP BY model, v")
def rules_by_model(spark, sf):
    """Counts by rule of each conversation, added up by model."""
    sums = metrics.merged(derived.records(spark, sf), ["model"], "by_rule")
    return sums.select("model", F.explode("by_rule").alias("rule", "n"))


@query(DUCK + "SELECT v AS rule, count(*) AS n FROM (SELECT unnest(rule_list) AS v FROM d_metrics WHERE reply_index = 0) GROUP BY v")
def first_pass_violations(spark, sf):
    """The violations of first attempts, of dialogs that are discarded later too."""
    return metrics.first_pass_histogram(derived.checked(spark, sf, first=True))


@query("WITH o AS (SELECT l_orderkey, bool_or(l_quantity < 10) AS has_label FROM lineitem GROUP BY l_orderkey) SELECT count(*) AS n, count(*) FILTER (NOT has_label) AS dropped FROM o")
def untrainable_rows(spark, sf):
    """Rows without any label to train on."""
    label = F.when(F.col("l_quantity") < 10, F.col("l_linenumber").cast("int")).otherwise(F.lit(-100))
    return metrics.untrainable(table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(label).alias("labels")))


@query("SELECT count(*) AS n, CAST(CASE WHEN count(*) >= 6 THEN greatest(round_even(0.175 * count(*), 0) // 2, 1) ELSE round_even(0.175 * count(*), 0) // 2 END AS BIGINT) AS pairs FROM customer")
def contrast_allocation(spark, sf):
    """How many pairs of twins a plan of so many dialogs has."""
    rows = table(spark, sf, "customer").agg(F.count("*").alias("n"))
    return rows.select("n", curation.contrast_pairs_of(F.col("n")).alias("pairs"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(least(CAST(l_shipdate AS DATE), CAST(l_shipdate AS DATE) + CAST(l_linenumber - 3 AS INTEGER)), '%B %-d, %Y') AS clock FROM lineitem")
def earliest_clock(spark, sf):
    """The earliest of the dates that bind, as printed."""
    day = F.to_date("l_shipdate")
    printed = F.array(T.long_date(day), F.lit("soon"), T.long_date(F.date_add(day, F.col("l_linenumber").cast("int") - 3)))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", T.earliest(printed).alias("clock"))


@query("SELECT conv_id, turn FROM conversations ORDER BY conv_id, turn LIMIT 50")
def first_in_order(spark, sf):
    return curation.limit_in_order(table(spark, sf, "conversations").select("conv_id", "turn"), 50, "conv_id", "turn")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def still_to_do(spark, sf):
    """Documents without a label yet."""
    return curation.not_done(table(spark, sf, "documents"), table(spark, sf, "labels"), ["doc_id"]).select("doc_id")


@query(
    DUCK
    + """, i AS (SELECT *, CASE WHEN turn = 3 AND length(conv_id) % 2 = 0 THEN 'deadline_collapse' ELSE 'vocab' END AS intent FROM d_said)
SELECT conv_id, turn, policy, CASE WHEN policy = 'all' OR first_reply OR (policy = 'dataset' AND intent = 'deadline_collapse') THEN deadline END AS deadline, CASE WHEN policy = 'first' THEN first_reply AND adverse ELSE adverse END AS adverse FROM i, (VALUES ('all'), ('dataset'), ('first')) p(policy)"""
)
def metadata_policies(spark, sf):
    """The deadline and notice kind that each reply is held to, by policy."""
    rows = derived.replies(spark, sf).withColumn("intent", F.when((F.col("turn") == 3) & (F.length("conv_id") % 2 == 0), "deadline_collapse").otherwise("vocab"))
    found = [turns.metadata_for_turn(rows, p).select("conv_id", "turn", F.lit(p).alias("policy"), "deadline", "adverse") for p in ("all", "dataset", "first")]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(
    """WITH m AS (SELECT conv_id, list(role ORDER BY turn) AS r, list(role || ': ' || text ORDER BY turn) AS l FROM conversations GROUP BY conv_id)
SELECT conv_id, right(array_to_string(CASE WHEN r[-1] = 'assistant' THEN l[:-2] ELSE l END, chr(10)), 20) || '!' AS completion FROM m"""
)
def completions(spark, sf):
    """A stand-in for a model: the end of each prompt."""
    said = turns.messages(table(spark, sf, "conversations"))
    return infer.with_completions(said, lambda prompt: F.concat(F.right(prompt, F.lit(20)), F.lit("!"))).select("conv_id", "completion")


@query(
    DUCK
    + """, s AS (SELECT genre, count(*) AS n, count(*) FILTER (adverse) AS adverse FROM d_notices GROUP BY genre), l AS (SELECT row_number() OVER (ORDER BY genre) - 1 AS place, '| ' || genre || ' | ' || n || ' | ' || adverse || ' |' AS line FROM s)
SELECT CAST(place AS INTEGER) AS place, line FROM l UNION ALL SELECT -2, '| genre | n | adverse |' UNION ALL SELECT -1, '| --- | --- | --- |'"""
)
def genre_table(spark, sf):
    """A markdown table with its header."""
    sums = derived.notices(spark, sf).groupBy("genre").agg(F.count("*").alias("n"), F.count_if("adverse").alias("adverse"))
    return curation.markdown_table(sums, ["genre", "n", "adverse"], "genre")


_JUDGED = (
    derived.DUCK_TWICE
    + """, c AS (SELECT 'notice' || substr(conv_id, length(conv_id) - strpos(reverse(conv_id), '-') + 1) AS dialog_id, starts_with(conv_id, 'fixed') AS fixed, turn, violations FROM d_checked),
t AS (SELECT c.dialog_id, n.o_orderkey, max(len(violations)) FILTER (NOT fixed AND turn = 1) AS first, max(len(violations)) FILTER (fixed AND turn = 1) AS rewrite,
  max(len(violations)) FILTER (NOT fixed AND turn = 3) AS second, max(len(violations)) FILTER (fixed AND turn = 3) AS second_fixed FROM c JOIN d_once n ON n.conv_id = c.dialog_id GROUP BY ALL),
s AS (SELECT *, CASE WHEN o_orderkey % 11 = 0 THEN 'refusal' WHEN first > 0 AND o_orderkey % 13 = 0 THEN 'max_tokens' WHEN first > 0 AND rewrite > 0 THEN 'repair_failed' END AS early, CASE WHEN first > 0 THEN second_fixed ELSE second END AS last FROM t),
d AS (SELECT *, coalesce(early, CASE WHEN last > 0 THEN 'repair_failed' END) AS discard_reason, early IS NULL AND last IS NOT NULL AS went_on FROM s)
"""
)


@query(
    _JUDGED
    + """SELECT dialog_id, discard_reason IS NULL AS accepted, (o_orderkey % 11 <> 0 AND first > 0 AND o_orderkey % 13 <> 0 AND rewrite = 0)::BIGINT AS repairs,
  (o_orderkey % 11 <> 0 AND first > 0 AND o_orderkey % 13 <> 0)::BIGINT + (went_on AND last > 0)::BIGINT AS repairs_tried, (o_orderkey % 11 <> 0 AND first = 0)::BIGINT + (went_on AND last = 0)::BIGINT AS first_passed,
  (o_orderkey % 11 <> 0)::BIGINT + went_on::BIGINT AS first_checked, 1 + (o_orderkey % 11 <> 0 AND first > 0)::BIGINT + went_on::BIGINT + (went_on AND last > 0)::BIGINT AS calls, discard_reason,
  CAST(CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE first END + CASE WHEN went_on THEN last ELSE 0 END AS BIGINT) AS first_violations FROM d"""
)
def judged_dialogs(spark, sf):
    """Replies and rewrites judged by all rules on the state before their turn, which only those that pass change."""
    found = repair.judge_dialogs(derived.attempts(spark, sf), derived.plain_words(spark))
    return found.drop("rejected").withColumn("first_violations", F.size(F.flatten("first_violations")).cast("long"))


_LABELLED = "WITH l AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 10 THEN l_linenumber ELSE -100 END AS label FROM lineitem), o AS (SELECT l_orderkey, list(label ORDER BY l_linenumber, label) AS labels FROM l GROUP BY l_orderkey)"


@query(
    _LABELLED
    + " SELECT l_orderkey, array_to_string(labels || list_transform(range(len(labels), 8), lambda i: -100), ',') AS padded, CAST(1 + len(list_filter(range(1, len(labels)), lambda i: (labels[i] = -100) <> (labels[i + 1] = -100))) AS INTEGER) AS n_runs,"
    " CAST(len(list_filter(range(1, len(labels) + 1), lambda i: labels[i] <> -100 AND (i = 1 OR labels[i - 1] = -100))) AS INTEGER) AS n_trained FROM o WHERE len(list_filter(labels, lambda x: x <> -100)) > 0"
)
def label_runs(spark, sf):
    """Rows with a label to train on, their labels filled up, and the runs of trained and masked ones."""
    label = F.when(F.col("l_quantity") < 10, F.col("l_linenumber").cast("int")).otherwise(F.lit(-100))
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("at"), label.alias("label")))).alias("l"))
    rows = metrics.trainable(rows.select("l_orderkey", F.transform("l", lambda x: x["label"]).alias("labels"))).withColumn("runs", turns.runs(F.col("labels")))
    padded = F.array_join(F.transform(T.padded(F.col("labels"), F.lit(8), -100), lambda x: x.cast("string")), ",")
    return rows.select("l_orderkey", padded.alias("padded"), F.size("runs").alias("n_runs"), F.size(F.filter("runs", lambda r: r["trained"])).alias("n_trained"))
