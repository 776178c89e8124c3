"""Queries over conversations, documents and events: text functions, state, word lists, series."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnwise.functions import text as T
from turnwise.functions import wordforms as W
from turnwise.operators import curation, lexicon, metrics, rules, taught, turns
from turnwise.plans import derived
from turnwise.plans.derived import DUCK, _sql
from turnwise.plans.registry import query
from turnwise.sources.tables import table
from turnwise.streaming import panels

_W = "'[A-Za-z][A-Za-z''’-]*'"
_LOWER_WORDS = f"list_transform(regexp_extract_all({{0}}, {_W}), lambda x: lower(x))"


_THINK = "CASE conv_id % 4 WHEN 0 THEN '<THINK>a plan' || chr(10) || 'of two lines</think> ' || text WHEN 1 THEN text || ' <think>not closed' WHEN 2 THEN '<think>a</think>  <think>b</think>' || text ELSE text END"


@query(f"SELECT conv_id, turn, regexp_replace(regexp_replace(t, '(?is)<think>.*?</think>', '', 'g'), '(?is)<think>.*\\z', '') AS stripped FROM (SELECT conv_id, turn, {_THINK} AS t FROM conversations)")
def think_strip(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.strip_think(F.expr(_THINK.replace("chr(10)", "char(10)"))).alias("stripped"))


_SHORT = "text || CASE conv_id % 4 WHEN 0 THEN ' I can''t, they''ll and we won’t.' WHEN 3 THEN ' The ''dog'' and ''money'' or ''red'' tape; the outlet''s ''vest''; toucan''t.' WHEN 1 THEN ' Let''s; I''d say it isn''t the worker''s.' ELSE ' Cannot ain''t shan''t.' END"


@query(f"SELECT conv_id, turn, {derived.duck_spelled('(' + _SHORT + ')')} AS expanded FROM conversations")
def contraction_expand(spark, sf):
    k = F.col("conv_id") % 4
    more = F.when(k == 0, " I can't, they'll and we won’t.").when(k == 3, " The 'dog' and 'money' or 'red' tape; the outlet's 'vest'; toucan't.").when(k == 1, " Let's; I'd say it isn't the worker's.").otherwise(" Cannot ain't shan't.")
    return table(spark, sf, "conversations").select("conv_id", "turn", T.expand_contractions(F.concat("text", more)).alias("expanded"))


_TOP = f"""WITH w AS (SELECT lang, unnest(list_distinct({_LOWER_WORDS.format("text")})) AS word FROM documents),
n AS (SELECT lang, word, count(*) AS n_docs FROM w GROUP BY lang, word),
top AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY n_docs DESC, word) AS INTEGER) AS rank FROM n)"""


@query(_TOP + " SELECT lang, word, n_docs, rank FROM top WHERE rank <= 200")
def lexicon_top_n(spark, sf):
    return lexicon.top_words(table(spark, sf, "documents"), 200)


_ENDINGS = ["ize", "ized", "ization", "yzing", "eled", "eling", "izers", ""]
_SUFFIXES = "izations isations ization isation izing ising izes ises ized ised ize ise izers isers izer iser izable isable yzing ysing yzes yses yzed ysed yze yse".split()
_ELS = "eled elled eling elling eler eller elers ellers".split()
_BRITISH = ", ".join([f"CASE WHEN ends_with(w, '{a}') AND length(w) > {len(a) + k} THEN left(w, length(w) - {len(a)}) || '{b}' END" for k, rules in ((1, _SUFFIXES), (2, _ELS)) for a, b in zip(rules[::2], rules[1::2])])


@query(_TOP + f", e AS (SELECT DISTINCT word || [{', '.join(map(_sql, _ENDINGS))}][rank % 8 + 1] AS w FROM top WHERE rank <= 200) SELECT w AS word, unnest(list_filter([{_BRITISH}], lambda x: x IS NOT NULL)) AS british FROM e")
def british_variants(spark, sf):
    top = lexicon.top_words(table(spark, sf, "documents"), 200)
    words = top.select(F.concat("word", derived.pick(_ENDINGS, F.col("rank") % 8)).alias("word")).distinct()
    return words.select("word", F.explode(W.british_variants(F.col("word"))).alias("british"))


_CUT = "left(word, length(word) - {0}) || '{1}'"
_MADE = (
    f"CASE WHEN ends_with(word, 'y') AND length(word) > 2 THEN [{_CUT.format(1, 'ily')}] WHEN ends_with(word, 'ic') THEN [word || 'ally'] ELSE [word || 'ly'] END || "
    f"CASE WHEN ends_with(word, 'y') THEN [{_CUT.format(1, 'ial')}] WHEN ends_with(word, 'e') THEN [{', '.join(_CUT.format(1, x) for x in ('al', 'ial', 'ation', 'tion', 'ment'))}] "
    "ELSE [word || 'al', word || 'ial', word || 'ation', word || 'tion'] END || [word || 'ment']"
)


@query(_TOP + f", l AS (SELECT DISTINCT word FROM top WHERE rank <= 300), f AS (SELECT DISTINCT word, unnest({_MADE}) AS form FROM l) SELECT word, form FROM f WHERE form IN (SELECT word FROM n) AND form NOT IN (SELECT word FROM l)")
def derivational_forms(spark, sf):
    docs = table(spark, sf, "documents")
    known = docs.select(F.explode(F.transform(T.words(F.col("text")), F.lower)).alias("word"))
    return W.derivational_forms(lexicon.top_words(docs, 300).select("word").distinct(), known)


_EARNED = f"""{_TOP},
v_lex AS MATERIALIZED (SELECT DISTINCT word FROM top WHERE rank <= 1000),
v_users AS MATERIALIZED (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'),
v_reply AS MATERIALIZED (SELECT r.conv_id, r.turn, r.text, '' AS notice_text, coalesce(string_agg(u.text, chr(10) ORDER BY u.turn), '') AS said FROM conversations r LEFT JOIN v_users u ON u.conv_id = r.conv_id AND u.turn < r.turn WHERE r.role = 'assistant' GROUP BY r.conv_id, r.turn, r.text),
{derived.duck_words_ok('v_reply', 'v_users', 'v_lex')},
{derived.duck_taught('v_reply')},
{derived.duck_unearned('v_reply', 'v_earned')}
SELECT conv_id, turn, unnest(unearned) AS word FROM v_earned"""


@query(_EARNED)
def vocab_ceiling(spark, sf):
    """Words of replies that are not among the 1,000 most common of a language, that the user didn't say before and that nothing taught."""
    said = turns.user_texts_before(table(spark, sf, "conversations")).withColumn("notice_text", F.lit(""))
    return rules.unearned_words(said, lexicon.top_words(table(spark, sf, "documents"), 1000))


@query(
    f"""SELECT r.conv_id, r.turn, (SELECT count(DISTINCT w) FROM (SELECT unnest({_LOWER_WORDS.format("x.text")}) AS w FROM conversations x WHERE x.conv_id = r.conv_id AND x.role = 'user' AND x.turn < r.turn)) AS n_words
FROM conversations r WHERE r.role = 'assistant'"""
)
def user_words_so_far(spark, sf):
    said = turns.user_texts_before(table(spark, sf, "conversations"))
    return said.select("conv_id", "turn", F.size(turns.words_of(F.col("user_texts"))).cast("long").alias("n_words"))


@query(
    DUCK
    + f""", tok AS MATERIALIZED (SELECT conv_id, turn, notice_text, unnest(regexp_extract_all(text, {_W})) AS token FROM d_said),
cap AS MATERIALIZED (SELECT conv_id, turn, token, notice_text, count(*) AS n FROM tok WHERE regexp_matches(token, '^[A-Z]') AND contains(notice_text, token) GROUP BY ALL)
SELECT conv_id, turn, token, n FROM cap WHERE regexp_matches(notice_text, '(^|[^A-Za-z0-9_])' || token || '($|[^A-Za-z0-9_])')"""
)
def proper_noun_exempt(spark, sf):
    rows = derived.replies(spark, sf)
    tokens = rows.select("conv_id", "turn", "notice_text", F.explode(T.words(F.col("text"))).alias("token"))
    return tokens.where(F.col("token").rlike(r"^\p{Lu}") & T.verbatim_in(F.col("token"), F.col("notice_text"))).groupBy("conv_id", "turn", "token").agg(F.count("*").alias("n"))


@query(
    """WITH s AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS i FROM conversations WHERE role IN ('user', 'assistant'))
SELECT conv_id, string_agg(CASE role WHEN 'user' THEN '[STUDENT]' ELSE '[ASSISTANT TURN ' || i || ']' END || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS transcript FROM s GROUP BY conv_id"""
)
def transcript_render(spark, sf):
    return turns.transcript(table(spark, sf, "conversations"))


_MARK, _STOP = "'<|im_start|>assistant' || chr(10)", "'<|im_end|>'"


@query(
    f"""WITH r AS (SELECT conv_id, string_split(string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn), {_MARK}) AS parts FROM conversations GROUP BY conv_id),
i AS (SELECT conv_id, parts, unnest(range(2, len(parts) + 1)) AS i FROM r),
s AS (SELECT conv_id, parts[i] AS part, list_sum(list_transform(parts[1:i - 1], lambda p: length(p))) + (i - 1) * 22 AS behind FROM i)
SELECT conv_id, CAST(behind AS INTEGER) AS span_start, CAST(behind + CASE WHEN instr(part, {_STOP}) > 0 THEN instr(part, {_STOP}) - 1 + 10 ELSE length(part) END AS INTEGER) AS span_end FROM s"""
)
def assistant_spans(spark, sf):
    said = turns.messages(table(spark, sf, "conversations"))
    text = F.array_join(F.transform("messages", lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["text"], F.lit("<|im_end|>\n"))), "")
    return said.select("conv_id", F.explode(T.assistant_spans(text)).alias("s")).select("conv_id", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"))


@query(
    """WITH m AS (SELECT conv_id, list(role ORDER BY turn) AS r FROM conversations GROUP BY conv_id)
SELECT conv_id, CAST(CASE WHEN r[-1] = 'assistant' THEN len(r) - 1 ELSE len(r) END AS INTEGER) AS n_turns, CASE WHEN r[-1] = 'assistant' THEN r[-2] ELSE r[-1] END AS last_role FROM m"""
)
def trailing_drop(spark, sf):
    rows = turns.drop_trailing_assistant(turns.messages(table(spark, sf, "conversations")))
    return rows.select("conv_id", F.size("messages").alias("n_turns"), F.try_element_at("messages", F.lit(-1))["role"].alias("last_role"))


@query(
    """WITH l AS (SELECT user_id % 16 AS run, event_id AS step, value AS loss, epoch(ts) AS elapsed_s FROM events)
SELECT run, count(*) AS steps, arg_min(loss, step) AS first_loss, arg_max(loss, step) AS last_loss, min(loss) AS least_loss, max(elapsed_s) AS wall_s, max(elapsed_s) / count(*) AS s_per_step FROM l GROUP BY run"""
)
def loss_curve(spark, sf):
    log = table(spark, sf, "events").select((F.col("user_id") % 16).alias("run"), F.col("event_id").alias("step"), F.col("value").alias("loss"), F.col("ts").cast("timestamp").cast("double").alias("elapsed_s"))
    return metrics.loss_curve(log)


@query(
    """WITH g AS (SELECT *, CASE WHEN epoch(ts) - lag(epoch(ts)) OVER w > 1800 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n_events, CAST(floor(epoch(min(ts))) AS BIGINT) AS started, CAST(floor(epoch(max(ts))) AS BIGINT) AS ended FROM s GROUP BY user_id, session"""
)
def session_windows(spark, sf):
    panel = curation.rate_panel(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return panel.withColumn("started", F.floor(F.col("started").cast("double"))).withColumn("ended", F.floor(F.col("ended").cast("double")))


@query("SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM events GROUP BY ALL")
def hourly_panel(spark, sf):
    return panels.hourly(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))).select(F.col("window.start").cast("long").alias("hour"), "event_type", "n", "total")


@query(DUCK + "SELECT conv_id, turn, array_to_string(new, ', ') AS taught, array_to_string(list_transform(bad, lambda b: b.rule || ': ' || b.detail), '; ') AS violations FROM d_earned")
def taught_term_fold(spark, sf):
    """What each reply newly teaches, and its gloss violations; the state of a conversation goes from reply to reply."""
    found = taught.taught_terms(derived.replies(spark, sf), derived.plain_words(spark))
    return found.select("conv_id", "turn", F.array_join("taught", ", ").alias("taught"), F.array_join("violations", "; ").alias("violations"))
