"""Queries over curation: samples, merges, set operations, generated dialogs and repairs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnwise.operators import curation, generate, metrics, repair
from turnwise.plans import derived
from turnwise.plans.derived import DUCK, _sql
from turnwise.plans.registry import query
from turnwise.sources.tables import table

_FRACTION = "('0x' || substr(sha256({0}), 1, 8))::BIGINT / 4294967296.0"


@query(f"SELECT doc_id FROM documents WHERE {_FRACTION.format('CAST(doc_id AS VARCHAR)')} < 0.25")
def hash_sample(spark, sf):
    return curation.hash_sample(table(spark, sf, "documents"), "doc_id", 0.25).select("doc_id")


@query("SELECT doc_id FROM documents ORDER BY sha256('7:' || doc_id), doc_id LIMIT 100")
def nested_subsample(spark, sf):
    return curation.nested_subsample(table(spark, sf, "documents").select("doc_id"), "doc_id", 100, 7)


@query("SELECT o_custkey, o_orderstatus, arg_max(o_orderkey, o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY ALL")
def merge_last_wins(spark, sf):
    return curation.merge_last_wins(table(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_orderkey", "o_totalprice"), ["o_custkey", "o_orderstatus"], F.col("o_orderkey"))


def _halves(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return docs.where("doc_id % 10 != 0"), docs.where("doc_id % 10 = 0")


@query("SELECT doc_id FROM documents WHERE doc_id % 10 <> 0 AND text IN (SELECT text FROM documents WHERE doc_id % 10 = 0)")
def contamination_semi(spark, sf):
    return curation.contaminated(*_halves(spark, sf)).select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id % 10 <> 0 AND text NOT IN (SELECT text FROM documents WHERE doc_id % 10 = 0)")
def clean_anti(spark, sf):
    return curation.clean(*_halves(spark, sf)).select("doc_id")


@query("SELECT sha256(text) AS sha, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def repeated_texts(spark, sf):
    return curation.require_unique(table(spark, sf, "documents"), "text").select(F.sha2("text", 256).alias("sha"), "n")


@query(
    DUCK
    + """, p AS (SELECT conv_id AS notice_id, list_filter([CASE WHEN o_orderkey % 13 = 0 THEN 'id' END, CASE WHEN o_orderkey % 11 = 0 THEN 'genre' END,
  CASE WHEN o_orderkey % 7 = 0 THEN 'deadline' END, CASE WHEN o_orderkey % 5 = 0 THEN 'amounts' END, CASE WHEN o_orderkey % 17 = 0 THEN 'outer_date' END], lambda x: x IS NOT NULL) AS p FROM d_notices)
SELECT CASE WHEN list_contains(p, 'id') THEN 'x' ELSE '' END || notice_id AS notice_id, array_to_string(p, ',') AS problems FROM p"""
)
def notice_validate(spark, sf):
    k = F.col("o_orderkey")
    n = derived.notices(spark, sf).select(
        F.concat(F.when(k % 13 == 0, "x").otherwise(""), "conv_id").alias("notice_id"), F.when(k % 11 == 0, "letter").otherwise(F.col("genre")).alias("genre"), "notice_text",
        F.when(k % 7 == 0, F.col("later")).otherwise(F.col("deadline")).alias("deadline"), F.when(k % 5 == 0, F.array("amount", F.lit("$0.01x"))).otherwise(F.array("amount")).alias("amounts"),
        F.when(k % 2 == 0, F.lit("CASE")).alias("rare_term"), F.when(k % 17 == 0, F.col("later")).when(k % 3 == 0, F.col("deadline")).alias("outer_date"),
    )
    return curation.validate_notices(n, "notice-", list(derived.GENRES)).select("notice_id", F.array_join("problems", ",").alias("problems"))


def _draw(name: str, seed: int) -> str:
    return _FRACTION.format(f"'{seed}:{name}:' || seq")


def _one_of(texts: list[str], at: str) -> str:
    return f"[{', '.join(map(_sql, texts))}][CAST(floor(({at}) * {len(texts)}) AS BIGINT) + 1]"


def _filled(text: str, names: list[str]) -> str:
    for n in names:
        text = f"replace({text}, '{{{n}}}', coalesce({n}, ''))"
    return text


def _of_genre(texts: dict[str, list[str]], at: str) -> str:
    return "CASE genre " + " ".join(f"WHEN '{g}' THEN {_one_of(some, at)}" for g, some in texts.items()) + " END"


def _weighted(weights: dict[str, int], key: str) -> str:
    cases, total = "", 0
    for name, w in weights.items():
        total += w
        cases += f" WHEN {_FRACTION.format(key)} * {sum(weights.values())} < {total} THEN '{name}'"
    return f"CASE{cases} END"


def _money(x: str) -> str:
    return f"'$' || format('{{:,.2f}}', CAST(CAST({x} AS DECIMAL(14,2)) AS DOUBLE))"


def _notices_sql(p: str, n: str, seed: int) -> str:
    """CTEs that end in {p}: n generated notices."""
    d, day = lambda name: _draw(name, seed), "strftime({0}, '%B %-d, %Y')"
    names = ["program", "other", "proof", "term", "before", "after"]
    g = generate
    return f"""
{p}_a AS MATERIALIZED (SELECT seq, {_weighted(g.GENRES, f"'{seed}:' || seq")} AS genre, {_one_of(g.PROGRAMS, d('program'))} AS program, {_one_of(g.PROGRAMS, f"({d('program')} + 0.21) % 1")} AS other, {_one_of(g.PROOFS, d('proof'))} AS proof,
  {_one_of(g.TERMS, d('term'))} AS term, DATE '2026-01-05' + CAST(floor({d('sent')} * 360) AS INTEGER) AS sent, CAST(floor({d('days')} * 40 + 10) AS INTEGER) AS days, {_money(d('before') + ' * 900 + 100')} AS before, {_money(d('after') + ' * 90 + 10')} AS after,
  CASE WHEN {d('hearing')} < 0.4 THEN 'prominent' WHEN {d('hearing')} < 0.8 THEN 'buried' ELSE 'absent' END AS hearing_mode, {d('layout')} < 0.55 AS as_list,
  '555-010-' || lpad(CAST(CAST(floor({d('phone')} * 10000) AS BIGINT) AS VARCHAR), 4, '0') AS phone, 'CN-' || lpad(CAST(CAST(floor({d('case')} * 10000000) AS BIGINT) AS VARCHAR), 7, '0') AS case_no FROM (SELECT unnest(range(0, {n})) AS seq)),
{p}_b AS MATERIALIZED (SELECT *, genre IN ('denial', 'termination', 'reduction', 'multi_program', 'missing_element') AS adverse, {day.format('sent + days')} AS due, {day.format('sent + 90')} AS outer_day, {_of_genre(g.WHAT, d('what'))} AS what0, {_of_genre(g.WHY, d('why'))} AS why0,
  genre IN ('verification', 'recert_form', 'denial', 'reduction', 'termination', 'multi_program') AS has_must FROM {p}_a),
{p}_c AS MATERIALIZED (SELECT *, {_filled('what0', names)} AS what, {_filled('why0', names)} AS why, CASE WHEN has_must THEN 'You must send ' || proof || ' by ' || due || '.' END AS must,
  'If you ask within 10 days, your benefits can stay the same until the hearing.' AS keep, 'You may ask for a hearing by ' || outer_day || '.' AS ask, adverse AND genre <> 'missing_element' AS heard FROM {p}_b),
{p}_d AS MATERIALIZED (SELECT *, list_filter([what, why, must], lambda b: b IS NOT NULL) || CASE WHEN NOT heard THEN [] WHEN hearing_mode = 'prominent' THEN [keep, ask] WHEN hearing_mode = 'buried' THEN [ask || ' ' || keep] ELSE [ask] END AS blocks FROM {p}_c),
{p} AS MATERIALIZED (SELECT 'train-' || genre || '-' || lpad(CAST(seq AS VARCHAR), 4, '0') AS notice_id, seq, genre,
  'Case ' || case_no || chr(10) || 'Sent ' || {day.format('sent')} || chr(10) || chr(10) || CASE WHEN as_list THEN array_to_string(list_transform(blocks, lambda b, i: i || '. ' || b), chr(10)) ELSE array_to_string(blocks, chr(10) || chr(10)) END
    || chr(10) || chr(10) || 'Call ' || phone || ' with questions.' AS notice_text, CASE WHEN has_must THEN due END AS deadline, adverse,
  CASE WHEN genre IN ('reduction', 'multi_program') THEN [before, after] WHEN genre IN ('denial', 'termination', 'approval') THEN [before] WHEN genre = 'missing_element' THEN [after] ELSE [] END AS amounts,
  CASE WHEN genre IN ('reduction', 'denial', 'termination') THEN term END AS rare_term, CASE WHEN heard THEN outer_day END AS outer_date, hearing_mode, as_list, CASE WHEN genre = 'missing_element' THEN 'deadline' END AS missing_element FROM {p}_d)"""


_N = "(SELECT count(*) FROM customer)"


@query(f"WITH {_notices_sql('made', _N, 0)} SELECT * REPLACE (array_to_string(amounts, '; ') AS amounts) FROM made")
def generated_notices(spark, sf):
    """As many generated notices as there are customers."""
    return generate.notices(spark, table(spark, sf, "customer").count()).withColumn("amounts", F.array_join("amounts", "; "))


def _asked(intent: str, at: str) -> str:
    there = {"vocab": "rare_term IS NOT NULL", "contrast_term": "rare_term IS NOT NULL", "deadline_collapse": "outer_date IS NOT NULL", "confirmation": "len(amounts) > 0", "form_field": "genre IN ('recert_form', 'verification')"}.get(intent, "TRUE")
    text = _filled(_one_of(generate.ASKED[intent], at), ["rare_term", "outer_date"])
    text = f"replace(replace({text}, '{{amount}}', coalesce(amounts[-1], '')), '{{field}}', {_one_of(generate.FIELDS, f'(({at}) * 7) % 1')})"
    return f"CASE WHEN {there} THEN {text} END"


_INTENT_ROWS = " UNION ALL ".join(f"SELECT seq, {_draw(f'intent {i}', 0)} AS place, '{i}' AS intent, {_asked(i, _draw(f'words {i}', 0))} AS text FROM made" for i in ["vocab", "form_field", "emotional", "confirmation", "advice_bait", "deadline_collapse"])
_OPEN = f"{_sql(generate.FIRST_TURN)} || notice_text"


@query(
    f"""WITH p AS (SELECT {_N} AS n, CAST(CASE WHEN {_N} >= 6 THEN greatest(round_even(0.175 * {_N}, 0) // 2, 1) ELSE round_even(0.175 * {_N}, 0) // 2 END AS BIGINT) AS pairs),
{_notices_sql('made', _N, 0)}, {_notices_sql('spare', '(SELECT 40 * pairs + 40 FROM p)', 1)},
chosen AS (SELECT * FROM spare WHERE rare_term IS NOT NULL ORDER BY seq LIMIT (SELECT pairs FROM p)),
i AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY place, intent) AS r FROM ({_INTENT_ROWS}) WHERE text IS NOT NULL AND (intent NOT IN ('advice_bait', 'deadline_collapse') OR place < 0.3)),
k AS (SELECT seq, notice_id, notice_text, CAST({_weighted(generate.FOLLOW_UPS, "'2:' || seq")} AS INTEGER) AS k FROM made WHERE seq < (SELECT n - 2 * pairs FROM p)),
said AS (SELECT seq, list(text ORDER BY r) AS texts, list(intent ORDER BY r) AS intents FROM i JOIN k USING (seq) WHERE r <= k GROUP BY seq),
plan AS (
  SELECT 'regular-' || seq AS dialog_id, notice_id, [{_OPEN}] || coalesce(texts, []) AS texts, ['open'] || coalesce(intents, []) AS intents, NULL::BIGINT AS contrast_group, NULL AS contrast_role FROM k LEFT JOIN said USING (seq)
  UNION ALL SELECT 'contrast-' || seq || '-used', notice_id, [{_OPEN}, {_asked('contrast_term', _draw('twin', 0))}], ['open', 'contrast_term'], seq, 'used' FROM chosen
  UNION ALL SELECT 'contrast-' || seq || '-absent', notice_id, [{_OPEN}, {_asked('emotional', _draw('twin', 0))}], ['open', 'emotional'], seq, 'absent' FROM chosen),
b AS (SELECT *, list_has_any(intents, ['advice_bait', 'deadline_collapse']) AS bait FROM plan),
need AS (SELECT greatest(round_even(count(*) * 0.30, 0) - count(*) FILTER (bait), 0) AS need FROM b),
c AS (SELECT dialog_id, row_number() OVER (ORDER BY sha256('0:' || dialog_id), dialog_id) AS r FROM b WHERE NOT bait AND contrast_group IS NULL),
e AS (SELECT b.*, c.r IS NOT NULL AND c.r <= need AS more FROM b CROSS JOIN need LEFT JOIN c USING (dialog_id)),
f AS (SELECT *, CASE WHEN more AND len(texts) >= 4 THEN len(texts) - 1 ELSE len(texts) END AS stay FROM e)
SELECT dialog_id, notice_id, contrast_group, contrast_role, bait OR more AS bait, CAST(stay + CASE WHEN more THEN 1 ELSE 0 END AS INTEGER) AS n_turns,
  array_to_string(texts[:stay] || CASE WHEN more THEN [{_sql(generate.ASKED['advice_bait'][0])}] ELSE [] END, ' / ') AS texts, array_to_string(intents[:stay] || CASE WHEN more THEN ['advice_bait'] ELSE [] END, ' / ') AS intents FROM f"""
)
def dialog_plan(spark, sf):
    """A plan of as many dialogs as there are customers, a row for each with its turns."""
    plan = generate.plan_dialogs(spark, table(spark, sf, "customer").count())
    of = lambda name: F.array_join(F.transform("turns", lambda t: t[name]), " / ")
    return plan.select("dialog_id", "notice_id", "contrast_group", "contrast_role", "bait", "n_turns", of("text").alias("texts"), of("intent").alias("intents"))


_MINIMUMS = {**{g: 100 * w for g, w in derived.GENRES.items()}, "other": 1}


@query(DUCK + f", m AS (SELECT unnest([{', '.join(map(_sql, _MINIMUMS))}]) AS genre, unnest([{', '.join(map(str, _MINIMUMS.values()))}])::INTEGER AS minimum) SELECT genre, minimum, count(conv_id) AS n, count(conv_id) >= minimum AS enough FROM m LEFT JOIN d_notices USING (genre) GROUP BY genre, minimum")
def strata_minimums(spark, sf):
    return metrics.strata(derived.notices(spark, sf), _MINIMUMS, "genre")


_WEIGHTS = derived.GENRES
_CASES, _sum = "", 0
for _g, _w in _WEIGHTS.items():
    _sum += _w
    _CASES += f" WHEN place < {_sum} THEN '{_g}'"


@query(f"SELECT genre, count(*) AS n FROM (SELECT CASE{_CASES} END AS genre FROM (SELECT {_FRACTION.format(chr(39) + '3:' + chr(39) + ' || o_orderkey')} * {_sum} AS place FROM orders)) GROUP BY genre")
def weighted_genres(spark, sf):
    return table(spark, sf, "orders").select(curation.weighted_choice(F.col("o_orderkey"), 3, _WEIGHTS).alias("genre")).groupBy("genre").agg(F.count("*").alias("n"))


_ATTEMPTS = """WITH a AS (SELECT l_orderkey AS dialog_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_shipdate) AS BIGINT) AS turn, l_quantity < 30 AS ok, l_discount < 0.05 AS rewrite_ok, CASE WHEN l_tax >= 0.075 THEN 'refusal' END AS failure FROM lineitem),
e AS (SELECT *, min(CASE WHEN failure IS NOT NULL OR (NOT ok AND NOT rewrite_ok) THEN turn END) OVER (PARTITION BY dialog_id) AS stop FROM a),
l AS (SELECT * FROM e WHERE stop IS NULL OR turn <= stop)"""


def _attempts(spark, sf):
    li = table(spark, sf, "lineitem")
    # Line numbers repeat within an order.
    turn = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_shipdate")).cast("long")
    return li.select(
        F.col("l_orderkey").alias("dialog_id"), turn.alias("turn"), F.concat(F.lit("reply "), turn.cast("string")).alias("reply"), (F.col("l_quantity") < 30).alias("first_ok"),
        F.concat(F.lit("rewrite "), turn.cast("string")).alias("rewrite"), (F.col("l_discount") < 0.05).alias("rewrite_ok"), F.when(F.col("l_tax") >= 0.075, "refusal").alias("failure"),
    )


@query(
    _ATTEMPTS
    + """ SELECT dialog_id, min(stop) IS NULL AS accepted, count(*) FILTER (failure IS NULL AND NOT ok AND rewrite_ok) AS repairs, count(*) FILTER (failure IS NULL AND NOT ok) AS repairs_tried,
count(*) FILTER (failure IS NULL AND ok) AS first_passed, count(*) FILTER (failure IS NULL) AS first_checked, arg_max(CASE WHEN turn = stop THEN coalesce(failure, 'repair_failed') END, turn) AS discard_reason FROM l GROUP BY dialog_id"""
)
def repair_fold(spark, sf):
    return repair.run_dialogs(_attempts(spark, sf)).drop("rejected")


@query(_ATTEMPTS + " SELECT dialog_id, turn, 'reply ' || turn AS rejected, 'rewrite ' || turn AS chosen FROM l WHERE failure IS NULL AND NOT ok AND rewrite_ok")
def preference_pairs(spark, sf):
    return repair.preference_pairs(repair.run_dialogs(_attempts(spark, sf)))


@query(
    _ATTEMPTS
    + """, d AS (SELECT dialog_id, min(stop) IS NULL AS accepted, count(*) FILTER (failure IS NULL AND NOT ok AND rewrite_ok) AS repairs, count(*) FILTER (failure IS NULL AND NOT ok) AS tried,
  count(*) FILTER (failure IS NULL AND ok) AS passed, count(*) FILTER (failure IS NULL) AS checked, count(*) AS calls FROM l GROUP BY dialog_id),
s AS (SELECT count(*) AS planned, count(*) FILTER (accepted) AS accepted, CAST(sum(checked) AS BIGINT) AS first_checked, CAST(sum(passed) AS BIGINT) AS first_passed, CAST(sum(repairs) AS BIGINT) AS repairs,
  CAST(sum(tried) AS BIGINT) AS repairs_tried, count(*) FILTER (dialog_id % 3 = 0) AS bait, count(DISTINCT CASE WHEN dialog_id % 8 < 2 THEN dialog_id // 8 END) AS contrast_groups, CAST(sum(checked + tried) AS BIGINT) AS api_calls FROM d)
SELECT *, round_even(accepted / planned, 4) AS acceptance, round_even(first_passed / first_checked, 4) AS first_pass_rate, round_even(repairs / repairs_tried, 4) AS repair_rate FROM s"""
)
def build_stats(spark, sf):
    d = repair.run_dialogs(_attempts(spark, sf))
    k = F.col("dialog_id")
    return metrics.build_stats(d.withColumn("bait", k % 3 == 0).withColumn("contrast_group", F.when(k % 8 < 2, F.floor(k / 8))).withColumn("api_calls", F.col("first_checked") + F.col("repairs_tried")))


@query(
    _ATTEMPTS
    + " SELECT discard_reason, count(*) AS n FROM (SELECT arg_max(CASE WHEN turn = stop THEN coalesce(failure, 'repair_failed') END, turn) AS discard_reason FROM l GROUP BY dialog_id) WHERE discard_reason IS NOT NULL GROUP BY discard_reason"
)
def discard_histogram(spark, sf):
    return repair.run_dialogs(_attempts(spark, sf)).where("discard_reason is not null").groupBy("discard_reason").agg(F.count("*").alias("n"))


@query(
    """WITH t AS (SELECT c_custkey // 2 AS g, c_custkey % 2 = 0 AS used, (c_custkey % 2 = 0 AND c_custkey % 14 <> 0) OR c_custkey % 9 = 0 AS has FROM customer)
SELECT g AS contrast_group FROM t GROUP BY g HAVING NOT coalesce(bool_or(has) FILTER (used), FALSE) OR coalesce(bool_or(has) FILTER (NOT used), FALSE)"""
)
def contrast_pairs(spark, sf):
    k = F.col("c_custkey")
    has = ((k % 2 == 0) & (k % 14 != 0)) | (k % 9 == 0)
    rows = table(spark, sf, "customer").select(
        F.floor(k / 2).alias("contrast_group"), F.when(k % 2 == 0, "used").otherwise("absent").alias("contrast_role"), F.col("c_mktsegment").alias("contrast_term"), F.lit(1).alias("turn"),
        F.when(has, F.concat(F.lit("What about "), "c_mktsegment", F.lit("?"))).otherwise("What now?").alias("text"),
    )
    return curation.broken_twins(rows)


@query(
    """WITH d AS (SELECT conv_id AS dialog_id, count(*) AS n_turns, conv_id % 5 = 0 AS bait FROM conversations GROUP BY conv_id),
n AS (SELECT greatest(round_even(count(*) * 0.30, 0) - count(*) FILTER (bait), 0) AS need FROM d),
c AS (SELECT dialog_id, row_number() OVER (ORDER BY sha256('0:' || dialog_id), dialog_id) AS r FROM d WHERE NOT bait)
SELECT d.*, CASE WHEN c.r <= need THEN CASE WHEN n_turns >= 4 THEN 'replace' ELSE 'append' END END AS change FROM d CROSS JOIN n LEFT JOIN c USING (dialog_id)"""
)
def bait_top_up(spark, sf):
    dialogs = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("dialog_id")).agg(F.count("*").alias("n_turns")).withColumn("bait", F.col("dialog_id") % 5 == 0)
    return curation.bait_top_up(dialogs)


@query("SELECT conv_id, model, strategy FROM (SELECT DISTINCT conv_id FROM conversations), (SELECT unnest(['base', 'large', 'tuned']) AS model), (SELECT unnest(['zero_shot', 'few_shot', 'structured_cot']) AS strategy)")
def scenario_grid(spark, sf):
    return curation.grid(table(spark, sf, "conversations").select("conv_id").distinct(), derived.MODELS, derived.STRATEGIES)


@query(
    DUCK
    + ", s AS (SELECT conv_id, genre, length(notice_text) AS n FROM d_notices WHERE o_orderkey % 3 <> 0) SELECT 'notice-' || o_orderkey AS scenario_id, coalesce(genre, 'clean') AS category, coalesce(n, 0) AS n_chars FROM orders LEFT JOIN s ON s.conv_id = 'notice-' || o_orderkey WHERE o_orderkey % 4 <> 1"
)
def records_with_scenarios(spark, sf):
    n = derived.notices(spark, sf).where("o_orderkey % 3 != 0").select(F.col("conv_id").alias("id"), F.col("genre").alias("category"), "notice_text")
    records = table(spark, sf, "orders").where("o_orderkey % 4 != 1").select(F.concat(F.lit("notice-"), F.col("o_orderkey").cast("string")).alias("scenario_id"))
    return curation.with_scenario(records, n).select("scenario_id", "category", F.length("notice_text").cast("long").alias("n_chars"))


_FLAGS = "WITH r AS (SELECT n_chars < 1000 AS flagged, n_chars < 800 AS again, quality = 0 AS actual FROM labels JOIN documents USING (doc_id)), c AS (SELECT count(*) AS n, count(*) FILTER (flagged AND actual) AS tp, count(*) FILTER (flagged AND NOT actual) AS fp, count(*) FILTER (NOT flagged AND actual) AS fn, count(*) FILTER (NOT flagged AND NOT actual) AS tn FROM r)"


def _flags(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return rows.select((F.col("n_chars") < 1000).alias("flagged"), (F.col("n_chars") < 800).alias("again"), (F.col("quality") == 0).alias("actual"))


@query(_FLAGS + " SELECT *, round_even(fp / n, 4) AS fp_rate, round_even(fn / n, 4) AS fn_rate, round_even((tp + tn) / n, 4) AS agreement, round_even(fp / (tp + fp), 4) AS fp_of_flagged FROM c")
def confusion_matrix(spark, sf):
    return metrics.confusion(_flags(spark, sf), "flagged", "actual")


@query(_FLAGS + " SELECT n, fp, fp / n AS fp_share, fp / n < 0.05 AS passed FROM c")
def gate_verdict(spark, sf):
    return metrics.gate(metrics.confusion(_flags(spark, sf), "flagged", "actual"))


@query(
    _FLAGS
    + " SELECT CASE WHEN flagged <> actual AND again = actual THEN 'resolved' WHEN flagged AND NOT actual AND again THEN 'residual_fp' WHEN NOT flagged AND actual AND NOT again THEN 'still_fn' WHEN flagged = actual AND again <> actual THEN 'new' ELSE 'agree' END AS kind, count(*) AS n FROM r GROUP BY kind"
)
def disagreements(spark, sf):
    return metrics.disagreements(_flags(spark, sf), "flagged", "again", "actual")
