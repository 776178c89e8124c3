"""Filtering of generated dialogs with one repair for each failed reply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions import text as T
from turnwise.operators import lexicon, rules, taught
from turnwise.operators.anchors import all_anchors, bound_anchors


def run_dialogs(attempts: DataFrame) -> DataFrame:
    """(dialog_id, accepted, repairs, repairs_tried, first_passed, first_checked, discard_reason, rejected)
    of dialogs from attempts(dialog_id, turn, reply, first_ok, rewrite, rewrite_ok, failure).

    Turns go in order. A reply that fails its check may be rewritten once; if that fails too, the
    dialog ends there as `repair_failed` and later turns don't count, as they don't after a failure
    (a refusal or an error). Rejected replies come with the rewrite that was accepted, or null.
    """
    state = "struct<open:boolean,repairs:bigint,tried:bigint,passed:bigint,checked:bigint,reason:string,rejected:array<struct<turn:bigint,reply:string,accepted_rewrite:string>>>"
    turns = attempts.groupBy("dialog_id").agg(F.array_sort(F.collect_list(F.struct("turn", "reply", "first_ok", "rewrite", "rewrite_ok", "failure"))).alias("turns"))
    start = F.struct(
        F.lit(True).alias("open"), *[F.lit(0).cast("long").alias(c) for c in ("repairs", "tried", "passed", "checked")], F.lit(None).cast("string").alias("reason"),
        F.array().cast("array<struct<turn:bigint,reply:string,accepted_rewrite:string>>").alias("rejected"),
    ).cast(state)

    def step(s, t):
        failed = t["failure"].isNotNull()
        checked = ~failed
        ok = checked & t["first_ok"]
        mended = checked & ~t["first_ok"] & F.coalesce(t["rewrite_ok"], F.lit(False))
        tried = checked & ~t["first_ok"]
        broken = tried & ~mended
        pair = F.array(F.struct(t["turn"].cast("long").alias("turn"), t["reply"].alias("reply"), F.when(mended, t["rewrite"]).alias("accepted_rewrite")))
        n = lambda c, x: (s[c] + x.cast("long")).alias(c)
        after = F.struct(
            (~failed & ~broken).alias("open"), n("repairs", mended), n("tried", tried), n("passed", ok), n("checked", checked),
            F.when(failed, t["failure"]).when(broken, F.lit("repair_failed")).alias("reason"), F.when(tried, F.concat(s["rejected"], pair)).otherwise(s["rejected"]).alias("rejected"),
        ).cast(state)
        return F.when(s["open"], after).otherwise(s)

    done = turns.select("dialog_id", F.aggregate("turns", start, step).alias("s"))
    return done.select(
        "dialog_id", F.col("s.open").alias("accepted"), F.col("s.repairs").alias("repairs"), F.col("s.tried").alias("repairs_tried"), F.col("s.passed").alias("first_passed"), F.col("s.checked").alias("first_checked"),
        F.col("s.reason").alias("discard_reason"), F.col("s.rejected").alias("rejected"),
    )


_BAD = rules.NONE
_REJECTED = f"array<struct<turn:bigint,reply:string,violations:{_BAD},accepted_rewrite:string,rejected_rewrite:string,rewrite_violations:{_BAD}>>"
_STATE = f"struct<open:boolean,asked:boolean,taught:array<string>,families:array<string>,repairs:bigint,tried:bigint,passed:bigint,checked:bigint,calls:bigint,reason:string,rejected:{_REJECTED},first_violations:array<{_BAD}>>"

_FIELDS = ["open", "asked", "taught", "families", "repairs", "tried", "passed", "checked", "calls", "reason", "rejected", "first_violations"]


def judge_dialogs(attempts: DataFrame, words: DataFrame) -> DataFrame:
    """run_dialogs() that judges replies and rewrites itself, by all ten rules against the list `words`(word).

    attempts(dialog_id, turn, user, reply, stop, rewrite, rewrite_stop, notice_text, deadline, adverse):
    what the user says, the reply to it, and the rewrite that is asked for if the reply fails. `stop`
    is why there is no reply (a refusal, or one that is cut short), else null. Each attempt is judged
    on the state before its turn: what was said and taught so far. The state of an attempt that
    passes is adopted; terms that a failed one taught are forgotten. A missing rewrite is an empty one;
    a reply whose rewrite is stopped is not among the rejected.

    Adds calls, first_violations, the violations of each first attempt in order, and to each rejected
    reply its violations, the rewrite and that one's violations. Turns of a dialog are gathered in one
    shuffle; a state is a fold over them.
    """
    own = ["turn", "user", "reply", "stop", "rewrite", "rewrite_stop", "notice_text", "deadline", "adverse"]
    turns = attempts.withColumnRenamed("dialog_id", "conv_id").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(*own))).alias("all"))
    each = turns.select("conv_id", F.posexplode("all").alias("place", "t"), F.transform("all", lambda t: F.coalesce(t["user"], F.lit(""))).alias("said"))
    each = each.select("conv_id", "place", "t.*", F.slice("said", F.lit(1), F.col("place") + 1).alias("users"), F.coalesce("t.notice_text", F.lit("")).alias("source"))
    each = each.withColumn("known_anchors", F.array_union(T.anchor_texts(F.col("source")), all_anchors(F.col("users")))).withColumn("bound_anchors", bound_anchors(F.col("source"))).withColumn("first_reply", F.col("place") == 0)
    of = lambda i, text: F.struct(F.lit(i).alias("i"), T.strip_think(F.coalesce(text, F.lit(""))).alias("reply"))
    tries = each.withColumnRenamed("reply", "first_text").select("*", F.explode(F.array(of(0, F.col("first_text")), of(1, F.col("rewrite")))).alias("a")).select("*", "a.i", "a.reply")
    tries, listed = taught.held_to(rules.fixed_rules(tries.withColumn("unquoted", T.unquoted(F.col("reply")))), words, F.array("reply"))
    facts = taught.facts(F.col("turn"), F.col("reply"), F.col("source"), F.col("users"), listed, unquoted=F.col("unquoted"))
    tries = tries.withColumn("facts", facts).select("conv_id", F.struct("place", "i", "turn", "first_text", "rewrite", "stop", "rewrite_stop", "facts", "head", "tail").alias("t"))
    done = tries.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("tries"))

    zero = [F.lit(0).cast("long").alias(c) for c in ("repairs", "tried", "passed", "checked", "calls")]
    start = F.struct(F.lit(True).alias("open"), F.lit(False).alias("asked"), F.array().alias("taught"), F.array().alias("families"), *zero, F.lit(None).alias("reason"), F.array().alias("rejected"), F.array().alias("first_violations")).cast(_STATE)

    def verdict(s: Column, t: Column) -> Column:
        def of_lesson(lesson: Column) -> Column:
            unearned = rules.each(lexicon.unearned(t["facts"]["reply"], lesson, t["facts"]["suspect"], taught.has_gloss(t["facts"])), "unearned_word")
            return F.struct(F.concat(t["head"], lesson["bad"], unearned, t["tail"]).alias("violations"), lesson["taught"].alias("taught"), lesson["families"].alias("families"))

        return T.once(taught.lesson(t["facts"], s["taught"], s["families"]), of_lesson)

    def after(s: Column, t: Column, v: Column) -> Column:
        first, ok = t["i"] == 0, F.size(v["violations"]) == 0
        last = F.element_at(s["rejected"], F.lit(-1))
        new = F.struct(
            t["turn"].cast("long").alias("turn"), t["first_text"].alias("reply"), v["violations"].alias("violations"), *[F.lit(None).alias(c) for c in ("accepted_rewrite", "rejected_rewrite", "rewrite_violations")]
        )
        mended = F.struct(
            last["turn"].alias("turn"), last["reply"].alias("reply"), last["violations"].alias("violations"), F.when(ok, t["rewrite"]).alias("accepted_rewrite"),
            F.when(~ok, t["rewrite"]).alias("rejected_rewrite"), F.when(~ok, v["violations"]).alias("rewrite_violations"),
        )
        rejected = F.when(first & ok, s["rejected"]).when(first, F.concat(s["rejected"], F.array(new).cast(_REJECTED))).otherwise(F.concat(F.slice(s["rejected"], F.lit(1), F.size(s["rejected"]) - 1), F.array(mended).cast(_REJECTED)))
        n = lambda c, x: (s[c] + x.cast("long")).alias(c)
        return F.struct(
            (first | ok).alias("open"), (first & ~ok).alias("asked"), F.when(ok, v["taught"]).otherwise(s["taught"]).alias("taught"), F.when(ok, v["families"]).otherwise(s["families"]).alias("families"),
            n("repairs", ~first & ok), n("tried", ~first), n("passed", first & ok), n("checked", first), n("calls", F.lit(1)), F.when(~first & ~ok, F.lit("repair_failed")).alias("reason"), rejected.alias("rejected"),
            F.when(first, F.concat(s["first_violations"], F.array(v["violations"]))).otherwise(s["first_violations"]).alias("first_violations"),
        ).cast(_STATE)

    def stopped(s: Column, t: Column, why: Column) -> Column:
        changed = {"open": F.lit(False), "calls": s["calls"] + 1, "reason": why, "rejected": F.when(t["i"] == 0, s["rejected"]).otherwise(F.slice(s["rejected"], F.lit(1), F.size(s["rejected"]) - 1))}
        return F.struct(*[changed.get(c, s[c]).alias(c) for c in _FIELDS]).cast(_STATE)

    def step(s: Column, t: Column) -> Column:
        why = F.when(t["i"] == 0, t["stop"]).otherwise(t["rewrite_stop"])
        wanted = s["open"] & ((t["i"] == 0) | s["asked"])
        return F.when(~wanted, s).when(why.isNotNull(), stopped(s, t, why)).otherwise(T.once(verdict(s, t), lambda v: after(s, t, v)))

    found = done.select(F.col("conv_id").alias("dialog_id"), F.aggregate("tries", start, step).alias("s"))
    return found.select(
        "dialog_id", F.col("s.open").alias("accepted"), "s.repairs", F.col("s.tried").alias("repairs_tried"), F.col("s.passed").alias("first_passed"), F.col("s.checked").alias("first_checked"), "s.calls",
        F.col("s.reason").alias("discard_reason"), "s.rejected", "s.first_violations",
    )


def preference_pairs(dialogs: DataFrame) -> DataFrame:
    """(dialog_id, turn, rejected, chosen): replies that failed with the rewrites that passed."""
    rows = dialogs.select("dialog_id", F.explode("rejected").alias("r"))
    return rows.where("r.accepted_rewrite is not null").select("dialog_id", "r.turn", F.col("r.reply").alias("rejected"), F.col("r.accepted_rewrite").alias("chosen"))


def repair_prompt(violations):
    """A list of what to mend, a line for each violation."""
    return F.array_join(F.transform(violations, lambda v: F.concat(F.lit("- "), v["rule"], F.lit(": "), v["detail"])), "\n")
