"""Word lists: reading, building, freezing, and holding replies to them."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnwise.functions import text as T
from turnwise.functions import wordforms as W

# Forms that need no list, the banner, what contractions are spelled out to.
CLITICS = ["'s", "’s", "s’", "s'"]
ORDINAL = r"(?i)(?=[0-9])\b[0-9]+(st|nd|rd|th)\b"
BANNER = (
    "Important: letters like this often have a much shorter deadline if you want to keep your benefits while you ask for a hearing. "
    "Look for it in the letter, and ask a free legal aid office if you are not sure."
)
CONTRACTED = ["not", "will", "are", "have", "am", "would", "can", "shall", "us", "is"]


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """(word): one or more to a line, trimmed, lower case, each once."""
    return spark.read.text(path).select(F.explode(F.split(F.lower("value"), r"(?U)\s+")).alias("word")).where("word != ''").distinct()


def top_words(docs: DataFrame, n: int) -> DataFrame:
    """(lang, word, n_docs, rank): of each language the n words in most documents; ties by word."""
    words = docs.select("lang", F.explode(F.array_distinct(F.transform(T.words(F.col("text")), F.lower))).alias("word"))
    counts = words.groupBy("lang", "word").agg(F.count("*").alias("n_docs"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_docs"), "word"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= n)


def expanded(words: DataFrame) -> DataFrame:
    """(word): words with their inflections and British spellings."""
    forms = words.select(F.explode(W.inflections(F.col("word"))).alias("word")).distinct()
    return forms.select(F.explode(F.concat(F.array("word"), W.british_variants(F.col("word")))).alias("word")).distinct()


def allowed(words: DataFrame, known: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """(word): the list that replies are held to, built from `words`(word).

    Their inflections, the forms made from them that `known`(word) has, with inflections too, and
    British spellings of all; then what contractions are spelled out to, and `extra` words.
    """
    made = W.derivational_forms(words, known).select(F.col("form").alias("word"))
    forms = expanded(words.select("word").union(made))
    forms = forms.union(W.british_words(forms).select(F.col("form").alias("word")))
    more = words.sparkSession.range(1).select(F.explode(F.array(*[F.lit(w) for w in [*CONTRACTED, *(extra or [])]])).alias("word"))
    return forms.union(more).distinct()


def uncovered(text: str, words: DataFrame) -> DataFrame:
    """(word): the words of a text that are not listed; a fixed text that replies must have should have none."""
    own = words.sparkSession.range(1).select(F.explode(F.array_distinct(F.transform(T.words(T.expand_contractions(F.lit(text))), F.lower))).alias("word"))
    return own.join(words.select("word"), "word", "left_anti")


def provenance(words: DataFrame) -> DataFrame:
    """(n, sha256) of the sorted words, each once: the hash of their ranges' hashes in order, a line each.

    Words go to ranges by their first two characters, so no task holds the list; what meets in one
    task is a hash for each pair of first characters.
    """
    head = F.substring("word", 1, 2)
    lines = words.select("word").distinct().groupBy(head.alias("head")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("word")), "\n"), 256).alias("sha"))
    whole = lines.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("head", "sha"))), lambda x: x["sha"]), "\n").alias("all"))
    return whole.select("n", F.sha2("all", 256).alias("sha256"))


def exempt(token: Column, source: Column, user_texts: Column) -> Column:
    """Whether a token needs no list: no letter in it, an ordinal, a clitic, or a capitalised word as in the source or a user turn."""
    plain = ~token.rlike(r"(?U)\p{L}") | token.rlike(r"(?i)^\d+(st|nd|rd|th)$") | F.lower(token).isin(CLITICS)
    named = token.rlike(r"^\p{Lu}") & (T.verbatim_in(token, source) | F.exists(user_texts, lambda u: T.verbatim_in(token, u)))
    return plain | named


def parts(token: Column) -> Column:
    """The parts of a hyphenated token; none of another."""
    inner = F.regexp_replace(token, r"^-+|-+$", "")
    return F.when(F.contains(token, F.lit("-")) & F.contains(inner, F.lit("-")), F.filter(F.split(token, "-"), lambda p: p != "")).otherwise(F.array().cast("array<string>"))


def masked(text: Column, banner: str = BANNER, unquoted: Column | None = None) -> Column:
    """The text without quotes, ordinals and the first place of the banner. `unquoted` is T.unquoted() of it where that is at hand."""

    def rest(plain: Column) -> Column:
        cut = lambda at: F.when(at > 0, F.concat(F.substring(plain, F.lit(1), at - 1), F.lit(" "), F.substring(plain, at + len(banner), F.length(plain)))).otherwise(plain)
        return T.once(F.instr(plain, banner), cut)

    return F.regexp_replace(rest(unquoted) if unquoted is not None else T.once(T.unquoted(text), rest), ORDINAL, " ")


SUSPECT = "array<struct<word:string,family:string,parts:array<string>>>"


#: A list of so many words at most goes into the plan as a constant; a longer one is joined.
MOST_CONSTANT = 1 << 14


class Listed(NamedTuple):
    """The tests whether a list has a word as it is, or None where only families are at hand, and whether it has a family."""

    word: Callable[[Column], Column] | None
    family: Callable[[Column], Column]


def few_words(words: DataFrame, most: int = MOST_CONSTANT) -> Listed | None:
    """The tests whether `words`(word) lists a word or its family, or None if it has more than `most` words.

    A listed form is found as it is; only other words are cut down to their families.
    """
    found = words.select(F.lower("word").alias("word"), W.lemma(F.col("word")).alias("family")).where("word is not null").distinct().limit(most + 1).collect()
    if len(found) > most:
        return None
    forms, families = (sorted({r[i] for r in found}) for i in range(2))
    return Listed(lambda word: F.lower(word).isin(forms), lambda family: family.isin(families))


def pieces(tokens: Column) -> Column:
    """Distinct tokens and the parts of the hyphenated ones."""
    with_parts = lambda own: F.when(F.size(own) > 0, F.array_distinct(F.concat(tokens, F.flatten(F.transform(own, parts))))).otherwise(tokens)
    return T.once(F.filter(tokens, lambda t: F.contains(t, F.lit("-"))), with_parts)


def unlisted(words: Column, listed: Listed) -> Column:
    """array<struct<word, family>>: the words that are not listed."""
    rest = F.filter(words, lambda w: ~listed.word(w)) if listed.word is not None else words
    return F.filter(F.transform(rest, lambda w: F.struct(w.alias("word"), W.lemma(w).alias("family"))), lambda x: ~listed.family(x["family"]))


def said(families: Column, texts: Column) -> Column:
    """Of the families those of words in the texts, and perhaps others of them.

    A word begins as its family does, up to a last y that stands for ies or ied, so only words that
    begin as one of the families are cut down.
    """
    stems = F.transform(families, lambda f: F.regexp_replace(f, r"y\z", ""))
    near = lambda some: F.filter(F.flatten(F.transform(texts, T.plain_words)), lambda w: F.exists(some, lambda s: F.startswith(F.lower(w), s)))
    return F.transform(T.once(stems, near), W.lemma)


def suspects(tokens: Column, listed: Listed, source: Column, user_texts: Column) -> Column:
    """SUSPECT: of the tokens, each distinct, those that are not listed, that no user said and that are no names of the source or a user turn.

    A hyphenated word is no suspect if all its parts are earned; `parts` has the families of those
    that are not. What users said is only looked at where a token is not listed.
    """

    def judged(rest: Column) -> Column:
        def found(open_: Column) -> Column:
            ok = lambda x: ~F.array_contains(open_, x["family"]) | exempt(x["word"], source, user_texts)
            bad = T.once(F.filter(rest, lambda x: ~ok(x)), lambda bad: F.transform(F.array_intersect(tokens, F.transform(bad, lambda x: x["word"])), lambda t: one(t, bad)))
            return F.filter(bad, lambda x: (F.size(parts(x["word"])) == 0) | (F.size(x["parts"]) > 0))

        def one(token: Column, bad: Column) -> Column:
            own = lambda x: F.array_contains(parts(token), x["word"])
            of = F.when(F.contains(token, F.lit("-")), F.transform(F.filter(bad, own), lambda x: x["family"])).otherwise(F.array().cast("array<string>"))
            return F.struct(token.alias("word"), W.lemma(token).alias("family"), of.alias("parts"))

        families = F.array_distinct(F.transform(rest, lambda x: x["family"]))
        return T.once(T.once(families, lambda all_: F.array_except(all_, said(all_, user_texts))), lambda open_: F.when(F.size(open_) > 0, found(open_)).otherwise(F.array().cast(SUSPECT)))

    return T.once(unlisted(pieces(tokens), listed), lambda u: F.when(F.size(u) > 0, judged(u)).otherwise(F.array().cast(SUSPECT)))


def open_words(suspect: Column, families: Column) -> Column:
    """The suspect words that no family taught earns: neither their own nor, of hyphenated ones, those of all open parts."""
    taught = lambda x: F.array_contains(families, x["family"]) | ((F.size(x["parts"]) > 0) & F.forall(x["parts"], lambda p: F.array_contains(families, p)))
    return F.transform(F.filter(suspect, lambda x: ~taught(x)), lambda x: x["word"])


def unearned(reply: Column, lesson: Column, suspect: Column, glossed: Column) -> Column:
    """The distinct lower-case words of a reply that are not earned, in order.

    Quotes, the banner, phrases taught so far and each term in the sentence that glosses it don't count.
    Where the reply has no gloss, `glossed`, its suspects are its own words without quotes and banner.
    """

    phrases = F.filter(lesson["taught"], lambda t: F.contains(t, F.lit(" ")))

    def of_text(some: Column) -> Column:
        text = F.aggregate(lesson["exempt"], reply, lambda t, x: F.replace(t, x["sentence"], T.without_term(x["term"], x["sentence"])))
        text = F.aggregate(phrases, text, lambda t, phrase: T.without_term(phrase, t))
        return F.array_intersect(T.plain_words(masked(text)), some)

    def found(some: Column) -> Column:
        own = F.when(~glossed & (F.size(phrases) == 0), some).otherwise(of_text(some))
        return F.array_sort(F.array_distinct(F.transform(own, F.lower)))

    return T.once(open_words(suspect, lesson["families"]), lambda some: F.when(F.size(some) > 0, found(some)).otherwise(F.array().cast("array<string>")))
