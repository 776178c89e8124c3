"""Word families learned from a corpus: which form goes back to which base, as a table.

A form is cut into a stem and an ending; the stem with a base ending may be a word of the corpus too.
How often that is so, by base ending, ending and shape of the stem, tells which base a form goes back
to where several are words: `caring` to `care` rather than `car`, as stems of this shape double their
consonant before `ing` when the base is bare. Irregular forms come from a list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnwise.functions import text as T

#: Endings of a form and what the base may have in their place; + stands for the stem's last letter once more.
ALTERNATIONS = [
    ("s", ["", "e"]), ("es", ["", "e"]), ("ies", ["y"]), ("ed", ["", "e"]), ("ied", ["y"]), ("ing", ["", "e"]), ("+ed", [""]), ("+ing", [""]), ("er", ["", "e"]), ("est", ["", "e"]), ("ier", ["y"]), ("iest", ["y"]), ("+er", [""]), ("+est", [""]),
]
#: The least stems that an alternation must have, the least share of the forms with its ending, the least letters of a stem, and how many forms all shapes together count as in the share of one.
LEAST_STEMS, LEAST_SHARE, LEAST_LETTERS, PRIOR = 3, 0.05, 2, 2.0
# Irregular English forms, base first.
IRREGULAR = """be am is are was were been being
have has had having
do does did done doing
go goes went gone going
say says said
make makes made making
get gets got gotten getting
give gives gave given giving
take takes took taken taking
come comes came coming
see sees saw seen
know knew known
think thought
find found
tell told
become became
leave left leaving
feel felt
bring brought
begin began begun beginning
keep kept
hold held
write wrote written
stand stood
hear heard
let letting
mean meant
meet met
pay paid
send sent
build built
fall fell fallen
lose lost losing
speak spoke spoken
spend spent
buy bought
teach taught
catch caught
sell sold
eat ate eaten
choose chose chosen
child children
man men
woman women
person people
foot feet
tooth teeth
good better best
bad worse worst"""
# Words that look like a form of another and are none.
ALONE = "news during thing things nothing something anything being need needs seed indeed speed hundred bed red used series species this his does has was bus gas pass less across process address access unless always perhaps".split()


def vocabulary(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(lang, word): the distinct lower-case words of documents(lang, text)."""
    return docs.select("lang", F.explode(F.array_distinct(F.transform(T.words(F.col(text_col)), F.lower))).alias("word")).distinct()


def shape(stem: Column) -> Column:
    """How a stem ends: on a single vowel and a consonant, on two consonants, on two vowels and a consonant, or else."""
    return F.when(stem.rlike("[aeiou]{2}[^aeiou]$"), "vvc").when(stem.rlike("(^|[^aeiou])[aeiou][^aeiouwxy]$"), "cvc").when(stem.rlike("[^aeiou]{2}$"), "cc").otherwise("other")


def cuts(words: DataFrame) -> DataFrame:
    """(lang, word, stem, ending, shape): the ways of taking an ending off a word that leave LEAST_LETTERS letters or more."""
    word = F.col("word")
    stem = lambda n: F.substring(word, F.lit(1), F.length(word) - n)
    found = []
    for ending, _ in ALTERNATIONS:
        bare = ending.lstrip("+")
        fits = F.endswith(word, F.lit(bare)) & (F.length(word) >= len(bare) + LEAST_LETTERS)
        if ending != bare:
            fits = fits & stem(len(bare)).rlike(r"([bdgklmnprt])\1$") & (F.length(word) >= len(ending) + LEAST_LETTERS)
        found.append(F.when(fits, F.struct(stem(len(ending)).alias("stem"), F.lit(ending).alias("ending"))))
    rows = words.select("lang", "word", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("x")).select("lang", "word", "x.*")
    return rows.where(F.col("stem").rlike("[aeiouy]")).withColumn("shape", shape(F.col("stem")))


def _candidates(words: DataFrame) -> DataFrame:
    """The cuts of words with each base, `base_ending` and `base`, that their ending may stand for."""
    bases = F.create_map(*[x for ending, of in ALTERNATIONS for x in (F.lit(ending), F.array(*map(F.lit, of)))])
    return cuts(words).withColumn("base_ending", F.explode(F.element_at(bases, F.col("ending")))).withColumn("base", F.concat("stem", "base_ending"))


def alternations(words: DataFrame) -> DataFrame:
    """(lang, ending, base_ending, shape, stems, share): for how many stems a form has its base in `words`(lang, word), and for what share of the forms cut so.

    The share of a shape is drawn to that of all shapes with the weight of PRIOR forms; stems count over all shapes.
    """
    known = words.select("lang", F.col("word").alias("base"), F.lit(True).alias("known"))
    tried = _candidates(words).join(known, ["lang", "base"], "left")
    counts = tried.groupBy("lang", "ending", "base_ending", "shape").agg(F.count_if("known").alias("with_base"), F.count("*").alias("all"))
    pooled = counts.groupBy("lang", "ending", "base_ending").agg(F.sum("with_base").alias("stems"), F.sum("all").alias("forms"))
    share = (F.col("with_base") + PRIOR * F.col("stems") / F.col("forms")) / (F.col("all") + PRIOR)
    rows = counts.join(pooled, ["lang", "ending", "base_ending"]).select("lang", "ending", "base_ending", "shape", "stems", share.alias("share"))
    return rows.where((F.col("stems") >= LEAST_STEMS) & (F.col("share") >= LEAST_SHARE))


def irregular(spark) -> DataFrame:
    """(word, base) of the fixed lists; a word that stands alone is its own base."""
    pairs = [(form, line.split()[0]) for line in IRREGULAR.split("\n") for form in line.split()]
    return spark.createDataFrame(sorted({(w, w) for w in ALONE if w not in {f for f, _ in pairs}} | set(pairs)), "word string, base string")


def learned(words: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """(lang, word, family): the family of each of `words`(lang, word), named by its base; a word without a base is one by itself.

    Of the bases that are words the one of the alternation of largest share counts, then the longer,
    then the first. A base may be a form itself (meetings, meeting, meet), so bases are followed
    twice. `exceptions`(word, base) come before all that is learned, in every language.
    """
    words = words.select("lang", "word").distinct()
    known = words.select("lang", F.col("word").alias("base"))
    rules = alternations(words).select("lang", "ending", "base_ending", "shape", "share")
    found = _candidates(words).join(known, ["lang", "base"]).join(rules, ["lang", "ending", "base_ending", "shape"])
    best = found.groupBy("lang", "word").agg(F.max_by("base", F.struct("share", F.length("base"), F.translate("base", "abcdefghijklmnopqrstuvwxyz", "zyxwvutsrqponmlkjihgfedcba"))).alias("base"))
    rows = words.join(best, ["lang", "word"], "left")
    if exceptions is not None:
        fixed = exceptions.groupBy("word").agg(F.min("base").alias("fixed"))
        rows = rows.join(fixed, "word", "left").withColumn("base", F.coalesce("fixed", "base")).drop("fixed")
    rows = rows.select("lang", "word", F.coalesce("base", "word").alias("base"))
    up = rows.select("lang", F.col("word").alias("base"), F.col("base").alias("above"))
    for _ in range(2):
        rows = rows.join(up, ["lang", "base"], "left").select("lang", "word", F.coalesce("above", "base").alias("base"))
    return rows.select("lang", "word", F.col("base").alias("family"))


def same_family(words: DataFrame, families: DataFrame) -> DataFrame:
    """(word): `words`(word) and all forms of their families by `families`(word, family)."""
    own = families.join(words.select("word").distinct(), "word", "left_semi").select("family").distinct()
    return words.select("word").union(families.join(own, "family", "left_semi").select("word")).distinct()


def ambiguous(words: DataFrame) -> DataFrame:
    """(lang, word, bases): forms with several bases that are words, for a look at what the shares decide."""
    known = words.select("lang", F.col("word").alias("base"))
    return _candidates(words).join(known, ["lang", "base"]).groupBy("lang", "word").agg(F.array_sort(F.collect_set("base")).alias("bases")).where(F.size("bases") > 1)

