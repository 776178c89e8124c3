"""Word families by suffix rules; an approximation of dictionary-based inflection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# British spellings of American suffixes, and of words that no suffix tells.
BRITISH = [
    ("izations", "isations"),
    ("ization", "isation"),
    ("izing", "ising"),
    ("izes", "ises"),
    ("ized", "ised"),
    ("ize", "ise"),
    ("izers", "isers"),
    ("izer", "iser"),
    ("izable", "isable"),
    ("yzing", "ysing"),
    ("yzes", "yses"),
    ("yzed", "ysed"),
    ("yze", "yse"),
]
BRITISH_DOUBLED = [("eled", "elled"), ("eling", "elling"), ("eler", "eller"), ("elers", "ellers")]
BRITISH_WORDS = {
    "color": ["colour", "colours", "coloured", "colouring", "colourful"],
    "honor": ["honour", "honours", "honoured", "honouring"],
    "favor": ["favour", "favours", "favoured", "favouring"],
    "favorite": ["favourite", "favourites"],
    "labor": ["labour", "labours", "laboured", "labouring"],
    "neighbor": ["neighbour", "neighbours", "neighbouring", "neighbourhood", "neighbourhoods"],
    "behavior": ["behaviour", "behaviours"],
    "humor": ["humour"],
    "flavor": ["flavour", "flavours"],
    "harbor": ["harbour", "harbours"],
    "center": ["centre", "centres", "centred", "centring"],
    "theater": ["theatre", "theatres"],
    "meter": ["metre", "metres"],
    "liter": ["litre", "litres"],
    "fiber": ["fibre", "fibres"],
    "gray": ["grey", "greys"],
    "practice": ["practise", "practises", "practised", "practising"],
    "license": ["licence", "licences"],
    "defense": ["defence", "defences"],
    "offense": ["offence", "offences"],
    "program": ["programme", "programmes"],
    "check": ["cheque", "cheques"],
    "tire": ["tyre", "tyres"],
    "age": ["ageing"],
    "judgment": ["judgement", "judgements"],
    "enroll": ["enrol", "enrolment"],
    "fulfill": ["fulfil", "fulfilment"],
}
# The ending of a word, how many letters of it go, and what comes behind the rest in adverbs made from
# adjectives, and in nouns and adjectives made from verbs. The first ending that a word has counts; every verb may also take the last.
DERIVED_ADJECTIVE = [("y", 1, ["ily"]), ("ic", 0, ["ally"]), ("", 0, ["ly"])]
DERIVED_VERB = [("y", 1, ["ial"]), ("e", 1, ["al", "ial", "ation", "tion", "ment"]), ("", 0, ["al", "ial", "ation", "tion"])]
DERIVED_ALWAYS = "ment"


def british_variants(word: Column) -> Column:
    """British spellings of a word by its suffix; words hardly longer than the suffix have none."""
    rules = [(a, b, len(a) + 1) for a, b in BRITISH] + [(a, b, len(a) + 2) for a, b in BRITISH_DOUBLED]
    found = F.array(*[F.when(F.endswith(word, F.lit(a)) & (F.length(word) > least), F.concat(F.substring(word, F.lit(1), F.length(word) - len(a)), F.lit(b))) for a, b, least in rules])
    return F.filter(found, lambda x: x.isNotNull())


def british_words(lexicon: DataFrame) -> DataFrame:
    """(word, form): the British spellings of the words of `lexicon`(word) that no suffix tells."""
    pairs = F.map_from_entries(F.array(*[F.struct(F.lit(a), F.array(*map(F.lit, b))) for a, b in BRITISH_WORDS.items()]))
    return lexicon.select("word").distinct().select("word", F.explode(F.try_element_at(pairs, F.col("word"))).alias("form"))


def inflections(word: Column) -> Column:
    """The word with its regular noun and verb endings."""
    vowel_y = word.rlike("[aeiou]y$")
    stem = F.when(F.endswith(word, F.lit("e")), F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)
    cut_y = F.substring(word, F.lit(1), F.length(word) - 1)
    y = F.endswith(word, F.lit("y")) & ~vowel_y
    s = F.when(y, F.concat(cut_y, F.lit("ies"))).when(word.rlike("(s|x|z|ch|sh)$"), F.concat(word, F.lit("es"))).otherwise(F.concat(word, F.lit("s")))
    # One vowel between single consonants doubles the last one: stop, stopped.
    doubles = word.rlike("^[^aeiou]*[aeiou][^aeiouwxy]$")
    base = F.when(doubles, F.concat(word, F.substring(word, -1, 1))).otherwise(stem)
    ed = F.when(y, F.concat(cut_y, F.lit("ied"))).otherwise(F.concat(base, F.lit("ed")))
    ing = F.concat(F.when(word.rlike("ee$"), word).otherwise(base), F.lit("ing"))
    return F.array_distinct(F.array(word, s, ed, ing))


# What an ending leaves of a form; the first alternative that fits counts.
_Y = r"([^aeiou])(?:ies|ied)$"
_ENDING = r"^(?:(.*(?:s|x|z|ch|sh))es|(.{2,}[^s])s|(.{3,})ing|(.{3,})ed)$"
_LAST = r"([bdgmnprt])\1$|(.)e$"


def lemma(word: Column) -> Column:
    """A regular form without its ending; an approximation that is equal for forms of one family."""
    y = F.regexp_replace(F.lower(word), _Y, "$1y")
    return F.regexp_replace(F.regexp_replace(y, _ENDING, "$1$2$3$4"), _LAST, "$1$2")


def made_forms(word: Column) -> Column:
    """Adverbs, nouns and adjectives that the endings make of a word, known or not."""
    cut = lambda n: F.substring(word, F.lit(1), F.length(word) - n)

    def first_of(rules: list[tuple[str, int, list[str]]], least: int) -> Column:
        chosen = F.array().cast("array<string>")
        for ending, gone, made in reversed(rules):
            has = F.endswith(word, F.lit(ending)) & (F.length(word) > (least if ending == "y" else 0))
            chosen = F.when(has, F.array(*[F.concat(cut(gone), F.lit(x)) for x in made])).otherwise(chosen)
        return chosen

    return F.array_distinct(F.concat(first_of(DERIVED_ADJECTIVE, 2), first_of(DERIVED_VERB, 0), F.array(F.concat(word, F.lit(DERIVED_ALWAYS)))))


def derivational_forms(lexicon: DataFrame, known: DataFrame) -> DataFrame:
    """(word, form): adverbs and nouns made from the words of `lexicon`(word) that `known`(word) lists and it doesn't.

    Without a dictionary of parts of speech each word is taken as adjective and as verb; `known` decides.
    """
    forms = lexicon.select("word").distinct().select("word", F.explode(made_forms(F.col("word"))).alias("form"))
    forms = forms.join(known.select(F.col("word").alias("form")).distinct(), "form", "left_semi")
    return forms.join(lexicon.select(F.col("word").alias("form")).distinct(), "form", "left_anti").select("word", "form")
