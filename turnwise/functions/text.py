"""Scalar text functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of words, anchors, quotes and contractions that results depend on.
WORD = "[A-Za-z][A-Za-z'’-]*+"
MONTH = "(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
# A pattern that begins with a boundary looks at the next character first: that is quicker at the places where nothing begins.
DATE = rf"(?=[\dJFMASOND])\b(?:\d{{1,2}}/\d{{1,2}}/\d{{2,4}}\b|\d{{4}}-\d{{2}}-\d{{2}}\b|{MONTH}\.?\s+\d{{1,2}}(?:st|nd|rd|th)?(?:,?\s+\d{{4}})?\b)"
AMOUNT = r"\$\s?\d(?:[\d,]*\d)?(?:\.\d+)?"
PHONE = r"(?=[\d(])\b(?:1[-. ])?(?:\(\d{3}\)\s?|\d{3}[-. ])\d{3}[-. ]\d{4}\b"
ANCHORS = {"date": DATE, "amount": AMOUNT, "phone": PHONE}
QUOTE = '"[^"\\n]+"|“[^”\\n]+”'
CONTRACTIONS = [
    (r"\bwon['’]t\b", "will not"),
    (r"\bcan['’]t\b", "can not"),
    (r"\bshan['’]t\b", "shall not"),
    (r"\bain['’]t\b", "is not"),
    (r"\blet['’]s\b", "let us"),
    (r"\bcannot\b", "can not"),
    (r"n['’]t\b", " not"),
    (r"['’]ll\b", " will"),
    (r"['’]re\b", " are"),
    (r"['’]ve\b", " have"),
    (r"['’]m\b", " am"),
    (r"['’]d\b", " would"),
]


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value worked out a single time; within a lambda it would be at each place where f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space of any kind at either end; a text with other ASCII characters at both is left at a glance."""
    plain = lambda end: F.ascii(end).between(33, 126)
    return F.when(plain(text) & plain(F.substring(text, -1, 1)), text).otherwise(F.regexp_replace(text, r"(?U)^\s+|\s+\z", ""))


def strip_think(text: Column) -> Column:
    """Without closed think blocks in any case, and without an unclosed one to the end."""
    closed = F.regexp_replace(text, r"(?is)<think>.*?</think>", "")
    return F.when(F.contains(text, F.lit("<")), F.regexp_replace(closed, r"(?is)<think>.*\z", "")).otherwise(text)


def strip_thinking(text: Column) -> Column:
    """The training variant: lower-case tags only, with the white space behind them.

    Null where a tag is left over, so that such rows can be told apart; required() makes them an error.
    """
    rest = F.regexp_replace(text, r"(?s)<think>.*?</think>\s*", "")
    return once(rest, lambda r: F.when(~r.rlike("</?think>"), strip(r)))


def required(value: Column, what: str) -> Column:
    """The value; a null fails the job with `what`."""
    return F.when(value.isNotNull(), value).otherwise(F.raise_error(F.lit(what)))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    """Words of a text, at least 1 so that it can divide."""
    return F.greatest(F.lit(1), F.regexp_count(text, F.lit(WORD))).cast("long")


def blanked(text: Column, pattern: str) -> Column:
    """The text with each match replaced by as many spaces, so that offsets hold."""

    def pieces(t: Column) -> Column:
        gaps = F.split(t, pattern, -1)
        found = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        # A gap with the match behind it; the last gap has none.
        return F.array_join(F.zip_with(gaps, found, lambda g, m: F.concat(g, F.coalesce(F.rpad(F.lit(""), F.length(m), " "), F.lit("")))), "")

    return once(text, pieces)


def verbatim_in(needle: Column, text: Column) -> Column:
    """Whether the text has the needle as it is, not inside a longer word."""
    # Most texts don't have it at all, and no pattern is made for them.
    return F.contains(text, needle) & F.rlike(text, F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.replace(needle, F.lit("\\E"), F.lit("")), F.lit(r"\E(?!\w)")))


def whole_words(term: Column) -> Column:
    """A pattern for a term as whole words in any case, its spaces standing for any white space."""
    escaped = lambda t: F.regexp_replace(F.regexp_replace(t, r"([\\.\[\]{}()*+?^$|])", r"\\$1"), r"\s+", r"\\s+")
    return F.concat(F.lit("(?iU)(?="), escaped(F.substring(term, 1, 1)), F.lit(r")(?<![\w'’-])"), escaped(term), F.lit(r"(?![\w'’-])"))


def word_spans(term: Column, text: Column) -> Column:
    """array<struct<start, end>>: the places of a term in a text as whole words; code points, end exclusive."""
    gaps, found = F.split(text, whole_words(term), -1), F.regexp_extract_all(text, whole_words(term), F.lit(0))
    kind = "array<struct<start:int,end:int>>"

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["word"]), F.lit(0))
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["word"].isNotNull(), F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    pieces = F.zip_with(gaps, found, lambda g, w: F.struct(g.alias("gap"), w.alias("word")))
    return F.aggregate(pieces, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("spans")), step, lambda s: s["spans"])


def without_term(term: Column, text: Column) -> Column:
    """The text with a space for each place of a term as whole words."""
    return F.regexp_replace(text, whole_words(term), F.lit(" "))


#: End marks followed by white space, and line breaks.
GAPS = r"(?=\s)(?:(?<=[.?!][\"”)]?)\s+|\n+)"


def stretches(text: Column, gaps: str = GAPS) -> Column:
    """What is between the gaps of a text: its sentences, with what white space is around them, and empty ones."""
    return F.split(text, gaps, -1)


def sentences(text: Column, gaps: str = GAPS) -> Column:
    """Sentences by a pattern of the gaps between them; the plain one is an approximation of a trained splitter, boundaries.pattern() learns a better one."""
    return F.filter(F.transform(stretches(text, gaps), strip), lambda s: s != "")


def anchors(text: Column) -> Column:
    """array<struct<kind, anchor>>: dates, amounts and phone numbers, by kind in text order."""
    of = lambda kind, rx: F.transform(F.regexp_extract_all(text, F.lit(rx), F.lit(0)), lambda a: F.struct(F.lit(kind).alias("kind"), a.alias("anchor")))
    return F.concat(*[of(k, rx) for k, rx in ANCHORS.items()])


def anchor_texts(text: Column) -> Column:
    """Distinct anchors, first ones first within each kind."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(rx), F.lit(0)) for rx in ANCHORS.values()]))


def _has_mark(text: Column) -> Column:
    return F.contains(text, F.lit("'")) | F.contains(text, F.lit("’"))


def expand_contractions(text: Column) -> Column:
    """The text with contractions spelled out; most texts have none and are left at a glance."""

    def expanded(t: Column) -> Column:
        full = t
        for pattern, long in CONTRACTIONS:
            full = F.regexp_replace(full, f"(?iU){pattern}", long)
        return F.when(_has_mark(t) | F.contains(F.lower(t), F.lit("cannot")), full).otherwise(t)

    return once(text, expanded)


def plain_words(text: Column) -> Column:
    """The words of a text with contractions spelled out and possessive endings off."""

    def bare(t: Column) -> Column:
        found = words(expand_contractions(t))
        return F.when(_has_mark(t), F.filter(F.transform(found, strip_possessive), lambda w: w != "")).otherwise(found)

    return once(text, bare)


def strip_possessive(word: Column) -> Column:
    return F.regexp_replace(word, r"['’]s\z|['’]\z", "")


def _may_quote(text: Column) -> Column:
    return F.contains(text, F.lit('"')) | F.contains(text, F.lit("“"))


def _block_quoted(line: Column) -> Column:
    return F.startswith(line, F.lit(">")) | (F.contains(line, F.lit(">")) & line.rlike(r"^[ \t]*>"))


def inline_blanked(text: Column) -> Column:
    """The text with inline quotes blanked; most texts have none and are left at a glance."""
    return F.when(_may_quote(text), blanked(text, QUOTE)).otherwise(text)


def quote_contents(text: Column, inline: Column | None = None) -> Column:
    """Contents of inline quotes, then of block-quoted lines; the latter see inline quotes as blanks. `inline` is inline_blanked() where that is at hand."""
    none = F.array().cast("array<string>")
    quoted = F.transform(F.regexp_extract_all(text, F.lit(QUOTE), F.lit(0)), lambda q: F.substring(q, F.lit(2), F.length(q) - 2))
    lines = lambda t: F.filter(F.split(t, "\n", -1), _block_quoted)
    block = lambda t: F.filter(F.transform(lines(t), lambda q: once(F.regexp_replace(q, r"^[ \t]*>[ \t]?", ""), strip)), lambda c: c != "")
    unwrapped = lambda t: F.transform(block(t), lambda c: F.when(c.rlike(r'(?s)^["“].*["”]\z') & (F.length(c) > 1), F.substring(c, F.lit(2), F.length(c) - 2)).otherwise(c))
    seen = lambda t: F.when(F.contains(t, F.lit(">")), unwrapped(t)).otherwise(none)
    return F.concat(F.when(_may_quote(text), quoted).when(text.isNotNull(), none), seen(inline) if inline is not None else once(inline_blanked(text), seen))


def unquoted(text: Column, inline: Column | None = None) -> Column:
    """The text with inline quotes and block-quoted lines blanked. `inline` is inline_blanked() where that is at hand."""
    blank = lambda line: F.when(_block_quoted(line), F.rpad(F.lit(""), F.length(line), " ")).otherwise(line)
    rest = lambda t: F.when(F.contains(t, F.lit(">")), F.array_join(F.transform(F.split(t, "\n", -1), blank), "\n")).otherwise(t)
    return rest(inline) if inline is not None else once(inline_blanked(text), rest)


def quoted_chars(text: Column, contents: Column | None = None) -> Column:
    return F.aggregate(contents if contents is not None else quote_contents(text), F.lit(0), lambda n, c: n + F.length(c)).cast("long")


def quote_ratio(text: Column, contents: Column | None = None) -> Column:
    """Quoted characters over all; 0 for an empty text."""
    return F.coalesce(F.try_divide(quoted_chars(text, contents), F.length(text)), F.lit(0.0))


def quote_matches(content: Column, source: Column) -> Column:
    """Exact part of the source, or so without one closing comma or period, or one word in any case."""
    word_in = lambda word: word.rlike(r"(?U)^\S+\z") & F.contains(F.lower(source), F.lower(word))
    trimmed_in = lambda t: F.contains(source, t) | once(strip(t), word_in)
    return F.contains(source, content) | once(F.regexp_replace(content, r"[,.]\z", ""), trimmed_in)


def money(amount: Column) -> Column:
    """$1,234.50"""
    return F.concat(F.lit("$"), F.format_number(amount.cast("decimal(14,2)"), 2))


def long_date(day: Column) -> Column:
    """March 4, 2027"""
    return F.date_format(day, "MMMM d, yyyy")


def parse_long_date(text: Column) -> Column:
    return F.to_date(F.try_to_timestamp(text, F.lit("MMMM d, yyyy")))


def earliest(printed: Column) -> Column:
    """Of an array of printed dates the earliest as it is printed; what is no date doesn't count."""
    dated = F.filter(F.transform(printed, lambda p: F.struct(parse_long_date(p).alias("day"), p.alias("text"))), lambda x: x["day"].isNotNull())
    return F.array_min(dated)["text"]


def retry_seconds(text: Column) -> Column:
    """The wait that a rate-limit message asks for; null where it asks for none."""
    return F.regexp_extract(text, r"retry in ([0-9.]+)s", 1).try_cast("double")


def subject(spec: Column) -> Column:
    """struct<provider, model> of provider:model, split at the first colon."""
    parts = F.split(spec, ":", 2)
    return F.struct(parts[0].alias("provider"), F.get(parts, F.lit(1)).alias("model"))


def markers(model: Column) -> Column:
    """struct<response, end>: where a model family's assistant turns begin and end; the first family by default."""
    llama = F.contains(F.lower(model), F.lit("llama")) & ~F.contains(F.lower(model), F.lit("qwen"))
    response = F.when(llama, F.lit("<|start_header_id|>assistant<|end_header_id|>\n\n")).otherwise(F.lit("<|im_start|>assistant\n"))
    end = F.when(llama, F.lit("<|eot_id|>")).otherwise(F.lit("<|im_end|>"))
    return F.struct(response.alias("response"), end.alias("end"))


def assistant_spans(text: Column, response: str = "<|im_start|>assistant\n", end: str = "<|im_end|>") -> Column:
    """array<struct<start, end>>: code points from behind each response mark through the end mark, or to the end."""
    parts = F.split(text, "\\Q" + response + "\\E", -1)
    kind = "array<struct<start:int,end:int>>"

    def step(s: Column, part: Column) -> Column:
        stop = F.instr(part, end)
        size = F.when(stop > 0, stop - 1 + len(end)).otherwise(F.length(part))
        span = F.array(F.struct(s["at"].alias("start"), (s["at"] + size).alias("end")))
        return F.struct((s["at"] + F.length(part) + len(response)).alias("at"), F.concat(s["spans"], span).alias("spans"))

    start = F.struct((F.length(parts[0]) + len(response)).alias("at"), F.array().cast(kind).alias("spans"))
    return F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), start, step, lambda s: s["spans"])


def hash_fraction(key: Column) -> Column:
    """A fixed place of a key in [0, 1): the first 32 bits of its SHA-256."""
    return F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def histogram(counts: Column, top: int | None = None) -> Column:
    """`rule:n; rule:n` of a map<string, long> by falling count, then name; `none` if it is empty."""
    entries = F.transform(F.map_entries(counts), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("k")))
    entries = F.array_sort(entries)
    if top is not None:
        entries = F.slice(entries, 1, top)
    text = F.array_join(F.transform(entries, lambda e: F.concat(e["k"], F.lit(":"), (-e["n"]).cast("string"))), "; ")
    return F.when(text == "", F.lit("none")).otherwise(text)


def padded(ids: Column, width: Column, pad: int) -> Column:
    """An array filled up to `width` elements."""
    return F.concat(ids, F.array_repeat(F.lit(pad), F.greatest(width - F.size(ids), F.lit(0))))
