"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A seed is the hash of the tokens at the set positions of a fixed mask; the other positions may hold
anything. Seeds of benchmark items and of documents are joined, each hit gives a diagonal (where the
item would begin in the document), and the tokens along the diagonal are compared one by one: the
document holds the item if some WINDOW tokens in a row, or the whole of a shorter item, agree in
AGREE of their places or more. The masks are so chosen that none of these is missed. An item of too
few tokens for a mask is its own seed, and a document holds it where it has the same tokens in a row.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import Staged

#: One of these lies on equal tokens alone in every window of SHORT to WINDOW tokens that agrees in AGREE of its places.
MASKS = ("11111", "111011", "11010011")
WINDOW = 13
AGREE = 0.8
#: Items of fewer than MIN_TOKENS tokens are their own seeds; those of fewer than SHORT must agree in all places.
MIN_TOKENS, SHORT = 5, 8
#: Seeds of up to about so many bytes are broadcast. Beyond, documents' seeds pass a bit table of FILTER_WORDS x 64 bits, which
#: is broadcast in place of them, and are then joined in a shuffle.
BROADCAST_BYTES, FILTER_WORDS = 32 << 20, 1 << 19
#: Ranges of scripts without spaces between words (Thai, Lao, Burmese, Khmer, Kana, Han): each character is a token.
_UNSPACED = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)]
_ALONE = "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in _UNSPACED) + "]"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, and single characters of scripts that have no spaces."""
    low = F.lower(text)
    low = F.when(low.rlike(_ALONE), F.regexp_replace(low, f"({_ALONE})", " $1 ")).otherwise(low)
    return F.split(F.trim(F.regexp_replace(low, r"[^\p{L}\p{N}]+", " ")), " ", -1)


def _seeds(rows: DataFrame, short: list[int], whole_only: bool = False) -> DataFrame:
    """A row for each position and mask of the token hashes `hashes` of `rows`: columns position, seed.

    The hashes of so many tokens in a row as `short` lists are seeds too, with `whole_only` where they
    are all tokens that there are; no token at all gives none.
    """
    least = min([*short, *map(len, MASKS)])
    at = rows.withColumn("n", F.size("hashes")).where(F.element_at("hashes", 1) != F.xxhash64(F.lit("")))
    at = at.withColumn("position", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - least, F.lit(0)))))
    of = lambda i, places: F.xxhash64(F.lit(i), *[F.get("hashes", F.col("position") + k) for k in places])
    seed = lambda i, m: F.when(F.col("position") + len(m) <= F.col("n"), of(i, [k for k, c in enumerate(m) if c == "1"]))
    fits = lambda n: F.col("n") == n if whole_only else F.col("position") + n <= F.col("n")
    row = [F.when(fits(n), of(-n, range(n))) for n in short]
    each = at.withColumn("seed", F.explode(F.array(*[seed(i, m) for i, m in enumerate(MASKS)], *row)))
    return each.where("seed is not null").drop("n")


def _hashed(rows: DataFrame) -> DataFrame:
    """`rows` with the hashes of the tokens of `text` in its place; rows without a text are left out."""
    words = rows.withColumn("words", tokens(F.col("text"))).where(F.col("words").isNotNull())
    return words.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w))).drop("words", "text")


def _hits(seeds: DataFrame, of_items: DataFrame, key: list[str], n_tokens: int) -> DataFrame:
    """(key, item_id, n_item, diagonal) of documents' seeds that items have."""
    if n_tokens * len(MASKS) * 64 <= BROADCAST_BYTES:
        found = seeds.join(F.broadcast(of_items), "seed")
    else:
        word, bit = F.pmod("seed", F.lit(FILTER_WORDS)), F.pmod(F.shiftrightunsigned("seed", 32), F.lit(64)).cast("int")
        table = of_items.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))  # FILTER_WORDS rows at most
        passed = seeds.withColumn("word", word).join(F.broadcast(table), "word").where(F.call_function("shiftrightunsigned", F.col("bits"), bit).bitwiseAND(F.lit(1)) == 1)
        found = passed.join(of_items.hint("merge"), "seed")
    return found.select(*key, "item_id", "n_item", (F.col("position") - F.col("at")).alias("diagonal")).distinct()


def _held(rows: DataFrame, key: list[str], benchmark: DataFrame, item_col: str, item_text_col: str, agree: float, whole_only: bool = False) -> DataFrame:
    """(key, item_id, n_equal, n_item) of rows(key, text); rows of one key hold what any of their texts holds, and with `whole_only` items under MIN_TOKENS only as a whole."""
    items = _hashed(benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("item_id is not null"))
    items = items.withColumn("n_item", F.size("hashes")).distinct()
    sizes = items.agg(F.coalesce(F.sum("n_item"), F.lit(0)).alias("n"), F.sort_array(F.collect_set(F.when(F.col("n_item") < MIN_TOKENS, F.col("n_item")))).alias("short")).first()
    n_tokens, short = sizes.n, sizes.short
    texts = _hashed(rows)
    of_items = _seeds(items, short, True).select("seed", "item_id", "n_item", F.col("position").alias("at")).distinct()
    hits = Staged(_hits(_seeds(texts, short, whole_only).select(*key, "seed", "position"), of_items, key, n_tokens), "hits").read()
    # Only documents with a hit are cut into tokens again; each diagonal takes its stretch of them along once.
    hit = _hashed(rows.join(hits.select(*key).distinct(), key, "left_semi"))
    first = F.greatest(F.lit(0), -F.col("diagonal"))
    length = F.least(F.col("n_item"), F.size("hashes") - F.col("diagonal")) - first
    stretch = F.slice("hashes", F.col("diagonal") + first + 1, F.greatest(F.lit(0), length))
    along = hit.join(hits, key).where(F.col("diagonal") < F.size("hashes")).select(*key, "item_id", "n_item", first.alias("first"), stretch.alias("stretch"), F.size("hashes").alias("n_text"))
    once = along.join(items.select("item_id", "n_item", F.col("hashes").alias("item")), ["item_id", "n_item"])
    equal = F.zip_with("stretch", F.slice("item", F.col("first") + 1, F.size("stretch")), lambda a, b: (a == b).cast("int"))
    width = F.least(F.lit(WINDOW), F.col("n_item"))
    total = lambda x: F.aggregate(x, F.lit(0), lambda s, e: s + e)
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size("equal") - F.col("width") + 1), lambda i: total(F.slice("equal", i, F.col("width")))))
    if whole_only:
        once = once.where((F.col("n_item") >= MIN_TOKENS) | (F.col("n_item") == F.col("n_text")))
    checked = once.select(*key, "item_id", "n_item", width.alias("width"), equal.alias("equal")).where(F.size("equal") >= F.col("width"))
    passed = checked.where(best >= F.when(F.col("n_item") < SHORT, F.col("width")).otherwise(F.ceil(F.lit(agree) * F.col("width"))))
    return passed.groupBy(*key, "item_id").agg(F.max(total(F.col("equal"))).alias("n_equal"), F.max("n_item").alias("n_item"))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", agree: float = AGREE) -> DataFrame:
    """(doc_id, item_id, n_equal, n_item): the items that each document holds, whole texts against all items.

    n_equal is the most equal tokens along any diagonal that passes. Items under MIN_TOKENS tokens are
    found wherever a document has their tokens in a row. Null and empty texts hold
    nothing and are held by nothing, and so are rows with a null id. Repeated rows count once, and
    an id with several texts holds what any of them holds. Other columns are ignored; empty tables
    give no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    return _held(rows, ["doc_id"], benchmark, item_col, item_text_col, agree)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, that hold no item of the benchmark.

    Rows are told apart by two hashes of their text, so a null id or one that repeats with another
    text makes no difference; rows of one text go or stay together. Null texts stay. An item under
    MIN_TOKENS tokens takes only documents that are that item and nothing else: a phrase so short is
    in too many that have nothing to do with it.
    """
    tag = uuid.uuid4().hex
    text = F.col(text_col).cast("string")
    name = {f"a_{tag}": F.xxhash64(text), f"b_{tag}": F.hash(text)}
    rows = docs.where(text.isNotNull()).select(*[x.alias(k) for k, x in name.items()], text.alias("text"))
    gone = _held(rows, list(name), benchmark, "item_id", "text", AGREE, True).select(*name).distinct()
    (a, x), (b, y) = name.items()
    return docs.join(gone, (x == F.col(a)) & (y == F.col(b)) & text.isNotNull(), "left_anti")


def oracle_sql(masks: tuple[str, ...] = MASKS) -> str:
    """The same over `documents` and `benchmark` in DuckDB SQL, with token strings for hashes."""
    words = rf"string_split(trim(regexp_replace(regexp_replace(lower(text), '({_ALONE})', ' \1 ', 'g'), '[^\pL\pN]+', ' ', 'g')), ' ')"
    key = lambda t: " UNION ALL ".join(f"SELECT id, w, p, {i} || '|' || concat_ws(' ', {', '.join(f'w[p + {k + 1}]' for k, c in enumerate(m) if c == '1')}) AS seed FROM {t} WHERE p + {len(m)} <= len(w)" for i, m in enumerate(masks))
    return f"""
WITH d AS (SELECT doc_id AS id, {words} AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id AS id, {words} AS w FROM benchmark WHERE text IS NOT NULL),
dp AS (SELECT id, w, unnest(range(0, len(w))) AS p FROM d), bp AS (SELECT id, w, unnest(range(0, len(w))) AS p FROM b WHERE len(w) >= {MIN_TOKENS}),
bs0 AS (SELECT id, w, len(w) AS n FROM b WHERE len(w) < {MIN_TOKENS} AND w <> ['']),
ds AS ({key('dp')}), bs AS ({key('bp')}),
hit AS (SELECT DISTINCT ds.id AS doc_id, bs.id AS item_id, ds.p - bs.p AS g, ds.w AS w, bs.w AS v FROM ds JOIN bs USING (seed)),
eq AS (SELECT doc_id, item_id, g, len(v) AS n_item, least({WINDOW}, len(v)) AS wd,
  list_transform(range(greatest(0, -g), least(len(v), len(w) - g)), lambda i: CASE WHEN v[i + 1] = w[g + i + 1] THEN 1 ELSE 0 END) AS e FROM hit),
ok AS (SELECT doc_id, item_id, n_item, list_sum(e) AS n FROM eq WHERE len(e) >= wd
  AND list_max(list_transform(range(0, len(e) - wd + 1), lambda i: list_sum(e[i + 1 : i + wd]))) >= CASE WHEN n_item < {SHORT} THEN wd ELSE ceil({AGREE} * wd) END
  UNION ALL SELECT dp.id, s.id, s.n, s.n FROM dp JOIN bs0 s ON dp.w[p + 1] = s.w[1] AND dp.w[p + 1:p + s.n] = s.w)
SELECT doc_id, item_id, CAST(max(n) AS INTEGER) AS n_equal, CAST(max(n_item) AS INTEGER) AS n_item FROM ok WHERE doc_id IS NOT NULL AND item_id IS NOT NULL GROUP BY doc_id, item_id
"""
