"""Fill-in-the-middle arrangements of texts, in Spark SQL functions only.

A text is cut into units by a pattern; two of its seams, drawn from a hash of the id, part it into
prefix, middle and suffix, which are put together around sentinels so that the middle comes last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentinels before prefix, suffix and middle; units of lines, each with its line break; the form of texts left as they are.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
LINES = r"[^\n]*\n|[^\n]+"
PLAIN, PSM, SPM = "plain", "psm", "spm"
SEED, RATE, SPM_RATE = 7, 100, 50


def check_sentinels(sentinels: tuple[str, str, str]) -> None:
    """Raises unless each is found where it was put: none empty, in another, or ending as another or itself begins."""
    for a in sentinels:
        for b in sentinels:
            laps = any(a.endswith(b[:n]) for n in range(1, min(len(a), len(b)) + (a != b)))
            if not a or laps or (a != b and b in a) or len(set(sentinels)) < 3:
                raise ValueError(f"sentinels that can't be told apart: {sentinels}")


def draws(key: Column, seed: int = SEED) -> list[Column]:
    """Four whole numbers of 32 bits from the SHA-256 of `seed:key`; a null key is the empty string."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hashed, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def arrange(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE,
    units: str = LINES, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE),
) -> DataFrame:
    """(doc_id, n, form, prefix, middle, suffix, output) of every row of `docs`.

    `units` is a pattern whose matches, left to right, make up the whole text; n counts them. Of a
    hundred texts about `rate` are arranged, of these `spm_rate` with the suffix first; empty texts
    and those that hold a sentinel stay plain, with null parts. A null text is empty, a null id is
    drawn for as the empty string, rows that repeat an id and a text give equal rows, and other
    columns of `docs` are ignored. An empty table gives no rows.
    """
    check_sentinels(sentinels)
    p, s, m = map(F.lit, sentinels)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("units", F.regexp_extract_all("text", F.lit(units), F.lit(0))).withColumn("n", F.size("units").cast("long")).withColumn("h", F.array(*draws(F.col("doc_id"), seed)))
    holds = F.contains("text", p) | F.contains("text", s) | F.contains("text", m)
    form = F.when((F.col("text") == "") | holds | (F.col("h")[2] % 100 >= rate), PLAIN).when(F.col("h")[3] % 100 < spm_rate, SPM).otherwise(PSM)
    seams = [(F.col("h")[i] % (F.col("n") + 1)).cast("int") for i in range(2)]
    rows = rows.select("doc_id", "text", "units", "n", form.alias("form"), F.least(*seams).alias("first"), F.greatest(*seams).alias("second"))
    part = lambda start, stop: F.when(F.col("form") != PLAIN, F.array_join(F.slice("units", start + 1, stop - start), ""))
    a, b, end = F.col("first"), F.col("second"), F.col("n").cast("int")
    rows = rows.select("doc_id", "text", "n", "form", part(F.lit(0), a).alias("prefix"), part(a, b).alias("middle"), part(b, end).alias("suffix"))
    psm = F.concat(p, F.col("prefix"), s, F.col("suffix"), m, F.col("middle"))
    spm = F.concat(s, F.col("suffix"), p, F.col("prefix"), m, F.col("middle"))
    return rows.select("doc_id", "n", "form", "prefix", "middle", "suffix", F.when(F.col("form") == PSM, psm).when(F.col("form") == SPM, spm).otherwise(F.col("text")).alias("output"))


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that an output was arranged from, by its form and its sentinels alone; null where a sentinel is missing."""
    p, s, m = sentinels
    # What stands between the first and the second, the second and the third, and behind the third.
    between = lambda first, second: (F.split_part(F.split_part(output, F.lit(first), F.lit(2)), F.lit(second), F.lit(1)), F.split_part(F.split_part(output, F.lit(second), F.lit(2)), F.lit(m), F.lit(1)))
    middle = F.split_part(output, F.lit(m), F.lit(2))
    prefix, suffix = between(p, s)
    whole = F.contains(output, F.lit(p)) & F.contains(output, F.lit(s)) & F.contains(output, F.lit(m))
    psm = F.when(whole, F.concat(prefix, middle, suffix))
    suffix, prefix = between(s, p)
    return F.when(form == PSM, psm).when(form == SPM, F.when(whole, F.concat(prefix, middle, suffix))).otherwise(output)


def digest(arranged: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of what arrange() returns, for the default sentinels."""
    chars = lambda c: F.length(c).cast("long").alias(f"{c}_chars")
    sha = lambda c: F.sha2(c, 256)
    restored = restore(F.col("output"), F.col("form"))
    return arranged.select("doc_id", "n", "form", chars("prefix"), chars("middle"), sha(F.col("output")).alias("output_sha256"), sha(restored).alias("restored_sha256"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
h AS (
  SELECT *, len(units) AS n, CAST('0x' || s[1:8] AS BIGINT) AS h1, CAST('0x' || s[9:16] AS BIGINT) AS h2, CAST('0x' || s[17:24] AS BIGINT) AS h3, CAST('0x' || s[25:32] AS BIGINT) AS h4 FROM d),
f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (
  SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS prefix, coalesce(array_to_string(units[a + 1:b], ''), '') AS middle, coalesce(array_to_string(units[b + 1:n], ''), '') AS suffix FROM f),
o AS (
  SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM p)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(output) AS output_sha256, sha256(text) AS restored_sha256 FROM o
"""
