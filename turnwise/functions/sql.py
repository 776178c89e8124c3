"""The library's functions under names for SQL text: scalar functions and table functions, which Catalyst inlines, and a table function over partitions of turns."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from turnwise.functions import text as T


def _text(pattern: str) -> str:
    """A pattern as a raw SQL string."""
    return 'r"' + pattern + '"' if '"' not in pattern else "r'" + pattern + "'"


def statements() -> list[str]:
    """What register() runs, each a temporary function of the session."""
    anchors = " UNION ALL ".join(
        f"SELECT '{kind}' AS kind, CAST(pos + 1 AS INT) AS place, anchor FROM (SELECT posexplode(regexp_extract_all(said, {_text(rx)}, 0)) AS (pos, anchor))" for kind, rx in T.ANCHORS.items()
    )
    return [
        f"CREATE OR REPLACE TEMPORARY FUNCTION reply_words(said STRING) RETURNS BIGINT RETURN greatest(1, regexp_count(said, {_text(T.WORD)}))",
        r"CREATE OR REPLACE TEMPORARY FUNCTION without_thinking(said STRING) RETURNS STRING RETURN regexp_replace(regexp_replace(said, r'(?is)<think>.*?</think>', ''), r'(?is)<think>.*\z', '')",
        "CREATE OR REPLACE TEMPORARY FUNCTION per_100_words(n BIGINT, words BIGINT) RETURNS DOUBLE RETURN bround(n * 100.0D / greatest(words, 1), 2)",
        "CREATE OR REPLACE TEMPORARY FUNCTION hash_fraction(key STRING) RETURNS DOUBLE RETURN CAST(conv(substring(sha2(key, 256), 1, 8), 16, 10) AS DOUBLE) / 4294967296.0D",
        f"CREATE OR REPLACE TEMPORARY FUNCTION anchors_of(said STRING) RETURNS TABLE(kind STRING, place INT, anchor STRING) RETURN {anchors}",
    ]


@udtf(returnType="conv_id string, turn bigint, reply_index int, n_said int")
class ReplyPlaces:
    """Of TABLE(turns: conv_id, turn, role) PARTITION BY conv_id ORDER BY turn: each reply with its place among the replies and the user turns before it; no turn is kept."""

    def __init__(self):
        self.replies, self.said = 0, 0

    def eval(self, row):
        if row["role"] == "user":
            self.said += 1
        elif row["role"] == "assistant":
            yield str(row["conv_id"]), row["turn"], self.replies, self.said
            self.replies += 1


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session: reply_words, without_thinking, per_100_words, hash_fraction, anchors_of and reply_places."""
    for statement in statements():
        spark.sql(statement)
    spark.udtf.register("reply_places", ReplyPlaces)
