"""Completions of conversations by a reply provider that is given as an expression or a function of batches."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.operators import turns
from turnwise.sources.files import write_jsonl


def with_completions(rows: DataFrame, complete: Callable[[Column], Column] | Callable[[pd.Series], pd.Series], batched: bool = False, system: str = "") -> DataFrame:
    """`rows`(messages, ...) with `completion`, what `complete` says to their prompts.

    A last assistant turn is a reference answer: it is kept in `messages` but is no part of the
    prompt. Rows may have a column `prompt`, which stands where they have no messages, behind the
    `system` message. `complete` maps the column of prompts, or with `batched` a series of them; a row
    with neither has a null completion.
    """
    line = lambda m: F.concat(m["role"], F.lit(": "), F.coalesce(m["text"], F.lit("")))
    text = F.when(F.col("messages").isNotNull(), F.array_join(F.transform(turns.without_trailing_assistant(F.col("messages")), line), "\n"))
    if "prompt" in rows.columns:
        text = F.coalesce(text, F.concat(F.lit(f"system: {system}\nuser: "), F.col("prompt")))
    asked = rows.withColumn("completion", text)
    said = F.pandas_udf(complete, "string")(F.coalesce("completion", F.lit(""))) if batched else complete(F.col("completion"))
    return asked.withColumn("completion", F.when(F.col("completion").isNotNull(), said))


def write_completions(rows: DataFrame, complete: Callable[[Column], Column] | Callable[[pd.Series], pd.Series], path: str, batched: bool = False, system: str = "") -> None:
    """The rows with their completions as JSON lines, as many files as partitions, so that each is written where it was answered."""
    write_jsonl(with_completions(rows, complete, batched, system), path)
