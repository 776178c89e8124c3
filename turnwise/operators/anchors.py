"""Anchors of sources and user turns: dates, amounts and phone numbers that replies are held to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnwise.functions import text as T

# Fixed value: the words that make a sentence of a source an obligation.
MODAL_SOURCE = r"(?i)(?=[mrh])\b(must|required|have to|has to)\b"


def all_anchors(texts: Column) -> Column:
    """Distinct anchors of an array of texts."""
    return F.array_distinct(F.flatten(F.transform(texts, T.anchor_texts)))


def bound_anchors(source: Column, gaps: str = T.GAPS) -> Column:
    """The anchors of the source's sentences that oblige, in order."""
    duties = F.filter(T.stretches(source, gaps), lambda s: s.rlike(MODAL_SOURCE))
    return F.array_sort(all_anchors(duties))
