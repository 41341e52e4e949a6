"""Confidence order: exact > probable > probable_async > context_only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rank of each confidence.
RANKS = {"exact": 3, "probable": 2, "probable_async": 1, "context_only": 0}


def rank(confidence: Column | str) -> Column:
    c = F.col(confidence) if isinstance(confidence, str) else confidence
    out: Column = F.lit(None).cast("int")
    for name, value in RANKS.items():
        out = F.when(c == name, value).otherwise(out)
    return out


def from_rank(value: Column | str) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    out: Column = F.lit(None).cast("string")
    for name, r in RANKS.items():
        out = F.when(v == r, name).otherwise(out)
    return out


def weakest(*confidences: Column) -> Column:
    return from_rank(F.least(*[rank(c) for c in confidences]))


def strongest(*confidences: Column) -> Column:
    return from_rank(F.greatest(*[rank(c) for c in confidences]))
