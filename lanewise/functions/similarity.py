"""Name similarities. Ratcliff-Obershelp has no built-in form, so these are Arrow-batched UDFs over candidate pairs only."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCORE_WEIGHTS = (0.65, 0.35)


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matching characters over all; null texts give 0."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b)])


def token_overlap(a: Column, b: Column) -> Column:
    """Common tokens over the smaller set's size."""
    x, y = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    return F.size(F.array_intersect(x, y)) / F.least(F.size(x), F.size(y))


def name_score(a: Column, b: Column) -> Column:
    return SCORE_WEIGHTS[0] * ratio(a, b) + SCORE_WEIGHTS[1] * token_overlap(a, b)


def competition_score(a: Column, b: Column) -> Column:
    """Of match keys: equal 1, one inside the other 0.95, else the ratio, or the token overlap from 0.8."""
    overlap = token_overlap(a, b)
    base = ratio(a, b)
    return (
        F.when(a.isNull() | b.isNull(), 0.0)
        .when(a == b, 1.0)
        .when(F.contains(a, b) | F.contains(b, a), 0.95)
        .otherwise(F.greatest(base, F.when(overlap >= 0.8, overlap).otherwise(0.0)))
    )


def within_one_edit(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, 1) >= 0
