"""How alike two answers are: the one scalar that Catalyst can't express."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from evalloom.functions.text import flip_category

MISREAD = 0.6


@F.pandas_udf(DoubleType())
def similarity(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The ratio of matching blocks (difflib), for which an edit distance is no stand-in; null counts as empty."""
    for a, b in pairs:
        yield pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def answer_category(a: Column, b: Column) -> Column:
    """number, extent, misread or different. Compute it for flipped records only: the ratio is the costly part."""
    plain = flip_category(a, b)
    return F.when((plain == "different") & (a != b) & (similarity(a, b) >= MISREAD), "misread").otherwise(plain)
