"""Exact number format of reports: the double's own decimal expansion, halves away from zero or, where asked, to even.

Spark's round and format_string round the shortest decimal instead, which
differs for values such as 1.005. Only sinks use this.
"""

from __future__ import annotations

from decimal import ROUND_HALF_EVEN, ROUND_HALF_UP, Context, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DASH = "—"
_WIDE = Context(prec=400)


def fixed(x: float | None, digits: int = 2, half_even: bool = False) -> str:
    """``x`` with ``digits`` decimals; a dash for what is no finite number. ``half_even`` as C's printf and SQL's format round."""
    if x is None or x != x or x in (float("inf"), float("-inf")):
        return DASH
    text = str(Decimal(x).quantize(Decimal(1).scaleb(-digits), rounding=ROUND_HALF_EVEN if half_even else ROUND_HALF_UP, context=_WIDE))
    return text[1:] if x == 0 and text.startswith("-") else text


def fmt(v: Column, digits: int = 2, half_even: bool = False) -> Column:
    @F.pandas_udf("string")
    def formatted(s: pd.Series) -> pd.Series:
        return pd.Series([fixed(None if pd.isna(x) else float(x), digits, half_even) for x in s], dtype="object")

    return formatted(v.cast("double"))


def thousandths(c: Column) -> Column:
    """Three decimals of a measure, far cheaper than by a format string."""
    return c.cast("double").cast("decimal(18,3)").cast("string")
