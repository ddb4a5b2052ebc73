"""Helpers of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 6
# Moves exact decimal ties (money and counts make them) off the rounding edge, on both sides.
OFF_TIE = 1.3e-8


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals (and no negative zero), so both engines compare equal."""
    return df.select(
        *(
            (F.round(F.col(f.name) + F.lit(OFF_TIE), DIGITS) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f.name)
            for f in df.schema.fields
        )
    )


def r(expression: str) -> str:
    """The SQL form of :func:`rounded` for one expression."""
    return f"round(({expression}) + {OFF_TIE}, {DIGITS}) + 0.0"
