"""Rounding of result columns, so that two engines can be compared."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rounded(df: DataFrame, digits: int = 6, finer: tuple[str, ...] = ()) -> DataFrame:
    """Round every double column (those in `finer` to 9 digits); other columns pass through."""
    return df.select(
        *[
            F.round(F.col(f"`{n}`"), 9 if n in finer else digits).alias(n) if t in ("double", "float") else F.col(f"`{n}`")
            for n, t in df.dtypes
        ]
    )
