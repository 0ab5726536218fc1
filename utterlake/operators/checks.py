"""Guards that stop a job early."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, columns: Sequence[str], what: str = "Dataset") -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what}: no column {missing} among {df.columns}")
    return df


def require_rows(df: DataFrame, message: str) -> DataFrame:
    if df.isEmpty():
        raise RuntimeError(message)
    return df


def drop_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def null_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: all rows, and rows that ``drop_null`` removes."""
    lost = F.lit(False)
    for name in columns:
        lost = lost | F.col(name).isNull()
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(lost).alias("dropped"))
