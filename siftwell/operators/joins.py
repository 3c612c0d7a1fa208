"""Joins whose strategy is settled by a measured size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def few(df: DataFrame, rows: int = 200_000) -> bool:
    """Whether df has at most so many rows; reads no more than that."""
    return bool(df.limit(rows + 1).select(F.lit(1)).agg(F.count("*").alias("n")).filter(F.col("n") <= rows).take(1))


def sized(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows; otherwise df, and the join shuffles."""
    return F.broadcast(df) if few(df, rows) else df


def exploded(df: DataFrame, columns: list[str], values: Column, name: str) -> DataFrame:
    """Columns of df with a row for each value of an array, null ones aside.

    A plain explode makes the optimizer test the array's size first, by evaluating it a second time; this does not.
    """
    return df.select(*columns, F.explode_outer(values).alias(name)).filter(F.col(name).isNotNull())
