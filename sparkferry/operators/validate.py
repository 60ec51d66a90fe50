"""Constraints as queries: Spark enforces none, so a load is checked after the fact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicates(df: DataFrame, key: list[str], nulls_match: bool = True) -> DataFrame:
    """Keys that more than one row has, with n. nulls_match=False is SQL's UNIQUE, where a key with a null never repeats."""
    rows = df if nulls_match else df.dropna(subset=key)
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n) for each of the columns that must not be null but is, in one pass."""
    counted = df.select(*[F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(c) for c in columns])
    return counted.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("n")) for c in columns]))).where("n > 0")


def orphans(child: DataFrame, columns: list[str], parent: DataFrame, to: list[str]) -> DataFrame:
    """Rows of child whose foreign key has no parent. A key with a null needs none.

    The parent's keys are reduced to one each before the anti join, and Spark broadcasts them where they are small.
    """
    wanted = parent.select(*[F.col(f"`{t}`").alias(f"__p{i}") for i, t in enumerate(to)]).dropna().distinct()
    on = [F.col(f"`{c}`") == F.col(f"__p{i}") for i, c in enumerate(columns)]
    return child.dropna(subset=columns).join(wanted, on, "left_anti")


def violations(df: DataFrame, condition: str) -> DataFrame:
    """Rows for which a check's condition is false; null passes, as in SQL."""
    return df.where(F.expr(f"not ({condition})"))
