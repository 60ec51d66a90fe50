"""Write semantics as relational plans: upsert, insert-ignore, append and replace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check_columns(dst: DataFrame, src: DataFrame, key: list[str]) -> None:
    """Every key column is in both tables, and src has no column that dst lacks."""
    if missing := [k for k in key if k not in dst.columns or k not in src.columns]:
        raise ValueError(f"key columns are missing: {missing}")
    if extra := [c for c in src.columns if c not in dst.columns]:
        raise ValueError(f"the destination lacks the columns {extra}")


def upsert(dst: DataFrame, src: DataFrame, key: list[str], order: list[Column] | None = None) -> DataFrame:
    """dst after src has been merged into it by key.

    Rows of src replace the columns that src has; columns only dst has keep their value (null for new rows).
    Rows that only dst has stay: nothing is deleted. Null keys match each other. With an empty key src is appended,
    and with nothing but key columns existing rows are left as they are (insert-ignore).
    With `order` the last row of src by it counts for each key; without one src must be unique by key, or its keys' rows multiply.
    """
    check_columns(dst, src, key)
    if key and order is not None:
        src = latest(src, key, order)
    if not key:
        return append(dst, src)
    if set(src.columns) == set(key):
        return insert_ignore(dst, src, key)
    d, s = dst.alias("d"), src.withColumn("__in_src", F.lit(True)).alias("s")
    on = F.lit(True)
    for k in key:
        on = on & F.col(f"d.`{k}`").eqNullSafe(F.col(f"s.`{k}`"))
    here = F.col("s.__in_src").isNotNull()
    picked = [F.when(here, F.col(f"s.`{c}`")).otherwise(F.col(f"d.`{c}`")).alias(c) if c in src.columns else F.col(f"d.`{c}`").alias(c) for c in dst.columns]
    return d.join(s, on, "full_outer").select(*picked)


def insert_ignore(dst: DataFrame, src: DataFrame, key: list[str]) -> DataFrame:
    """dst plus the rows of src whose key dst lacks."""
    check_columns(dst, src, key)
    d, s = dst.select(*key).alias("d"), src.alias("s")
    on = F.lit(True)
    for k in key:
        on = on & F.col(f"d.`{k}`").eqNullSafe(F.col(f"s.`{k}`"))
    return dst.unionByName(s.join(d, on, "left_anti"), allowMissingColumns=True)


def append(dst: DataFrame, src: DataFrame) -> DataFrame:
    """dst followed by src; what a table without a key gets."""
    return dst.unionByName(src, allowMissingColumns=True)


def replace(dst: DataFrame, src: DataFrame) -> DataFrame:
    """src in the columns of dst."""
    have = set(src.columns)
    return src.select(*[F.col(f"`{c}`") if c in have else F.lit(None).cast(dst.schema[c].dataType).alias(c) for c in dst.columns])


def latest(src: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the last by `order`, which should be total. A max of one struct, so that Spark combines before the shuffle."""
    if not key:
        return src
    names = src.columns
    packed = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    best = src.groupBy(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(key)]).agg(F.max(packed).alias("__m"))
    return best.select("__m.row.*")
