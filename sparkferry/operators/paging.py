"""Reading in key order, page by page: the pager's pages as lazy plans, and all pages at once."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page_order(key: list[str]) -> list[str]:
    """Pages are ordered by the key columns in the order of their names."""
    if not key:
        raise ValueError("a page needs a key to be ordered by")
    return sorted(key)


def after(key: list[str], last: list[Any]) -> Column:
    """Rows behind the key values `last`, which are in the order of the sorted key columns: a > x or (a = x and b > y) ...

    The expanded form has SQL's plain treatment of nulls and is pushed to the scan; no key gives a constant true.
    """
    key = sorted(key)
    if len(key) != len(last):
        raise ValueError(f"{len(key)} key columns, but {len(last)} values")
    out = F.lit(not key)
    for i, k in enumerate(key):
        here = F.col(f"`{k}`") > F.lit(last[i])
        for before, value in zip(key[:i], last[:i], strict=True):
            here = (F.col(f"`{before}`") == F.lit(value)) & here
        out = here if i == 0 else out | here
    return out


def after_tuple(df: DataFrame, key: list[str], last: list[Any]) -> Column:
    """The same as one comparison of rows, (a, b) > (x, y); literals get the columns' types. A null key compares as the smallest."""
    key = sorted(key)
    if len(key) != len(last):
        raise ValueError(f"{len(key)} key columns, but {len(last)} values")
    if not key:
        return F.lit(True)
    types = dict(df.dtypes)
    return F.struct(*[F.col(f"`{k}`").alias(k) for k in key]) > F.struct(*[F.lit(v).cast(types[k]).alias(k) for k, v in zip(key, last, strict=True)])


def page(df: DataFrame, key: list[str], size: int, last: list[Any] | None = None) -> DataFrame:
    """The next `size` rows behind `last`, or the first ones. Spark runs it as a top-k: no full sort."""
    rows = df if last is None else df.where(after(key, last))
    return rows.orderBy(*[F.col(f"`{k}`").asc() for k in page_order(key)]).limit(size)


def pages(df: DataFrame, key: list[str], size: int) -> Iterator[DataFrame]:
    """All pages in turn, as the cursor loop of a row-at-a-time copier reads them. Each is a job; whole tables are better read at once."""
    last = None
    while True:
        now = page(df, key, size, last)
        tail = now.select(*page_order(key)).orderBy(*[F.col(f"`{k}`").desc() for k in page_order(key)]).first()
        if tail is None:
            return
        yield now
        last = list(tail)


#: Rows that a range has on average, and ranges at most: these are literals of the plan.
RANGE_ROWS, RANGES = 1_000_000, 1024


def _bounds(df: DataFrame, key: list[str], parts: int | None) -> list:
    """Up to parts - 1 keys that cut the table into about equal ranges, from a sample of about 100 keys for each part, by hash.
    Without a number of parts it is what the table's size asks for."""
    keys = df.select(*[F.col(f"`{k}`") for k in page_order(key)])
    total = keys.count()
    parts = min(RANGES, -(-total // RANGE_ROWS)) if parts is None else parts
    if parts < 2:
        return []
    share = min(1.0, 100 * parts / max(1, total))
    place = F.pmod(F.xxhash64(*keys.columns), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = keys.where(place < share).orderBy(*keys.columns).collect()
    step = max(1, len(sample) // parts)
    return sorted_unique(sample[step::step])


def sorted_unique(rows: list) -> list:
    return [r for i, r in enumerate(rows) if i == 0 or r != rows[i - 1]]


def _range_of(row: Column, bounds: list[Column], low: int = 0, high: int | None = None) -> Column:
    """How many of the rising bounds are not above a row: a search by halves, as nested conditions."""
    high = len(bounds) if high is None else high
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    return F.when(row < bounds[mid], _range_of(row, bounds, low, mid)).otherwise(_range_of(row, bounds, mid + 1, high))


def numbered(df: DataFrame, key: list[str], size: int, parts: int | None = None) -> DataFrame:
    """df with page_id (0 and up), for all pages at once, without a single-task sort.

    Rows fall into key ranges between fixed bounds, so that each evaluation of the plan cuts alike; a running total of
    the ranges' counts, of which there are `parts` at most, gives each range its first number, and rows are numbered within ranges.
    parts: by default one for each million rows, up to 1024.
    """
    types = dict(df.dtypes)
    order = [F.col(f"`{k}`").asc() for k in page_order(key)]
    row = F.struct(*[F.col(f"`{k}`").alias(k) for k in page_order(key)])
    bounds = [F.struct(*[F.lit(b[k]).cast(types[k]).alias(k) for k in page_order(key)]) for b in _bounds(df, key, parts)]
    ranged = df.withColumn("__part", _range_of(row, bounds))
    counts = ranged.groupBy("__part").agg(F.count("*").cast("long").alias("__n"))
    ahead = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))  # one row for each range
    starts = counts.select("__part", F.coalesce(ahead, F.lit(0)).alias("__ahead"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    out = ranged.withColumn("__at", place).join(F.broadcast(starts), "__part")
    return out.withColumn("page_id", F.floor((F.col("__ahead") + F.col("__at")) / size).cast("long")).drop("__part", "__at", "__ahead")


def manifest(df: DataFrame, key: list[str], size: int) -> DataFrame:
    """A row for each page: page_id, n_rows, and the first and last key (as structs `low` and `high`)."""
    k = F.struct(*[F.col(f"`{c}`") for c in page_order(key)])
    return numbered(df, key, size).groupBy("page_id").agg(F.count("*").alias("n_rows"), F.min(k).alias("low"), F.max(k).alias("high"))
