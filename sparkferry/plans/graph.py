"""The order in which tables depend on each other."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Cycle(ValueError):
    """Tables that depend on each other in a circle."""


def edges_of(tables) -> set[tuple[str, str]]:
    """(table, referenced table) of tables' foreign keys; a table's reference to itself, or out of the set, is no edge."""
    names = {t.name for t in tables}
    return {(t.name, c.to_table) for t in tables for c in t.foreign_keys if c.to_table in names and c.to_table != t.name}


def ordered(tables: list[str], edges: set[tuple[str, str]]) -> list[str]:
    """Referenced tables first; of those that are ready, the first by name. Raises Cycle with what can't be ordered."""
    waits = {t: {b for a, b in edges if a == t and b != t and b in tables} for t in tables}
    ready = [t for t in sorted(tables) if not waits[t]]
    heapq.heapify(ready)
    out = []
    while ready:
        out.append(now := heapq.heappop(ready))
        for t in tables:
            if now in waits[t]:
                waits[t].discard(now)
                if not waits[t]:
                    heapq.heappush(ready, t)
    if len(out) < len(tables):
        raise Cycle(f"tables depend on each other: {sorted(set(tables) - set(out))}")
    return out


def levels(tables: list[str], edges: set[tuple[str, str]]) -> list[list[str]]:
    """Groups of tables, each of which depends only on those before; a group's tables may run at once. A cycle makes one last group."""
    left, out = set(tables), []
    while left:
        now = sorted(t for t in left if not any(a == t and b in left and b != t for a, b in edges))
        out.append(now or sorted(left))
        left -= set(out[-1])
    return out


def level_frame(tables: DataFrame, edges: DataFrame) -> DataFrame:
    """(table, level) by a recursive query: 0 without a reference, else one more than the highest referenced. edges: (src, dst), without cycles."""
    spark = tables.sparkSession
    tables.createOrReplaceTempView("__tables")
    edges.createOrReplaceTempView("__edges")
    found = spark.sql(
        """with recursive reach(name, level) as (
             select name, 0 from __tables union all select e.src, r.level + 1 from reach r join __edges e on e.dst = r.name)
           select name, level from reach"""
    )
    return found.groupBy(F.col("name").alias("table")).agg(F.max("level").alias("level"))
