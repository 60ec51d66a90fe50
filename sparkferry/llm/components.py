"""Connected components of an edge table by alternating large-star and small-star, with nothing but edges shuffled.

Rows of a node that very many edges share don't meet in one task: such hubs are joined by broadcast (of nodes with more than
a thousandth of all rows there are fewer than a thousand), all others by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkferry.llm._frames import Held

#: A key is a hub beyond this share of the rows and this many: so there are at most 1000 hubs of any table.
HUB, LEAST_HUB = 1 / 1000, 100


def join_hubs(rows: DataFrame, about: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with `about`, which has one row for each key and in column n the number of its rows."""
    most = max(LEAST_HUB, int(total * HUB))
    hubs, others = about.where(F.col("n") > most), about.where(F.col("n") <= most)
    by_hub = rows.join(F.broadcast(hubs), key)
    return by_hub.unionByName(rows.join(F.broadcast(hubs.select(key)), key, "left_anti").join(others, key))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return join_hubs(both, least, "u", 2 * total).where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    moved = join_hubs(edges, least, "a", total).where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b): root is the smallest node that it is linked with. Edges from a node to itself don't count.

    Each round is written to the shared folder; rounds grow with the logarithm of the longest path. The result is such a table.
    """
    now = Held(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct())
    while True:
        total = now.df.count()
        stars = now.df.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("m"))
        # Stars: each node hangs on one, on which no other node hangs.
        tangled = stars.where(F.col("n") > 1).select("a").unionByName(now.df.select(F.col("b").alias("a")).distinct().join(stars, "a", "left_semi").select("a"))
        if tangled.isEmpty():
            roots = now.df.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return now.df.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
        large = Held(_large_star(now.df, total))
        now.drop()
        now = Held(_small_star(large.df, large.df.count()))
        large.drop()
