"""Connected components by alternating star contraction (large star, small star).

Edges are rows (u, v).  Every round points each node's neighbours at the least of them, first those
above the node and then those below, until the edges are stars around each component's least
node.  Minima are pre-aggregated before they are shuffled; nodes with a large part of all edges
meet them by broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from platewright.llm._shared import BROADCAST_BYTES, removed, written

#: A key is heavy when it has more than one in HEAVY of all rows, so that there are fewer heavy ones.
HEAVY = 1000


def joined(rows: DataFrame, table: DataFrame, on: str, total: int) -> DataFrame:
    """`rows` with the other columns of `table`, which has a row for every `on` and the number `n` of its rows; `total` is the number of all rows.

    A table of few rows is broadcast.  Of a larger one, rows of heavy keys stay where they are: fewer than
    HEAVY rows of `table` are broadcast to them, and the others meet it in a shuffle.
    """
    if 48 * total <= BROADCAST_BYTES:  # it has as many rows at most
        return rows.join(F.broadcast(table.drop("n")), on)
    heavy = F.broadcast(table.where(F.col("n") * HEAVY > total + HEAVY).drop("n"))
    return rows.join(heavy, on).unionByName(rows.join(heavy.select(on), on, "left_anti").join(table.drop("n"), on))


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))


def _large(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"), "n")
    # an edge gives one row at most, so rows that repeat can wait for the small star's distinct
    return joined(both, least, "u", 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small(edges: DataFrame, total: int) -> DataFrame:
    # rows hold u > v here: a node's smaller neighbours
    least = _least(edges)
    turned = joined(edges, least, "u", total).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return turned.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _kept(edges: DataFrame) -> tuple[DataFrame, str, int]:
    """Edges written, their path and number, which the write counts on its way."""
    seen = Observation()
    table, path = written(edges.observe(seen, F.count(F.lit(1)).alias("n")), "edges")
    return table, path, seen.get["n"]


def _settled(edges: DataFrame) -> bool:
    """Whether all edges go to a node that has none itself, one from each node."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("out")))
    by = ends.groupBy("node").agg(F.sum("out").alias("out"), F.count("*").alias("n"))
    return not by.where("out > 1 or (out = 1 and n > 1)").take(1)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Rows (node, component) of all nodes but the components' least ones; `edges` has (u, v)."""
    spark = edges.sparkSession
    current, path, mark = _kept(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(rounds):
        if not mark:
            break
        # each half is written: the next reads it three times
        larger, between, n = _kept(_large(current, mark))
        removed(spark, path)
        current, path, mark = _kept(_small(larger, n))
        removed(spark, between)
        if _settled(current):
            break
    else:
        raise RuntimeError("components did not settle")
    return current.select(F.col("u").alias("node"), F.col("v").alias("component"))
