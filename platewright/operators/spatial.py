"""Boxes: overlap, containment, matching and coverage.  A box is (page, id, x, y, w, h)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Side of the tiles that bucket range joins.
TILE = 256


def side(a: str, b: str, at: str, size: str) -> Column:
    """Length of the common interval of two boxes on one axis, negative if apart."""
    c = F.col
    return F.least(c(f"{a}.{at}") + c(f"{a}.{size}"), c(f"{b}.{at}") + c(f"{b}.{size}")) - F.greatest(c(f"{a}.{at}"), c(f"{b}.{at}"))


def common(a: str, b: str) -> Column:
    return F.greatest(side(a, b, "x", "w"), F.lit(0)) * F.greatest(side(a, b, "y", "h"), F.lit(0))


def iou(a: str, b: str) -> Column:
    both = common(a, b)
    total = F.col(f"{a}.w") * F.col(f"{a}.h") + F.col(f"{b}.w") * F.col(f"{b}.h") - both
    return F.when(total > 0, both / total).otherwise(0.0)


def centre_in(inner: str, outer: str) -> Column:
    c = F.col
    x, y = c(f"{inner}.x") + c(f"{inner}.w") / 2, c(f"{inner}.y") + c(f"{inner}.h") / 2
    return x.between(c(f"{outer}.x"), c(f"{outer}.x") + c(f"{outer}.w")) & y.between(c(f"{outer}.y"), c(f"{outer}.y") + c(f"{outer}.h"))


def tiled(boxes: DataFrame, tile: int = TILE) -> DataFrame:
    """A row for each tile that a box touches."""
    span = lambda at, size: F.explode(F.sequence(F.floor(F.col(at) / tile), F.floor((F.col(at) + F.col(size)) / tile)))
    return boxes.withColumn("tx", span("x", "w")).withColumn("ty", span("y", "h"))


def overlaps(left: DataFrame, right: DataFrame, tile: int = TILE) -> DataFrame:
    """Overlapping pairs of a page as structs `l` and `r`, each once: an equality join on page and tile.

    A pair is taken in the tile of its common area's least corner.
    """
    pack = lambda df, name: tiled(df, tile).select(F.struct(*df.columns).alias(name), F.col("page").alias(f"{name}p"), F.col("tx").alias(f"{name}x"), F.col("ty").alias(f"{name}y"))
    a, b = pack(left, "l"), pack(right, "r")
    pairs = a.join(b, (F.col("lp") == F.col("rp")) & (F.col("lx") == F.col("rx")) & (F.col("ly") == F.col("ry")))
    first = (F.col("lx") == F.floor(F.greatest("l.x", "r.x") / tile)) & (F.col("ly") == F.floor(F.greatest("l.y", "r.y") / tile))
    return pairs.where(first & (common("l", "r") > 0)).select("l", "r")


def matches(found: DataFrame, expected: DataFrame, least: float = 0.3) -> DataFrame:
    """Pairs that are each other's best match: IoU of at least `least` or a centre inside the other."""
    pairs = overlaps(found, expected).where((iou("l", "r") >= least) | centre_in("l", "r") | centre_in("r", "l")).withColumn("iou", F.round(iou("l", "r"), 9))
    by = lambda key, other: F.row_number().over(Window.partitionBy(f"{key}.page", f"{key}.id").orderBy(F.col("iou").desc(), F.col(f"{other}.id")))
    return pairs.withColumn("a", by("l", "r")).withColumn("b", by("r", "l")).where("a = 1 and b = 1").select("l", "r", "iou")
