"""Square windows around pixels in two passes: along the row, then along the column.

Rows shuffled are the pixels twice, whatever the window's size.  Where a row has gaps, or ends, places
up to the radius beside its pixels take part in the first pass, so that pages of any form get what the
window really holds; they are left out at the end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _beside(pixels: DataFrame, values: list[str], radius: int) -> DataFrame:
    """`pixels` and, with null values and `_own` false, the places up to `radius` beside them in their row."""
    w = Window.partitionBy("page", "y").orderBy("x")
    x, none = F.col("x"), F.array().cast("array<long>")
    d = pixels.select("page", "y", F.col("x").cast("long").alias("x"), *values).withColumns({"_p": F.lag("x").over(w), "_q": F.lead("x").over(w)})
    low = F.greatest(F.coalesce(F.col("_p") + radius + 1, x - radius), x - radius)
    high = F.least(F.coalesce(F.col("_q") - 1, x + radius), x + radius)
    places = F.concat(F.when(low < x, F.sequence(low, x - 1)).otherwise(none), F.array(x), F.when(high > x, F.sequence(x + 1, high)).otherwise(none))
    each = d.select("page", "y", x.alias("_x"), *values, F.explode(places).alias("x"))
    own = x == F.col("_x")
    return each.select("page", "y", "x", own.alias("_own"), *(F.when(own, F.col(v)).alias(v) for v in values))


def windowed(pixels: DataFrame, radius: int, values: dict[str, tuple[Column, Callable[[Column], Column]]]) -> DataFrame:
    """`pixels` (page, x, y, ...) with results over the square of 2 radius + 1 places around each.

    `values` gives each result's name its value and an aggregate of which parts can be aggregated again:
    F.sum, F.min or F.max.
    """
    others = [c for c in pixels.columns if c not in ("page", "x", "y")]
    d = _beside(pixels.withColumns({f"_v_{n}": v for n, (v, _) in values.items()}), [*others, *(f"_v_{n}" for n in values)], radius)
    across = Window.partitionBy("page", "y").orderBy("x").rangeBetween(-radius, radius)
    down = Window.partitionBy("page", "x").orderBy("y").rangeBetween(-radius, radius)
    d = d.select("page", "x", "y", "_own", *others, *(f(F.col(f"_v_{n}")).over(across).alias(f"_v_{n}") for n, (_, f) in values.items()))
    d = d.select("page", "x", "y", "_own", *others, *(f(F.col(f"_v_{n}")).over(down).alias(n) for n, (_, f) in values.items()))
    return d.where("_own").drop("_own")


def extrema(pixels: DataFrame, radius: int, columns: list[str]) -> DataFrame:
    """`pixels` with low_<c> and high_<c>, the least and greatest value of the window, of each column."""
    return windowed(pixels, radius, {f"low_{c}": (F.col(c), F.min) for c in columns} | {f"high_{c}": (F.col(c), F.max) for c in columns})


def blurred(pixels: DataFrame, columns: list[str]) -> DataFrame:
    """`columns` of bytes weighed 1, 2, 1 along rows and columns and rounded; a missing neighbour is the one on the other side, or the pixel itself."""
    across, down = Window.partitionBy("page", "y").orderBy("x"), Window.partitionBy("page", "x").orderBy("y")

    def weighed(c: str, w, at: str) -> Column:
        before = F.when(F.lag(at).over(w) == F.col(at) - 1, F.lag(c).over(w))
        after = F.when(F.lead(at).over(w) == F.col(at) + 1, F.lead(c).over(w))
        return F.coalesce(before, after, F.col(c)) + 2 * F.col(c) + F.coalesce(after, before, F.col(c))

    d = pixels.withColumns({c: F.col(c).cast("long") for c in columns})
    d = d.withColumns({c: weighed(c, across, "x") for c in columns})
    return d.withColumns({c: F.floor((weighed(c, down, "y") + 8) / 16) for c in columns})
