"""Uneven light on a client's picture: a field of gains from the paper, by a masked pyramid.

Sums over the paper's pixels go up by halved coordinates until a page is one cell; going down, a cell
with enough paper has its own ratio and every other one what its coarser neighbours give by
interpolation.  Cells of a level meet by equality of halved coordinates, pixels meet the block of four
cells around them, so no row is multiplied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BANDS = ("r", "g", "b")
#: Least share of paper, range of the exposure that is kept and of gains, least spread of gains that is worth a change.
LEAST_PAPER, EXPOSURE, GAINS, LEAST_SPREAD = 0.08, (0.88, 1.12), (0.5, 1.6), 0.04


def paper(design: DataFrame) -> DataFrame:
    """(page, key, share): the commonest colour of a page in 32 levels a band; the least key on ties."""
    counts = design.groupBy("page", colour_key().alias("key")).agg(F.count("*").alias("n"))
    return counts.groupBy("page").agg(F.min_by("key", F.struct(-F.col("n"), F.col("key"))).alias("key"), (F.max("n") / F.sum("n")).alias("share"))


def colour_key() -> Column:
    r, g, b = (F.shiftright(F.col(c).cast("int"), 5) for c in BANDS)
    return F.shiftleft(r, 6) + F.shiftleft(g, 3) + b


def blocks(cells: DataFrame, values: list[str]) -> DataFrame:
    """(page, i, j, <value>00, 10, 01, 11): each cell with its neighbours right, below and both; at the end a cell's own."""
    right, below = Window.partitionBy("page", "j").orderBy("i"), Window.partitionBy("page", "i").orderBy("j")
    d = cells.select("page", "i", "j", *(F.col(v).alias(f"{v}00") for v in values), *(F.coalesce(F.lead(v).over(right), F.col(v)).alias(f"{v}10") for v in values))
    return d.select("*", *(F.coalesce(F.lead(f"{v}{a}0").over(below), F.col(f"{v}{a}0")).alias(f"{v}{a}1") for v in values for a in (0, 1)))


def interpolated(rows: DataFrame, u: Column, v: Column, cells: DataFrame, values: list[str]) -> DataFrame:
    """`rows` with the cells' `values` at place (u, v), counted in cells from the first one's centre; beyond the last centres the slope goes on."""
    sizes = cells.groupBy("page").agg(F.max("i").alias("_mi"), F.max("j").alias("_mj"))
    first = lambda at, most: F.greatest(F.least(F.floor(at), F.col(most) - 1), F.lit(0))
    d = rows.join(sizes, "page").withColumns({"_u": u, "_v": v}).withColumns({"i": first(F.col("_u"), "_mi"), "j": first(F.col("_v"), "_mj")})
    a, b = F.col("_u") - F.col("i"), F.col("_v") - F.col("j")
    mixed = lambda c: (F.col(f"{c}00") * (1 - a) + F.col(f"{c}10") * a) * (1 - b) + (F.col(f"{c}01") * (1 - a) + F.col(f"{c}11") * a) * b
    return d.join(blocks(cells, values), ["page", "i", "j"]).select(*rows.columns, *(mixed(c).alias(c) for c in values))


def gain_field(design: DataFrame, client: DataFrame, valid: DataFrame | None = None, cell: int = 8, least: float = 0.25) -> DataFrame:
    """(page, i, j, n, r, g, b): the client's light against the design's in cells, from the paper's pixels.

    `n` is the number of those in the cell; a cell needs the share `least` of them for a ratio of its own.
    """
    known = paper(design).where(F.col("share") >= LEAST_PAPER).select("page", "key")
    both = design.join(client.select("page", "x", "y", *(F.col(c).alias(f"c{c}") for c in BANDS)), ["page", "x", "y"]).join(known, "page")
    if valid is not None:
        both = both.join(valid.select("page", "x", "y", F.lit(True).alias("_valid")), ["page", "x", "y"], "left")
    on = (colour_key() == F.col("key")) & (F.lit(True) if valid is None else F.col("_valid").isNotNull())
    sums = {"n": F.lit(1), **{f"d{c}": F.col(c) for c in BANDS}, **{f"c{c}": F.col(f"c{c}") for c in BANDS}}
    total = [F.coalesce(F.sum(F.when(on, v)), F.lit(0)).alias(k) for k, v in sums.items()]
    levels = [both.groupBy("page", F.floor(F.col("x") / cell).alias("i"), F.floor(F.col("y") / cell).alias("j")).agg(*total, F.count("*").alias("all")).checkpoint()]
    side = levels[0].agg(F.max(F.greatest("i", "j"))).first()[0] or 0
    while side:  # as many levels as the page's size has bits
        levels.append(levels[-1].groupBy("page", F.floor(F.col("i") / 2).alias("i"), F.floor(F.col("j") / 2).alias("j")).agg(*(F.sum(k).alias(k) for k in [*sums, "all"])))
        side //= 2
    ratio = lambda c: F.col(f"c{c}") / F.greatest(F.col(f"d{c}"), F.lit(1))
    field = levels.pop().select("page", "i", "j", *(F.when(F.col("n") > 0, ratio(c)).otherwise(1.0).alias(c) for c in BANDS))
    while levels:
        own = levels.pop().select("page", F.col("i").alias("_i"), F.col("j").alias("_j"), *(F.when(F.col("n") >= least * F.col("all"), ratio(c)).alias(f"_{c}") for c in BANDS), "n")
        met = interpolated(own, (F.col("_i") - 0.5) / 2, (F.col("_j") - 0.5) / 2, field, list(BANDS))
        field = met.select("page", F.col("_i").alias("i"), F.col("_j").alias("j"), *(F.coalesce(f"_{c}", F.col(c)).alias(c) for c in BANDS), "n")
    return field


def normalized(design: DataFrame, client: DataFrame, valid: DataFrame | None = None, cell: int = 8) -> DataFrame:
    """Client pixels (page, x, y, r, g, b, changed) with the light evened; the tone of the whole page stays within EXPOSURE.

    Pages without enough paper, and those that are lit evenly, stay as they are.
    """
    field = gain_field(design, client, valid, cell)
    n = field.columns.count("n")
    if not n:  # a page of one cell has no spread
        field = field.withColumn("n", F.lit(0))
    middle = field.groupBy("page").agg(*(F.greatest(F.coalesce(F.percentile(F.when(F.col("n") > cell * cell / 2, F.col(c)), F.lit(0.5)), F.percentile(c, F.lit(0.5))), F.lit(1e-3)).alias(f"_m{c}") for c in BANDS))
    scale = F.least(F.greatest(sum((F.col(f"_m{c}") for c in BANDS), F.lit(0.0)) / 3, F.lit(EXPOSURE[0])), F.lit(EXPOSURE[1]))
    held = lambda c: F.least(F.greatest(F.col(c) / F.col(f"_m{c}") * scale, F.lit(GAINS[0])), F.lit(GAINS[1]))
    gains = field.join(middle, "page").select("page", "i", "j", *(held(c).alias(f"g{c}") for c in BANDS))
    spread = gains.groupBy("page").agg((F.max(F.greatest(*(f"g{c}" for c in BANDS))) - F.min(F.least(*(f"g{c}" for c in BANDS)))).alias("_spread")).where(F.col("_spread") >= LEAST_SPREAD).select("page")
    lit = gains.join(spread, "page", "left_semi").checkpoint()
    names = [f"g{c}" for c in BANDS]
    pixels = client.select("page", "x", "y", *BANDS)
    changed = interpolated(pixels, (F.col("x") + 0.5) / cell - 0.5, (F.col("y") + 0.5) / cell - 0.5, lit, names)
    fixed = lambda c: F.floor(F.least(F.greatest(F.col(c) / F.greatest(F.col(f"g{c}"), F.lit(1e-3)), F.lit(0.0)), F.lit(255.0)))
    kinds = dict(pixels.dtypes)
    even = changed.select("page", "x", "y", *(fixed(c).cast(kinds[c]).alias(c) for c in BANDS), F.lit(True).alias("changed"))
    return even.unionByName(pixels.join(lit.select("page").distinct(), "page", "left_anti").withColumn("changed", F.lit(False)))
