"""Sheets: cells of a step-and-repeat, how many fit, use of the sheet, and lengthening on a cylinder."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fitting(sheet: Column, side: Column, gap: Column, low: Column, high: Column) -> Column:
    """How many sides with gaps fit between two margins."""
    return F.greatest(F.floor((sheet - low - high + gap) / (side + gap)), F.lit(0)).cast("int")


def cells(jobs: DataFrame) -> DataFrame:
    """(job, row, col, x, y, w, h, rot) of jobs (job, trim_w, trim_h, cols, rows, gap_x, gap_y, left, top, row_turns array, col_turns array, row_shift, col_shift).

    A cell turned by 90 or 270 has its sides swapped; odd rows and columns are shifted.  A row is as high as
    its highest cell; a place is the sum of what stands before it.
    """
    turn = lambda turns, i: F.element_at(turns, (F.pmod(i, F.size(turns)) + 1).cast("int"))
    rotation = lambda r, c: F.pmod(turn(F.col("row_turns"), r) + turn(F.col("col_turns"), c), F.lit(360))
    turned = lambda r, c: rotation(r, c).isin(90, 270)
    width = lambda r, c: F.when(turned(r, c), F.col("trim_h")).otherwise(F.col("trim_w")).cast("double")
    height = lambda r, c: F.when(turned(r, c), F.col("trim_w")).otherwise(F.col("trim_h")).cast("double")
    first = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    add = lambda parts: F.aggregate(parts, F.lit(0.0), lambda s, v: s + v)
    row_high = lambda r: F.array_max(F.transform(first(F.col("cols")), lambda c: height(r, c)))
    df = jobs.where("rows > 0 and cols > 0").withColumn("_high", F.transform(first(F.col("rows")), row_high))
    df = df.select("*", F.explode(first(F.col("rows"))).alias("row"))
    df = df.withColumns({"_y": F.col("top") + add(F.transform(F.slice("_high", F.lit(1), F.col("row")), lambda h: h + F.col("gap_y"))), "_wide": F.transform(first(F.col("cols")), lambda c: width(F.col("row"), c))})
    df = df.select("*", F.explode(first(F.col("cols"))).alias("col"))
    odd = lambda c, shift: F.when(F.col(c) % 2 == 1, F.col(shift)).otherwise(0.0)
    x = F.col("left") + odd("row", "row_shift") + add(F.transform(F.slice("_wide", F.lit(1), F.col("col")), lambda w: w + F.col("gap_x")))
    row, col = F.col("row"), F.col("col")
    return df.select("job", "row", "col", x.alias("x"), (F.col("_y") + odd("col", "col_shift")).alias("y"), width(row, col).alias("w"), height(row, col).alias("h"), rotation(row, col).alias("rot"))


def sheets(jobs: DataFrame, placed: DataFrame) -> DataFrame:
    """(job, cells, used_w, used_h, use_pct, problem) of jobs with sheet_w, sheet_h, right and bottom margins."""
    used = placed.groupBy("job").agg(F.count("*").alias("cells"), F.max(F.col("x") + F.col("w")).alias("used_w"), F.max(F.col("y") + F.col("h")).alias("used_h"))
    joined = jobs.join(used, "job", "left")
    over = (F.col("used_w") > F.col("sheet_w") - F.col("right") + 0.01) | (F.col("used_h") > F.col("sheet_h") - F.col("bottom") + 0.01)
    problem = F.when(F.col("cells").isNull(), "nothing fits").when(over, "larger than the sheet")
    use = F.round(100 * F.coalesce("cells", F.lit(0)) * F.col("trim_w") * F.col("trim_h") / (F.col("sheet_w") * F.col("sheet_h")), 1)
    return joined.select("job", F.coalesce("cells", F.lit(0).cast("long")).alias("cells"), "used_w", "used_h", use.alias("use_pct"), problem.alias("problem"))


def crop_marks(placed: DataFrame, length: float = 4.0, away: float = 1.0) -> DataFrame:
    """Two marks at each corner of a cell: rows (job, row, col, x0, y0, x1, y1)."""
    corners = F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 1) for dy in (-1, 1))))
    c = placed.select("*", corners.alias("c"))
    px, py = F.when(F.col("c.dx") > 0, F.col("x") + F.col("w")).otherwise(F.col("x")), F.when(F.col("c.dy") > 0, F.col("y") + F.col("h")).otherwise(F.col("y"))
    near, far = (lambda p, d: p + d * away), (lambda p, d: p + d * (away + length))
    dx, dy = F.col("c.dx"), F.col("c.dy")
    lines = F.explode(F.array(F.struct(near(px, dx).alias("x0"), py.alias("y0"), far(px, dx).alias("x1"), py.alias("y1")), F.struct(px.alias("x0"), near(py, dy).alias("y0"), px.alias("x1"), far(py, dy).alias("y1"))))
    return c.select("job", "row", "col", lines.alias("m")).select("job", "row", "col", "m.*")


def distortion_pct(k_mm: Column, repeat_mm: Column) -> Column:
    """Shortening of a plate of thickness k on a repeat, in percent; null where k is negative or there is no repeat."""
    return F.when((repeat_mm > 0) & (k_mm >= 0), 2 * math.pi * k_mm / F.nullif(repeat_mm, F.lit(0.0)) * 100)


def distorted(pages: DataFrame) -> DataFrame:
    """Pages (file, page, width, height, pct, direction) with the side in printing direction made shorter; problems are named."""
    factor = 1 - F.col("pct") / 100
    problem = F.when(~F.col("direction").isin("horizontal", "vertical"), "unknown direction").when((F.col("pct") < 0) | (F.col("pct") >= 20) | F.col("pct").isNull(), "distortion out of range")
    side = lambda c, d: F.when(F.col("problem").isNull(), F.when(F.col("direction") == d, F.col(c) * factor).otherwise(F.col(c)))
    return pages.withColumn("problem", problem).withColumns({"new_width": side("width", "horizontal"), "new_height": side("height", "vertical")})


def ramp_patches(inks: DataFrame, steps: list[int] | None = None) -> DataFrame:
    """(id, inks map) of a test chart: ramps of each ink (pos, name), and each pair at full coverage."""
    steps = steps or list(range(0, 101, 10))
    ramps = inks.select(F.col("pos").alias("_a"), F.lit(-1).alias("_b"), "name", F.explode(F.array(*map(F.lit, steps))).alias("step")).select("_a", "_b", "step", F.format_string("%s|%d", "name", "step").alias("id"), F.create_map("name", "step").alias("inks"))
    a, b = inks.select(F.col("pos").alias("_a"), F.col("name").alias("na")), inks.select(F.col("pos").alias("_b"), F.col("name").alias("nb"))
    pairs = a.join(F.broadcast(b), F.col("_a") < F.col("_b")).select("_a", "_b", F.lit(100).alias("step"), F.format_string("%s+%s|100", "na", "nb").alias("id"), F.create_map("na", F.lit(100), "nb", F.lit(100)).alias("inks"))  # inks of one press
    return ramps.unionByName(pairs)
