"""Cubic curves through chains of points, all chains of all pages at a time.

Chains are smoothed and cut at corners; each part gets one cubic by least squares, and only parts that
lie farther from it than the tolerance are cut in two, at their farthest point, for the next level.
A level is one shuffle by part: chord lengths, sums of the normal equations, errors and the steps that
move parameters nearer to the curve are windows over it.  Levels end when no part is left, after the
logarithm of the pieces of the most winding chain in usual cases.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHAIN = ("page", "chain")
#: Points beyond a part's end that give its direction at corners, and at smooth cuts.
REACH, SMOOTH_REACH = 4, 2
#: Steps that move parameters, for parts of an error under NEAR tolerances.
STEPS, NEAR = 3, 6.0


def _wrapped(points: DataFrame, k: int) -> DataFrame:
    """Points with `k` more of a ring on both sides, outside of 0 to length; a ring's last point is its first one's copy."""
    n, pos = F.col("length"), F.col("pos")
    inside = ~F.col("closed") | (pos < n)
    more = F.array(F.lit(0).cast("long"), F.when(F.col("closed") & (pos >= n - k), -n), F.when(F.col("closed") & (pos < k), n))
    return points.where(inside).withColumn("_d", F.explode(F.array_distinct(F.array_compact(more)))).withColumn("pos", pos + F.col("_d")).drop("_d")


def _unwrapped(points: DataFrame) -> DataFrame:
    """Rings from 0 to length again, the first point repeated at the end."""
    n, pos = F.col("length"), F.col("pos")
    return points.where(F.when(F.col("closed"), pos.between(0, n)).otherwise(True))


def smoothed(points: DataFrame, sigma: float = 1.6) -> DataFrame:
    """Points (page, chain, pos, x, y, length, closed) weighed with their neighbours; a chain's ends stay, near them the window is narrower."""
    k = max(1, round(sigma * 2.5))
    w = Window.partitionBy(*CHAIN).orderBy("pos")
    d = _wrapped(points, k + 1).withColumns({"x": F.col("x").cast("double"), "y": F.col("y").cast("double")})
    reach = F.when(F.col("closed"), k).otherwise(F.least(F.lit(k), F.col("pos"), F.col("length") - F.col("pos")))
    weight = lambda j: F.when(F.lit(abs(j)) <= reach, math.exp(-0.5 * (j / sigma) ** 2)).otherwise(0.0)
    total = sum((weight(j) for j in range(-k, k + 1)), F.lit(0.0))
    mean = lambda c: sum((weight(j) * F.coalesce(F.lag(c, -j).over(w), F.lit(0.0)) for j in range(-k, k + 1)), F.lit(0.0)) / total
    return _unwrapped(d.withColumns({"_x": mean("x"), "_y": mean("y")})).withColumns({"x": F.col("_x"), "y": F.col("_y")}).drop("_x", "_y")


def _cornered(points: DataFrame, degrees: float, reach: int) -> DataFrame:
    """`points` with their `turn` and whether they are `corner`s, as `corners` has them; a ring's last point is none."""
    w = Window.partitionBy(*CHAIN).orderBy("pos")
    d = _wrapped(points, 2 * reach + 1)
    before, after = (lambda c: F.col(c) - F.lag(c, reach).over(w)), (lambda c: F.lead(c, reach).over(w) - F.col(c))
    d = d.withColumns({"_ax": before("x"), "_ay": before("y"), "_bx": after("x"), "_by": after("y")})
    cosine = (F.col("_ax") * F.col("_bx") + F.col("_ay") * F.col("_by")) / F.greatest(F.hypot("_ax", "_ay") * F.hypot("_bx", "_by"), F.lit(1e-9))
    d = d.withColumn("turn", F.round(F.coalesce(F.degrees(F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0)))), F.lit(0.0)), 6))
    near = Window.partitionBy(*CHAIN).orderBy("pos").rangeBetween(-reach, reach)
    d = d.withColumn("_m", F.max(F.struct("turn", -F.col("pos"))).over(near))
    inside = F.when(F.col("closed"), (F.col("pos") >= 0) & (F.col("pos") < F.col("length"))).otherwise(True)
    return _unwrapped(d.withColumn("corner", (F.col("turn") >= degrees) & (F.col("_m.col2") == -F.col("pos")) & inside)).drop("_ax", "_ay", "_bx", "_by", "_m")


def corners(points: DataFrame, degrees: float = 60.0, reach: int = 5) -> DataFrame:
    """(page, chain, pos, turn): where the way turns by `degrees` or more, the greatest turn within `reach` points (the first of equal ones); no ends."""
    return _cornered(points, degrees, reach).where("corner").select(*CHAIN, "pos", "turn")


def _unit(x: Column, y: Column) -> tuple[Column, Column]:
    n = F.hypot(x, y)
    return F.when(n > 1e-12, x / n).otherwise(1.0), F.when(n > 1e-12, y / n).otherwise(0.0)


def parts(points: DataFrame, degrees: float = 60.0, reach: int = 5) -> DataFrame:
    """(page, chain, part, pos, x, y, t1x, t1y, t2x, t2y): chains cut at corners, with directions into each part at both ends.

    A ring begins at its first corner; one with a single corner or none is cut in halves, and without
    corners both cuts are smooth.  A part is named by its first place.
    """
    n = F.col("length")
    known = F.array_sort(F.collect_list(F.when(F.col("corner"), F.col("pos"))).over(Window.partitionBy(*CHAIN)))  # corners of a chain
    d = _cornered(points, degrees, reach).withColumn("_c", known)
    turned = F.when(F.col("closed") & (F.size("_c") > 0), F.element_at("_c", 1)).otherwise(F.lit(0).cast("long"))
    d = d.withColumn("_s", turned).where(~(F.col("closed") & (F.col("pos") == n))).withColumn("pos", F.when(F.col("closed"), F.pmod(F.col("pos") - F.col("_s"), n)).otherwise(F.col("pos")))
    moved = F.transform("_c", lambda c: F.when(F.col("closed"), F.pmod(c - F.col("_s"), n)).otherwise(c))
    inner = F.filter(moved, lambda c: (c > 0) & (c < n))
    half = F.when(F.col("closed") & (F.size(inner) == 0), F.array(F.floor(n / 2))).otherwise(inner)
    d = d.withColumns({"_cuts": F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0).cast("long")), half, F.array(n.cast("long"))))), "_round": F.col("closed") & (F.size("_c") == 0)})
    # a ring's first point is its last one too
    d = d.withColumn("pos", F.explode(F.when(F.col("closed") & (F.col("pos") == 0), F.array(F.lit(0).cast("long"), n.cast("long"))).otherwise(F.array("pos"))))
    w = Window.partitionBy(*CHAIN).orderBy("pos")
    ring = lambda c, j: F.coalesce(F.lag(c, -j).over(w), F.when(F.col("_round"), F.first(F.when(F.col("pos") == F.pmod(F.lit(j), n), F.col(c)), True).over(Window.partitionBy(*CHAIN)) if j > 0 else F.first(F.when(F.col("pos") == n + j, F.col(c)), True).over(Window.partitionBy(*CHAIN))), F.col(c))
    d = d.withColumns({"_dx": ring("x", SMOOTH_REACH) - ring("x", -SMOOTH_REACH), "_dy": ring("y", SMOOTH_REACH) - ring("y", -SMOOTH_REACH)})
    k = F.size(F.filter("_cuts", lambda c: c <= F.col("pos")))
    at = lambda i: F.element_at("_cuts", i)
    cut, last = F.array_contains("_cuts", F.col("pos")), F.size("_cuts")
    owners = F.when(cut & (k > 1) & (k < last), F.array(at(k - 1), at(k))).when(cut & (k == last), F.array(at(k - 1))).otherwise(F.array(at(k)))
    d = d.withColumn("part", F.explode(owners)).select(*CHAIN, "part", "pos", "x", "y", "_dx", "_dy", "_round")
    own = Window.partitionBy(*CHAIN, "part")
    order = own.orderBy("pos")
    size = F.count("*").over(own)
    back = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    reach_ = F.least(F.lit(REACH), size - 1)
    d = d.withColumns({"_i": F.row_number().over(order) - 1, "_n": size})
    pick = lambda c, i: F.max(F.when(F.col("_i") == i, F.col(c))).over(own)
    d = d.withColumn("_k", reach_)
    first, end = (pick("x", F.lit(0)), pick("y", F.lit(0))), (pick("x", F.col("_n") - 1), pick("y", F.col("_n") - 1))
    d = d.withColumns({"_ax": pick("x", F.col("_k")) - first[0], "_ay": pick("y", F.col("_k")) - first[1], "_bx": pick("x", F.col("_n") - 1 - F.col("_k")) - end[0], "_by": pick("y", F.col("_n") - 1 - F.col("_k")) - end[1], "_fx": F.first("_dx").over(back), "_fy": F.first("_dy").over(back), "_lx": F.last("_dx").over(back), "_ly": F.last("_dy").over(back)})
    smooth = lambda name, other: F.when(F.col("_round"), F.col(name)).otherwise(F.col(other))
    d = d.withColumns({"_ax": smooth("_fx", "_ax"), "_ay": smooth("_fy", "_ay"), "_bx": F.when(F.col("_round"), -F.col("_lx")).otherwise(F.col("_bx")), "_by": F.when(F.col("_round"), -F.col("_ly")).otherwise(F.col("_by"))})
    t1, t2 = _unit(F.col("_ax"), F.col("_ay")), _unit(F.col("_bx"), F.col("_by"))
    return d.select(*CHAIN, "part", "pos", "x", "y", t1[0].alias("t1x"), t1[1].alias("t1y"), t2[0].alias("t2x"), t2[1].alias("t2y"))


def _fitted(rows: DataFrame, tolerance: float) -> DataFrame:
    """Parts' points with the controls (x0 to y3) of the part's cubic, its greatest distance `error` and the place `worst` of it."""
    part = Window.partitionBy(*CHAIN, "part")
    order = part.orderBy("pos")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    step = F.coalesce(F.hypot(F.col("x") - F.lag("x").over(order), F.col("y") - F.lag("y").over(order)), F.lit(0.0))
    d = rows.withColumns({"_s": step, "x0": F.first("x").over(whole), "y0": F.first("y").over(whole), "x3": F.last("x").over(whole), "y3": F.last("y").over(whole), "n": F.count("*").over(part)})
    d = d.withColumns({"_c": F.sum("_s").over(order.rowsBetween(Window.unboundedPreceding, 0)), "_t": F.sum("_s").over(part)})
    d = d.withColumns({"u": F.when(F.col("_t") > 0, F.col("_c") / F.nullif(F.col("_t"), F.lit(0.0))).otherwise(0.0), "chord": F.hypot(F.col("x3") - F.col("x0"), F.col("y3") - F.col("y0"))}).drop("_s", "_c", "_t")
    for turn in range(STEPS + 1):
        u, v = F.col("u"), 1 - F.col("u")
        b0, b1, b2, b3 = v * v * v, 3 * u * v * v, 3 * u * u * v, u * u * u
        rx = F.col("x") - F.col("x0") * (b0 + b1) - F.col("x3") * (b2 + b3)
        ry = F.col("y") - F.col("y0") * (b0 + b1) - F.col("y3") * (b2 + b3)
        sums = {"c11": b1 * b1, "c12": b1 * b2 * (F.col("t1x") * F.col("t2x") + F.col("t1y") * F.col("t2y")), "c22": b2 * b2, "e1": b1 * (F.col("t1x") * rx + F.col("t1y") * ry), "e2": b2 * (F.col("t2x") * rx + F.col("t2y") * ry)}
        d = d.withColumns({k: F.sum(s).over(part) for k, s in sums.items()})
        det = F.col("c11") * F.col("c22") - F.col("c12") * F.col("c12")
        safe = F.when(F.abs(det) > 1e-12, det)
        d = d.withColumns({"a1": F.coalesce((F.col("e1") * F.col("c22") - F.col("e2") * F.col("c12")) / safe, F.lit(0.0)), "a2": F.coalesce((F.col("c11") * F.col("e2") - F.col("c12") * F.col("e1")) / safe, F.lit(0.0))})
        thirds = (F.col("n") == 2) | (F.col("a1") < 1e-6 * F.col("chord")) | (F.col("a2") < 1e-6 * F.col("chord"))
        d = d.withColumns({k: F.when(thirds, F.col("chord") / 3).otherwise(F.col(k)) for k in ("a1", "a2")})
        d = d.withColumns({"x1": F.col("x0") + F.col("t1x") * F.col("a1"), "y1": F.col("y0") + F.col("t1y") * F.col("a1"), "x2": F.col("x3") + F.col("t2x") * F.col("a2"), "y2": F.col("y3") + F.col("t2y") * F.col("a2")})
        at = lambda c: b0 * F.col(f"{c}0") + b1 * F.col(f"{c}1") + b2 * F.col(f"{c}2") + b3 * F.col(f"{c}3")  # noqa: E731, B023
        d = d.withColumns({"_qx": at("x") - F.col("x"), "_qy": at("y") - F.col("y")})
        d = d.withColumn("_far", F.max(F.struct(F.round(F.hypot("_qx", "_qy"), 9).alias("d"), (-F.col("pos")).alias("p"))).over(part))
        if turn < STEPS:
            slope = lambda c: 3 * v * v * (F.col(f"{c}1") - F.col(f"{c}0")) + 6 * v * u * (F.col(f"{c}2") - F.col(f"{c}1")) + 3 * u * u * (F.col(f"{c}3") - F.col(f"{c}2"))  # noqa: E731, B023
            bend = lambda c: 6 * v * (F.col(f"{c}2") - 2 * F.col(f"{c}1") + F.col(f"{c}0")) + 6 * u * (F.col(f"{c}3") - 2 * F.col(f"{c}2") + F.col(f"{c}1"))  # noqa: E731, B023
            up = F.col("_qx") * slope("x") + F.col("_qy") * slope("y")
            down = slope("x") * slope("x") + slope("y") * slope("y") + F.col("_qx") * bend("x") + F.col("_qy") * bend("y")
            moved = F.least(F.greatest(F.when(F.abs(down) > 1e-12, u - up / F.nullif(down, F.lit(0.0))).otherwise(u), F.lit(0.0)), F.lit(1.0))
            near = (F.col("_far.d") >= tolerance) & (F.col("_far.d") < NEAR * tolerance) & (F.col("n") > 2)
            d = d.withColumn("u", F.when(near, moved).otherwise(u))
    return d.withColumns({"error": F.col("_far.d"), "worst": -F.col("_far.p")})


CONTROLS = [f"{c}{k}" for k in range(4) for c in "xy"]


def fit(cut: DataFrame, tolerance: float = 0.8) -> DataFrame:
    """(page, chain, part, last, x0 ... y3, error): cubics of the chains' `parts`, in order of `part`; none is farther than `tolerance` from its points, but for two neighbouring ones."""
    done, rows = None, cut
    part = Window.partitionBy(*CHAIN, "part")
    while True:
        good = (F.col("error") < tolerance) | (F.col("n") == 2)
        d = _fitted(rows, tolerance).withColumns({"_first": F.min("pos").over(part), "_last": F.max("pos").over(part)})
        # of a part that has its cubic one row is kept
        d = d.where(~good | (F.col("pos") == F.col("_first"))).select(*cut.columns, "n", "error", "worst", "_first", "_last", *CONTROLS).checkpoint()
        made = d.where(good & (F.col("pos") == F.col("_first"))).select(*CHAIN, "part", F.col("_last").alias("last"), *CONTROLS, "error")
        done = made if done is None else done.unionByName(made)
        left = d.where(~good)
        if not left.take(1):
            return done
        split = F.least(F.greatest("worst", F.col("_first") + 1), F.col("_last") - 1)
        left = left.withColumn("_m", split)
        beside = lambda c, j: F.max(F.when(F.col("pos") == F.col("_m") + j, F.col(c))).over(part)
        left = left.withColumns({"_x": beside("x", -1) - beside("x", 1), "_y": beside("y", -1) - beside("y", 1)})
        tx, ty = _unit(F.col("_x"), F.col("_y"))
        side = lambda name, t1, t2: F.struct(name.alias("part"), t1[0].alias("t1x"), t1[1].alias("t1y"), t2[0].alias("t2x"), t2[1].alias("t2y"))
        before, after = side(F.col("part"), (F.col("t1x"), F.col("t1y")), (tx, ty)), side(F.col("_m"), (-tx, -ty), (F.col("t2x"), F.col("t2y")))
        each = F.explode(F.array_compact(F.array(F.when(F.col("pos") <= F.col("_m"), before), F.when(F.col("pos") >= F.col("_m"), after)))).alias("s")
        rows = left.select(*CHAIN, "pos", "x", "y", each).select(*CHAIN, "s.part", "pos", "x", "y", "s.t1x", "s.t1y", "s.t2x", "s.t2y")


def outlined(points: DataFrame, tolerance: float = 0.8, degrees: float = 60.0, sigma: float = 1.6, reach: int = 5) -> DataFrame:
    """Cubics (as `fit`) of chains of points (page, chain, pos, x, y, length, closed) as `contours.points` gives them; corners stay where they are."""
    dealt = points.repartition(*CHAIN)  # the one shuffle of all points; what follows are windows over chains
    exact = _cornered(dealt, degrees, reach).withColumns({"_x": F.col("x").cast("double"), "_y": F.col("y").cast("double")}).drop("turn")
    soft = smoothed(exact.withColumnsRenamed({"_x": "_ex", "_y": "_ey"}), sigma)
    both = soft.withColumns({"x": F.when(F.col("corner"), F.col("_ex")).otherwise(F.col("x")), "y": F.when(F.col("corner"), F.col("_ey")).otherwise(F.col("y"))}).drop("_ex", "_ey", "corner")
    return fit(parts(both, degrees, reach), tolerance)
