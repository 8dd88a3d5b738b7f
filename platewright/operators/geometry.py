"""Outlines as arrays of points and segments: area, chords, arcs, circles; functions of colour values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def signed_area(points: Column) -> Column:
    """Area of a closed outline (array of x, y), positive where it turns from x to y."""
    after = F.concat(F.slice(points, F.lit(2), F.size(points)), F.slice(points, F.lit(1), F.lit(1)))
    each = F.zip_with(points, after, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.aggregate(each, F.lit(0.0), lambda s, v: s + v) / 2


def chord_parameters(points: DataFrame, keys: tuple[str, ...] = ("chain",)) -> DataFrame:
    """Adds `t`, the share of a chain's length (keys, pos, x, y) up to each point."""
    w = Window.partitionBy(*keys).orderBy("pos")
    step = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    d = points.withColumn("_s", F.coalesce(step, F.lit(0.0)))
    d = d.withColumns({"_c": F.sum("_s").over(w), "_t": F.sum("_s").over(Window.partitionBy(*keys))})
    return d.withColumn("t", F.when(F.col("_t") > 0, F.col("_c") / F.nullif(F.col("_t"), F.lit(0.0))).otherwise(0.0)).drop("_s", "_c", "_t")


def arc_cubics(cx: Column, cy: Column, r: Column, start: Column, sweep: Column) -> Column:
    """Cubic pieces (x0, y0 ... x3, y3) of at most a quarter turn that follow an arc."""
    n = F.greatest(F.ceil(F.abs(sweep) / (math.pi / 2) - 1e-9), F.lit(1)).cast("int")

    def piece(i: Column) -> Column:
        d = sweep / n
        k, t0 = F.lit(4 / 3) * F.tan(d / 4), start + i * d
        t1 = t0 + d
        at = lambda t: (cx + r * F.cos(t), cy + r * F.sin(t))
        (x0, y0), (x3, y3) = at(t0), at(t1)
        values = [x0, y0, x0 - k * r * F.sin(t0), y0 + k * r * F.cos(t0), x3 + k * r * F.sin(t1), y3 - k * r * F.cos(t1), x3, y3]
        return F.struct(*(v.alias(f"{c}{j}") for v, (j, c) in zip(values, ((j, c) for j in range(4) for c in "xy"), strict=True)))

    return F.transform(F.sequence(F.lit(0), n - 1), piece)


def without_empty_segments(segments: Column, within: float = 1e-6) -> Column:
    """Segments (kind, x0, y0, x1, y1) without lines of no length; the first stays if all are."""
    kept = F.filter(segments, lambda s: ~((s["kind"] == "L") & (F.abs(s["x0"] - s["x1"]) <= within) & (F.abs(s["y0"] - s["y1"]) <= within)))
    return F.when(F.size(kept) > 0, kept).otherwise(F.slice(segments, F.lit(1), F.lit(1)))


def fitted_circles(points: DataFrame, keys: tuple[str, ...] = ("chain",)) -> DataFrame:
    """(keys, cx, cy, r, error): least-squares circles through chains of points, by sums; null where points lie in a line."""
    centre = points.groupBy(*keys).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    d = points.join(centre, list(keys)).withColumns({"u": F.col("x") - F.col("mx"), "v": F.col("y") - F.col("my")})
    total = lambda *names: F.sum(_product(names)).alias("".join(names))
    s = d.groupBy(*keys, "mx", "my").agg(F.count("*").alias("n"), total("u", "u"), total("u", "v"), total("v", "v"), total("u", "u", "u"), total("v", "v", "v"), total("u", "v", "v"), total("v", "u", "u"))
    det = F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv")
    bu, bv = (F.col("uuu") + F.col("uvv")) / 2, (F.col("vvv") + F.col("vuu")) / 2
    safe = F.when(F.abs(det) > 1e-9, det)
    a, b = (bu * F.col("vv") - bv * F.col("uv")) / safe, (bv * F.col("uu") - bu * F.col("uv")) / safe
    c = s.select(*keys, (F.col("mx") + a).alias("cx"), (F.col("my") + b).alias("cy"), F.sqrt(a * a + b * b + (F.col("uu") + F.col("vv")) / F.col("n")).alias("r"))
    away = points.join(c, list(keys)).groupBy(*keys).agg(F.max(F.abs(F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")) - F.col("r"))).alias("error"))
    return c.join(away, list(keys))


def fitted_ellipses(points: DataFrame, keys: tuple[str, ...] = ("chain",), least: int = 12, shortest: float = 2.0) -> DataFrame:
    """(keys, cx, cy, a, b, angle, error): ellipses through chains of `least` points or more, a >= b, the angle in radians of the long axis.

    The conic of least squares that is an ellipse comes from the sums of products of a chain's points, six
    by six, in one aggregation; the constrained eigenproblem of each chain is three by three.  Chains
    that lie on no ellipse, lines above all, and ellipses with an axis below `shortest` have no row.
    `error` is the greatest distance of a point from the ellipse.
    """
    import numpy as np
    import pyarrow as pa

    points = points.select(*keys, "x", "y").repartition(*keys)  # one shuffle for all that follows
    size = points.groupBy(*keys).agg(F.avg("x").alias("_mx"), F.avg("y").alias("_my"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.lit(1e-9)).alias("_s"), F.count("*").alias("_n")).where(F.col("_n") >= least)
    d = points.join(size, list(keys)).withColumns({"_u": (F.col("x") - F.col("_mx")) / F.col("_s"), "_v": (F.col("y") - F.col("_my")) / F.col("_s")})
    powers = {f"_{i}{j}": (i, j) for i in range(5) for j in range(5 - i)}
    power = lambda c, n: F.lit(1.0) if n == 0 else _product((c,) * n)
    sums = d.groupBy(*keys, "_mx", "_my", "_s").agg(*(F.sum(power("_u", i) * power("_v", j)).alias(name) for name, (i, j) in powers.items()))
    square, line = [(2, 0), (1, 1), (0, 2)], [(1, 0), (0, 1), (0, 0)]
    kinds = ", ".join(f"`{k}` {dict(points.dtypes)[k]}" for k in keys)

    def solved(batches):
        for batch in batches:
            table = {name: batch.column(name).to_numpy() for name in powers}
            moment = lambda one, two: np.stack([np.stack([table[f"_{a + c}{b + e}"] for c, e in two], -1) for a, b in one], -2)  # noqa: E731, B023
            s1, s2, s3 = moment(square, square), moment(square, line), moment(line, line)
            rows = np.flatnonzero(~(np.linalg.cond(s3) > 1e10)) if batch.num_rows else np.zeros(0, np.int64)
            s1, s2, s3 = s1[rows], s2[rows], s3[rows]
            back = -np.linalg.solve(s3, s2.transpose(0, 2, 1))
            m = s1 + s2 @ back
            values, vectors = np.linalg.eig(np.stack([m[:, 2] / 2, -m[:, 1], m[:, 0] / 2], 1))
            vectors = vectors.real
            bent = 4 * vectors[:, 0] * vectors[:, 2] - vectors[:, 1] ** 2
            good = (bent > 1e-9) & (abs(values.imag) < 1e-9)
            some = good.any(1)
            rows, vectors, back = rows[some], vectors[some], back[some]
            one = np.take_along_axis(vectors, np.where(good, values.real, np.inf)[some].argmin(1)[:, None, None], 2)[..., 0]
            a, b, c = one.T
            e, f, g = (back @ one[..., None])[..., 0].T
            cx, cy = np.linalg.solve(np.stack([np.stack([2 * a, b], -1), np.stack([b, 2 * c], -1)], -2), np.stack([-e, -f], -1)[..., None])[..., 0].T
            level = -(g + (e * cx + f * cy) / 2)
            axes, turned = np.linalg.eigh(np.stack([np.stack([a, b / 2], -1), np.stack([b / 2, c], -1)], -2))
            with np.errstate(divide="ignore", invalid="ignore"):
                radii = np.sqrt(level[:, None] / axes)
            real = np.isfinite(radii).all(1)
            rows, cx, cy, radii, turned = rows[real], cx[real], cy[real], radii[real], turned[real]
            long = radii.argmax(1)[:, None]
            axis = np.take_along_axis(turned, long[:, None], 2)[..., 0]
            a, b, angle = np.take_along_axis(radii, long, 1)[:, 0], np.take_along_axis(radii, 1 - long, 1)[:, 0], np.arctan2(axis[:, 1], axis[:, 0]) % np.pi
            scale, mx, my = (batch.column(c).to_numpy()[rows] for c in ("_s", "_mx", "_my"))
            columns = [batch.column(k).take(pa.array(rows, pa.int64())) for k in keys]
            yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, (cx * scale + mx, cy * scale + my, a * scale, b * scale, angle))], [*keys, "cx", "cy", "a", "b", "angle"])

    made = sums.mapInArrow(solved, f"{kinds}, cx double, cy double, a double, b double, angle double").where(F.col("b") >= shortest)
    away = ellipse_distance(points.join(made, list(keys)), "_e").groupBy(*keys, "cx", "cy", "a", "b", "angle").agg(F.max("_e").alias("error"))
    return away.select(*keys, "cx", "cy", "a", "b", "angle", "error")


def ellipse_distance(points: DataFrame, name: str, steps: int = 6) -> DataFrame:
    """`points` (x, y, cx, cy, a, b, angle, ...) with their distance from the ellipse as `name`, by steps along the circle of curvature."""
    c, columns = F.col, points.columns
    dx, dy = c("x") - c("cx"), c("y") - c("cy")
    d = points.withColumns({"_p": F.abs(dx * F.cos("angle") + dy * F.sin("angle")), "_q": F.abs(dy * F.cos("angle") - dx * F.sin("angle")), "_c": F.lit(math.sqrt(0.5)), "_s": F.lit(math.sqrt(0.5))})
    for _ in range(steps):
        d = d.withColumns({"_ex": (c("a") * c("a") - c("b") * c("b")) * F.pow("_c", F.lit(3)) / c("a"), "_ey": (c("b") * c("b") - c("a") * c("a")) * F.pow("_s", F.lit(3)) / c("b")})
        d = d.withColumn("_t", F.hypot(c("a") * c("_c") - c("_ex"), c("b") * c("_s") - c("_ey")) / F.greatest(F.hypot(c("_p") - c("_ex"), c("_q") - c("_ey")), F.lit(1e-12)))
        held = lambda z: F.least(F.greatest(z, F.lit(0.0)), F.lit(1.0))
        d = d.withColumns({"_c": held(((c("_p") - c("_ex")) * c("_t") + c("_ex")) / c("a")), "_s": held(((c("_q") - c("_ey")) * c("_t") + c("_ey")) / c("b"))})
        d = d.withColumn("_n", F.greatest(F.hypot("_c", "_s"), F.lit(1e-12))).withColumns({"_c": c("_c") / c("_n"), "_s": c("_s") / c("_n")})
    return d.select(*columns, F.hypot(c("_p") - c("a") * c("_c"), c("_q") - c("b") * c("_s")).alias(name))


def _product(names: tuple[str, ...]) -> Column:
    out = F.col(names[0])
    for n in names[1:]:
        out = out * F.col(n)
    return out


# ---------------------------------------------------------------- colour functions


def exponential(x: Column, c0: Column, c1: Column, n: Column) -> Column:
    """c0 + x ** n (c1 - c0) of each component."""
    held = F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    return F.zip_with(c0, c1, lambda a, b: a + F.pow(held, n) * (b - a))


def sampled(x: Column, samples: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Linear interpolation of a table of samples over [low, high]."""
    last = F.size(samples) - 1
    place = F.least(F.greatest((x - low) / (high - low), F.lit(0.0)), F.lit(1.0)) * last
    i = F.least(F.floor(place), F.greatest(last - 1, F.lit(0))).cast("int")
    a, b = F.get(samples, i), F.coalesce(F.get(samples, i + 1), F.get(samples, i))
    return a + (place - i) * (b - a)


def stitched(x: Column, bounds: Column, pieces: Column) -> Column:
    """Exponential pieces (c0, c1, n: structs) joined at bounds; each piece sees its part of [0, 1] as a whole."""
    edges = F.concat(F.array(F.lit(0.0)), bounds, F.array(F.lit(1.0)))
    held = F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    k = F.least(F.size(F.filter(bounds, lambda b: b <= held)), F.size(pieces) - 1)
    a, b, p = F.get(edges, k), F.get(edges, k + 1), F.get(pieces, k)
    part = F.when(b > a, (held - a) / F.nullif(b - a, F.lit(0.0))).otherwise(0.0)
    return exponential(part, p["c0"], p["c1"], p["n"])


def calculated(x: Column, program: Column) -> Column:
    """A calculator program (array of words) over one number: what is left on the stack.

    Words: numbers, add sub mul div neg abs sqrt exch dup pop; without jumps a fold over the words is enough.
    """
    rest = lambda s, n: F.slice(s, F.lit(1), F.greatest(F.size(s) - n, F.lit(0)))
    put = lambda s, n, *values: F.concat(rest(s, n), F.array(*values))

    def step(s: Column, w: Column) -> Column:
        one, two = F.try_element_at(s, F.lit(-1)), F.try_element_at(s, F.lit(-2))
        return (
            F.when(w == "add", put(s, 2, two + one)).when(w == "sub", put(s, 2, two - one)).when(w == "mul", put(s, 2, two * one)).when(w == "div", put(s, 2, F.try_divide(two, one)))
            .when(w == "neg", put(s, 1, -one)).when(w == "abs", put(s, 1, F.abs(one))).when(w == "sqrt", put(s, 1, F.sqrt(one))).when(w == "exch", put(s, 2, one, two)).when(w == "dup", put(s, 0, one)).when(w == "pop", rest(s, 1))
            .otherwise(put(s, 0, w.try_cast("double")))
        )

    return F.aggregate(program, F.array(x.cast("double")), step)
