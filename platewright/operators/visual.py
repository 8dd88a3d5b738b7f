"""Comparison of two rasters of a page, design and client, from pixels to boxes with kind and severity."""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewright.operators import raster, tiles

#: Boxes of which a side is shorter than THIN lie on the page's edge within EDGE pixels: what an alignment leaves.
THIN, EDGE, MARGIN = 14, 6, 2
#: Share of the page and mean excess that make a difference high or medium.
HIGH, MEDIUM = (0.02, 90.0), (0.003, 40.0)


def grey(r: Column, g: Column, b: Column) -> Column:
    return F.floor(0.299 * r + 0.587 * g + 0.114 * b + 0.5)


def pixel_limit(similarity: float, difference: float) -> float:
    """The excess that counts: `difference`, more of it the lower the similarity asked for."""
    return difference * min(max(1.0 - (similarity - 0.85) * 4.0, 0.4), 2.5)


def cosine_hash(pixels: DataFrame, keys: tuple[str, ...], n: int = 8, side: int = 32) -> DataFrame:
    """(keys, hash) of boxes' pixels (keys, px, py, w, h, value): signs of the lowest n by n cosine coefficients against their median.

    A box becomes `side` by `side` cell means (small ones are stretched); the transform is a sum along
    each row of cells and one along the columns.
    """
    cells = lambda p, size: F.sequence(F.floor(F.col(p) * side / F.col(size)), F.greatest(F.floor(F.col(p) * side / F.col(size)), F.ceil((F.col(p) + 1) * side / F.col(size)) - 1))
    each = pixels.select(*keys, "value", "py", "h", F.explode(cells("px", "w")).alias("cx")).select(*keys, "value", "cx", F.explode(cells("py", "h")).alias("cy"))
    mean = each.groupBy(*keys, "cy", "cx").agg(F.avg("value").alias("v"))
    wave = lambda c, k: F.cos(F.lit(math.pi * k / side) * (F.col(c) + 0.5))
    rows = mean.groupBy(*keys, "cy").agg(*(F.sum(F.col("v") * wave("cx", u)).alias(f"u{u}") for u in range(n)))
    # rounded, so that the order of a sum does not decide on which side of the median a zero lies
    whole = rows.groupBy(*keys).agg(F.array(*(F.round(F.sum(F.col(f"u{u}") * wave("cy", v)), 6) for v in range(n) for u in range(n))).alias("c"))
    ordered = F.array_sort("c")
    middle = (ordered[n * n // 2 - 1] + ordered[n * n // 2]) / 2
    bit = lambda v, i: F.when(v > middle, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    return whole.select(*keys, F.aggregate(F.transform("c", bit), F.lit(0).cast("long"), lambda s, b: s.bitwiseOR(b)).alias("hash"))


def _blurred(value: np.ndarray, there: np.ndarray) -> np.ndarray:
    """An array of whole numbers weighed as `windows.blurred` does, where `there` is true; a rim of one place is left as it is."""

    def weighed(v: np.ndarray, axis: int) -> np.ndarray:
        before, after = np.roll(v, 1, axis), np.roll(v, -1, axis)
        has, follows = np.roll(there, 1, axis), np.roll(there, -1, axis)
        return np.where(has, before, np.where(follows, after, v)) + 2 * v + np.where(follows, after, np.where(has, before, v))

    return (weighed(weighed(value, 1), 0) + 8) >> 4


def _windowed(f: np.ufunc, a: np.ndarray, radius: int) -> np.ndarray:
    """`f` over the square of 2 radius + 1 places around all but the outermost `radius` places."""
    for axis in (0, 1):
        n = a.shape[axis] - 2 * radius
        parts = [a.take(range(k, k + n), axis) for k in range(2 * radius + 1)]
        a = functools.reduce(f, parts)
    return a


#: Places around a pixel that its differences look at: the window of similarity and the blur of what is in it.
REACH, TOLERANT, SIMILAR = 4, 2, 3


def differences(design: DataFrame, client: DataFrame, bits: int = tiles.BITS) -> DataFrame:
    """(page, x, y, excess, similarity) of rasters (page, x, y, r, g, b); similarity is null where the window is cut by the page's edge.

    Both rasters are blurred; excess is how far the client leaves the range of the design's window, as in
    `raster.tolerant_excess`, similarity is that of `raster.local_similarity`, in one pass by tiles.
    """
    return _differences(design, client, bits).drop("colours")


def _differences(design: DataFrame, client: DataFrame, bits: int = tiles.BITS) -> DataFrame:
    """`differences` with both pixels' bytes, design's red to client's blue from the highest on, as a number `colours`."""
    kind = dict(design.dtypes)["page"]
    side = lambda df, of: df.select("page", "x", "y", *(F.col(c).cast("long").alias(c) for c in "rgb"), F.lit(of).alias("client"))

    def work(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        bands, second = [table.column(c).to_numpy() for c in "rgb"], table.column("client").combine_chunks().to_numpy(zero_copy_only=False)
        out = []
        for lo, hi, tx, ty, x, y in tiles.each(table, starts):
            ox, oy = int(x.min()) - REACH, int(y.min()) - REACH
            shape = (int(y.max()) - oy + REACH + 1, int(x.max()) - ox + REACH + 1)
            there, soft, packed = [], [], np.zeros(shape, np.int64)
            for of in (False, True):
                k = lo + np.flatnonzero(second[lo:hi] == of)
                at = (y[k - lo] - oy, x[k - lo] - ox)
                here = np.zeros(shape, bool)
                here[at] = True
                there.append(here)
                for band in bands:
                    value = np.zeros(shape, np.int64)
                    value[at] = band[k]
                    soft.append(_blurred(value, here))
                    packed = (packed << 8) + value
            both = there[0] & there[1]
            i, j = np.nonzero(both)
            own = (j + ox >> bits == tx) & (i + oy >> bits == ty)
            i, j = i[own], j[own]
            if not len(i):
                continue
            d, c = soft[:3], soft[3:]
            excess = np.zeros(len(i), np.int64)
            for one, two in zip(d, c, strict=True):
                high = _windowed(np.maximum, np.where(both, one, -1), TOLERANT)[i - TOLERANT, j - TOLERANT]
                low = _windowed(np.minimum, np.where(both, one, 1 << 40), TOLERANT)[i - TOLERANT, j - TOLERANT]
                excess = np.maximum(excess, np.maximum(two[i, j] - high, low - two[i, j]))
            p, q = (np.where(both, np.floor(0.299 * s[0] + 0.587 * s[1] + 0.114 * s[2] + 0.5).astype(np.int64), 0) for s in (d, c))
            n, sp, sq, pp, qq, pq = (_windowed(np.add, v, SIMILAR)[i - SIMILAR, j - SIMILAR] for v in (both.astype(np.int64), p, q, p * p, q * q, p * q))
            whole = (2 * SIMILAR + 1) ** 2
            out.append((np.full(len(i), lo), j + ox, i + oy, excess, raster.similarity(sp, sq, pp, qq, pq, float(whole)), n < whole, packed[i, j]))
        at, x, y, excess, similarity, cut, colours = (np.concatenate(v) for v in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4 + (np.zeros(0), np.zeros(0, bool), np.zeros(0, np.int64))
        return pa.RecordBatch.from_arrays([table.column("page").combine_chunks().take(pa.array(at)), pa.array(x), pa.array(y), pa.array(excess), pa.array(similarity, mask=cut), pa.array(colours)], ["page", "x", "y", "excess", "similarity", "colours"])

    return tiles.tiled(side(design, False).unionByName(side(client, True)), ("page",), REACH, work, f"page {kind}, x long, y long, excess long, similarity double, colours long", bits)


def strengths(found: DataFrame) -> DataFrame:
    """(page, x, y, strength): how strongly a pixel of `differences` differs, 0 to 1."""
    s = F.greatest(F.col("excess") / 255.0 * 2.0, 1.0 - F.least(F.greatest(F.coalesce("similarity", F.lit(1.0)), F.lit(0.0)), F.lit(1.0)) - 0.6)
    return found.select("page", "x", "y", F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0)).alias("strength"))


def compared(design: DataFrame, client: DataFrame, similarity: float = 0.85, difference: float = 40.0, least_area: int = 60, valid: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Scores (page, similarity) and boxes (page, x, y, w, h, pixels, severity, subtype) of what differs between two rasters (page, x, y, r, g, b).

    `valid` (page, x, y) are the pixels that the client's picture covers; near its rim nothing counts.
    Marked pixels grow, gaps close, and connected parts of `least_area` pixels make boxes.
    """
    found = _differences(design, client).checkpoint()
    scores = found.groupBy("page").agg(F.coalesce(F.avg("similarity"), F.lit(1.0)).alias("similarity"))
    pages = found.groupBy("page").agg((F.max("x") + 1).alias("_w"), (F.max("y") + 1).alias("_h"))
    marked = found.where(F.col("excess") > pixel_limit(similarity, difference)).select("page", "x", "y")
    if valid is not None:
        marked = marked.join(raster.eroded(valid, raster.square(9)), ["page", "x", "y"], "left_semi")
    disc = raster.ellipse(4, 4)
    for step in (raster.dilated, raster.dilated, raster.dilated, raster.eroded, raster.eroded):
        marked = step(marked, disc)
    inside = marked.join(found.select("page", "x", "y"), ["page", "x", "y"], "left_semi")
    boxes = raster.component_boxes(raster.components(inside)).where(F.col("pixels") >= least_area).join(pages, "page")
    rim = (F.col("x") <= EDGE) | (F.col("y") <= EDGE) | (F.col("x") + F.col("w") >= F.col("_w") - EDGE) | (F.col("y") + F.col("h") >= F.col("_h") - EDGE)
    boxes = boxes.where(~((F.least("w", "h") < THIN) & rim)).withColumn("box", F.row_number().over(Window.partitionBy("page").orderBy("y", "x", "w", "h"))).drop("component").checkpoint()
    # each box's own pixels, the margin around them too; boxes of a page hardly overlap
    upto = lambda at, size, most: F.sequence(F.greatest(F.col(at) - MARGIN, F.lit(0)), F.least(F.col(at) + F.col(size) + MARGIN, F.col(most)) - 1)
    places = boxes.select("page", "box", "x", "w", "_w", "_h", "y", "h", F.explode(upto("y", "h", "_h")).alias("py")).select("page", "box", "x", "w", "y", "h", "py", F.explode(upto("x", "w", "_w")).alias("px"))
    core = F.col("px").between(F.col("x"), F.col("x") + F.col("w") - 1) & F.col("py").between(F.col("y"), F.col("y") + F.col("h") - 1)
    cut = places.select("page", "box", F.col("px").alias("x"), F.col("py").alias("y"), core.alias("core"), (F.col("px") - F.greatest(F.col("x") - MARGIN, F.lit(0))).alias("px"), (F.col("py") - F.greatest(F.col("y") - MARGIN, F.lit(0))).alias("py"))
    size = Window.partitionBy("page", "box")
    byte = lambda k: F.shiftright("colours", 40 - 8 * k).bitwiseAND(F.lit(255))
    pixels = cut.join(found.select("page", "x", "y", "excess", *(byte(k).alias(n) for k, n in enumerate(("dr", "dg", "db", "cr", "cg", "cb")))), ["page", "x", "y"])
    pixels = pixels.withColumns({"w": F.max("px").over(size) + 1, "h": F.max("py").over(size) + 1, "gd": grey(*(F.col(f"d{c}") for c in "rgb")), "gc": grey(*(F.col(f"c{c}") for c in "rgb"))}).checkpoint()
    median = lambda c: F.percentile(c, F.lit(0.5))
    facts = pixels.groupBy("page", "box").agg(F.avg(F.when(F.col("core"), F.col("excess"))).alias("_mean"), F.stddev_pop("gd").alias("design_sd"), F.stddev_pop("gc").alias("client_sd"), F.greatest(*(F.abs(median(f"d{c}") - median(f"c{c}")) for c in "rgb")).alias("median_change"))
    hashes = [cosine_hash(pixels.select("page", "box", "px", "py", "w", "h", F.col(c).alias("value")), ("page", "box")).withColumnRenamed("hash", f"_{c}") for c in ("gd", "gc")]
    known = facts.join(hashes[0], ["page", "box"]).join(hashes[1], ["page", "box"]).withColumn("hash_distance", raster.hash_distance(F.col("_gd"), F.col("_gc")))
    share = F.col("w") * F.col("h") / (F.col("_w") * F.col("_h"))
    severity = F.when((share > HIGH[0]) | (F.col("_mean") > HIGH[1]), "high").when((share > MEDIUM[0]) | (F.col("_mean") > MEDIUM[1]), "medium").otherwise("low")
    rated = raster.region_kind(boxes.join(known, ["page", "box"])).withColumn("severity", severity)
    return scores, rated.select("page", "x", "y", "w", "h", "pixels", "severity", "subtype")
