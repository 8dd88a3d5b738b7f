"""Rasters as rows (page, x, y, value): components, regions, morphology, screens, palettes and label edits.

Pixels are keys: neighbours meet by equality joins on shifted coordinates, so no image has to fit a task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewright.operators import distance, tiles, windows

NEAR4 = [(1, 0), (-1, 0), (0, 1), (0, -1)]
NEAR8 = [*NEAR4, (1, 1), (1, -1), (-1, 1), (-1, -1)]


def ellipse(rx: float, ry: float) -> list[tuple[int, int]]:
    """Offsets within an ellipse of semi-axes half a pixel larger, so that diagonal edges are covered."""
    ax, ay = rx + 0.5, ry + 0.5
    nx, ny = math.ceil(ax), math.ceil(ay)
    return [(x, y) for y in range(-ny, ny + 1) for x in range(-nx, nx + 1) if (x / ax) ** 2 + (y / ay) ** 2 <= 1 + 1e-9]


def square(k: int) -> list[tuple[int, int]]:
    r = k // 2
    return [(x, y) for y in range(-r, r + 1) for x in range(-r, r + 1)]


def _shifts(offsets: list[tuple[int, int]]) -> Column:
    return F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in offsets))).alias("d")


def _morphed(mask: DataFrame, offsets: list[tuple[int, int]], keys: tuple[str, ...], all_: bool) -> DataFrame:
    """Places (keys, x, y) from which one of the `offsets`, or all of them, leads to a pixel of the mask."""
    kinds = dict(mask.dtypes)
    radius = max(max(abs(a), abs(b)) for a, b in offsets)
    bits = max(tiles.BITS, (2 * radius).bit_length())

    def work(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        rows, xs, ys = [], [], []
        for lo, _, tx, ty, x, y in tiles.each(table, starts):
            ox, oy = int(x.min()) - radius, int(y.min()) - radius
            h, w = int(y.max()) - oy + radius + 1, int(x.max()) - ox + radius + 1
            on = np.zeros((h + 2 * radius, w + 2 * radius), bool)
            on[y - oy + radius, x - ox + radius] = True
            out = np.full((h, w), all_)
            for dx, dy in offsets:
                (np.logical_and if all_ else np.logical_or)(out, on[radius + dy : radius + dy + h, radius + dx : radius + dx + w], out=out)
            i, j = np.nonzero(out)
            own = (j + ox >> bits == tx) & (i + oy >> bits == ty)
            xs.append(j[own] + ox), ys.append(i[own] + oy), rows.append(np.full(int(own.sum()), lo))
        at, x, y = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (rows, xs, ys))
        return pa.RecordBatch.from_arrays([*(table.column(k).combine_chunks().take(pa.array(at)) for k in keys), pa.array(x), pa.array(y)], [*keys, "x", "y"])

    made = tiles.tiled(mask.select(*keys, "x", "y"), keys, radius, work, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "x long, y long"]), bits)
    return made.select(*keys, *(F.col(c).cast(kinds[c]).alias(c) for c in ("x", "y")))


def dilated(mask: DataFrame, offsets: list[tuple[int, int]], keys: tuple[str, ...] = ("page",)) -> DataFrame:
    """Pixels (keys, x, y) that the mask reaches by an offset."""
    return _morphed(mask, [(-dx, -dy) for dx, dy in offsets], keys, False)


def eroded(mask: DataFrame, offsets: list[tuple[int, int]], keys: tuple[str, ...] = ("page",)) -> DataFrame:
    """Pixels all of whose offsets are in the mask."""
    return _morphed(mask, offsets, keys, True)


def closed(mask: DataFrame, offsets: list[tuple[int, int]], keys: tuple[str, ...] = ("page",)) -> DataFrame:
    return eroded(dilated(mask, offsets, keys), offsets, keys)


def opened(mask: DataFrame, offsets: list[tuple[int, int]], keys: tuple[str, ...] = ("page",)) -> DataFrame:
    return dilated(eroded(mask, offsets, keys), [(-dx, -dy) for dx, dy in offsets], keys)


def runs(mask: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Horizontal runs (keys, y, x0, x1) of a mask."""
    w = Window.partitionBy(*keys, "y").orderBy("x")
    return mask.withColumn("_i", F.col("x") - F.row_number().over(w)).groupBy(*keys, "y", "_i").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_i")


def _tile_parts(tile: np.ndarray, x: np.ndarray, y: np.ndarray, own: np.ndarray, reach: int, wide: int) -> tuple[np.ndarray, ...]:
    """First and last pixel of each run of pixels sorted by tile, y and x, and the run with which its part of the tile begins; `wide` is more than a tile's width."""
    same = (tile[1:] == tile[:-1]) & (y[1:] == y[:-1])
    begins = np.append(True, ~(same & (x[1:] == x[:-1] + 1) & (own[1:] == own[:-1])))[: len(x)]
    first = np.flatnonzero(begins)
    last = np.append(first[1:], len(x))[: len(first)] - 1
    t, row, x0, x1 = tile[first], y[first], x[first], x[last]
    beside = np.flatnonzero((t[1:] == t[:-1]) & (row[1:] == row[:-1]) & (x0[1:] == x1[:-1] + 1))
    # runs of the next row of the tile that touch: numbers of tiles and rows are dense, places are taken from the tile's left
    rows, number = np.unique(np.stack([t, row], 1), axis=0, return_inverse=True)
    number = number.ravel()
    below = np.full(len(rows) + 1, -1)
    below[: len(rows) - 1] = np.where((rows[1:, 0] == rows[:-1, 0]) & (rows[1:, 1] == rows[:-1, 1] + 1), np.arange(1, len(rows)), -1) if len(rows) > 1 else below[: len(rows) - 1]
    left = np.minimum.reduceat(x0, np.flatnonzero(np.append(True, t[1:] != t[:-1]))) if len(t) else t
    base = left[np.cumsum(np.append(True, t[1:] != t[:-1])) - 1] if len(t) else t
    u0, u1, size = x0 - base + 1, x1 - base + 1, 4 * wide
    some = np.flatnonzero(below[number] >= 0)
    at = below[number[some]] * size
    lo, hi = np.searchsorted(number * size + u1, at + u0[some] - reach), np.searchsorted(number * size + u0, at + u1[some] + reach, "right")
    sizes = np.maximum(hi - lo, 0)
    a = np.concatenate([beside, np.repeat(some, sizes)])
    b = np.concatenate([beside + 1, np.arange(sizes.sum()) + np.repeat(lo - (np.cumsum(sizes) - sizes), sizes)])
    part = np.arange(len(first))
    while (part[a] != part[b]).any():
        least = np.minimum(part[a], part[b])
        np.minimum.at(part, part[a], least)
        np.minimum.at(part, part[b], least)
        while (part[part] != part).any():
            part = part[part]
    return first, last, part


def components(mask: DataFrame, keys: tuple[str, ...] = ("page",), diagonal: bool = True, rounds: int = 40, bits: int = tiles.BITS) -> DataFrame:
    """Runs (keys, y, x0, x1, component) of a mask's connected parts; a component is its first run's place `y:x0` as a struct.

    Tiles find their own parts; runs end at their sides.  Parts of different tiles that hold the same
    pixel, as one of their own or as one beside them, are edges; each round takes the least place of the
    neighbours and then of the place's own place, so that chains halve.  Rounds cut lineage by a checkpoint.
    """
    kinds = dict(mask.dtypes)
    reach = 1 if diagonal else 0

    def work(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        x, y, tx, ty = (table.column(c).to_numpy() for c in ("x", "y", "_tx", "_ty"))
        tile = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
        order = np.lexsort((x, y, tile))
        new = np.append(True, (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0) | (np.diff(tile[order]) != 0))[: len(order)]
        order = order[new]
        x, y, tx, ty, tile = x[order], y[order], tx[order], ty[order], tile[order]
        own = (x >> bits == tx) & (y >> bits == ty)
        first, last, part = _tile_parts(tile, x, y, own, reach, (1 << bits) + 4)
        run = np.repeat(np.arange(len(first)), last - first + 1)
        cy, cx = y[first][part], x[first][part]
        rim = ~own | (x - (tx << bits) == 0) | (y - (ty << bits) == 0) | (x - (tx << bits) == (1 << bits) - 1) | (y - (ty << bits) == (1 << bits) - 1)
        # tiles that hold nothing but what lies beside them tell nothing
        rim &= (np.bincount(tile, own, len(starts)) > 0)[tile]
        runs_, marks = np.flatnonzero(own[first]), np.flatnonzero(rim)
        at = np.concatenate([order[first[runs_]], order[marks]])
        both = lambda a, b: pa.array(np.concatenate([a, b]))
        return pa.RecordBatch.from_arrays(
            [*(table.column(k).combine_chunks().take(pa.array(at)) for k in keys), both(y[first[runs_]], y[marks]), both(x[first[runs_]], x[marks]), both(x[last[runs_]], x[marks]), both(cy[runs_], cy[run[marks]]), both(cx[runs_], cx[run[marks]]), pa.array(np.arange(len(at)) >= len(runs_))],
            [*keys, "y", "x0", "x1", "_cy", "_cx", "_mark"],
        )

    made = tiles.tiled(mask.select(*keys, "x", "y"), keys, 1, work, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "y long, x0 long, x1 long, _cy long, _cx long, _mark boolean"]), bits).checkpoint()
    place = F.struct(F.col("_cy").cast(kinds["y"]).alias("y"), F.col("_cx").cast(kinds["x"]).alias("x0"))
    part = made.where("not _mark").select(*keys, F.col("y").cast(kinds["y"]).alias("y"), *(F.col(c).cast(kinds["x"]).alias(c) for c in ("x0", "x1")), place.alias("id"))
    met = made.where("_mark").groupBy(*keys, "y", "x0").agg(F.collect_set(place).alias("_s")).where(F.size("_s") > 1)  # at most four tiles meet at a pixel
    touching = met.select(*keys, F.array_min("_s").alias("a"), F.explode("_s").alias("b")).where("a <> b").distinct()
    edges = touching.unionByName(touching.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).checkpoint()
    if not edges.take(1):
        return part.withColumnRenamed("id", "component")
    labels = edges.select(*keys, F.col("a").alias("id")).distinct().withColumn("c", F.col("id")).checkpoint()
    for _ in range(rounds):
        offered = edges.join(labels.select(*keys, F.col("id").alias("b"), "c"), [*keys, "b"]).groupBy(*keys, F.col("a").alias("id")).agg(F.min("c").alias("o"))
        lower = labels.join(offered, [*keys, "id"], "left").withColumn("n", F.least("c", F.coalesce("o", "c")))
        jumped = lower.select(*keys, "id", "c", "n").join(lower.select(*keys, F.col("id").alias("n"), F.col("n").alias("m")), [*keys, "n"], "left")
        new = jumped.select(*keys, "id", F.least("n", F.coalesce("m", "n")).alias("l"), "c").checkpoint()
        changed = new.where("l <> c").take(1)
        labels = new.select(*keys, "id", F.col("l").alias("c"))
        if not changed:
            break
    else:
        raise RuntimeError("components did not settle")
    return part.join(labels, [*keys, "id"], "left").select(*keys, "y", "x0", "x1", F.coalesce("c", "id").alias("component"))


def component_boxes(parts: DataFrame, keys: tuple[str, ...] = ("page",)) -> DataFrame:
    """(keys, component, x, y, w, h, pixels)."""
    by = parts.groupBy(*keys, "component").agg(F.min("x0").alias("x"), F.min("y").alias("y"), F.max("x1").alias("_x"), F.max("y").alias("_y"), F.sum(F.col("x1") - F.col("x0") + 1).alias("pixels"))
    return by.select(*keys, "component", "x", "y", (F.col("_x") - F.col("x") + 1).alias("w"), (F.col("_y") - F.col("y") + 1).alias("h"), "pixels")


def pixels_of(parts: DataFrame, keys: tuple[str, ...] = ("page",)) -> DataFrame:
    return parts.select(*keys, "component", "y", F.explode(F.sequence("x0", "x1")).alias("x"))


def high_regions(totals: DataFrame, limit: float, dpi: float, least_mm2: float = 1.0) -> DataFrame:
    """(page, x, y, w, h, greatest) of regions of (page, x, y, total) above a limit: gaps closed, small boxes left out, highest first."""
    k = max(3, int(dpi / 50) | 1)
    mask = closed(totals.where(F.col("total") > limit).select("page", "x", "y"), square(k))
    parts = components(mask)
    boxes = component_boxes(parts).where(F.col("w") * F.col("h") * (25.4 / dpi) ** 2 >= least_mm2)
    inside = totals.join(pixels_of(parts).select("page", "x", "y", "component"), ["page", "x", "y"]).groupBy("page", "component").agg(F.round(F.max("total"), 1).alias("greatest"))
    return boxes.join(inside, ["page", "component"]).select("page", "x", "y", "w", "h", "greatest").orderBy(F.col("greatest").desc(), "page", "y", "x")


def without_specks(mask: DataFrame, most: int = 4, side: int = 3) -> DataFrame:
    """A mask without components of at most `most` pixels and `side` pixels a side."""
    parts = components(mask.select("page", "x", "y").distinct())
    keep = component_boxes(parts).where((F.col("pixels") > most) | (F.greatest("w", "h") > side)).select("page", "component")
    return pixels_of(parts).join(keep, ["page", "component"]).select("page", "x", "y")


def tolerant_excess(design: DataFrame, client: DataFrame, k: int = 5) -> DataFrame:
    """(page, x, y, excess): how far a client's pixel leaves the range of the design's k by k window; client pixels without any design in reach have none."""
    both = client.select("page", "x", "y", F.col("value").alias("_c")).join(design.select("page", "x", "y", "value"), ["page", "x", "y"], "full")
    d = windows.extrema(both, k // 2, ["value"]).where("_c is not null and low_value is not null")
    return d.select("page", "x", "y", F.greatest(F.col("_c") - F.col("high_value"), F.col("low_value") - F.col("_c"), F.lit(0)).alias("excess"))


def best_channel(pixels: DataFrame) -> DataFrame:
    """(page, channel): the channel of (page, channel, value) whose 5th and 95th percentiles are farthest apart, the first name on ties."""
    spans = pixels.groupBy("page", "channel").agg(F.percentile("value", F.array(F.lit(0.05), F.lit(0.95))).alias("p"))
    return spans.groupBy("page").agg(F.min_by("channel", F.struct(-(F.element_at("p", 2) - F.element_at("p", 1)), F.col("channel"))).alias("channel"))


def otsu(pixels: DataFrame) -> DataFrame:
    """(page, threshold): the level of bytes (page, value) that parts their histogram best; the lowest on ties."""
    bins = pixels.groupBy("page", "value").agg(F.count("*").alias("n"))
    low = Window.partitionBy("page").orderBy("value")  # 256 levels
    all_ = Window.partitionBy("page")
    b = bins.withColumns({"w0": F.sum("n").over(low), "s0": F.sum(F.col("n") * F.col("value")).over(low), "w": F.sum("n").over(all_), "s": F.sum(F.col("n") * F.col("value")).over(all_)}).where("w0 < w")
    m0, m1 = F.col("s0") / F.col("w0"), (F.col("s") - F.col("s0")) / (F.col("w") - F.col("w0"))
    between = F.col("w0") * (F.col("w") - F.col("w0")) * F.pow(m0 - m1, F.lit(2))
    return b.groupBy("page").agg(F.min_by("value", F.struct(-between, F.col("value"))).alias("threshold"))


def binarized(pixels: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Pixels with `on` (above the page's threshold), turned round where most of the page were dark."""
    p = pixels.join(thresholds, "page").withColumn("on", F.col("value") > F.col("threshold"))
    share = p.groupBy("page").agg((F.avg(F.col("on").cast("int")) < 127 / 255).alias("flip"))
    return p.join(share, "page").withColumn("on", F.col("on") != F.col("flip")).drop("threshold", "flip")


def leading_bar(lines: DataFrame, edge: Column, different: float = 40.0, uniform: float = 0.85) -> DataFrame:
    """(page, bar): length of the leading run of lines (page, i, median, share) that are uniform and unlike the design's edge."""
    bad = (F.abs(F.col("median") - edge) < different) | (F.col("share") < uniform)
    return lines.groupBy("page").agg(F.coalesce(F.min(F.when(bad, F.col("i"))), F.max("i") + 1).cast("int").alias("bar"))


def ink_colour(pixels: DataFrame) -> DataFrame:
    """(page, r, g, b, br, bg, bb): a box's ink and ground of pixels (page, id, ring, r, g, b).

    The ground is the median of the ring; ink is the median of the farthest quarter of the box (three
    pixels, 25 away at least); nothing where no pixel is 40 away.
    """
    median = lambda c: F.percentile(c, F.lit(0.5))
    ground = pixels.where("ring").groupBy("page").agg(*(median(c).alias(f"b{c}") for c in "rgb"))
    box = pixels.where("not ring").join(ground, "page")
    box = box.withColumn("far", F.sqrt(sum((F.pow(F.col(c) - F.col(f"b{c}"), F.lit(2)) for c in "gb"), F.pow(F.col("r") - F.col("br"), F.lit(2)))))
    w = Window.partitionBy("page")
    ranked = box.withColumns({"_k": F.row_number().over(w.orderBy(F.col("far").desc(), "id")), "_n": F.count("*").over(w), "_far": F.max("far").over(w)})
    chosen = ranked.where((F.col("_far") >= 40) & (F.col("_k") <= F.greatest(F.lit(3), F.floor(F.col("_n") * 0.25))) & (F.col("far") >= 25))
    by = chosen.groupBy("page", "br", "bg", "bb").agg(*(median(c).alias(c) for c in "rgb"), F.count("*").alias("_n"))
    return by.where("_n >= 3").select("page", "r", "g", "b", "br", "bg", "bb")


def colour_cells(cells: DataFrame, tolerance: float) -> DataFrame:
    """(page, x, y, w, h, de, n) of groups of cells (page, x, y, de, text, spread, valid) whose colours differ.

    Cells with text, edges or without content take no part; a single cell must differ twice as much.
    """
    bad = cells.where((F.col("de") > tolerance) & (F.col("text") < 0.1) & (F.col("spread") < 25) & (F.col("valid") > 0.98))
    parts = components(bad.select("page", "x", "y"))
    inside = bad.join(pixels_of(parts), ["page", "x", "y"]).groupBy("page", "component").agg(F.avg("de").alias("de"), F.count("*").alias("n"))
    return component_boxes(parts).join(inside, ["page", "component"]).where((F.col("n") >= 2) | (F.col("de") >= 2 * tolerance)).select("page", "x", "y", "w", "h", "de", "n")


def region_kind(regions: DataFrame) -> DataFrame:
    """Adds `subtype` to regions (design_sd, client_sd, hash_distance, median_change)."""
    d, c = F.col("design_sd"), F.col("client_sd")
    kind = F.when((c < 6) & (d >= 10), "element_extra").when((d < 6) & (c >= 10), "element_missing").when(F.col("hash_distance") > 10, "element_changed").when(F.col("median_change") > 25, "recoloured").otherwise("visual_difference")
    return regions.withColumn("subtype", kind)


def hash_distance(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hashes."""
    return F.bit_count(a.bitwiseXOR(b))


def mean_hash(pixels: DataFrame, n: int = 8) -> DataFrame:
    """(page, hash) of n by n cell means (page, cx, cy, value): a bit for each cell above the median."""
    mid = pixels.groupBy("page").agg(F.percentile("value", F.lit(0.5)).alias("mid"))
    bit = F.when(F.col("value") > F.col("mid"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("cy") * n + F.col("cx")).cast("int"))).otherwise(0)
    return pixels.join(mid, "page").groupBy("page").agg(F.bit_or(bit).alias("hash"))


# ---------------------------------------------------------------- screens


def spot(u: Column, v: Column, shape: str = "round") -> Column:
    """Height of a dot at a place of its cell (0..1)."""
    a, b = u - 0.5, v - 0.5
    if shape == "square":
        return -F.greatest(F.abs(a), F.abs(b))
    return F.cos(2 * math.pi * a) + (0.6 if shape == "ellipse" else 1.0) * F.cos(2 * math.pi * b)


def cell_place(dpi: float, lpi: float, angle: float) -> tuple[Column, Column]:
    """Place of a pixel in its turned cell."""
    cos, sin, k = math.cos(math.radians(angle)), math.sin(math.radians(angle)), lpi / dpi
    u, v = (F.col("x") * cos + F.col("y") * sin) * k, (F.col("y") * cos - F.col("x") * sin) * k
    return u - F.floor(u), v - F.floor(v)


def held_coverage(cov: Column, least: float, most: float) -> Column:
    """Coverage in 0..1: nothing below the least dot, full above the greatest."""
    c = cov / 255.0
    return F.when(c < least, 0.0).when(c > most, 1.0).otherwise(c)


def am_screen(plate: DataFrame, dpi: float, lpi: float = 55.0, angle: float = 22.5, shape: str = "round", least: float = 0.0, most: float = 1.0, levels: int = 1024) -> DataFrame:
    """Adds `on` of a clustered-dot screen to (x, y, cov): a dot grows from its cell's middle, and mean coverage stays.

    The threshold of a height is the share of a cell's places that are higher; it comes from a table of
    `levels` quantiles, made once on the driver.
    """
    n = 256
    at = [(i + 0.5) / n for i in range(n)]
    cosine = [math.cos(2 * math.pi * (t - 0.5)) for t in at]
    if shape == "square":
        heights = sorted(-max(abs(a - 0.5), abs(b - 0.5)) for a in at for b in at)
    else:
        heights = sorted(a + (0.6 if shape == "ellipse" else 1.0) * b for a in cosine for b in cosine)
    table = [heights[i * len(heights) // levels] for i in range(levels)]
    quantiles = F.lit(table)
    # binary search as a fold: ten halvings of the table
    search = F.aggregate(F.array(*(F.lit(levels >> (i + 1)) for i in range(int(math.log2(levels))))), F.lit(0), lambda s, step: F.when(F.element_at(quantiles, s + step) < F.col("_g"), s + step).otherwise(s))
    u, v = cell_place(dpi, lpi, angle)
    df = plate.withColumn("_g", spot(u, v, shape)).withColumn("_c", held_coverage(F.col("cov"), least, most))
    return df.withColumn("on", (F.col("_c") > 1 - search / levels) & (F.col("_c") > 0)).drop("_g", "_c")


def fm_screen(plate: DataFrame, mask: DataFrame, size: int = 64, least: float = 0.0, most: float = 1.0) -> DataFrame:
    """Adds `on` of a tiled threshold mask (mx, my, threshold), `size` by `size`, to (x, y, cov)."""
    keyed = plate.withColumns({"mx": F.pmod("x", F.lit(size)), "my": F.pmod("y", F.lit(size)), "_c": held_coverage(F.col("cov"), least, most)})
    return keyed.join(F.broadcast(mask), ["mx", "my"]).withColumn("on", (F.col("_c") > F.col("threshold")) & (F.col("_c") > 0)).drop("mx", "my", "_c", "threshold")


def shifted(plate: DataFrame, dx: float, dy: float) -> DataFrame:
    """Plate (ink, x, y, cov) moved by parts of a pixel: each pixel's coverage goes to four by area."""
    fx, fy = math.floor(dx), math.floor(dy)
    tx, ty = dx - fx, dy - fy
    parts = [(fx + i, fy + j, (tx if i else 1 - tx) * (ty if j else 1 - ty)) for i in (0, 1) for j in (0, 1)]
    to = F.explode(F.array(*(F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy"), F.lit(w).alias("w")) for a, b, w in parts if w > 0))).alias("d")
    moved = plate.select("ink", "x", "y", "cov", to)
    return moved.groupBy("ink", (F.col("x") + F.col("d.dx")).alias("x"), (F.col("y") + F.col("d.dy")).alias("y")).agg(F.round(F.sum(F.col("cov") * F.col("d.w")), 6).alias("cov"))


# ---------------------------------------------------------------- labels


def compacted(labels: DataFrame, column: str = "label") -> DataFrame:
    """Labels of a page numbered from 0 without gaps; the few distinct ones are numbered, not the pixels."""
    ids = labels.select("page", column).distinct().withColumn("_n", F.row_number().over(Window.partitionBy("page").orderBy(column)) - 1)
    return labels.join(ids, ["page", column]).withColumn(column, F.col("_n")).drop("_n")


def merged(labels: DataFrame, keep: int, gone: int) -> DataFrame:
    return compacted(labels.withColumn("label", F.when(F.col("label") == gone, keep).otherwise(F.col("label"))))


def filled(labels: DataFrame, holes: DataFrame) -> DataFrame:
    """Labels (page, x, y, label) with pixels (page, x, y) of `holes` taken over by the nearest other label, the least of equally near ones.

    Every pixel comes back: on a page without other labels the holes keep theirs.
    """
    open_ = holes.select("page", "x", "y").distinct()
    known = labels.select("page", "x", "y", "label").join(open_, ["page", "x", "y"], "left_anti")
    own = labels.select("page", "x", "y", F.col("label").alias("_own")).join(open_, ["page", "x", "y"])
    kind = {c: t for c, t in labels.dtypes}
    near = distance.nearest_seeds(open_, known).select("page", F.col("x").cast(kind["x"]).alias("x"), F.col("y").cast(kind["y"]).alias("y"), "label")
    return known.unionByName(own.join(near, ["page", "x", "y"]).select("page", "x", "y", F.coalesce("label", "_own").cast(kind["label"]).alias("label")))


def without_islands(labels: DataFrame, least: int) -> DataFrame:
    """Components of a label with fewer than `least` pixels go to the labels around them."""
    parts = components(labels.select("page", "label", "x", "y"), ("page", "label"), diagonal=False)
    small = component_boxes(parts, ("page", "label")).where(F.col("pixels") < least)
    holes = pixels_of(parts, ("page", "label")).join(small.select("page", "label", "component"), ["page", "label", "component"]).select("page", "x", "y")
    return filled(labels, holes)


def without_label(labels: DataFrame, label: int) -> DataFrame:
    """A label's pixels go to the nearest other one."""
    return compacted(filled(labels, labels.where(F.col("label") == label).select("page", "x", "y")))


def opening_loss(labels: DataFrame, width: int) -> DataFrame:
    """Pixels (page, x, y) of details thinner than `width`."""
    mask = labels.select("page", "label", "x", "y")
    kept = opened(mask, square(width), ("page", "label"))
    return mask.join(kept, ["page", "label", "x", "y"], "left_anti").select("page", "x", "y")


def mirror_share(labels: DataFrame, ground: int) -> DataFrame:
    """(page, vertical, horizontal): share of the content that equals its mirror image."""
    fg = labels.where(F.col("label") != ground)
    box = fg.groupBy("page").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    inside = fg.join(box, "page")
    def share(mirror_x: bool, name: str) -> DataFrame:
        x = F.col("x0") + F.col("x1") - F.col("x") if mirror_x else F.col("x")
        y = F.col("y") if mirror_x else F.col("y0") + F.col("y1") - F.col("y")
        both = inside.select("page", "x", "y", "label").join(inside.select("page", x.alias("x"), y.alias("y"), F.col("label").alias("other")), ["page", "x", "y"], "full")
        return both.groupBy("page").agg(F.avg(F.coalesce(F.col("label") == F.col("other"), F.lit(False)).cast("int")).alias(name))
    return share(True, "vertical").join(share(False, "horizontal"), "page")


def label_edges(labels: DataFrame) -> DataFrame:
    """(page, a, b, length): how long two labels of a page border on each other, a < b."""
    right = labels.select("page", (F.col("x") - 1).alias("x"), "y", F.col("label").alias("other"))
    down = labels.select("page", "x", (F.col("y") - 1).alias("y"), F.col("label").alias("other"))
    pairs = labels.join(right.unionByName(down), ["page", "x", "y"]).where("label <> other")
    return pairs.groupBy("page", F.least("label", "other").alias("a"), F.greatest("label", "other").alias("b")).agg(F.count("*").alias("length"))


def dominant(plates: DataFrame) -> DataFrame:
    """(page, x, y, ink): the ink of greatest coverage, the least on ties."""
    return plates.groupBy("page", "x", "y").agg(F.min_by("ink", F.struct(-F.col("cov"), F.col("ink"))).alias("ink"))


def pruned(palette: DataFrame, least: float = 0.004, large: float = 0.03, near: float = 10.0) -> DataFrame:
    """Palette (page, i, L, a, b, area) without tiny colours and those on the way between two large ones.

    A page has at most a dozen colours, so its triples are few.
    """
    big, small = palette.where(F.col("area") >= large), palette.where((F.col("area") >= least) & (F.col("area") <= large))
    p, q = (big.select("page", *(F.col(k).alias(f"{s}{k}") for k in ("i", "L", "a", "b"))) for s in "pq")
    t = small.join(p, "page").join(q, "page").where("pi < qi and i <> pi and i <> qi")
    axes = ("L", "a", "b")
    dot = sum((F.col(f"q{k}") - F.col(f"p{k}")) * (F.col(k) - F.col(f"p{k}")) for k in axes)
    length = sum(F.pow(F.col(f"q{k}") - F.col(f"p{k}"), F.lit(2)) for k in axes)
    t = t.withColumn("_t", F.least(F.greatest(dot / F.greatest(length, F.lit(1e-6)), F.lit(0.0)), F.lit(1.0)))
    off = F.sqrt(sum(F.pow(F.col(f"p{k}") + F.col("_t") * (F.col(f"q{k}") - F.col(f"p{k}")) - F.col(k), F.lit(2)) for k in axes))
    between = t.where(off < near).select("page", "i").distinct()
    return palette.where(F.col("area") >= least).join(between, ["page", "i"], "left_anti")


def nearest(pixels: DataFrame, palette: DataFrame) -> DataFrame:
    """Pixels (page, x, y, L, a, b) with `label`, the nearest of the page's palette (page, i, L, a, b), the lowest on ties.

    The palette comes as one array a page; distances are an array expression, no row is multiplied.
    """
    held = palette.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("i", "L", "a", "b"))).alias("_pal"))  # a dozen colours
    d = lambda c: F.pow(c["L"] - F.col("L"), F.lit(2)) + F.pow(c["a"] - F.col("a"), F.lit(2)) + F.pow(c["b"] - F.col("b"), F.lit(2))
    least = F.array_min(F.transform("_pal", lambda c: F.struct(d(c).alias("d"), c["i"].alias("i"))))
    return pixels.join(held, "page").withColumn("label", least["i"]).drop("_pal")


# ---------------------------------------------------------------- composed operations


def composed(plates: DataFrame, inks: DataFrame, substrate: tuple | None = None, n: float = 1.7, gain: float = 0.0) -> DataFrame:
    """(page, x, y, L, a, b) of plates (page, x, y, ink, cov 0..255) printed with inks (ink, L, a, b, opacity, rank), opaque ones first, then by rank.

    `gain` is dot gain at one half.  A pixel's inks are one array, so nothing but the pixel's own rows meet.
    """
    from platewright.functions import colour

    cov = F.col("cov") / 255.0
    grown = F.least(F.greatest(cov + gain * 4 * cov * (1 - cov), F.lit(0.0)), F.lit(1.0))
    p = plates.join(F.broadcast(inks), "ink")  # a press has a dozen inks
    ink = F.struct(F.when(F.col("opacity") >= 0.5, 0).otherwise(1).alias("o"), "rank", "ink", F.col("L").cast("double").alias("L"), F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"), F.col("opacity").cast("double").alias("opacity"), grown.alias("cov"))
    pixels = p.groupBy("page", "x", "y").agg(F.array_sort(F.collect_list(ink)).alias("_all"))
    made = colour.with_mixture(pixels, "_all", substrate or colour.PAPER, n)
    return made.select("page", "x", "y", F.col("mL").alias("L"), F.col("ma").alias("a"), F.col("mb_").alias("b"))


def textured(pixels: DataFrame, amplitude: float, cell: int = 3, seed: int = 3) -> DataFrame:
    """Adds `factor`, the fibre of a substrate: noise of a seed, the same within a cell, held in 0.85 to 1.1."""
    draw = lambda salt: (F.pmod(F.xxhash64("page", F.floor(F.col("x") / cell), F.floor(F.col("y") / cell), F.lit(seed), F.lit(salt)), F.lit(1 << 30)) + 1) / float((1 << 30) + 1)
    normal = F.sqrt(-2 * F.log(draw(0))) * F.cos(2 * math.pi * draw(1))
    return pixels.withColumn("factor", F.least(F.greatest(1 + amplitude * normal, F.lit(0.85)), F.lit(1.1)))


def separated_flat(pixels: DataFrame, palette: DataFrame, least: int) -> DataFrame:
    """Labels of pixels (page, x, y, L, a, b): the nearest palette colour, without islands, numbered without gaps."""
    return compacted(without_islands(nearest(pixels, palette).select("page", "x", "y", "label"), least))


def symmetrized(labels: DataFrame, ground: int, least: float = 0.97) -> DataFrame:
    """Labels whose content mirrors itself almost: the right half is the left one's image, where the share is high enough."""
    share = mirror_share(labels, ground)
    box = labels.where(F.col("label") != ground).groupBy("page").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    near = box.join(share.where(F.col("vertical") >= least), "page").select("page", "x0", "x1")
    d = labels.join(near, "page", "left")
    half = F.col("x0") + F.floor((F.col("x1") - F.col("x0") + 1) / 2)
    right = F.col("x0").isNotNull() & F.col("x").between(F.col("x1") - (half - F.col("x0")) + 1, F.col("x1"))
    source = d.select("page", F.col("x").alias("_sx"), "y", F.col("label").alias("_l"))
    moved = d.withColumn("_sx", F.when(right, F.col("x0") + F.col("x1") - F.col("x")).otherwise(F.col("x")))
    return moved.join(source, ["page", "_sx", "y"]).select("page", "x", "y", F.col("_l").alias("label"))


def thickened(labels: DataFrame, width: int, ground: int) -> DataFrame:
    """Details thinner than `width` grow by a pixel, over the ground only."""
    thin = opening_loss(labels.where(F.col("label") != ground), width).join(labels, ["page", "x", "y"])
    grown = thin.select("page", "label", "x", "y", _shifts(NEAR4)).select("page", (F.col("x") + F.col("d.dx")).alias("x"), (F.col("y") + F.col("d.dy")).alias("y"), F.col("label").alias("_l"))
    over = labels.where(F.col("label") == ground).join(grown, ["page", "x", "y"]).groupBy("page", "x", "y").agg(F.min("_l").alias("_l"))
    return labels.join(over, ["page", "x", "y"], "left").select("page", "x", "y", F.coalesce("_l", "label").alias("label"))


def trapped(plates: DataFrame, decisions: DataFrame, rx: int, ry: int, solid: int = 128) -> DataFrame:
    """Plates (page, ink, x, y, cov) with traps: an ink spreads under its neighbour by `decisions` (page, spread, under, fraction).

    A spread pixel is where the other ink prints, within the trap's ellipse of the spreading ink's border
    with it, and gets the greatest coverage of the spreading pixels in reach.
    """
    on = plates.where(F.col("cov") >= solid)
    parts = []
    for fraction in (1.0, 0.5):
        some = decisions.where(F.col("fraction") == fraction)
        kernel = ellipse(max(1, math.ceil(rx * fraction)) - 0.5, max(1, math.ceil(ry * fraction)) - 0.5)
        spread = on.join(some.select("page", F.col("spread").alias("ink"), "under"), ["page", "ink"])
        moved = spread.select("page", "ink", "under", "cov", "x", "y", _shifts(kernel)).select("page", "ink", "under", "cov", (F.col("x") + F.col("d.dx")).alias("x"), (F.col("y") + F.col("d.dy")).alias("y"))
        below = on.select("page", F.col("ink").alias("under"), "x", "y")
        parts.append(moved.join(below, ["page", "under", "x", "y"]).groupBy("page", "ink", "x", "y").agg(F.max("cov").alias("cov")))
    every = plates.select("page", "ink", "x", "y", "cov").unionByName(parts[0]).unionByName(parts[1])
    return every.groupBy("page", "ink", "x", "y").agg(F.max("cov").alias("cov"))


def choked(plates: DataFrame, white: str, rx: int, ry: int, solid: int = 128) -> DataFrame:
    """The white plate drawn in by an ellipse, so that it does not look out under the colours."""
    w = plates.where((F.col("ink") == white) & (F.col("cov") >= solid)).select("page", "x", "y")
    kept = eroded(w, ellipse(rx - 0.5, ry - 0.5)).withColumn("ink", F.lit(white))
    rest = plates.where(F.col("ink") != white)
    return rest.unionByName(plates.join(kept, ["page", "ink", "x", "y"], "left_semi").select(*rest.columns))


def gap_boxes(gaps: DataFrame, dpi: float, grow: int = 9, most: int | None = 40) -> DataFrame:
    """(page, x, y, w, h, mm2) of gaps (page, x, y), grown together; the first `most` of a page, which is what a report shows, or all (None)."""
    parts = components(dilated(gaps.select("page", "x", "y").distinct(), square(grow)))
    boxes = component_boxes(parts)
    own = gaps.select("page", "x", "y").distinct().join(pixels_of(parts), ["page", "x", "y"]).groupBy("page", "component").agg((F.count("*") * (25.4 / dpi) ** 2).alias("mm2"))
    ranked = boxes.join(own, ["page", "component"]).withColumn("k", F.row_number().over(Window.partitionBy("page").orderBy("y", "x")))
    shown = ranked if most is None else ranked.where(F.col("k") <= most)
    return shown.select("page", "x", "y", "w", "h", "mm2")


def text_mask(spans: DataFrame, below_pt: float) -> DataFrame:
    """Pixels (page, x, y) under spans (page, x, y, w, h, pt) that are too small to be trapped."""
    upto = lambda at, size: F.explode(F.sequence(F.col(at), F.col(at) + F.col(size) - 1))
    small = spans.where((F.col("pt") < below_pt) & (F.col("w") > 0) & (F.col("h") > 0))
    return small.select("page", "y", "h", upto("x", "w").alias("px")).select("page", F.col("px").alias("x"), upto("y", "h").alias("y")).distinct()


def local_similarity(both: DataFrame, k: int = 7, range_: float = 255.0) -> DataFrame:
    """(page, x, y, similarity) of whole k by k windows of two rasters (page, x, y, value, other) of whole numbers."""
    p, q = F.col("value").cast("long"), F.col("other").cast("long")
    w = windows.windowed(both.select("page", "x", "y", "value", "other"), k // 2, {"n": (F.lit(1), F.sum), "sp": (p, F.sum), "sq": (q, F.sum), "pp": (p * p, F.sum), "qq": (q * q, F.sum), "pq": (p * q, F.sum)}).where(F.col("n") == k * k)
    return w.select("page", "x", "y", similarity(*(F.col(c) for c in ("sp", "sq", "pp", "qq", "pq")), float(k * k), range_).alias("similarity"))


def similarity(sp, sq, pp, qq, pq, n: float, range_: float = 255.0):
    """Structural similarity of a window of `n` pixels by the sums of both values and of their products, as columns or arrays."""
    c1, c2 = (0.01 * range_) ** 2, (0.03 * range_) ** 2
    mp, mq = sp / n, sq / n
    spread = lambda ab, a, b: (ab - a * b / n) / (n - 1)
    return (2 * mp * mq + c1) * (2 * spread(pq, sp, sq) + c2) / ((mp * mp + mq * mq + c1) * (spread(pp, sp, sp) + spread(qq, sq, sq) + c2))


def structural_similarity(one: DataFrame, two: DataFrame, k: int = 7, range_: float = 255.0) -> DataFrame:
    """(page, similarity): mean structural similarity of two rasters (page, x, y, value) over k by k windows; pages of different size have 0."""
    both = one.join(two.withColumnRenamed("value", "other"), ["page", "x", "y"])
    size = lambda df, name: df.groupBy("page").agg(F.struct(F.max("x"), F.max("y")).alias(name))
    sizes = size(one, "_a").join(size(two, "_b"), "page", "full")
    scored = local_similarity(both, k, range_).groupBy("page").agg(F.avg("similarity").alias("s"))
    return sizes.join(scored, "page", "left").select("page", F.when(F.col("_a") == F.col("_b"), F.coalesce("s", F.lit(1.0))).otherwise(0.0).alias("similarity"))


def local_threshold(pixels: DataFrame, k: int = 15, weight: float = 0.2, range_: float = 128.0) -> DataFrame:
    """Adds `on` by a threshold of mean and deviation of each pixel's k by k window of whole numbers."""
    v = F.col("value").cast("long")
    w = windows.windowed(pixels, k // 2, {"_n": (F.lit(1), F.sum), "_s": (v, F.sum), "_q": (v * v, F.sum)})
    mean = F.col("_s") / F.col("_n")
    deviation = F.sqrt(F.greatest(F.col("_n") * F.col("_q") - F.col("_s") * F.col("_s"), F.lit(0))) / F.col("_n")
    return w.withColumn("on", F.col("value") > mean * (1 + weight * (deviation / range_ - 1))).drop("_n", "_s", "_q")


def text_colours(spans: DataFrame, tolerance: float) -> DataFrame:
    """Spans (page, id, pt, and ink colours cr, cg, cb of the client, dr, dg, db of the design) whose colours differ, with de and severity.

    Small text loses contrast when it is sampled again, so it may differ more.
    """
    from platewright.functions import colour

    s = colour.with_lab_d65(colour.with_lab_d65(spans, "cr", "cg", "cb", "c"), "dr", "dg", "db", "d")
    s = colour.with_delta_e2000(s, ("cL", "ca", "cb_"), ("dL", "da", "db_"))
    allowed = tolerance * F.greatest(F.lit(1.0), 24.0 / F.greatest(F.col("pt"), F.lit(1.0)))
    found = F.struct(F.round("de", 1).alias("de"), F.when(F.col("de") > 3 * tolerance, "high").otherwise("medium").alias("severity"))
    # a filter would be moved below the steps of the formula, and their expressions into it
    return s.select("page", "id", F.explode(F.filter(F.array(found), lambda _: F.col("de") > allowed)).alias("f")).select("page", "id", "f.*")


def probed(plates: DataFrame, x: int, y: int, radius: int, width: int, height: int) -> DataFrame:
    """(page, inks map of percentages, total, outside): a densitometer's window, clipped to the page."""
    x0, x1, y0, y1 = max(0, x - radius), min(width, x + radius + 1), max(0, y - radius), min(height, y + radius + 1)
    pages = plates.select("page").distinct()
    if x1 <= x0 or y1 <= y0:
        return pages.select("page", F.create_map().cast("map<string,double>").alias("inks"), F.lit(0.0).alias("total"), F.lit(True).alias("outside"))
    n = (x1 - x0) * (y1 - y0)
    inside = plates.where(F.col("x").between(x0, x1 - 1) & F.col("y").between(y0, y1 - 1)).groupBy("page", F.col("ink").cast("string").alias("ink")).agg(F.round(F.sum("cov") / n / 255 * 100, 1).alias("v"))
    by = inside.groupBy("page").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("ink", "v")))).alias("inks"), F.round(F.sum("v"), 1).alias("total"))  # a page's inks
    return pages.join(by, "page", "left").select("page", F.coalesce("inks", F.create_map().cast("map<string,double>")).alias("inks"), F.coalesce("total", F.lit(0.0)).alias("total"), F.lit(False).alias("outside"))
