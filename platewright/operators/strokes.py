"""Strokes of one width as centre lines, and lines that are nearly upright or level made so.

Centre lines come from thinning: each half step looks every pixel's eight neighbours up in a table and
takes pixels away that are not needed to keep their part together, all tiles at once, until nothing goes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewright.operators import contours, distance, raster, tiles

#: Bits of a pixel's neighbourhood: the row above from left to right, its own, the row below.
NW, N, NE, W, SELF, E, SW, S, SE = (1 << k for k in range(9))
#: The ring of neighbours from the one above on, clockwise.
RING = (N, NE, E, SE, S, SW, W, NW)


def removable(half: int) -> list[bool]:
    """For each neighbourhood whether the pixel goes in a half step: an edge pixel whose neighbours hang together without it."""
    out = []
    for code in range(512):
        on = [bool(code & b) for b in RING]
        turns = sum(not a and b for a, b in zip(on, [*on[1:], on[0]], strict=True))
        up, right, down, left = on[0], on[2], on[4], on[6]
        open_ = not (up and right and down) and not (right and down and left) if half == 0 else not (up and right and left) and not (up and down and left)
        out.append(bool(code & SELF) and 2 <= sum(on) <= 6 and turns == 1 and open_)
    return out


def _codes(on: np.ndarray) -> np.ndarray:
    """Neighbourhoods of all but the outermost places of an array of zeros and ones."""
    h, w = on.shape
    return sum(on[k // 3 : h - 2 + k // 3, k % 3 : w - 2 + k % 3] << k for k in range(9))


def _drawn(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pixels as ones of an array with a free rim, and their places in it."""
    i, j = y - y.min() + 1, x - x.min() + 1
    on = np.zeros((int(i.max()) + 2, int(j.max()) + 2), np.int16)
    on[i, j] = 1
    return on, i, j


def neighbourhoods(mask: DataFrame, bits: int = tiles.BITS) -> DataFrame:
    """(page, x, y, code) of a mask's pixels (page, x, y)."""

    def work(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        own, code = np.zeros(table.num_rows, bool), np.zeros(table.num_rows, np.int64)
        for lo, hi, tx, ty, x, y in tiles.each(table, starts):
            on, i, j = _drawn(x, y)
            own[lo:hi], code[lo:hi] = (x >> bits == tx) & (y >> bits == ty), _codes(on)[i - 1, j - 1]
        kept = table.filter(pa.array(own))
        return pa.RecordBatch.from_arrays([*(kept.column(c).combine_chunks() for c in ("page", "x", "y")), pa.array(code[own])], ["page", "x", "y", "code"])

    return tiles.tiled(mask.select("page", "x", "y"), ("page",), 1, work, f"page {dict(mask.dtypes)['page']}, x long, y long, code long", bits)


def thinned(mask: DataFrame, bits: int = tiles.BITS) -> DataFrame:
    """Centre lines (page, x, y) of a mask, a pixel wide; each part keeps its holes and its ends.

    A half step reaches a pixel far, so a tile with pixels of others up to `radius` around it takes half
    as many whole steps at a time as these allow; one without them takes all its steps at once.
    """
    radius = min(16, 1 << bits - 1)
    tables = [np.array(removable(half)) for half in (0, 1)]

    def work(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        kept, open_ = np.zeros(table.num_rows, bool), np.zeros(table.num_rows, bool)
        for lo, hi, tx, ty, x, y in tiles.each(table, starts):
            own = (x >> bits == tx) & (y >> bits == ty)
            if not own.any():
                continue
            on, i, j = _drawn(x, y)
            alone, steps, left = bool(own.all()), radius // 2, -1
            while (alone or steps) and (now := int(on.sum())) != left:
                left, steps = now, steps - 1
                for gone in tables:
                    on[1:-1, 1:-1][gone[_codes(on)]] = 0
            kept[lo:hi], open_[lo:hi] = own & (on[i, j] == 1), not alone
        rows = table.filter(pa.array(kept))
        return pa.RecordBatch.from_arrays([*(rows.column(c).combine_chunks() for c in ("page", "x", "y")), pa.array(open_[kept])], ["page", "x", "y", "open"])

    now, left = mask.select("page", "x", "y").distinct(), -1
    while True:
        made = tiles.tiled(now, ("page",), radius, work, f"page {dict(mask.dtypes)['page']}, x long, y long, open boolean", bits).checkpoint()
        count, more = made.agg(F.count("*"), F.max("open")).first()
        now = made.select("page", "x", "y")
        if not more or count == left:
            return now
        left = count


def ways(code: Column) -> Column:
    """Directions 0 to 7 (clockwise from above) in which a line goes on; a diagonal step counts if no straight one leads round it."""
    has = lambda b: code.bitwiseAND(F.lit(b)) > 0
    step = {0: has(N), 2: has(E), 4: has(S), 6: has(W), 1: has(NE) & ~has(N) & ~has(E), 3: has(SE) & ~has(S) & ~has(E), 5: has(SW) & ~has(S) & ~has(W), 7: has(NW) & ~has(N) & ~has(W)}
    return F.array_compact(F.array(*(F.when(step[k], F.lit(k)) for k in range(8))))


def centre_lines(mask: DataFrame, spread: float = 1.0, slender: float = 3.0) -> DataFrame:
    """(page, stroke, pos, x, y, width, length, closed) of the parts of a mask that are strokes of one width.

    A part is a stroke if its centre line does not branch, is `slender` times as long as wide and has
    depths that differ by `spread` pixels at most, but at its ends.  `stroke` is the place of the part's first run.
    """
    mask = mask.select("page", "x", "y").distinct().checkpoint()
    runs = raster.components(mask).withColumnRenamed("component", "stroke")
    parts = runs.select("page", "stroke", "y", F.explode(F.sequence("x0", "x1")).alias("x"))
    deep = distance.depths(mask).select("page", "x", "y", F.sqrt("square").alias("depth"))
    coded = neighbourhoods(thinned(mask)).withColumn("ways", ways(F.col("code")))
    line = coded.join(parts, ["page", "x", "y"]).join(deep, ["page", "x", "y"]).checkpoint()
    area = runs.groupBy("page", "stroke").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("area"))
    inner = F.when(F.size("ways") == 2, F.col("depth"))
    facts = line.groupBy("page", "stroke").agg(F.count("*").alias("n"), F.max(F.size("ways")).alias("most"), F.percentile(inner, F.lit(0.1)).alias("low"), F.percentile(inner, F.lit(0.9)).alias("high")).join(area, ["page", "stroke"])
    width = F.col("area") / F.col("n")
    good = facts.where((F.col("most") <= 2) & (F.col("high") - F.col("low") <= spread) & (F.col("n") >= slender * width)).select("page", "stroke", width.alias("width"))
    kept = line.join(good, ["page", "stroke"])
    # every step between two pixels in both directions, as a list to be put in order
    dx = F.element_at(F.array(*map(F.lit, (0, 1, 1, 1, 0, -1, -1, -1))), F.col("way") + 1)
    dy = F.element_at(F.array(*map(F.lit, (-1, -1, 0, 1, 1, 1, 0, -1))), F.col("way") + 1)
    number = lambda x, y, way: F.shiftleft(F.shiftleft(y.cast("long"), contours.BITS) + x.cast("long"), 3) + way
    steps = kept.select("page", "stroke", "width", "x", "y", F.explode("ways").alias("way")).withColumns({"x1": F.col("x") + dx, "y1": F.col("y") + dy, "id": number(F.col("x"), F.col("y"), F.col("way"))}).checkpoint()
    ends = kept.select("page", F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("ways").alias("_on"))
    onward = F.filter("_on", lambda k: k != F.pmod(F.col("way") + 4, F.lit(8)))
    links = steps.join(ends, ["page", "x1", "y1"]).select("page", "id", number(F.col("x1"), F.col("y1"), F.get(onward, F.lit(0))).alias("next"))
    ordered = steps.join(contours.ranked(links, 3), ["page", "id"])
    # a line runs from its first end in reading order; a ring in the direction of its first pixel's lesser step
    first = F.first("id").over(Window.partitionBy("page", "list").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    chosen = ordered.withColumn("_f", first).withColumn("_m", F.min("_f").over(Window.partitionBy("page", "stroke"))).where(F.col("_f") == F.col("_m"))
    last = chosen.where(~F.col("closed") & (F.col("pos") == F.col("length") - 1)).select("page", "stroke", F.col("length").alias("pos"), F.col("x1").alias("x"), F.col("y1").alias("y"), "width", "length", "closed")
    return chosen.select("page", "stroke", "pos", "x", "y", "width", "length", "closed").unionByName(last)


def connected(edges: DataFrame) -> DataFrame:
    """(page, node, part) of edges (page, a, b): the least node that a node is connected with."""
    both = edges.select("page", "a", "b").unionByName(edges.select("page", F.col("b").alias("a"), F.col("a").alias("b"))).checkpoint()
    state = both.groupBy("page", F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("part")).checkpoint()
    while True:
        offered = both.join(state.select("page", F.col("node").alias("b"), "part"), ["page", "b"]).groupBy("page", F.col("a").alias("node")).agg(F.min("part").alias("_o"))
        lower = state.join(offered, ["page", "node"]).select("page", "node", "part", F.least("part", "_o").alias("_l"))
        jumped = lower.join(lower.select("page", F.col("node").alias("_l"), F.col("_l").alias("_j")), ["page", "_l"], "left")
        new = jumped.select("page", "node", F.least("_l", F.coalesce("_j", "_l")).alias("_n"), "part").checkpoint()
        moved = new.where("_n <> part").take(1)
        state = new.select("page", "node", F.col("_n").alias("part"))
        if not moved:
            return state


def straightened(lines: DataFrame, degrees: float = 2.0, most: float = 1.5, shortest: float = 3.0) -> DataFrame:
    """Lines (page, line, a, b, x0, y0, x1, y1) between nodes a and b with nearly level and upright ones made so.

    Nodes that level lines join get one height, the mean by the lines' lengths; likewise for upright ones.
    Nodes of several lines stay shared.  A group of which a node would move by more than `most` stays as it is.
    """
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    d = lines.withColumns({"_len": F.hypot(dx, dy), "_turn": F.degrees(F.atan2(F.abs(dy), F.abs(dx)))})
    ends = d.select("page", F.col("a").alias("node"), F.col("x0").alias("x"), F.col("y0").alias("y")).unionByName(d.select("page", F.col("b").alias("node"), F.col("x1").alias("x"), F.col("y1").alias("y")))
    nodes = ends.groupBy("page", "node").agg(F.first("x").alias("x"), F.first("y").alias("y")).checkpoint()
    for axis, near in (("y", F.col("_turn") < degrees), ("x", F.col("_turn") > 90 - degrees)):
        tied = d.where(near & (F.col("_len") >= shortest)).select("page", "a", "b", "_len").checkpoint()
        if not tied.take(1):
            continue
        groups = connected(tied)
        weights = tied.select("page", F.col("a").alias("node"), "_len").unionByName(tied.select("page", F.col("b").alias("node"), "_len")).groupBy("page", "node").agg(F.sum("_len").alias("_w"))
        members = groups.join(nodes, ["page", "node"]).join(weights, ["page", "node"])
        group = Window.partitionBy("page", "part")
        mean = F.sum(F.col(axis) * F.col("_w")).over(group) / F.sum("_w").over(group)
        placed = members.withColumn("_to", mean).withColumn("_far", F.max(F.abs(F.col("_to") - F.col(axis))).over(group)).where(F.col("_far") <= most).select("page", "node", "_to")
        nodes = nodes.join(placed, ["page", "node"], "left").withColumn(axis, F.coalesce("_to", axis)).drop("_to").checkpoint()
    at = lambda node, x, y: nodes.select("page", F.col("node").alias(node), F.col("x").alias(x), F.col("y").alias(y))
    return lines.select("page", "line", "a", "b").join(at("a", "x0", "y0"), ["page", "a"]).join(at("b", "x1", "y1"), ["page", "b"]).select(lines.columns)
