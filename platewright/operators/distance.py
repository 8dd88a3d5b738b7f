"""Exact distance transform: the nearest seed of every pixel, in one pass by columns and one by rows.

The square of a distance is a sum over the axes.  The first pass gives every column with seeds the
nearest of its own seeds at each height; the second takes along every row the lower envelope of the
parabolas that stand on these.  The parabola that is lowest at a place never lies left of that of a
place before, so the envelope is found by halving: the middle place of each stretch, then both sides,
for all rows of a batch at a time.

Results are exact for pages of any form: no rounds, no greatest radius.  Of seeds that are equally
near the one with the least label counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewright.operators.lines import along


def lower_envelope(x: np.ndarray, line: np.ndarray, at: np.ndarray, height: np.ndarray, own: np.ndarray, unit: int = 1) -> np.ndarray:
    """Least `unit * (x - at)^2 + height` over the parabolas of each place's line, -1 where the line has none.

    Places (x, line) and parabolas (at, height, own line) are sorted by line and x.
    """
    out = np.full(len(x), -1, np.int64)
    lines = np.unique(line)
    low, high = np.searchsorted(line, lines), np.searchsorted(line, lines, "right")
    first, last = np.searchsorted(own, lines), np.searchsorted(own, lines, "right")
    some = first < last
    low, high, first, last = low[some], high[some], first[some], last[some]
    while len(low):
        middle, sizes = (low + high) // 2, last - first
        starts = np.cumsum(sizes) - sizes
        stretch = np.repeat(np.arange(len(low)), sizes)
        each = np.arange(len(stretch)) + np.repeat(first - starts, sizes)
        values = unit * (x[middle][stretch] - at[each]) ** 2 + height[each]
        least = np.minimum.reduceat(values, starts)
        out[middle] = least
        found = np.flatnonzero(values == least[stretch])
        lowest = each[found[np.unique(stretch[found], return_index=True)[1]]]
        low, high, first, last = np.concatenate([low, middle + 1]), np.concatenate([middle, high]), np.concatenate([first, lowest]), np.concatenate([lowest + 1, last])
        some = low < high
        low, high, first, last = low[some], high[some], first[some], last[some]
    return out


def _by_columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page, x, y, square, label) of each column at the heights that are asked for."""
    for batch in batches:
        for page, x, seeds, heights in zip(*(batch.column(c).to_pylist() for c in ("page", "x", "seeds", "heights")), strict=True):
            y, label = np.array([s["y"] for s in seeds], np.int64), np.array([s["label"] for s in seeds], np.int64)
            asked = np.array(heights, np.int64)
            above = np.maximum(np.searchsorted(y, asked, "right") - 1, 0)
            below = np.minimum(np.searchsorted(y, asked), len(y) - 1)
            up, down = (asked - y[above]) ** 2, (asked - y[below]) ** 2
            square = np.minimum(up, down)
            most = np.iinfo(np.int64).max
            chosen = np.minimum(np.where(up == square, label[above], most), np.where(down == square, label[below], most))
            n = len(asked)
            yield pa.RecordBatch.from_arrays([pa.array([page] * n, batch.schema.field("page").type), pa.array(np.full(n, x)), pa.array(asked), pa.array(square), pa.array(chosen)], ["page", "x", "y", "square", "label"])


def nearest_seeds(places: DataFrame, seeds: DataFrame) -> DataFrame:
    """(page, x, y, label, square) of places (page, x, y): label and squared distance of the nearest seed (page, x, y, label); null on pages without seeds."""
    whole = [F.col(c).cast("long").alias(c) for c in ("x", "y")]
    targets = places.select("page", *whole).distinct()
    marks = seeds.select("page", *whole, F.col("label").cast("long").alias("label")).where(F.col("label").isNotNull()).groupBy("page", "x", "y").agg(F.min("label").alias("label"))
    heights = targets.groupBy("page").agg(F.array_sort(F.collect_set("y")).alias("heights"))  # the rows of a page
    columns = marks.groupBy("page", "x").agg(F.array_sort(F.collect_list(F.struct("y", "label"))).alias("seeds")).join(heights, "page").repartition("page", "x")
    kind = dict(targets.dtypes)["page"]
    found = columns.select("page", "x", "seeds", "heights").mapInArrow(_by_columns, f"page {kind}, x long, y long, square long, label long")

    def by_rows(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        line = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, table.num_rows)))
        x, square = table.column("x").to_numpy(), table.column("square").combine_chunks()
        stands = ~np.asarray(square.is_null())
        labels, codes = np.unique(table.column("label").combine_chunks().fill_null(0).to_numpy()[stands], return_inverse=True)
        unit = len(labels) + 1
        height = square.fill_null(0).to_numpy()[stands] * unit + codes
        best = lower_envelope(x[~stands], line[~stands], x[stands], height, line[stands], unit)
        none = best < 0
        label = labels[np.where(none, 0, best % unit)] if len(labels) else np.zeros(len(best), np.int64)
        own = table.filter(pa.array(~stands))
        return pa.RecordBatch.from_arrays([own.column("page").combine_chunks(), own.column("x").combine_chunks(), own.column("y").combine_chunks(), pa.array(label, mask=none), pa.array(best // unit, mask=none)], ["page", "x", "y", "label", "square"])

    both = found.select("page", "x", "y", "square", "label").unionByName(targets.select("page", "x", "y", F.lit(None).cast("long").alias("square"), F.lit(None).cast("long").alias("label")))
    return along(both, ["page", "y"], ["x"], by_rows, f"page {kind}, x long, y long, label long, square long")


def depths(mask: DataFrame, keys: tuple[str, ...] = ("page",)) -> DataFrame:
    """(keys, x, y, square): squared distance of a mask's pixels to the nearest place that is not in it, beyond the page too.

    Each column's unbroken runs give a pixel the distance to their ends; within a row's unbroken run and
    the places at its ends the parabolas that stand on these distances hold the least one.
    """
    kinds = ", ".join(f"`{k}` {dict(mask.dtypes)[k]}" for k in keys)

    def run_ends(table: pa.Table, starts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each row its run's number, first and last place."""
        begins = np.ones(len(at), bool)
        begins[1:] = at[1:] != at[:-1] + 1
        begins[starts] = True
        first = np.flatnonzero(begins)
        run = np.cumsum(begins) - 1
        return run, at[first][run], at[np.append(first[1:], len(at)) - 1][run]

    def by_columns(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        y = table.column("y").to_numpy()
        new = np.ones(len(y), bool)
        new[1:] = y[1:] != y[:-1]
        new[starts] = True
        if not new.all():  # pixels given twice
            starts, table, y = (np.cumsum(new) - 1)[starts], table.filter(pa.array(new)).combine_chunks(), y[new]
        _, first, last = run_ends(table, starts, y)
        return pa.RecordBatch.from_arrays([*(table.column(k).combine_chunks() for k in (*keys, "x", "y")), pa.array(np.minimum(y - first, last - y) + 1)], [*keys, "x", "y", "far"])

    def by_rows(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        x, far = table.column("x").to_numpy(), table.column("far").to_numpy()
        run, first, last = run_ends(table, starts, x)
        begin = np.flatnonzero(np.append(True, run[1:] != run[:-1])) if len(run) else run
        own = np.concatenate([run, run[begin], run[begin]])
        at = np.concatenate([x, first[begin] - 1, last[begin] + 1])
        height = np.concatenate([far * far, np.zeros(2 * len(begin), np.int64)])
        order = np.lexsort((at, own))
        square = lower_envelope(x, run, at[order], height[order], own[order])
        return pa.RecordBatch.from_arrays([*(table.column(k).combine_chunks() for k in (*keys, "x", "y")), pa.array(square)], [*keys, "x", "y", "square"])

    whole = mask.select(*keys, *(F.col(c).cast("long").alias(c) for c in ("x", "y")))
    found = along(whole, [*keys, "x"], ["y"], by_columns, f"{kinds}, x long, y long, far long")
    return along(found, [*keys, "y"], ["x"], by_rows, f"{kinds}, x long, y long, square long")
