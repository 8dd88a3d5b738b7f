"""Index separation by error diffusion, many pages at a time.

A pixel needs the errors of its left neighbour and of three above it, so pixels of the same x + 2 y do
not need each other.  Pages are dealt to tasks and their pixels come in the order of x + 2 y; a task
holds the last three errors of every row of the page it is at, and works a diagonal at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sixteenths of a pixel's error that go right, left below, below and right below.
RIGHT, LEFT_BELOW, BELOW, RIGHT_BELOW = 7, 3, 5, 1


class Wave:
    """Errors of a page's rows at the last three diagonals, the newest first."""

    def __init__(self, palette: np.ndarray):
        self.palette, self.errors, self.at = palette, [np.zeros((1, 3)) for _ in range(3)], None
        self.new = np.zeros((1, 3))

    def begin(self, t: int, rows: int) -> None:
        """Go on to diagonal t; rows are numbered from 1."""
        if len(self.new) <= rows:
            self.errors = [np.concatenate([e, np.zeros((rows + 1, 3))]) for e in self.errors]
            self.new = np.concatenate([self.new, np.zeros((rows + 1, 3))])
        if t != self.at:
            for _ in range(min(3, t - self.at) if self.at is not None else 0):
                self.errors = [self.new, *self.errors[:2]]
                self.new = np.zeros_like(self.new)
            self.at = t

    def diagonal(self, y: np.ndarray, colours: np.ndarray) -> np.ndarray:
        """Palette numbers of a diagonal's pixels."""
        one, two, three = self.errors
        carried = RIGHT * one[y + 1] + LEFT_BELOW * one[y] + BELOW * two[y] + RIGHT_BELOW * three[y]  # row y is at y + 1
        wanted = np.clip(colours + carried / 16, 0, 255)
        index = ((wanted[:, None, :] - self.palette[None]) ** 2).sum(-1).argmin(1)
        self.new[y + 1] = wanted - self.palette[index]
        return index


def diffused(pixels: DataFrame, palette: list[tuple[int, int, int]]) -> DataFrame:
    """(page, x, y, index) of pixels (page, x, y, r, g, b): the nearest palette colour (the first of equally near ones) to the pixel's and what its neighbours left over.

    Places are 0 or more; a missing pixel passes no error on.  A page is one task's, as each pixel waits for
    its left neighbour; a task's memory is that of a page's rows.
    """
    if not 0 < len(palette) <= 255:
        raise ValueError("a palette has 1 to 255 colours")
    table = np.array(palette, np.float64)
    kind = dict(pixels.dtypes)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, wave = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            pages, t, y = batch.column("page").to_pylist(), batch.column("t").to_numpy(), batch.column("y").to_numpy().astype(np.int64)
            colours = np.stack([batch.column(c).to_numpy().astype(np.float64) for c in "rgb"], 1)
            codes = batch.column("page").dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.append(True, (codes[1:] != codes[:-1]) | (t[1:] != t[:-1]))).tolist()
            index = np.empty(len(t), np.int64)
            for a, b in zip(cuts, [*cuts[1:], len(t)], strict=True):
                if wave is None or pages[a] != page:
                    page, wave = pages[a], Wave(table)
                wave.begin(int(t[a]), int(y[a:b].max()) + 1)
                index[a:b] = wave.diagonal(y[a:b], colours[a:b])
            yield pa.RecordBatch.from_arrays([batch.column("page"), batch.column("x"), batch.column("y"), pa.array(index, pa.int32())], ["page", "x", "y", "index"])

    ordered = pixels.select("page", "x", "y", "r", "g", "b", (F.col("x") + 2 * F.col("y")).cast("long").alias("t"))
    return ordered.repartition("page").sortWithinPartitions("page", "t", "y").mapInArrow(apply, f"page {kind['page']}, x {kind['x']}, y {kind['y']}, index int")
