"""Work along the lines of rasters: rows of one key, in order, as one Arrow table of whole lines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def line_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Places where another key begins, the first too."""
    differs = np.ones(table.num_rows, bool)
    if table.num_rows:
        same = np.ones(table.num_rows - 1, bool)
        for key in keys:
            codes = table.column(key).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            same &= codes[1:] == codes[:-1]
        differs[1:] = ~same
    return np.flatnonzero(differs)


def along(rows: DataFrame, keys: list[str], order: list[str], work: Callable[[pa.Table, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """`work` on tables of whole lines, each sorted by `order`, with the places where lines begin.

    One shuffle by `keys`; a task holds a batch and the line that is not yet whole, never a page.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = line_starts(pa.Table.from_batches([*held[-1:], batch]), keys)
            cut = int(starts[-1]) - (held[-1].num_rows if held else 0)
            if cut >= 0 and (held or cut):
                table = pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
                if table.num_rows:
                    yield work(table, line_starts(table, keys))
                held = []
            held.append(batch.slice(max(cut, 0)))
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            yield work(table, line_starts(table, keys))

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(apply, schema)


def folded(rows: DataFrame, keys: list[str], order: list[str], begin: Callable[[], object], step: Callable[[object, dict], list[tuple]], fields: str) -> DataFrame:
    """Rows (keys, fields) that `step(state, row)` gives for each row of a line in order; a line begins with the state of `begin`.

    A task holds one state and one batch, however long lines are.
    """
    kinds = dict(rows.dtypes)
    names = [f.split()[0] for f in fields.split(", ")]
    schema = pa_schema(rows, keys, fields)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, begin()
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if key != last:
                    last, state = key, begin()
                out += ({**dict(zip(keys, key, strict=True)), **dict(zip(names, made, strict=True))} for made in step(state, row))
            yield pa.RecordBatch.from_pylist(out, schema)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(apply, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), fields]))


def pa_schema(rows: DataFrame, keys: list[str], fields: str) -> pa.Schema:
    """Arrow's types of the keys of `rows` and of `fields`."""
    kinds = T._parse_datatype_string(fields)
    return to_arrow_schema(T.StructType([*(rows.schema[k] for k in keys), *kinds]))
