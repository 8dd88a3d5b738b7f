"""Token counts of fields or sections by offset-mapped attribution.

A whole document is encoded once; each token has a character span, and spans are joined with the
section intervals of the document.  A token that crosses a boundary goes to the section that holds
most of its characters, and of equal shares to the earlier one.  A token of which no section holds
a character is counted as `outside`.  A token that is part of a character's bytes has that
character's span.

Defined results: a null or empty text has no tokens; a document without sections counts all its
tokens as outside; sections must not overlap (they may touch, be empty, or leave gaps), and an
empty or null-bounded one gets no token.  Whole texts are encoded, rows are never dropped; repeated
rows and null ids are counted like others, an empty table gives no rows, and columns but the id,
the text and the sections are not looked at.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewright.llm._text import CHUNK, FIRST_LATER, Pieces, settled, slices

CACHE_ENTRIES = 1_000_000


class Spans:
    """Token spans of texts; each distinct chunk and piece is encoded once (see `_text`)."""

    def __init__(self, serialized: str, pattern: str):
        from tokenizers import Tokenizer

        self.pieces = Pieces(Tokenizer.from_str(serialized))
        self.plain, self.full = regex.compile(pattern), regex.compile(settled(pattern), regex.V1)
        self.cache: dict[str, bytes] = {}
        self.known: dict[str, np.ndarray] = {}

    def learn(self, pieces: list[str]) -> None:
        """Keep each piece's token spans in characters."""
        for at in range(0, len(pieces), 20_000):
            part = pieces[at : at + 20_000]
            _, which, places = self.pieces(part)
            sizes = np.array([len(p.encode()) for p in part], np.int64)
            origin = np.cumsum(sizes + 1) - sizes - 1
            which = np.array(which, np.int64)
            spans = np.array(places, np.int64).reshape(-1, 2) - origin[which][:, None]  # in bytes
            ends = np.cumsum(np.bincount(which, minlength=len(part))).tolist()
            begin = 0
            for p, size, end in zip(part, sizes.tolist(), ends, strict=True):
                own = spans[begin:end]
                if size != len(p):  # a token within a character has that character's span
                    lead = np.cumsum((np.frombuffer(p.encode(), np.uint8) & 0xC0) != 0x80)
                    own = np.stack([lead[own[:, 0]] - 1, lead[own[:, 1] - 1]], 1)
                self.known[p] = own
                begin = end

    def chunk(self, chunk: str) -> list[str]:
        return (self.plain if max(chunk) < FIRST_LATER else self.full).findall(chunk)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all tokens, counted through the joined texts, and tokens of each text."""
        chunks = [CHUNK.findall(t) if t else [] for t in texts]
        new = set().union(*chunks)
        if len(self.cache) + len(new) > CACHE_ENTRIES:
            self.cache.clear()
            self.known.clear()
        fresh = {c: self.chunk(c) for c in new if c not in self.cache}
        self.learn([p for p in set().union(*fresh.values()) if p not in self.known])
        for c, parts in fresh.items():
            if len(parts) == 1:
                self.cache[c] = self.known[c].astype("<u4").tobytes()
            else:
                at, out = 0, []
                for p in parts:
                    out.append(self.known[p] + at)
                    at += len(p)
                self.cache[c] = np.concatenate(out).astype("<u4").tobytes()
        flat = [c for doc in chunks for c in doc]
        parts = [self.cache[c] for c in flat]
        counts = np.fromiter(map(len, parts), np.int64, len(parts)) >> 3
        begins = np.cumsum([0, *map(len, flat)])[:-1]
        spans = np.frombuffer(b"".join(parts), "<u4").reshape(-1, 2).astype(np.int64) + np.repeat(begins, counts)[:, None]
        per_text = np.add.reduceat(np.append(counts, 0), np.cumsum([0, *(len(c) for c in chunks)])[:-1]) if texts else np.zeros(0, np.int64)
        return spans[:, 0], spans[:, 1], np.where([len(c) > 0 for c in chunks], per_text, 0)


def attribute(starts: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, int]:
    """Section of each token span, -1 for none, and how many spans cross a boundary.

    Sections [low, high) are in order and do not overlap.
    """
    if not len(low):
        return np.full(len(starts), -1), 0
    first = np.searchsorted(high, starts, "right")  # the first section that ends beyond the start
    last = np.searchsorted(low, ends, "left") - 1  # the last that begins before the end
    touched = last - first + 1
    out = np.where(touched > 0, first, -1)
    inside = (touched == 1) & (low[np.minimum(first, len(low) - 1)] <= starts) & (high[np.minimum(first, len(low) - 1)] >= ends)
    for t in np.flatnonzero(touched > 1).tolist():
        held = range(first[t], last[t] + 1)
        shares = [min(ends[t], high[k]) - max(starts[t], low[k]) for k in held]
        out[t] = held[int(np.argmax(shares))]
    return out, int(((touched > 0) & ~inside).sum())


def line_bounds(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of a text's lines, their line feeds included."""
    ends = np.flatnonzero(np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4") == 10) + 1
    return np.append(0, ends), np.append(ends, len(text or "") + 1)


def count_tokens(df: DataFrame, tokenizer_path: str, pattern: str, sections: str | None = "sections", key: str = "doc_id", column: str = "text") -> DataFrame:
    """Token counts by section.

    `sections` is an array of struct<start, end> in characters; None takes each line for a section.  Returns key, n_tokens, n_sections,
    section_tokens (array, in the order of `sections`), n_crossing and n_outside.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        serialized = df.sparkSession.sparkContext.broadcast(f.read())  # as large as the vocabulary file
    bounds = lambda name: F.transform(F.coalesce(F.col(sections), F.array()), lambda s: s[name].cast("long")).alias(f"_{name}")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one task has one core
        spans = None
        for batch in batches:
            for part in slices(batch, column):
                spans = spans or Spans(serialized.value, pattern)
                texts = part.column(column).to_pylist()
                starts, ends, per_text = spans(texts)
                tokens = np.cumsum([0, *per_text]).tolist()
                origin, rows = 0, []
                given = map(line_bounds, texts) if sections is None else zip(part.column("_start").to_pylist(), part.column("_end").to_pylist(), strict=True)
                for i, (text, (low, high)) in enumerate(zip(texts, given, strict=True)):
                    a, b = (low, high) if sections is None else (np.array([-1 if v is None else v for v in x], np.int64) for x in (low, high))
                    order = np.flatnonzero((a < b) & (a >= 0))
                    order = order[np.argsort(a[order], kind="stable")]
                    own = slice(tokens[i], tokens[i + 1])
                    where, crossing = attribute(starts[own] - origin, ends[own] - origin, a[order], b[order])
                    counts = np.zeros(len(a), np.int64)
                    counts[order] = np.bincount(where[where >= 0], minlength=len(order))
                    rows.append((int(per_text[i]), len(a), counts, crossing, int((where < 0).sum())))
                    origin += len(text or "")
                n, k, c, x, o = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(c, pa.list_(pa.int64())), pa.array(x, pa.int64()), pa.array(o, pa.int64())], [key, "n_tokens", "n_sections", "section_tokens", "n_crossing", "n_outside"])

    return df.select(key, column, *([] if sections is None else [bounds("start"), bounds("end")])).mapInArrow(apply, f"`{key}` {df.schema[key].dataType.simpleString()}, n_tokens long, n_sections long, section_tokens array<long>, n_crossing long, n_outside long")


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))
def line_sections(text: pd.Series) -> pd.Series:
    """A section for each line of `text`, its line feed included."""

    def sections(t: str | None) -> list[dict[str, int]]:
        ends = np.cumsum([len(line) + 1 for line in (t or "").split("\n")]).tolist()
        return [{"start": a, "end": b} for a, b in zip([0, *ends], ends, strict=False)]

    return text.map(sections, na_action=None)
