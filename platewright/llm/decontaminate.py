r"""Benchmark decontamination by a generalised suffix automaton of the normalised test items.

Items are normalised to words (capitals A-Z made small; ASCII letters and digits and everything
beyond ASCII make words) and their word numbers form one generalised suffix automaton.  The words
of each document stream through it; every place has the longest match that ends there.  A match of
`words` words or more is an occurrence of a window of an item; an item of fewer words (not none) is
one window as a whole.  The windows that end at a place are found by the suffix links: each state
knows the state of its last `words` words and the shorter items that end in it.

Stretches of words that are in no item cannot match; only stretches of known words that are as long
as the shortest window are streamed.

Defined results: a null or empty text has no words, no hits and no spans; items that are null or
without words match nothing; an item without id gives hits and is not named; repeated items count
once for each id; repeated documents are judged each; texts are processed whole.  Extra columns are
carried and give way to results of their name.  Without items nothing is hit.

An automaton holds PART_WORDS words of items (or one longer item).  More items are dealt into parts
by hash, and documents meet one part after the other, with a table written between the parts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewright.llm._shared import written
from platewright.llm._text import slices

#: Words of items in one automaton; a state takes some 400 bytes and there are two for a word at most.
PART_WORDS = 250_000
#: Bytes of words stand, with capitals made small; all others are blanks.
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: The same characters for SQL: ASCII that is no word.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SOLID = re.compile(rb"[^ ]+")


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(TO_WORDS).split() if text else []


class Automaton:
    """Generalised suffix automaton of word sequences, with the windows that end in each state."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], words: int):
        self.words, self.numbers = words, {}
        self.next, self.link, self.length = [{}], [-1], [0]
        ends = []
        for name, item in items:
            if item:
                state, path = 0, []
                for word in item:
                    state = self._extend(state, self.numbers.setdefault(word, len(self.numbers) + 1))
                    path.append(state)
                ends.append((name, path))
        self.least = min((min(words, len(path)) for _, path in ends), default=0)
        #: The state whose class holds a state's last `words` words.
        self.window = [0] * len(self.next)
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        for v in order:
            if self.length[v] >= words:
                self.window[v] = v if self.length[self.link[v]] < words else self.window[self.link[v]]
        self.named: dict[int, set[str]] = {}
        short = set()
        for name, path in ends:
            if len(path) < words:
                at = [self._whole(path)]
                short.update(at)
            else:
                at = {self.window[v] for v in self._states(path)[words - 1 :]}
            for v in at:
                self.named.setdefault(v, set()).update([] if name is None else [name])
        #: Of each state the nearest one on its links, itself included, in which a shorter item ends.
        self.short = [0] * len(self.next) if short else None
        if short:
            for v in order:
                self.short[v] = v if v in short else self.short[self.link[v]]

    def _new(self, length: int, link: int, following: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(following)
        return len(self.next) - 1

    def _extend(self, last: int, c: int) -> int:
        """The state of the sequence of `last` and the word c."""
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def _split(self, p: int, c: int, q: int) -> int:
        k = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = k
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = k
            p = self.link[p]
        return k

    def _states(self, path: list[int]) -> list[int]:
        """The states of an item's prefixes; a later split may have moved them to a copy of the right length."""
        return [self._of_length(v, i + 1) for i, v in enumerate(path)]

    def _of_length(self, v: int, length: int) -> int:
        while self.length[self.link[v]] >= length:
            v = self.link[v]
        return v

    def _whole(self, path: list[int]) -> int:
        return self._of_length(path[-1], len(path))

    def scan(self, run: list[int], start: int, spans: list[list[int]], found: set[int]) -> int:
        """Stream known words from place `start` on; adds to the spans of hit places and the window states, gives the longest match."""
        following, link, length, window, k, short = self.next, self.link, self.length, self.window, self.words, self.short
        v = matched = most = 0
        for at, c in enumerate(run, start):
            n = following[v].get(c)
            while n is None:
                v = link[v]
                matched = length[v]
                n = following[v].get(c)
            v, matched = n, matched + 1
            low = at + 1
            if matched >= k:
                low, most = at + 1 - k, max(most, matched)
                found.add(window[v])
            elif short:
                u = short[v]
                if u == v and matched < length[v]:
                    u = short[link[v]] if link[v] > 0 else 0
                low, most = at + 1 - length[u], max(most, length[u])
            if short:
                u = short[v] if matched == length[v] or short[v] != v else short[link[v]] if link[v] > 0 else 0
                while u > 0:
                    found.add(u)
                    u = short[link[u]] if link[u] > 0 else 0
            if low <= at:
                while spans and spans[-1][0] >= low:
                    spans.pop()
                if spans and spans[-1][1] >= low:
                    spans[-1][1] = at + 1
                else:
                    spans.append([low, at + 1])
        return most

    def __call__(self, words: list[bytes]) -> tuple[list[list[int]], set[str], int]:
        """Spans of hit words, the items named, and the longest match that holds a window."""
        spans, found, most = [], set(), 0
        if self.least and len(words) >= self.least:
            ids = np.fromiter(map(self.numbers.get, words, repeat(0)), np.int32, len(words))
            gaps = np.concatenate([[-1], np.flatnonzero(ids == 0), [len(ids)]])
            for i in np.flatnonzero(np.diff(gaps) > self.least).tolist():
                a, b = int(gaps[i]) + 1, int(gaps[i + 1])
                most = max(most, self.scan(ids[a:b].tolist(), a, spans, found))
        return spans, set().union(*(self.named.get(v, ()) for v in found)), most


def joined(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    """The union of two lists of spans, as spans that do not touch."""
    out: list[list[int]] = []
    for low, high in sorted([*a, *b]):
        if out and out[-1][1] >= low:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return out


def in_characters(text: str, spans: list[list[int]]) -> list[dict[str, int]]:
    """Spans of words as spans of characters, from the first word's start to the last word's end."""
    raw = text.encode()
    places = np.array([m.span() for m in SOLID.finditer(raw.translate(TO_WORDS))])
    lead = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    return [{"start": int(lead[places[a, 0]]) - 1, "end": int(lead[places[b - 1, 1] - 1])} for a, b in spans]


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_FIELDS = [("n_words", pa.int64(), "long"), ("longest", pa.int64(), "long"), ("_hit", pa.list_(pa.list_(pa.int64())), "array<array<bigint>>"), ("_items", pa.list_(pa.string()), "array<string>"), ("spans", _SPAN, "array<struct<start:bigint,end:bigint>>")]
_built: dict[bytes, Automaton] = {}


def _automaton(rows: list[tuple[str | None, str]], words: int) -> Automaton:
    """The worker's automaton; tasks of the same part find it built."""
    key = hashlib.sha256(repr((words, rows)).encode()).digest()
    if key not in _built:
        _built.clear()
        _built[key] = Automaton([(name, words_of(text)) for name, text in rows], words)
    return _built[key]


def _scanned(docs: DataFrame, rows: list[tuple[str | None, str]], words: int, column: str) -> DataFrame:
    """`docs` with the columns of _FIELDS; those that are there from a part before are added to."""
    items = docs.sparkSession.sparkContext.broadcast(rows)
    before = "_hit" in docs.columns
    names = [n for n, _, _ in _FIELDS]
    keep = [c for c in docs.columns if c not in names]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(items.value, words)
        for batch in batches:
            for part in slices(batch, column):
                texts = part.column(column).to_pylist()
                old = zip(*(part.column(n).to_pylist() for n in ("longest", "_hit", "_items")), strict=True) if before else repeat((0, [], []))
                out = []
                for text, (longest, hit, named) in zip(texts, old, strict=False):
                    own = words_of(text)
                    spans, found, most = automaton(own)
                    spans = joined(hit, spans) if hit else spans
                    out.append((len(own), max(longest, most), spans, sorted(found.union(named)), in_characters(text, spans) if spans else []))
                columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array(list(c), kind) for c, (_, kind, _) in zip(columns, _FIELDS, strict=True))], [*keep, *names])

    schema = T.StructType([*(docs.schema[c] for c in keep), *(T._parse_datatype_string(f"{n} {kind}").fields[0] for n, _, kind in _FIELDS)])
    return docs.mapInArrow(apply, schema)


def find(docs: DataFrame, items: DataFrame, words: int = 10, column: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """`docs` with n_words, n_hit (words inside windows), longest (words of the longest match that holds a window, 0 if none),
    items (ids as strings, sorted), n_items, and spans (array of struct<start, end> in characters, of hit words next to each other)."""
    if words < 1:
        raise ValueError("a window has one word at least")
    small = items.select(F.col(item).cast("string").alias("name"), F.col(item_text).alias("text")).where(F.col("text").isNotNull())
    count = F.size(F.array_remove(F.split(F.regexp_replace(F.lower("text"), NO_WORD, " "), " "), ""))
    parts = -(-(small.agg(F.sum(count)).first()[0] or 0) // PART_WORDS) or 1
    found = docs.drop("n_words", "n_hit", "longest", "items", "n_items", "spans", "_hit", "_items")
    for k in range(parts):
        own = small if parts == 1 else small.where(F.pmod(F.xxhash64("name", "text"), F.lit(parts)) == k)
        rows = sorted({(r.name, r.text) for r in own.collect()}, key=repr)  # PART_WORDS words
        found = _scanned(found, rows, words, column)
        if k + 1 < parts:
            found, _ = written(found, "hits")
    hits = F.aggregate("_hit", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return found.select(*(c for c in found.columns if c not in {n for n, _, _ in _FIELDS}), "n_words", hits.alias("n_hit"), "longest", F.size("_items").cast("long").alias("n_items"), F.col("_items").alias("items"), "spans")


def remove(docs: DataFrame, items: DataFrame, words: int = 10, coverage: float = 0.5, column: str = "text", **names: str) -> DataFrame:
    """`docs` without the spans that hold a window; a document of which more than `coverage` of the words is hit goes whole."""
    found = find(docs, items, words, column, **names)
    text, spans = F.col(column), F.col("spans")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"]))
    ends = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(text).cast("long")))
    kept = F.array_join(F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda s: F.substring(text, s["a"].cast("int") + 1, (s["b"] - s["a"]).cast("int"))), "")
    stay = found.where(F.col("n_hit") <= F.col("n_words") * coverage)
    return stay.withColumn(column, F.when(F.size(spans) > 0, kept).otherwise(text)).select(docs.columns)
