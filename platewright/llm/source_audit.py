r"""Audit of how sources of a language diverge in their terms, by mergeable radix tries.

1. Partitions count terms, slice by slice in byte order, in byte tries, one for each language: a leaf holds the documents of the
   term and a counter for each source.  Texts come as UTF-8; bytes of letters and of characters
   beyond ASCII make terms, capitals A-Z made small.  A trie of TRIE_LEAVES leaves is written out in
   byte order and begun anew.
2. Leaves meet by ranges of prefixes: rows are dealt by ranges of (language, term) and sorted, so that
   a range arrives as the traversal of its merged trie, and equal neighbours' counters are added.
   Terms in fewer than `least` documents of the language go.
3. The kept terms are traversed in UTF-8 order.  Each (language, source) group has the share
   p = 1 + floor(10^9 (count + 1) / (N + V)) of each kept term, N its count of kept terms and V their
   number; the language has its own share likewise.  The divergence of p from q is
   floor((p - q)^2 / q).  A traversal adds up the divergences of all pairs of sources, a row of the
   result each, and keeps each group's best candidates; both are merged in a last step.

Defined results: null text, language and source are the empty string; repeated rows are counted each;
a language without kept terms has pairs of value 0 and no terms; an empty table gives no rows; other
columns are not looked at.  Values are exact whole numbers.

The names and sums of the groups are broadcast to the traversal: one row for each pair of sources is
in the result, so sources of a language are few; beyond BROADCAST_BYTES an error says so.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from itertools import batched, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platewright.llm._shared import BROADCAST_BYTES, written
from platewright.llm._text import slices

SHARES = 1_000_000_000
#: Leaves, and counters, of a worker's tries before they are written out.
TRIE_LEAVES, TRIE_COUNTERS = 400_000, 4_000_000
#: Rows of an Arrow batch of leaves; counters of a block of terms in the traversal; sums of pairs held.
LEAF_ROWS, BLOCK_CELLS, HELD_PAIRS = 20_000, 1 << 17, 1 << 21
#: Bytes of terms stand, with capitals made small; all others are blanks.
TO_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))

LEAF_SCHEMA = pa.schema([("lang", pa.string()), ("term", pa.string()), ("docs", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
LEAF_TYPES = "lang string, term string, docs long, sources array<string>, counts array<long>"


class Node:
    """A radix trie's node: the bytes of its edge, the nodes below by first byte, and its leaf."""

    __slots__ = ("edge", "below", "leaf")

    def __init__(self, edge: bytes, below: dict[int, Node] | None, leaf: list[int] | None):
        self.edge, self.below, self.leaf = edge, below, leaf


class Trie:
    """Radix trie of byte strings; a leaf is [documents, source, count, source, count, ...]."""

    def __init__(self):
        self.root, self.leaves, self.counters = Node(b"", {}, None), 0, 0
        self.path = [(b"", self.root)]  # nodes down to the last key's, with their bytes

    def leaf(self, key: bytes) -> list[int]:
        """Found from the last key's path: near keys one after another are found in few steps."""
        path = self.path
        while not key.startswith(path[-1][0]):
            path.pop()
        node, at, n = path[-1][1], len(path[-1][0]), len(key)
        while at < n:
            if node.below is None:
                node.below = {}
            child = node.below.get(key[at])
            if child is None:
                child = node.below[key[at]] = Node(key[at:], None, None)
                node = child
                path.append((key, node))
                break
            edge = child.edge
            if key.startswith(edge, at):
                node = child
                at += len(edge)
                path.append((key[:at], node))
                continue
            k = 1
            while k < len(edge) and at + k < n and edge[k] == key[at + k]:
                k += 1
            node.below[key[at]] = node = Node(edge[:k], {edge[k]: child}, None)
            child.edge = edge[k:]
            at += k
            path.append((key[:at], node))
        if node.leaf is None:
            node.leaf = [0]
            self.leaves += 1
        return node.leaf

    def add(self, terms: list[bytes], documents: list[int], counters: list[int], ends: list[int]) -> None:
        """Terms' documents and counters: source, count, source, count, ... up to each of `ends`."""
        self.counters += len(counters) // 2
        at = 0
        for term, n, end in zip(terms, documents, ends, strict=True):
            leaf = self.leaf(term)
            leaf[0] += n
            leaf += counters[at:end]
            at = end

    def __iter__(self) -> Iterator[tuple[bytes, list[int]]]:
        """Leaves in the order of their bytes."""
        stack = [(b"", self.root)]
        while stack:
            prefix, node = stack.pop()
            prefix += node.edge
            if node.leaf is not None:
                yield prefix, node.leaf
            if node.below:
                stack.extend((prefix, node.below[b]) for b in sorted(node.below, reverse=True))


def _rows(lang: str, trie: Trie, names: list[str]) -> Iterator[pa.RecordBatch]:
    """A trie's leaves as rows; counters of one source are added."""
    names = pa.array(names, pa.string())
    for found in batched(trie, LEAF_ROWS):
        terms, leaves = zip(*found, strict=True)
        sizes = np.fromiter(map(len, leaves), np.int64, len(leaves))
        flat = np.fromiter(chain.from_iterable(leaves), np.int64, int(sizes.sum()))
        starts = np.cumsum(sizes) - sizes
        docs, pairs = flat[starts], np.delete(flat, starts).reshape(-1, 2)
        keys, where = np.unique(np.repeat(np.arange(len(leaves)), sizes // 2) * len(names) + pairs[:, 0], return_inverse=True)
        counts = np.zeros(len(keys), np.int64)
        np.add.at(counts, where, pairs[:, 1])
        ends = pa.array(np.searchsorted(keys, np.arange(len(leaves) + 1) * len(names)).astype(np.int32))
        sources = pa.DictionaryArray.from_arrays(pa.array((keys % len(names)).astype(np.int32)), names).cast(pa.string())
        columns = [pa.array([lang] * len(leaves), pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(docs), pa.ListArray.from_arrays(ends, sources), pa.ListArray.from_arrays(ends, pa.array(counts))]
        yield pa.RecordBatch.from_arrays(columns, schema=LEAF_SCHEMA)


def _terms(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct terms, the number among them of every term in order, and its text's number."""
    lists = pc.ascii_split_whitespace(pa.array([t.translate(TO_TERMS) for t in texts], pa.binary()).cast(pa.string()))
    codes = pc.list_flatten(lists).dictionary_encode()
    text, code = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy()), codes.indices.to_numpy().astype(np.int64)
    empty = pc.index(codes.dictionary, "").as_py()  # of a blank at an end
    if empty >= 0:
        text, code = text[code != empty], code[code != empty]
    order = pc.sort_indices(codes.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return codes.dictionary.take(order).cast(pa.binary()), rank[code], text


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves of the tries of a partition's documents."""
    tries: dict[str, Trie] = {}
    numbers: dict[str, int] = {}

    def flushed() -> Iterator[pa.RecordBatch]:
        names = list(numbers)
        for lang in sorted(tries):
            yield from _rows(lang, tries[lang], names)
        tries.clear()
        numbers.clear()

    collects = gc.isenabled()
    gc.disable()  # tries have no cycles, and many nodes to look through
    try:
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                terms, code, text = _terms(part.column("text").cast(pa.binary()).to_pylist())
                if not len(code):
                    continue
                langs = part.column("lang").dictionary_encode()
                source = np.array([numbers.setdefault(s, len(numbers)) for s in part.column("source").to_pylist()], np.int64)
                code = code + len(terms) * langs.indices.to_numpy().astype(np.int64)[text]  # of a language's term
                seen = np.sort(code * part.num_rows + text)
                once = seen[np.append(True, seen[1:] != seen[:-1])] // part.num_rows
                found, documents = np.unique(once, return_counts=True)
                pairs, counts = np.unique(code * len(numbers) + source[text], return_counts=True)
                counters = np.stack([pairs % len(numbers), counts], axis=1).ravel()
                ends = 2 * np.searchsorted(pairs, (found + 1) * len(numbers))
                words = terms.to_numpy(zero_copy_only=False)
                for k, lang in enumerate(langs.dictionary.to_pylist()):
                    lo, hi = np.searchsorted(found, [k * len(terms), (k + 1) * len(terms)])
                    if lo < hi:
                        first = 0 if not lo else ends[lo - 1]
                        own = words[found[lo:hi] - k * len(terms)].tolist()
                        tries.setdefault(lang, Trie()).add(own, documents[lo:hi].tolist(), counters[first : ends[hi - 1]].tolist(), (ends[lo:hi] - first).tolist())
                if sum(t.leaves for t in tries.values()) >= TRIE_LEAVES or sum(t.counters for t in tries.values()) >= TRIE_COUNTERS:
                    yield from flushed()
        yield from flushed()
    finally:
        if collects:
            gc.enable()


def trie_leaves(docs: DataFrame) -> DataFrame:
    """Partial leaves (lang, term, docs, sources, counts) of `docs` (text, lang, source)."""
    columns = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")]
    return docs.select(columns).mapInArrow(_counted, LEAF_TYPES)


def _ends(table: pa.Table) -> np.ndarray:
    """Places where rows of one (lang, term) end, the last one too."""
    differs = np.zeros(table.num_rows, bool)
    differs[-1] = True
    for name in ("lang", "term"):
        codes = table.column(name).combine_chunks().dictionary_encode().indices.to_numpy()
        differs[:-1] |= codes[1:] != codes[:-1]
    return np.flatnonzero(differs) + 1


def _added(table: pa.Table, least: int) -> pa.RecordBatch:
    """Whole runs of equal (lang, term) as one leaf each, if in `least` documents."""
    ends = _ends(table)
    starts = np.append(0, ends[:-1])
    docs = np.add.reduceat(table.column("docs").to_numpy(), starts)
    lists = table.column("sources").combine_chunks()
    codes = lists.values.slice(lists.offsets[0].as_py(), lists.offsets[-1].as_py() - lists.offsets[0].as_py()).dictionary_encode()
    held = table.column("counts").combine_chunks()
    counts = held.values.to_numpy()[held.offsets[0].as_py() : held.offsets[-1].as_py()]
    sizes = np.diff(lists.offsets.to_numpy())
    run = np.repeat(np.repeat(np.arange(len(ends)), ends - starts), sizes)
    stay = (docs >= least)[run]
    keys, where = np.unique(run[stay] * len(codes.dictionary) + codes.indices.to_numpy()[stay], return_inverse=True)
    sums = np.zeros(len(keys), np.int64)
    np.add.at(sums, where, counts[stay])
    runs, sources = np.divmod(keys, max(1, len(codes.dictionary)))
    kept = np.flatnonzero(docs >= least)
    offsets = pa.array(np.append(np.searchsorted(runs, kept), len(runs)).astype(np.int32))
    first = table.select(["lang", "term"]).take(starts[kept])
    names = pa.DictionaryArray.from_arrays(pa.array(sources.astype(np.int32)), codes.dictionary).cast(pa.string())
    columns = [first.column("lang").combine_chunks(), first.column("term").combine_chunks(), pa.array(docs[kept]), pa.ListArray.from_arrays(offsets, names), pa.ListArray.from_arrays(offsets, pa.array(sums))]
    return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], schema=LEAF_SCHEMA)


def merged(leaves: DataFrame, least: int) -> DataFrame:
    """Leaves by prefix range, each (lang, term) once, in byte order; only terms in `least` documents."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = LEAF_SCHEMA.empty_table()
        for batch in batches:
            if batch.num_rows:
                table = pa.concat_tables([held, pa.Table.from_batches([batch]).cast(LEAF_SCHEMA)])
                ends = _ends(table)
                whole = int(ends[-2]) if len(ends) > 1 else 0  # the last run may go on
                if whole:
                    yield _added(table.slice(0, whole).combine_chunks(), least)
                held = table.slice(whole).combine_chunks()
        if held.num_rows:
            yield _added(held, least)

    return leaves.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(apply, LEAF_TYPES)


def shares(counts: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(SHARES (count + 1) / total) by long division in three steps of 1,000."""
    whole, rest = np.divmod(counts + 1, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digit
    return whole + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


class Traversal:
    """Sums of pairs of sources and best terms of groups of one language."""

    def __init__(self, sources: list[str], sums: np.ndarray, total: int, kept: int, ranks: int):
        self.sources, self.sums, self.total, self.kept, self.ranks = sources, sums, total, kept, ranks
        self.numbers = {s: i for i, s in enumerate(sources)}
        self.pairs: dict[int, np.ndarray] = {}
        self.best: list[list[tuple[int, str]]] = [[] for _ in sources]

    def block(self, terms: list[str], sources: pa.ListArray, counts: pa.ListArray) -> None:
        """Whole counters of some terms."""
        codes = sources.flatten().dictionary_encode()
        column = np.array([self.numbers[s] for s in codes.dictionary.to_pylist()], np.int64)[codes.indices.to_numpy()]
        row = np.repeat(np.arange(len(terms)), np.diff(sources.offsets.to_numpy()))
        table = np.zeros((len(terms), len(self.sources)), np.int64)
        table[row, column] = counts.flatten().to_numpy()
        p = shares(table, self.sums + self.kept)
        for s in range(len(self.sources)):
            found = divergence(p[:, s : s + 1], p).sum(0)
            self.pairs[s] = self.pairs[s] + found if s in self.pairs else found.astype(object)
        q = shares(table.sum(1), self.total + self.kept)
        for s in range(len(self.sources)):
            own = np.flatnonzero((table[:, s] > 0) & (p[:, s] > q))
            if len(own):
                values, best = divergence(p[own, s], q[own]), self.best[s]
                if len(best) == self.ranks:
                    more = values >= -best[-1][0]
                    own, values = own[more], values[more]
                if len(own) > self.ranks:  # ties at the edge stay
                    edge = np.partition(values, -self.ranks)[-self.ranks]
                    own, values = own[values >= edge], values[values >= edge]
                self.best[s] = sorted([*best, *((-v, terms[i]) for v, i in zip(values.tolist(), own.tolist(), strict=True))])[: self.ranks]


def _traversed(kept: DataFrame, groups: dict[str, tuple], ranks: int) -> DataFrame:
    """Partial rows (lang, source, part, item, value) of both parts."""
    held = kept.sparkSession.sparkContext.broadcast(groups)

    def rows(lang: str, walk: Traversal, terms: bool) -> list[tuple]:
        out = [(lang, walk.sources[s], "pair", walk.sources[t], str(v)) for s, row in walk.pairs.items() for t, v in enumerate(row.tolist()) if v]
        walk.pairs.clear()
        if terms:
            out += [(lang, walk.sources[s], "term", term, str(-v)) for s, best in enumerate(walk.best) for v, term in best]
        return out

    def batch(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in zip(*found, strict=True)], ["lang", "source", "part", "item", "value"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks: dict[str, Traversal] = {}
        for table in batches:
            langs = table.column("lang").to_pylist()
            at = 0
            while at < len(langs):
                lang, end = langs[at], at + 1
                if lang not in walks:
                    walks[lang] = Traversal(*held.value[lang], ranks)
                walk = walks[lang]
                most = at + max(1, BLOCK_CELLS // len(walk.sources))
                while end < len(langs) and end < most and langs[end] == lang:
                    end += 1
                part = table.slice(at, end - at)
                walk.block(part.column("term").to_pylist(), part.column("sources"), part.column("counts"))
                at = end
                if sum(len(w.pairs) * len(w.sources) for w in walks.values()) > HELD_PAIRS:
                    for name, w in walks.items():
                        if found := rows(name, w, False):
                            yield batch(found)
        for name, w in walks.items():
            if found := rows(name, w, True):
                yield batch(found)

    return kept.mapInArrow(apply, "lang string, source string, part string, item string, value string")


def audit(docs: DataFrame, least: int = 3, ranks: int = 200) -> DataFrame:
    """Rows lang, source, part ('pair', 'term'), item, value, rank of the module's divergences; terms up to rank `ranks`."""
    spark = docs.sparkSession
    leaves, _ = written(trie_leaves(docs), "leaves")
    kept, _ = written(merged(leaves, least), "terms")
    all_groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    sums = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    groups, _ = written(all_groups.join(sums, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).cast("long").alias("n")), "groups")
    size = groups.agg(F.sum(F.octet_length("source") + 120)).first()[0] or 0
    if size > BROADCAST_BYTES:
        raise ValueError(f"{size} bytes of sources: their pairs are a row each, so divide the languages by another column first")
    terms = {r.lang: r.v for r in kept.groupBy("lang").agg(F.count("*").alias("v")).collect()}
    known: dict[str, list[tuple[str, int]]] = {}
    for r in groups.collect():
        known.setdefault(r.lang, []).append((r.source, r.n))
    held = {lang: ([s for s, _ in rows], np.array([n for _, n in rows], np.int64), sum(n for _, n in rows), terms.get(lang, 0)) for lang, rows in known.items()}
    partial = _traversed(kept, held, ranks).withColumn("value", F.col("value").cast("decimal(38,0)"))
    other = groups.select("lang", F.col("source").alias("item"))
    pairs = groups.select("lang", "source").join(other, "lang").where(F.col("source") != F.col("item")).select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("decimal(38,0)").alias("value"))
    own = F.col("source") != F.col("item")
    pairs = pairs.unionByName(partial.where((F.col("part") == "pair") & own)).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    both = pairs.unionByName(partial.where(F.col("part") == "term"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item"))
    return both.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= ranks)).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank")
