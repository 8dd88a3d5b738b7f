"""Exact self-join of documents by the Jaccard similarity of their word shingles.

A document's set holds 64-bit hashes of its distinct shingles.  Jaccard distance is a metric; the
join works in its space by pivots.  Documents without a common shingle are at distance 1 from each
other and from every pivot, so pivots cannot part them; a first exact step does:

1. Blocks.  Shingles are counted in a sketch and each set is ordered by count.  Linked sets have a
   key in common among their first ones, whatever the order is; counts only make sure that passages
   of many documents come last and join nothing.  A key is one of the shingles left if as many were
   taken off as a link needs in common, less one; or, at high similarities, two neighbours of the
   order: linked sets differ in D shingles, each parts two neighbours, so of the first 2 D + 2 some
   two are neighbours in both.  A common key gives an edge, and connected documents form a block.
   No link leaves its block.
2. Copies.  Documents with equal sets become one.  Blocks of more than REGION sets are counted and
   ordered once more, by themselves, with a counter for each of their shingles.
3. Regions.  Pivots part a block into Voronoi regions.  A set is at home in its nearest pivot's
   region and is copied into the regions of lesser pivots that are no more than twice the linking
   distance farther: by the triangle inequality a linked pair then meets in the lesser of its two
   homes.  Sets within the linking distance of a pivot are linked with it, so that pairs of two such
   need no comparison; a region that has no other sets is done.
4. Recursion.  A region is parted again in the same way: as long as it has more than REGION sets by
   Spark, where that halves the comparisons, and then within a task.  What stays large (sets that
   are all about as far from each other) is dealt in tiles, every strip of home sets with every
   strip of the region.
5. Leaves.  Pairs whose distances from the pivot don't differ by more than the linking distance are
   compared exactly.  Components of all links are the result.

Defined results: a null text, or one without words, has an empty set and is linked with nothing;
a text with fewer words than a shingle has its whole sequence as its one shingle; rows that repeat
an id and its text are one document; an id with several texts is one document for each of them;
rows without an id are a component of their own (null).  Ids are whole numbers; a document is known
by a 64-bit hash of id and text.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewright.llm import components as cc
from platewright.llm._shared import freed, lean, live, small, swept, written
from platewright.llm._text import slices

#: Sets of a region that one task compares; strips of larger regions have half as many.
REGION = 256
#: Most pivots of a region, home sets for each pivot, and levels of splitting by Spark.
PIVOTS, PER_PIVOT, LEVELS = 256, 64, 4
#: Regions of a task: home sets for each pivot, sets that are compared without one.
TASK_PER_PIVOT, LEAF = 16, 4
#: Bytes of text that are made into sets at a time.
SLICE = 2 << 20
#: Shingles for each counter of the first sketch and of a large block's own, most bits of a counter's number (16 MB of levels), counters of a row.
PER_CELL, BLOCK_PER_CELL, MOST_BITS, CHUNK_BITS = 8, 1, 24, 14
#: Rows of a batch that go to Python at once: sets are long.
BATCH_ROWS = 500
#: Keys that a task remembers with their document.
HELD_KEYS = 50_000

#: Bytes that stand for white space of ASCII (1) or not (0); masks of a block's first bytes; longest word that is hashed with all others.
BLANKS = bytes(b in b"\t\n\v\f\r " for b in range(256))
FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
LONG_WORD = 64
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

#: Makes a task's reader of batches: parts of a batch, each with its rows' sets.
Sets = Callable[[], Callable[[pa.RecordBatch], Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]]]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word between white space of ASCII starts, and a hash of its bytes, taken eight at a time."""
    space = np.ones(len(data) + 2, bool)
    space[1:-1] = np.frombuffer(data.translate(BLANKS), bool)
    edges = np.flatnonzero(space[1:] != space[:-1])
    at, left = edges[::2], edges[1::2] - edges[::2]
    long = np.flatnonzero(left > LONG_WORD)
    blocks = np.ndarray(len(data) + 1, "<u8", data + bytes(8), strides=(1,))  # the eight bytes from each place on
    hashes = mix(left.astype(np.uint64) + B)
    rows, here, size = np.arange(len(at)), at, np.minimum(left, LONG_WORD)
    while len(rows):
        hashes[rows] = mix(hashes[rows] * A + (blocks[here] & FIRST_BYTES[np.minimum(size, 8)]))
        more = np.flatnonzero(size > 8)
        rows, here, size = rows[more], here[more] + 8, size[more] - 8
    for i in long.tolist():
        hashes[i] = xxhash.xxh3_64_intdigest(data[at[i] : at[i] + left[i]])
    return at, hashes


class Shingler:
    """Sets of shingle hashes; words are split at white space of ASCII, capitals A-Z made small."""

    def __init__(self, words: int):
        self.k = words

    def __call__(self, text: str | None) -> np.ndarray:
        return self.sets([text])[0]

    def of_words(self, h: np.ndarray, k: int) -> np.ndarray:
        """Hashes of all runs of k words."""
        out = mix(h[: len(h) - k + 1] + np.uint64(k))
        for j in range(1, k):
            out = mix(out * A + h[j : len(h) - k + 1 + j])
        return out

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        """Each text's set in increasing order."""
        if not texts:
            return []
        encoded = [t.encode() if t else b"" for t in texts]
        at, h = word_hashes(b" ".join(encoded).lower())
        ends = np.searchsorted(at, np.cumsum([len(t) + 1 for t in encoded]))
        starts = np.append(0, ends[:-1])
        counts = ends - starts
        runs = self.of_words(h, self.k) if len(h) >= self.k else np.zeros(0, np.uint64)
        sizes = np.where(counts >= self.k, counts - self.k + 1, np.minimum(counts, 1))
        after = np.cumsum(sizes)
        out = np.empty(int(after[-1]), np.uint64)
        for start, end, n, to, size in zip(starts.tolist(), ends.tolist(), counts.tolist(), after.tolist(), sizes.tolist(), strict=True):
            if size:
                own = out[to - size : to]
                own[:] = runs[start : start + size] if n >= self.k else self.of_words(h[start:end], n)
                own.sort()
        first = np.append(True, out[1:] != out[:-1])[: len(out)]
        first[(after - sizes)[sizes > 0]] = True
        kept = np.append(0, np.cumsum(first))[np.append(0, after)].tolist()
        out = out[first]
        return [out[a:b] for a, b in zip(kept, kept[1:], strict=False)]


def of_texts(words: int) -> Sets:
    """Sets of the column `text`."""

    def make():
        shingle = Shingler(words)

        def parts(batch):
            for part in slices(batch, "text", SLICE):
                yield part, shingle.sets(part.column("text").to_pylist())
            pa.default_memory_pool().release_unused()  # workers stay for the next stages

        return parts

    return make


def of_lists(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The column `set`."""
    held = batch.column("set")
    values, offsets = held.values.to_numpy().view(np.uint64), held.offsets.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def of_sets() -> Sets:
    def parts(batch):
        yield batch, of_lists(batch)
        pa.default_memory_pool().release_unused()

    return lambda: parts


# ---------------------------------------------------------------- counts and first shingles


def cells(shingles: np.ndarray, block: np.ndarray | np.uint64, salt: int, bits: int) -> np.ndarray:
    """Counters of a block's shingles."""
    return (mix((shingles ^ np.uint64(salt)) + B * block) >> np.uint64(64 - bits)).astype(np.int64)


def levels_of(counts: np.ndarray) -> np.ndarray:
    """Counts as bytes in the same order: twelve for each doubling; 0 and 1 have a byte of their own."""
    return np.minimum(255, np.floor(12 * np.log2(1 + counts.astype(np.float64)) + 1e-9)).astype(np.uint8)


ONCE = int(levels_of(np.array([1]))[0])


def shingle_levels(rows: DataFrame, make: Sets, salt: int, bits: int) -> Broadcast:
    """Levels of the counts of all shingles of (block, text or set), a byte for each of 2 ** bits counters."""
    spark = rows.sparkSession
    chunk_size = 1 << CHUNK_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = make(), np.zeros(1 << bits, np.uint16)
        for batch in batches:
            for part, sets in parts(batch):
                blocks = np.repeat(part.column("block").to_numpy().astype(np.uint64), [len(s) for s in sets])
                at, n = np.unique(cells(np.concatenate(sets), blocks, salt, bits), return_counts=True)
                held[at] = np.minimum(held[at] + n, 65535)
        chunks = held.reshape(-1, chunk_size)
        for i in np.flatnonzero(chunks.any(axis=1)):
            thin = chunks[i].astype(np.uint8) if chunks[i].max() < 256 else chunks[i]
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([thin.itemsize], pa.int32()), pa.array([pa.compress(thin.tobytes(), "zstd", asbytes=True)], pa.binary())], ["chunk", "wide", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, total = None, np.zeros(chunk_size, np.int64)

        def done():
            if chunk is not None:
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([levels_of(total).tobytes()], pa.binary())], ["chunk", "levels"])

        for batch in batches:
            for at, wide, counts in zip(*(batch.column(c).to_pylist() for c in ("chunk", "wide", "counts")), strict=True):
                if at != chunk:
                    yield from done()
                    chunk, total = at, np.zeros(chunk_size, np.int64)
                total += np.frombuffer(pa.decompress(counts, chunk_size * wide, "zstd", asbytes=True), np.uint8 if wide == 1 else np.uint16)
        yield from done()

    counted = rows.mapInArrow(lean(count), "chunk int, wide int, counts binary").repartition("chunk").sortWithinPartitions("chunk")
    levels = np.zeros(1 << bits, np.uint8)
    for row in counted.mapInArrow(lean(add), "chunk int, levels binary").collect():  # 2 ** MOST_BITS bytes at most
        levels[row["chunk"] << CHUNK_BITS : (row["chunk"] + 1) << CHUNK_BITS] = np.frombuffer(row["levels"], np.uint8)
    return spark.sparkContext.broadcast(levels.tobytes())


def first_keys(shingles: np.ndarray, level: np.ndarray, percent: int) -> np.ndarray:
    """Keys of a set that others may have: each set that links with it has one of them.

    Neighbours are used where that takes at most a quarter of the shingles.
    """
    n = len(shingles)
    rank = level.astype(np.uint64) << np.uint64(56) | shingles >> np.uint64(8)
    if 8 * (100 - percent) > percent or n < 2:
        first = n - -(-percent * n // 100) + 1
        found = np.argpartition(rank, first - 1)[:first] if first < n else np.arange(n)
        return shingles[found[level[found] > ONCE]]  # a shingle that was counted once is in no other set
    first = min(n, 2 * ((100 - percent) * n // percent) + 2)
    found = np.argpartition(rank, first - 1)[:first] if first < n else np.arange(n)
    found = found[np.argsort(rank[found])]
    often = level[found] > ONCE
    return mix(shingles[found[:-1]] * A + shingles[found[1:]])[often[:-1] & often[1:]]


def candidate_edges(rows: DataFrame, make: Sets, levels: Broadcast, salt: int, bits: int, percent: int) -> DataFrame:
    """Edges (u, v) between documents of a block that have a key in common; rows (block, u, text or set)."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, level_of = make(), np.frombuffer(levels.value, np.uint8)
        copies: dict[bytes, int] = {}  # of a set's digest, its first document here
        held: dict[int, int] = {}  # of a key, its first document here
        for batch in batches:
            for part, sets in parts(batch):
                edges, out, owner = set(), [], []
                for u, block, s in zip(part.column("u").to_pylist(), part.column("block").to_pylist(), sets, strict=True):
                    if not len(s):
                        continue
                    v = copies.setdefault(xxhash.xxh3_128_digest(s.tobytes()), u)
                    if v != u:
                        edges.add((u, v))
                        continue
                    block = np.uint64(block % (1 << 64))
                    found = mix(first_keys(s, level_of[cells(s, block, salt, bits)], percent) + B * block)
                    new = []
                    for k in found.tolist():
                        v = held.get(k)
                        if v is None:
                            new.append(k)
                            if len(held) < HELD_KEYS:
                                held[k] = u
                        elif v != u:
                            edges.add((u, v))
                    out += new
                    owner += [u] * len(new)
                pairs = np.array(sorted(edges), np.int64).reshape(-1, 2)
                part_key = np.concatenate([np.array(out, np.uint64), mix(pairs[:, 0].astype(np.uint64) * A + pairs[:, 1].astype(np.uint64))]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part_key), pa.array(np.concatenate([np.array(owner, np.int64), pairs[:, 0]])), pa.array(np.concatenate([np.zeros(len(owner), np.int64), pairs[:, 1]]), mask=np.arange(len(part_key)) < len(owner))],
                    ["part", "u", "v"],
                )

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last_u = None, 0
        for batch in batches:
            known = batch.column("v").is_valid().to_numpy(zero_copy_only=False)
            key, u = batch.column("part").to_numpy()[~known], batch.column("u").to_numpy()[~known]
            pairs = np.stack([batch.column("u").to_numpy()[known], batch.column("v").drop_null().to_numpy()], axis=1)
            if len(key):
                head = np.append(True, key[1:] != key[:-1])
                starts = np.flatnonzero(head)
                least = u[starts].copy()
                if last_key is not None and key[0] == last_key:
                    least[0] = last_u
                v = least[np.cumsum(head) - 1]
                last_key, last_u = key[-1], v[-1]
                pairs = np.concatenate([pairs, np.stack([u, v], axis=1)[u != v]])
            pairs = np.unique(pairs, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

    return rows.mapInArrow(lean(keys), "part long, u long, v long").repartition("part").sortWithinPartitions("part").mapInArrow(lean(edges), "u long, v long")


def blocks_of(rows: DataFrame, make: Sets, shingles: Column, salt: int, percent: int, per_cell: int = PER_CELL) -> DataFrame:
    """(block, u) of every document that may have a link; rows (block, u, text or set).

    The sketch grows with the number of shingles (an expression of the rows) up to MOST_BITS; beyond it
    orders less well, which costs time and loses nothing.
    """
    total = rows.agg(F.sum(shingles)).first()[0] or 0
    bits = min(max(int(total // per_cell).bit_length(), CHUNK_BITS), MOST_BITS)
    levels = shingle_levels(rows.drop("u", "id"), make, salt, bits)
    found = cc.components(candidate_edges(rows, make, levels, salt, bits, percent))
    levels.destroy()
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct()).select(F.col("component").alias("block"), F.col("node").alias("u"))


# ---------------------------------------------------------------- a region within a task


def linked(a: np.ndarray, b: np.ndarray, both: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes a and b with `both` common elements link, in whole numbers."""
    return 100 * both >= percent * (a + b - both)


class Region:
    """Sets of a region; `edges` joins what links: pairs with one set at home, one far from the last pivot and one needed."""

    def __init__(self, ids: np.ndarray, sets: list[np.ndarray], percent: int):
        self.ids, self.percent, self.reach = ids, percent, (100 - percent) / 100 + 1e-9
        self.sizes = np.array([len(s) for s in sets], np.int64)
        values, inverse, shared = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        keep = shared[inverse] > 1  # values of one set cannot be common
        column = (np.cumsum(shared > 1) - 1)[inverse[keep]]
        order = np.argsort(column, kind="stable")
        self.owner, self.column = np.repeat(np.arange(len(ids)), self.sizes)[keep][order], column[order]
        self.width = int((shared > 1).sum())
        self.parent = list(range(len(ids)))
        self.compared = self.visits = 0

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def unite(self, left: np.ndarray, right: np.ndarray) -> None:
        for i, j in zip(left.tolist(), right.tolist(), strict=True):
            i, j = self.root(i), self.root(j)
            if i != j:
                if self.ids[i] > self.ids[j]:
                    i, j = j, i
                self.parent[j] = i

    def common(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Numbers of common elements."""
        n, both = len(self.ids), np.zeros((len(rows), len(columns)), np.float32)
        place, used = np.full(n, -1), np.union1d(rows, columns)
        place[used] = np.arange(len(used))
        for at in range(0, self.width, 4096):
            lo, hi = np.searchsorted(self.column, [at, at + 4096])
            owner, column = place[self.owner[lo:hi]], self.column[lo:hi] - at
            strip = np.zeros((len(used), 4096), np.float32)
            strip[owner[owner >= 0], column[owner >= 0]] = 1
            both += strip[place[rows]] @ strip[place[columns]].T
        self.compared += both.size
        return both.astype(np.int64)

    def join(self, members: np.ndarray, home: np.ndarray, far: np.ndarray, need: np.ndarray, away: np.ndarray | None = None) -> None:
        """`away`: distances from the pivot of the region above."""
        n = len(members)
        homes = np.flatnonzero(home)
        if n < 2 or not len(homes) or not far.any():
            return
        if n <= LEAF:
            self.compare(members, home, far, need, away)
            return
        pivots = homes[np.argsort(mix(self.ids[members[homes]].astype(np.uint64) + A))[: max(1, -(-len(homes) // TASK_PER_PIVOT))]]
        pivots.sort()
        both = self.common(members[pivots], members)
        a, b = self.sizes[members[pivots], None], self.sizes[None, members]
        d, near = 1 - both / (a + b - both), linked(a, b, both, self.percent)
        for p, row in zip(pivots, near, strict=True):
            self.unite(np.full(int(row.sum()), members[p]), members[row])
        nearest = d.argmin(axis=0)
        least = d[nearest, np.arange(n)]
        for k in range(len(pivots)):
            at_home = nearest == k
            visits = (nearest > k) & (d[k] <= least + 2 * self.reach)
            inside = at_home | visits
            if not (inside & ~near[k]).any() or not at_home.any():
                continue
            self.visits += int(visits.sum())
            region = members[inside]
            args = region, at_home[inside], ~near[k][inside], home[inside], d[k][inside]
            if 2 * len(region) <= n:
                self.join(*args)
            else:
                self.compare(*args)

    def compare(self, members: np.ndarray, home: np.ndarray, far: np.ndarray, need: np.ndarray, away: np.ndarray | None) -> None:
        rows = np.flatnonzero(home)
        pairs = (far[rows, None] | far[None, :]) & (need[rows, None] | need[None, :])
        if away is not None:
            pairs &= np.abs(away[rows, None] - away[None, :]) <= self.reach
        used = pairs.any(axis=1)
        if not used.any():
            return
        rows, pairs = rows[used], pairs[used]
        both = self.common(members[rows], members)
        i, j = np.nonzero(pairs & linked(self.sizes[members[rows], None], self.sizes[None, members], both, self.percent))
        self.unite(members[rows[i]], members[j])

    def edges(self, home: np.ndarray, far: np.ndarray, need: np.ndarray) -> list[tuple[int, int]]:
        """(id, least id of its group)."""
        self.join(np.arange(len(self.ids)), home, far, need)
        return [(int(self.ids[i]), int(self.ids[self.root(i)])) for i in range(len(self.ids)) if self.root(i) != i]


# ---------------------------------------------------------------- regions by Spark


def split(regions: DataFrame, percent: int) -> DataFrame:
    """Where sets go when regions of (region, u, home, size, set) are split by pivots.

    Rows (region, u, new, home, pivot, near): the set's new regions.  A set is at home with its nearest
    pivot and visits the pivots of lesser id that its window reaches; a linked pair meets at the lesser
    home.  `near` sets are linked with the pivot.
    """
    reach = 2 * (100 - percent) / 100 + 1e-9
    # pivots are the home sets of lowest hash: some one in PER_PIVOT, and the lowest in any case
    luck = F.xxhash64("u", "region", F.lit(7)).cast("double") / 2.0**64 + 0.5
    drawn = regions.where("home").select("region", "u", "size", luck.alias("luck"))
    part = F.greatest(F.lit(2.0), F.least(F.lit(float(PIVOTS)), F.col("size") / PER_PIVOT)) / F.col("size")
    lowest = drawn.groupBy("region").agg(F.min_by("u", "luck").alias("u"))
    chosen = drawn.where(F.col("luck") < part).select("region", "u").unionByName(lowest).distinct()
    pivots = regions.join(chosen, ["region", "u"]).select("region", F.col("u").alias("pivot"), F.col("set").alias("pivot_set"))
    both = F.size(F.array_intersect("set", "pivot_set"))
    sizes = F.size("set") + F.size("pivot_set")
    met = regions.join(pivots, "region").select("region", "u", "pivot", both.alias("both"), sizes.alias("sizes"))
    far = met.select("region", "u", F.struct((1 - F.col("both") / (F.col("sizes") - F.col("both"))).alias("d"), "pivot", (100 * F.col("both") >= percent * (F.col("sizes") - F.col("both"))).alias("near")).alias("p"))
    near = far.groupBy("region", "u").agg(F.collect_set("p").alias("all")).withColumn("first", F.array_min("all"))
    mine = F.filter("all", lambda p: (p["pivot"] == F.col("first.pivot")) | (p["pivot"] < F.col("first.pivot")) & (p["d"] <= F.col("first.d") + reach))
    return near.select("region", "u", "first", F.explode(mine).alias("p")).select("region", "u", F.xxhash64("region", "p.pivot").alias("new"), (F.col("p.pivot") == F.col("first.pivot")).alias("home"), F.col("p.pivot").alias("pivot"), F.col("p.near").alias("near"))


def tiles(regions: DataFrame, strip: int = REGION // 2) -> DataFrame:
    """Regions dealt as tiles: every strip of sets at home with every strip of all sets."""
    sizes = regions.groupBy("region").agg(F.ceil(F.count("*") / strip).cast("int").alias("across"), F.ceil(F.sum(F.col("home").cast("int")) / strip).cast("int").alias("down"))
    sized = regions.join(sizes, "region").where("down > 0")
    row, column = F.pmod(F.xxhash64("u", F.lit(5)), F.col("down")).cast("int"), F.pmod(F.xxhash64("u", F.lit(6)), F.col("across")).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = sized.where("home").select("*", row.alias("row"), upto("across").alias("column"))
    others = sized.withColumn("home", F.lit(False)).select("*", upto("down").alias("row"), column.alias("column"))
    return own.unionByName(others).select(F.xxhash64("region", "row", "column").alias("region"), "u", "home", "far", "need")


def leaf_edges(regions: DataFrame, percent: int) -> DataFrame:
    """Edges (u, v) of linked sets within each region of (region, u, home, far, need, set)."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[bool, bool, bool, np.ndarray]] = {}
        current = None

        def done() -> list[tuple[int, int]]:
            ids = sorted(held)
            if len(ids) < 2:
                return []
            home, far, need, sets = zip(*(held[u] for u in ids), strict=True)
            return Region(np.array(ids), list(sets), percent).edges(np.array(home), np.array(far), np.array(need))

        def batch_of(edges: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], ["u", "v"])

        for batch in batches:
            edges = []
            for region, u, home, far, need, s in zip(*(batch.column(c).to_pylist() for c in ("region", "u", "home", "far", "need")), of_lists(batch), strict=True):
                if region != current:
                    edges += done()
                    held, current = {}, region
                if u in held:
                    held[u] = held[u][0] or home, far, need, held[u][3]
                else:
                    held[u] = home, far, need, s.copy()
            yield batch_of(edges)
        yield batch_of(done())

    return regions.select("region", "u", "home", "far", "need", "set").repartition("region").sortWithinPartitions("region").mapInArrow(lean(apply), "u long, v long")


def sets_of_members(members: DataFrame, words: int) -> DataFrame:
    """(block, u, id, first, digest, set) of (block, u, id, text); a task's later documents of an equal set have its `first` document and no set."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = of_texts(words)()
        seen: dict[bytes, int] = {}
        for batch in batches:
            for part, sets in parts(batch):
                digests, firsts, kept = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], [], []
                for u, digest, s in zip(part.column("u").to_pylist(), digests, sets, strict=True):
                    kept.append(None if digest in seen else s.view(np.int64))
                    firsts.append(seen.setdefault(digest, u))
                yield pa.RecordBatch.from_arrays([part.column("block"), part.column("u"), part.column("id"), pa.array(firsts, pa.int64()), pa.array(digests, pa.binary()), pa.array(kept, pa.list_(pa.int64()))], ["block", "u", "id", "first", "digest", "set"])

    return members.mapInArrow(lean(apply), "block long, u long, id long, first long, digest binary, set array<long>")


def node_of(key: str, text: str) -> Column:
    return F.xxhash64(F.col(key).cast("long"), F.col(text))


def in_small_batches(join):
    """`join` with BATCH_ROWS rows a batch, as a batch of long sets must fit into a task's memory."""

    @functools.wraps(join)
    def joined(df: DataFrame, *args, **kwargs):
        conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = conf.get(name)
        conf.set(name, BATCH_ROWS)
        try:
            return join(df, *args, **kwargs)
        finally:
            conf.set(name, before)

    return joined


@in_small_batches
def joined_groups(df: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(node, component, chief) of every document that has a link: the least id it reaches by links, and whether it is the one of its group to stay.

    Two documents link when 100 * common shingles >= percent * all shingles of both.  `node` is
    `node_of` the document; of texts with the group's least id the one of the least node is the chief.
    """
    spark = df.sparkSession
    start = len(live())
    held = lambda table, name: written(table, name)[0]
    docs = df.where(F.col(key).isNotNull()).select(F.lit(0).cast("long").alias("block"), node_of(key, text).alias("u"), F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    letters = (F.octet_length("text") / 6).cast("long")  # a word of five letters and a blank
    blocks = held(blocks_of(docs, of_texts(words), letters, 1, percent), "blocks")
    freed(spark)
    # few rows go to the texts or sets; more of them meet in a shuffle
    members = docs.select("u", "id", "text").join(small(blocks), "u").select("block", "u", "id", "text")
    hashed = held(sets_of_members(members, words), "sets")
    kept = hashed.where("set is not null")
    named = kept.select("block", "u", "digest").distinct()
    one = named.groupBy("block", "digest").agg(F.min("u").alias("least"))
    copies = hashed.where("u <> first").select("u", F.col("first").alias("v")).unionByName(named.join(one, ["block", "digest"]).where("u <> least").select("u", F.col("least").alias("v")))
    alone = one.select(F.col("block").alias("region"), F.col("least").alias("u"), F.lit(True).alias("home"), F.lit(True).alias("far"), F.lit(True).alias("need"))
    with_sets = lambda rows: kept.select("u", "set").join(small(rows), "u")

    links, ready, level, counted, regions = [copies], [], 0, False, alone
    while True:
        sizes = regions.groupBy("region").agg(F.count("*").alias("size"), F.count_if("home").alias("homes"), F.count_if("far").alias("fars")).where("size > 1 and homes > 0 and fars > 0").drop("fars")
        sized = held(regions.join(sizes, "region"), "regions")
        ready.append(sized.where(F.col("size") <= REGION).drop("size", "homes"))
        large = sized.where(F.col("size") > REGION)
        if not large.take(1):
            break
        if not counted:
            counted = True
            finer = blocks_of(with_sets(large.select(F.col("region").alias("block"), "u")), of_sets(), F.size("set"), 2, percent, BLOCK_PER_CELL)
            regions = large.drop("region", "size", "homes").join(finer, "u").select(F.col("block").alias("region"), "u", "home", "far", "need")
            continue
        wide = large.where(F.col("homes") > 2 * PER_PIVOT)
        if level == LEVELS or not wide.take(1):
            ready.append(tiles(large.drop("size", "homes")))
            break
        moved = held(split(with_sets(wide), percent), "moved")
        links.append(moved.where("near and u <> pivot").select("u", F.col("pivot").alias("v")))
        # a split that leaves more than half of the comparisons isn't worth its copies
        cost = moved.groupBy("region", "new").agg(F.when(F.count_if(~F.col("near")) > 0, F.count("*") * F.count_if("home")).otherwise(0).alias("cost")).groupBy("region").agg(F.sum("cost").alias("cost"))
        better = large.select("region", "size", "homes").distinct().join(cost, "region").where("2 * cost < size * homes").select("region")
        ready.append(tiles(large.drop("size", "homes").join(better, "region", "left_anti")))
        parted = large.join(better, "region").select("region", "u", F.col("home").alias("need"))
        regions = parted.join(moved.select("region", "u", "new", "home", (~F.col("near")).alias("far")), ["region", "u"]).select(F.col("new").alias("region"), "u", "home", "far", "need")
        level += 1
    leaves = ready[0]
    for r in ready[1:]:
        leaves = leaves.unionByName(r)
    links.append(leaf_edges(with_sets(held(leaves, "leaves")), percent))
    found = links[0]
    for r in links[1:]:
        found = found.unionByName(r)
    groups = held(cc.components(found), "groups")
    everyone = groups.unionByName(groups.select(F.col("component").alias("node"), "component").distinct())
    # sizes of groups and of ids are known only here: a large group's least id goes to its rows by broadcast
    named = everyone.join(hashed.select(F.col("u").alias("node"), "id").distinct(), "node")
    chiefs = named.groupBy("component").agg(F.min(F.struct("id", "node")).alias("chief"), F.count("*").alias("n"))
    result, path = written(cc.joined(named.select("node", "component"), chiefs, "component", everyone.count()).select("node", F.col("chief.id").alias("component"), (F.col("node") == F.col("chief.node")).alias("chief")), "components")
    swept(spark, start, path)
    return result


def components(df: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, n_shingles and component_id of every row: the least key it reaches by links, itself included.

    Other columns of `df` are not looked at.
    """
    groups = joined_groups(df, words, percent, key, text)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = of_texts(words)()
        for batch in batches:
            for part, sets in parts(batch):
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("node"), pa.array([len(s) for s in sets], pa.int64())], ["key", "node", "n_shingles"])

    counts = df.select(F.col(key).alias("key"), node_of(key, text).alias("node"), F.col(text).alias("text")).mapInArrow(lean(apply), f"key {df.schema[key].dataType.simpleString()}, node long, n_shingles long")
    return counts.join(groups.select("node", "component"), "node", "left").select(F.col("key").alias(key), "n_shingles", F.coalesce("component", "key").alias("component_id"))


def deduplicate(df: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`df` with one document of each group of linked ones: that of the least key.

    Rows that repeat an id and its text are one document and stay or go together.
    """
    gone = joined_groups(df, words, percent, key, text).where("not chief").select("node")
    name = "node"
    while name in df.columns:
        name += "_"
    return df.join(small(gone.withColumnRenamed("node", name)), (node_of(key, text) == F.col(name)) & F.col(key).isNotNull(), "left_anti")
