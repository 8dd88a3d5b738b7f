"""Byte-level BPE encoding and decoding by recursive DuckDB queries inside each partition.

The merge ranks become a table of (left id, right id, merged id); a merged token's id is its
rank.  A partition's distinct pieces become token-position rows, and a recursive query contracts
the leftmost pair of minimum rank of every piece until no piece has a pair in the table.
Decoding joins id-position rows with the vocabulary and concatenates in position order.

Defined results: a null or empty text has no tokens and decodes to the empty string; texts are
processed whole and every row gives one row; repeated rows give repeated results.  Extra columns
are carried by `encode`/`decode` only when named in `keep`, and give way to results of their name.  State per Python worker is bounded:
texts are taken in slices of some 8 MB and the piece cache is dropped when it is full.

A piece of more than LONG_PIECE bytes would need as many rounds as bytes, over as many rows; it
is merged by a heap instead, which gives the same ids in n log n steps.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from platewright.llm._text import CHUNK, FIRST_LATER, SPACES, Numbers, Ragged, rows_of, settled, slices

#: A chunk whose white space is one leading blank at most; the four control characters are white space to some.
SINGLE = re.compile(f" ?[^{SPACES}\x1c-\x1f]+")
LONG_PIECE = 512
CACHE_ENTRIES = 1_000_000
#: Pieces of one recursive query.
BATCH_PIECES = 40_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a `.tiktoken` file: base64 token and rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def merge_rows(ranks: dict[bytes, int]) -> tuple[list[int], list[int], list[int]]:
    """Every split of a token into two tokens, as (left id, right id, merged id)."""
    left, right, merged = [], [], []
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            a = ranks.get(token[:cut])
            b = ranks.get(token[cut:]) if a is not None else None
            if b is not None:
                left.append(a)
                right.append(b)
                merged.append(rank)
    return left, right, merged


#: A row per token: its position, the position and id of the next token of its piece.  Each round
#: takes a piece's least (rank, position), gives that row the merged id and drops the next row;
#: a piece without a pair in the table is done.
ENCODE_SQL = """
with recursive state(piece, pos, nxt, id, nid, done) as (
    select piece, pos, lead(pos) over w, id, lead(id) over w, false
    from start_rows window w as (partition by piece order by pos)
  union all
    (with best as materialized (
        select piece, min((m.merged << 32) | (pos << 16) | nxt) as found
        from state s join merges m on m.left_id = s.id and m.right_id = s.nid
        where not done group by piece),
    pair as materialized (
        select b.piece, found >> 32 as merged, (found >> 16) & 65535 as spot, found & 65535 as gone,
               s.nxt as beyond, s.nid as beyond_id
        from best b join state s on s.piece = b.piece and s.pos = b.found & 65535
        where not done)
    select s.piece, s.pos,
           case when s.pos = spot then beyond else s.nxt end,
           case when s.pos = spot then merged else s.id end,
           case when s.pos = spot then beyond_id when s.nxt = spot then merged else s.nid end,
           spot is null
    from state s left join pair using (piece)
    where not done and (gone is null or s.pos <> gone))
)
select piece, pos, id from state where done order by piece, pos
"""

DECODE_SQL = """
select doc, string_agg(v.bytes, '' order by pos) as bytes
from id_rows r join vocabulary v on v.id = r.id
group by doc order by doc
"""


class Codec:
    """One worker's DuckDB database with the merge table and vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memory: str = "400MB"):
        import duckdb
        import regex

        self.ranks, self.plain, self.full = ranks, regex.compile(pattern), regex.compile(settled(pattern), regex.V1)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": memory, "temp_directory": ""})
        left, right, merged = merge_rows(ranks)
        source = pa.table({"left_id": pa.array(left, pa.int64()), "right_id": pa.array(right, pa.int64()), "merged": pa.array(merged, pa.int64())})
        self.db.register("source", source)
        self.db.execute("create table merges as select * from source")
        # bytes travel as the characters U+0000 to U+00FF
        words = pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "bytes": pa.array([t.decode("latin-1") for t in ranks], pa.string())})
        self.db.register("words", words)
        self.db.execute("create table vocabulary as select * from words")
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.clear()

    def split(self, chunk: str) -> list[str]:
        """The pattern's matches in a chunk; letters beyond the first later one need the full tables."""
        return (self.plain if max(chunk) < FIRST_LATER else self.full).findall(chunk)

    def split_all(self, chunks: list[str]) -> list[list[str]]:
        """Pieces of each chunk.  Chunks without white space but a leading blank are cut together, a line feed between
        two: no match but white space goes over it."""
        out: list = [None] * len(chunks)
        plain = [i for i, c in enumerate(chunks) if max(c) < FIRST_LATER and SINGLE.fullmatch(c)]
        pieces = self.plain.findall("\n".join([chunks[i] for i in plain]))
        ends = [-1, *(at for at, p in enumerate(pieces) if p == "\n"), len(pieces)]
        if len(ends) == len(plain) + 1:  # else the pattern is of another kind and takes line feeds along
            for i, a, b in zip(plain, ends[:-1], ends[1:], strict=True):
                out[i] = pieces[a + 1 : b]
        return [self.split(c) if p is None else p for c, p in zip(chunks, out, strict=True)]

    def merge_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of tokens of the pieces, and their ids one after another."""
        sizes, out = [], []
        for at in range(0, len(pieces), BATCH_PIECES):
            part = pieces[at : at + BATCH_PIECES]
            lengths = np.array([len(p) for p in part], np.int64)
            short = lengths <= LONG_PIECE
            flat = np.frombuffer(b"".join([p for p in part if len(p) <= LONG_PIECE]), np.uint8)
            lengths = lengths[short]
            piece = np.repeat(np.flatnonzero(short).astype(np.int32), lengths)
            pos = np.arange(len(flat), dtype=np.int64) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            self.db.register("start_rows", pa.table({"piece": piece, "pos": pos, "id": self.byte_ids[flat]}))
            got = self.db.execute(ENCODE_SQL).fetchnumpy()
            self.db.unregister("start_rows")
            which, ids = got["piece"], got["id"].astype(np.uint32)
            if not short.all():
                long = [(i, self.merge_long(part[i])) for i in np.flatnonzero(~short).tolist()]
                which = np.concatenate([which, *(np.full(len(x), i, which.dtype) for i, x in long)])
                ids = np.concatenate([ids, *(np.array(x, np.uint32) for _, x in long)])
                order = np.argsort(which, kind="stable")
                which, ids = which[order], ids[order]
            sizes.append(np.bincount(which, minlength=len(part)))
            out.append(ids)
        return np.concatenate(sizes), np.concatenate(out)

    def merge_long(self, piece: bytes) -> list[int]:
        """The same contraction by a heap of (rank, position), for very long pieces."""
        ranks, n = self.ranks, len(piece)
        ends, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else n
            if i >= 0 and j < n and (r := ranks.get(piece[i : ends[j]])) is not None:
                heapq.heappush(heap, (r, i, ends[i], ends[j]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, mid, end = heapq.heappop(heap)
            j = after[i]
            if ends[i] != mid or j >= n or j != mid or ends[j] != end or after[j] == -1:
                continue
            ends[i], after[i] = end, after[j]
            if after[j] < n:
                before[after[j]] = i
            ends[j], after[j] = -1, -1
            offer(i)
            offer(before[i])
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : ends[i]]])
            i = after[i]
        return ids

    def clear(self) -> None:
        self.chunks, self.chunk_ids = Numbers(), Ragged()
        self.pieces, self.piece_ids = Numbers(), Ragged()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.chunks) > CACHE_ENTRIES:
            self.clear()
        chunks = [CHUNK.findall(t) if t else [] for t in texts]
        lengths = [len(c) for c in chunks]
        codes = pa.array(list(chain.from_iterable(chunks)), pa.large_string()).dictionary_encode()  # equal chunks are looked up once
        chunks = codes.dictionary.to_numpy(zero_copy_only=False).tolist()
        numbers = self.chunks.of(chunks)[codes.indices.to_numpy()]
        fresh, self.chunks.new = self.chunks.new, []
        if fresh:
            parts = self.split_all(fresh)
            which = self.pieces.of([p for part in parts for p in part])
            new, self.pieces.new = self.pieces.new, []
            if new:
                self.piece_ids.extend(*self.merge_pieces([p.encode() for p in new]))
            sizes, ids = self.piece_ids.gather(which)
            chunk = np.repeat(np.arange(len(fresh)), [len(p) for p in parts])
            self.chunk_ids.extend(np.bincount(chunk, sizes, len(fresh)).astype(np.int64), ids)
        sizes, ids = self.chunk_ids.gather(numbers)
        return rows_of(ids.astype("<u4", copy=False), sizes, lengths)

    def decode(self, sequences: list[bytes], budget: int = 1_500_000) -> list[bytes]:
        """Bytes of each id sequence; id rows go to DuckDB in groups of some `budget` rows."""
        out, start = [b""] * len(sequences), 0
        while start < len(sequences):
            stop, rows = start, 0
            while stop < len(sequences) and (stop == start or rows + len(sequences[stop]) // 4 <= budget):
                rows += len(sequences[stop]) // 4
                stop += 1
            counts = np.array([len(s) // 4 for s in sequences[start:stop]])
            id_rows = pa.table({"doc": np.repeat(np.arange(start, stop, dtype=np.int32), counts), "pos": np.arange(rows, dtype=np.int32), "id": np.frombuffer(b"".join(sequences[start:stop]), "<u4").astype(np.int32)})
            self.db.register("id_rows", id_rows)
            for doc, text in self.db.execute(DECODE_SQL).fetchall():
                out[doc] = text.encode("latin-1")
            self.db.unregister("id_rows")
            start = stop
        return out


def _run(df: DataFrame, work, fields: list[T.StructField], keep: list[str], column: str, ranks_path: str, pattern: str) -> DataFrame:
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))  # as large as the vocabulary file
    keep = [k for k in keep if k not in {f.name for f in fields}]
    kept = [df.schema[k] for k in keep]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in batches:
            for part in slices(batch, column):
                codec = codec or Codec(ranks.value, pattern)
                made = work(codec, part.column(column).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), *made], [*keep, *(f.name for f in fields)])

    return df.select(*keep, *([] if column in keep else [column])).mapInArrow(apply, T.StructType([*kept, *fields]))


def encode(df: DataFrame, ranks_path: str, pattern: str, column: str = "text", keep: list[str] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """`keep` columns and `ids`, the token ids as little-endian unsigned 32-bit integers (binary)."""

    def work(codec: Codec, texts: list) -> list[pa.Array]:
        return [pa.array(codec.encode(texts), pa.binary())]

    return _run(df, work, [T.StructField(ids, T.BinaryType())], list(keep), column, ranks_path, pattern)


def decode(df: DataFrame, ranks_path: str, column: str = "ids", keep: list[str] = ("doc_id",), bytes_column: str = "decoded") -> DataFrame:
    """`keep` columns and the decoded bytes of `column` as written by `encode`; null ids decode to nothing."""

    def work(codec: Codec, rows: list) -> list[pa.Array]:
        return [pa.array(codec.decode([r or b"" for r in rows]), pa.binary())]

    return _run(df, work, [T.StructField(bytes_column, T.BinaryType())], list(keep), column, ranks_path, "x")


def round_trip(df: DataFrame, ranks_path: str, pattern: str, column: str = "text", keep: list[str] = ("doc_id",)) -> DataFrame:
    """Encode and decode in one pass; gives the token count and digests of ids and decoded bytes."""
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]

    def work(codec: Codec, texts: list) -> list[pa.Array]:
        ids = codec.encode(texts)
        decoded = codec.decode(ids)
        digest = lambda rows: pa.array([hashlib.sha256(r).hexdigest() for r in rows], pa.string())
        return [pa.array([len(r) // 4 for r in ids], pa.int64()), digest(ids), digest(decoded)]

    return _run(df, work, fields, list(keep), column, ranks_path, pattern)
