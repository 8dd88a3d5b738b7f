"""Packing token sequences by best-fit decreasing.

Overlong documents are first cut into full windows; the rests and the short documents are packed.
Packing works in groups of pieces dealt by hash (a group is one Spark partition): pieces are taken
in decreasing length, and a segment tree over remaining capacities finds the tightest open window
that still holds the piece, or opens a new one.

Defined results: a null or empty text is its end token alone; every id lies in exactly one piece;
equal texts may lie in different windows.  Ties in length go to the smaller (doc_id, start).  Rows that
repeat an id, and rows without one, are documents of their own; an empty table gives none; columns but
the id and the text are not looked at.  Long texts are tokenised whole.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewright.llm._shared import lean
from platewright.llm._text import Numbers, Pieces, Ragged, distinct_words, rows_of, slices

WINDOW = 2048
CACHE_ENTRIES = 300_000
#: Bytes of text that are tokenised at a time.
SLICE = 2 << 20
# The tokeniser's own cut of words in small letters below U+0180: letters and numbers there are fixed values.
LETTERS, NUMBERS = "a-zªµºß-öø-ÿĀ-ſ", "0-9²³¹¼-¾"
LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^ \\t-\\r\x85\xa0{LETTERS}{NUMBERS}]+|\\n")
OTHER = re.compile("[^\0-\u012f\u0131-\u017f]")
#: Pieces that the tokeniser merges at a time: of long texts each one takes longer.
MERGED_PIECES = 500
#: Pieces of one packing group; bounds a task's memory.
GROUP_PIECES = 200_000

PIECES = "length long, ids_crc32 long, doc_tokens long"


class WordTokens:
    """Ids of white-space separated words, each distinct word tokenised once.

    The tokeniser drops white space, and none of its steps looks across it, so a text's ids are
    those of its words one after another.  Words of Latin letters are put in small letters and cut
    into letters, digits and marks here, as the tokeniser does it, and only its merges are left to
    do; other words go through all its steps.
    """

    def __init__(self, serialized: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(serialized)
        self.merges = Pieces(self.tokenizer)
        self.clear()
        self.pieces, self.piece_ids = Numbers(), Ragged()

    def clear(self) -> None:
        self.words, self.word_ids = Numbers(), Ragged()

    def learn(self, words: list[str]) -> None:
        """Append the words' ids, in order."""
        latin = lambda w: not OTHER.search(w) and "<|" not in w
        plain = range(len(words)) if latin("".join(words)) else [i for i, w in enumerate(words) if latin(w)]
        found = LATIN.findall("\n".join([words[i] for i in plain]).lower())  # a line feed is a piece by itself
        line = int(self.pieces.of(["\n"])[0])
        which = self.pieces.of(found)
        new, self.pieces.new = self.pieces.new, []
        made = []
        for at in range(0, len(new), MERGED_PIECES):
            part = new[at : at + MERGED_PIECES]
            ids, of, _ = self.merges([p if p != "\n" else "a" for p in part], places=False)
            ids, of = np.array(ids, np.uint32), np.array(of, np.int64)
            sizes = np.bincount(of, minlength=len(part))
            if at == 0 and part[0] == "\n":  # numbered first
                ids, sizes[0] = ids[of != 0], 0
            made.append((sizes, ids))
        if made:
            self.piece_ids.extend(*map(np.concatenate, zip(*made, strict=True)))
        sizes, ids = self.piece_ids.gather(which)
        word = np.cumsum(which == line) if found else np.zeros(0, np.int64)
        counts = np.zeros(len(words), np.int64)
        plain = list(plain)
        counts[plain] = np.bincount(word, sizes, len(plain)).astype(np.int64) if plain else 0
        if len(plain) == len(words):
            self.word_ids.extend(counts, ids)
            return
        rows = dict(zip(plain, rows_of(ids, counts[plain], [1] * len(plain)), strict=True))
        rest = [i for i in range(len(words)) if i not in rows]
        for at in range(0, len(rest), 20_000):
            part = rest[at : at + 20_000]
            for i, e in zip(part, self.tokenizer.encode_batch_fast([words[i] for i in part], add_special_tokens=False), strict=True):
                rows[i] = np.array(e.ids, np.uint32).tobytes()
                counts[i] = len(e.ids)
        self.word_ids.extend(counts, np.frombuffer(b"".join([rows[i] for i in range(len(words))]), np.uint32))

    def __call__(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        if len(self.words) > CACHE_ENTRIES:
            self.clear()
        if len(self.pieces) > CACHE_ENTRIES:  # words share pieces, which stay longer
            self.pieces, self.piece_ids = Numbers(), Ragged()
        words, of, lengths = distinct_words(pa.array(texts, pa.string()) if isinstance(texts, list) else texts)
        numbers = self.words.of(words)[of]
        new, self.words.new = self.words.new, []
        if new:
            self.learn(new)
        sizes, ids = self.word_ids.gather(numbers)
        return rows_of(ids.astype("<u4", copy=False), sizes, lengths.tolist())


def cuts(length: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full windows, then the rest."""
    return [(s, min(window, length - s)) for s in range(0, length, window)]


def tokenize_and_cut(df: DataFrame, tokenizer_path: str, end_id: int, key: str = "doc_id", column: str = "text", window: int = WINDOW) -> DataFrame:
    """A row per piece: key, start, length, ids_crc32 and doc_tokens.  The ids themselves stay behind."""
    with open(tokenizer_path, encoding="utf-8") as f:
        serialized = df.sparkSession.sparkContext.broadcast(f.read())  # as large as the vocabulary file
    end = np.array([end_id], "<u4").tobytes()
    kind = df.schema[key].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one task has one core
        tokens = None
        for batch in batches:
            for part in slices(batch, column, SLICE):
                tokens = tokens or WordTokens(serialized.value)
                rows = []
                keys = part.column(key)
                for i, ids in enumerate(tokens(part.column(column))):
                    ids += end
                    n = len(ids) // 4
                    rows += [(i, s, m, zlib.crc32(ids[4 * s : 4 * (s + m)]), n) for s, m in cuts(n, window)]
                at, *rest = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), *(pa.array(x, pa.int64()) for x in rest)], [key, "start", "length", "ids_crc32", "doc_tokens"])

    return df.select(key, column).mapInArrow(lean(apply), f"{key} {kind}, start long, {PIECES}")


class Capacities:
    """Segment tree over remaining capacities 0..size; a leaf holds the open windows with that much room."""

    def __init__(self, size: int):
        self.base = 1 << size.bit_length()
        self.open = [0] * (2 * self.base)  # a node's number of open windows
        self.windows: list[list[int]] = [[] for _ in range(size + 1)]

    def _add(self, room: int, by: int) -> None:
        i = self.base + room
        while i:
            self.open[i] += by
            i >>= 1

    def push(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        self._add(room, 1)

    def tightest(self, need: int) -> int:
        """The least room of at least `need` that an open window has, or -1."""
        i = self.base + need
        if self.open[i]:
            return need
        while i > 1:
            if not i & 1 and self.open[i + 1]:
                i += 1
                while i < self.base:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.base
            i >>= 1
        return -1

    def pop(self, room: int) -> int:
        self._add(room, -1)
        return self.windows[room].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each piece; `lengths` must not increase."""
    tree, used = Capacities(window), []
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, n in enumerate(lengths.tolist()):
        room = tree.tightest(n) if n < window else -1
        if room < 0:
            w, room = len(used), window
            used.append(0)
        else:
            w = tree.pop(room)
        where[i], offset[i] = w, used[w]
        used[w] += n
        if room > n:
            tree.push(room - n, w)
    return where, offset


def pack(pieces: DataFrame, key: str = "doc_id", window: int = WINDOW, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds sequence_id and offset.  A full window is a sequence by itself; the rest go to hashed groups.

    A group's sequences are numbered from the group's number times 2^32.  Groups are cut in order of
    hash, so that a task that runs again packs as before.
    """
    names = pieces.columns
    hashed = F.xxhash64(key, "start")
    dealt = pieces.repartition(hashed).sortWithinPartitions(hashed, key, "start")  # without a number, small groups are merged at run time

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        held, rows = [], 0

        def packed(held: list[pa.RecordBatch]) -> pa.Table:
            nonlocal first
            t = pa.Table.from_batches(held)
            t = t.take(np.lexsort((t["start"].to_numpy(), t[key].to_numpy(zero_copy_only=False), -t["length"].to_numpy())))
            where, offset = best_fit_decreasing(t["length"].to_numpy(), window)
            t = t.append_column("sequence_id", pa.array(first + where)).append_column("offset", pa.array(offset))
            first += int(where.max()) + 1
            return t

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= group_pieces:
                yield from packed(held).to_batches()
                held, rows = [], 0
        if rows:
            yield from packed(held).to_batches()

    return dealt.mapInArrow(lean(apply), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long").select(*names, "sequence_id", "offset")


def pack_documents(df: DataFrame, tokenizer_path: str, end_id: int = 1, key: str = "doc_id", column: str = "text", window: int = WINDOW) -> DataFrame:
    """Tokenise, cut and pack `df`: a row per piece."""
    return pack(tokenize_and_cut(df, tokenizer_path, end_id, key, column, window), key, window)
