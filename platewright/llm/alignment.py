r"""Alignment of two tokenizers' tokens over the bytes of a text.

Each byte of a text has a label: no token ends behind it, a token of A ends, a token of B ends, or
both do.  The labels form a string, and a regular expression scans it for spans up to each
both-label; the labels in a span count the tokens of its group.  Within a group the ends of A and B
never coincide, so its n tokens of A and m of B overlap in n + m - 1 pairs.

Both tokenizers cut a text at every blank behind a character that is no white space: A's pattern
and B's pieces hold such a blank only at their start.  A *chunk* between such cuts is therefore
tokenised and aligned by itself, each distinct one once per worker, and a text's result is that of
its chunks.

Corpus-wide counts take two passes.  The first writes each text's figures with its distinct linked
pairs of ids, and each partition's counts of texts by pair; the second looks the summed counts up.
The table of counts is bounded by the product of the vocabularies, not by the corpus; it is
broadcast in parts of PART_PAIRS rows, and a part's sums are added to the others' for each text.

Defined results: texts that are null, empty, or of which the joined token bytes of A or B differ
from blank + text have no tokens: all figures are 0 and the groups the empty string.  Texts are
processed whole; repeated rows count as texts each; an empty table gives no rows; other columns
are not looked at, but for those named in `keep`, which give way to results of their name.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewright.llm._shared import written
from platewright.llm._text import SPACES, Numbers, Ragged, byte_characters, slices

#: Distinct chunks, and their characters, that a worker keeps; pairs that it counts before it hands them on.
CACHE_ENTRIES, CACHE_CHARACTERS, HELD_PAIRS = 400_000, 32 << 20, 500_000
#: Pairs of a part of the counts: 16 bytes each.
PART_PAIRS = 1_000_000
#: A cut: a blank behind a character that is white space to neither tokenizer; a text's last character begins no chunk.
CUT = re.compile(f"(?s)(?<=[^{SPACES}\x1c-\x1f])(?= .)")
#: Labels of a byte: no end, an end of A, of B, of both.
LABELS = np.frombuffer(b"nabx", np.uint8)
SPAN = re.compile(rb"[nab]*x")


def piece_bytes(piece: str) -> bytes:
    """The bytes that a piece of B stands for."""
    byte = re.fullmatch(r"<0x([0-9A-Fa-f]{2})>", piece)
    return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()


class Aligner:
    """A worker's two tokenizers and its aligned chunks."""

    def __init__(self, a_json: str, b_model: bytes):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(a_json), SentencePieceProcessor(model_proto=b_model)
        self.a.encode_special_tokens = True
        back = {c: b for b, c in enumerate(byte_characters())}
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for entry, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(back[c] for c in entry) if all(c in back for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [piece_bytes(p) for p in pieces]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("a piece of B goes over a blank: its texts cannot be cut at blanks")
        self.a_sizes, self.b_sizes = (np.fromiter(map(len, table), np.int64, len(table)) for table in (self.a_bytes, self.b_bytes))
        # ids as text: within a group, and at the end of its A or B part
        self.texts = [np.array([[b"%d%s" % (i, end) for i in range(len(table))] for end in ends], object) for table, ends in ((self.a_bytes, (b",", b"|")), (self.b_bytes, (b",", b";")))]
        self.clear()

    def clear(self) -> None:
        self.chunks, self.pairs, self.links, self.held = Numbers(), Numbers(), Ragged(np.int32), 0
        self.figures = np.zeros((0, 3), np.int64)  # of each chunk: tokens of A and B, groups; -1: bytes differ
        self.groups: list[bytes] = []  # each group with a semicolon behind it

    def same(self, chunks: list[bytes], ids: list[list[int]], table: list[bytes]) -> list[bool] | None:
        """Whether the tokens' bytes are each chunk's; None if all are."""
        joined = lambda own: b"".join(map(table.__getitem__, own))
        if joined(itertools.chain.from_iterable(ids)) == b"".join(chunks) and all(map(len, ids)):
            return None
        return [joined(own) == c for own, c in zip(ids, chunks, strict=True)]

    def learn(self, chunks: list[str]) -> None:
        """Tokenise and align new chunks; each begins with a blank, which B's tokenizer puts there itself."""
        self.held += sum(map(len, chunks))
        a_ids = [e.ids for e in self.a.encode_batch_fast(chunks, add_special_tokens=False)]
        b_ids = self.b.encode([c[1:] for c in chunks], num_threads=1)
        raw = [c.encode() for c in chunks]
        checks = [x for x in (self.same(raw, a_ids, self.a_bytes), self.same(raw, b_ids, self.b_bytes)) if x]
        good = np.ones(len(chunks), bool)
        for x in checks:
            good &= np.array(x)
        if checks:
            a_ids, b_ids, raw = ([v for v, g in zip(values, good.tolist(), strict=True) if g] for values in (a_ids, b_ids, raw))
        figures, links, groups = self._aligned(raw, a_ids, b_ids)
        every = np.zeros((len(chunks), 3), np.int64)
        every[:, 0] = -1
        every[good] = figures
        self.figures = np.concatenate([self.figures, every])
        counts = np.where(good, every[:, 0] + every[:, 1] - every[:, 2], 0)  # a group of n and m tokens has n + m - 1 links
        self.links.extend(counts, self.pairs.of(links.tolist()))
        rest = iter(groups)
        self.groups += [next(rest) if g else b"" for g in good.tolist()]

    def _aligned(self, chunks: list[bytes], a_ids: list[list[int]], b_ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Figures of the chunks, codes of all links in order, and the chunks' groups as text."""
        chunk_ends = np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)))
        labels = np.zeros(int(chunk_ends[-1]) if len(chunks) else 0, np.uint8)
        flat, ends = [], []
        for ids, sizes, bit in ((a_ids, self.a_sizes, 1), (b_ids, self.b_sizes, 2)):
            flat.append(np.fromiter(itertools.chain.from_iterable(ids), np.int64))
            ends.append(np.cumsum(sizes[flat[-1]]) - 1)
            labels[ends[-1]] |= bit
        spans = np.fromiter((m.end() for m in SPAN.finditer(LABELS[labels].tobytes())), np.int64) - 1
        # the labels that end in a span are its tokens
        counts = [np.diff(np.searchsorted(e, spans, "right"), prepend=0) for e in ends]
        group = [np.repeat(np.arange(len(spans)), n) for n in counts]
        before = [np.cumsum(n) - n for n in counts]
        places = [np.arange(len(flat[0])) + before[1][group[0]], np.arange(len(flat[1])) + (before[0] + counts[0])[group[1]]]
        text = np.empty(len(flat[0]) + len(flat[1]), object)
        for k in range(2):
            last = np.append(group[k][1:] != group[k][:-1], True)[: len(flat[k])].astype(np.int64)
            text[places[k]] = self.texts[k][last, flat[k]]
        n = [np.fromiter(map(len, ids), np.int64, len(chunks)) for ids in (a_ids, b_ids)]
        upto, words = np.cumsum(n[0] + n[1]).tolist(), text.tolist()
        groups = [b"".join(words[x:y]) for x, y in zip([0, *upto], upto, strict=False)]
        # every end of a token closes a stretch of bytes that one token of A and one of B share
        shared = np.flatnonzero(labels)
        a_bit, b_bit = (labels[shared] & 1).astype(np.int64), (labels[shared] >> 1).astype(np.int64)
        links = flat[0][np.cumsum(a_bit) - a_bit] << 32 | flat[1][np.cumsum(b_bit) - b_bit]
        return np.stack([*n, np.diff(np.searchsorted(spans, chunk_ends), prepend=0)], 1), links, groups

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        """Numbers of the chunks of each text, none if its bytes differ."""
        if len(self.chunks) > CACHE_ENTRIES or self.held > CACHE_CHARACTERS or len(self.pairs) > 4 * HELD_PAIRS:
            self.clear()
        numbers = [self.chunks.of(CUT.split(" " + t) if t else []) for t in texts]
        fresh, self.chunks.new = self.chunks.new, []
        for at in range(0, len(fresh), 50_000):
            self.learn(fresh[at : at + 50_000])
        self.pairs.new = []
        if (self.figures[:, 0] < 0).any():
            numbers = [n[:0] if (self.figures[n, 0] < 0).any() else n for n in numbers]
        return numbers


_FIGURES = ("n_a", "n_b", "n_groups", "n_links")
_FIRST = "_row string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, _codes binary, _times binary, _pair long, _texts long"


def _linked(docs: DataFrame, a_path: str, b_path: str, keep: list[str], column: str) -> DataFrame:
    """A row for each text with its figures and distinct links (codes a << 32 | b, times), and rows of (_pair, _texts) counts."""
    with open(a_path, encoding="utf-8") as f, open(b_path, "rb") as g:
        models = docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))  # as large as the vocabulary files
    kinds = T._parse_datatype_string(_FIRST)
    schema = T.StructType([*(T.StructField(k, docs.schema[k].dataType) for k in keep), *kinds])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one task has one core
        aligner, held, partition, rows = None, {}, os.urandom(9).hex(), 0

        def handed_on(sample: pa.RecordBatch) -> pa.RecordBatch:
            codes = pa.array(np.fromiter(held.keys(), np.int64, len(held)))
            nothing = [pa.nulls(len(held), sample.schema.field(k).type) for k in keep]
            columns = [pa.nulls(len(held), pa.string()), *(pa.nulls(len(held), pa.int64()) for _ in _FIGURES), pa.nulls(len(held), pa.string()), pa.nulls(len(held), pa.binary()), pa.nulls(len(held), pa.binary())]
            out = pa.RecordBatch.from_arrays([*nothing, *columns, codes, pa.array(np.fromiter(held.values(), np.int64, len(held)))], [*keep, *kinds.names])
            held.clear()
            return out

        for batch in batches:
            for part in slices(batch, column, 2 << 20):
                aligner = aligner or Aligner(*models.value)
                numbers = aligner(part.column(column).to_pylist())
                flat = np.concatenate(numbers).astype(np.int64)
                text = np.repeat(np.arange(len(numbers)), [len(n) for n in numbers])
                sums = [np.bincount(text, aligner.figures[flat, k], len(numbers)).astype(np.int64) for k in range(3)]
                sizes, links = aligner.links.gather(flat)
                owner = np.repeat(text, sizes)
                codes = np.fromiter(aligner.pairs, np.int64, len(aligner.pairs))
                keys, times = np.unique(owner << 32 | links, return_counts=True)
                owners, kinds_of = keys >> 32, keys & 0xFFFFFFFF
                found, texts = np.unique(kinds_of, return_counts=True)
                for c, n in zip(codes[found].tolist(), texts.tolist(), strict=True):
                    held[c] = held.get(c, 0) + n
                ends = np.searchsorted(owners, np.arange(len(numbers) + 1)).tolist()
                pair, times = codes[kinds_of], times.astype(np.uint32)
                digest = [hashlib.sha256(b"".join(map(aligner.groups.__getitem__, own.tolist()))[:-1]).hexdigest() if len(own) else "" for own in numbers]
                columns = [pa.array([f"{partition}-{rows + i}" for i in range(len(numbers))]), *(pa.array(s) for s in sums), pa.array(np.bincount(owner, minlength=len(numbers)).astype(np.int64)), pa.array(digest)]
                columns += [pa.array([pair[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)], pa.binary()), pa.array([times[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)], pa.binary())]
                rows += len(numbers)
                none = pa.nulls(len(numbers), pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), *columns, none, none], [*keep, *kinds.names])
                if len(held) > HELD_PAIRS:
                    yield handed_on(part)
            sample = batch
        if held:
            yield handed_on(sample)

    return docs.select(*keep, *([] if column in keep else [column])).mapInArrow(apply, schema)


def _looked_up(texts: DataFrame, counts: tuple[np.ndarray, np.ndarray, np.ndarray], columns: list[str]) -> DataFrame:
    """`columns` of `texts` and n_best and count_sum of those links that are in `counts` (codes in order, counts, best ones)."""
    part = texts.sparkSession.sparkContext.broadcast(counts)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number, best = part.value
        for batch in batches:
            sums, bests = [], []
            for codes, times in zip(batch.column("_codes").to_pylist(), batch.column("_times").to_pylist(), strict=True):
                c, t = np.frombuffer(codes, np.int64), np.frombuffer(times, np.uint32).astype(np.int64)
                at = np.minimum(np.searchsorted(known, c), max(0, len(known) - 1))
                t = t * (known[at] == c) if len(known) else t * 0
                sums.append(int((t * number[at]).sum()) if len(known) else 0)
                bests.append(int((t * best[at]).sum()) if len(known) else 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(bests, pa.int64()), pa.array(sums, pa.int64())], [*columns, "n_best", "count_sum"])

    schema = T.StructType([*(texts.schema[c] for c in columns), T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
    return texts.select(*columns, "_codes", "_times").mapInArrow(apply, schema)


def align(docs: DataFrame, a_path: str, b_path: str, keep: list[str] = ("doc_id",), column: str = "text") -> DataFrame:
    """`keep` columns, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each text.

    A is a byte-level BPE of the tokenizers library (its JSON file), B a model of the sentencepiece library.
    """
    results = [*_FIGURES, "n_best", "count_sum", "groups_sha256"]
    keep = [k for k in keep if k not in results and not k.startswith("_")]
    first, _ = written(_linked(docs, a_path, b_path, keep, column), "links")
    texts = first.where(F.col("_row").isNotNull())
    pairs = first.where(F.col("_row").isNull()).groupBy("_pair").agg(F.sum("_texts").alias("n")).withColumn("a", F.shiftrightunsigned("_pair", 32))
    highest = pairs.groupBy("a").agg(F.max("n").alias("most"))
    counts, _ = written(pairs.join(highest, "a").select("_pair", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")
    parts = max(1, -(-counts.count() // PART_PAIRS))
    columns = [*keep, *_FIGURES, "groups_sha256"]
    found = None
    for k in range(parts):
        own = counts if parts == 1 else counts.where(F.pmod(F.xxhash64("_pair"), F.lit(parts)) == k)
        table = own.toArrow()  # PART_PAIRS rows
        codes = table.column("_pair").to_numpy()
        order = np.argsort(codes)
        made = _looked_up(texts, (codes[order], table.column("n").to_numpy()[order], table.column("best").to_numpy()[order]), ["_row", *columns])
        found = made if found is None else found.unionByName(made)
    if parts > 1:
        found = found.groupBy("_row", *columns).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return found.select(*keep, *results)
