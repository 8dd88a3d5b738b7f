"""Shared text helpers for the tokenising operators.

A *chunk* is a run of non-white-space characters with at most one leading space, or a run of
white space cut as GPT-2 style patterns cut it.  Every match of such a pattern lies inside one
chunk, so a chunk's tokens never depend on its neighbours and each distinct chunk needs to be
tokenised once per partition.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The Unicode White_Space characters, as the body of a character class.
SPACES = "\t-\r \x85\xa0  -     　"
CHUNK = re.compile(f" ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
SOLID = re.compile(f"[^{SPACES}]+")


def slices(batch, column: str, limit: int = 8 << 20):
    """Cut an Arrow batch into row ranges whose text stays near `limit` bytes (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    yield batch.slice(start, n - start)


#: Letters and numbers that Unicode got after version 16; the tokenisers' own tables do not
#: hold them yet, `regex` does.
LATER_LETTERS = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F),
    (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2),
    (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE),
    (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DF1, 0x11DF1), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF3),
    (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2),
    (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96),
    (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4),
    (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
LATER_NUMBERS = ((0x11DE0, 0x11DE9), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16FF4, 0x16FF6))


FIRST_LATER = chr(LATER_LETTERS[0][0])


def settled(pattern: str) -> str:
    r"""`pattern` (regex V1 syntax) with \p{L} and \p{N} as the tokenisers' libraries know them."""
    for name, later in (("L", LATER_LETTERS), ("N", LATER_NUMBERS)):
        body = "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in later)
        pattern = pattern.replace(rf"\p{{{name}}}", rf"[\p{{{name}}}--[{body}]]")
    return pattern


def byte_characters() -> list[str]:
    """The characters that byte-level vocabularies write bytes as: printable ones stand for themselves."""
    out, free = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(free))
            free += 1
    return out


class Pieces:
    """A vocabulary's merges applied to many pieces at once, by the tokenizers library."""

    def __init__(self, tokenizer):
        from tokenizers import Tokenizer, pre_tokenizers

        self.alone = Tokenizer(tokenizer.model)
        self.alone.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        self.table = dict(enumerate(byte_characters()))
        self.blank_stays = self.table | {32: " "}

    def written(self, piece: str) -> str:
        """The piece in byte characters; they hold no blank."""
        return piece if piece.isascii() and piece.isalnum() else piece.encode().decode("latin-1").translate(self.table)

    def __call__(self, pieces: list[str], places: bool = True) -> tuple[list[int], list[int], list[tuple[int, int]]]:
        """Ids of all tokens, the piece of each, and their places in the written pieces joined by blanks (if asked for)."""
        text = " ".join(pieces)
        if text.count(" ") == len(pieces) - 1:  # no piece holds a blank
            text = text.encode().decode("latin-1").translate(self.blank_stays)
        else:
            text = " ".join(map(self.written, pieces))
        e = self.alone.encode(text, add_special_tokens=False)
        return e.ids, e.word_ids, e.offsets if places else []


class Numbers(dict):
    """Numbers keys in the order of their first look-up; `new` holds keys not yet learnt."""

    def __init__(self):
        self.new: list = []

    def of(self, keys: list) -> np.ndarray:
        found = np.fromiter(map(self.get, keys, repeat(-1)), np.int32, len(keys))
        unknown = np.flatnonzero(found < 0)
        if len(unknown):
            missed = [keys[i] for i in unknown.tolist()]
            fresh = dict.fromkeys(missed)
            self.update(zip(fresh, range(len(self), len(self) + len(fresh)), strict=True))
            self.new += fresh
            found[unknown] = np.fromiter(map(self.__getitem__, missed), np.int32, len(missed))
        return found


class Ragged:
    """Growing list of integer rows, gathered by number."""

    def __init__(self, dtype=np.uint32):
        self.start, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, dtype)

    def extend(self, sizes: np.ndarray, flat: np.ndarray) -> None:
        begin = np.cumsum(sizes) - sizes + len(self.flat)
        self.start, self.size = np.concatenate([self.start, begin]), np.concatenate([self.size, sizes])
        self.flat = np.concatenate([self.flat, flat.astype(self.flat.dtype)])

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes of the rows, and their values one after another."""
        sizes = self.size[rows]
        ends = np.cumsum(sizes)
        at = np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
        at += np.repeat(self.start[rows] - (ends - sizes), sizes)
        return sizes, self.flat[at]


def rows_of(flat: np.ndarray, sizes: np.ndarray, lengths: list[int]) -> list[bytes]:
    """Bytes of `flat` by group: each of `lengths` counts the rows (of `sizes`) that form a group."""
    ends = np.cumsum(np.append(0, sizes))[np.cumsum([0, *lengths])].tolist()
    return [flat[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]


def solid_words(text: str | None) -> list[str]:
    """Words between white space; `split` also splits at four control characters that are none."""
    if not text:
        return []
    return SOLID.findall(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()


def distinct_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words between white space, the number among them of every word in order, and each text's number of words."""
    if pc.any(pc.match_substring_regex(texts, "[\x1c-\x1f]")).as_py():  # Arrow splits at these too
        lists = pa.array([solid_words(t) for t in texts.to_pylist()], pa.list_(pa.string()))
    else:
        lists = pc.utf8_split_whitespace(texts)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    codes = pc.list_flatten(lists).dictionary_encode()
    words, numbers = codes.dictionary.to_numpy(zero_copy_only=False).tolist(), codes.indices.to_numpy()
    if "" in words:  # white space at an end of a text
        empty = words.index("")
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[numbers != empty], minlength=len(sizes))
        numbers = numbers[numbers != empty]
        numbers = numbers - (numbers > empty)
        del words[empty]
    return words, numbers, sizes
