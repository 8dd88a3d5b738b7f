"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document.  Expectation
maximisation over the counts of vote patterns estimates each labeller's accuracy and the share of
bad documents; the posteriors label documents, and a linear scorer over
hashed word-shape features is fitted to the posterior labels.  The scorer decides for all
documents.

Vote patterns are counted over all documents (3 to the power of the labellers at most).  The
scorer is fitted on a hashed sample of some FIT_ROWS documents, a parameter.

Defined results: a null or empty text gets no votes, scores 0 and is rejected;
repeated rows get equal scores; scores do not depend on the order of rows or on partitions.  Null ids
are scored like others, an empty table gives no rows; of columns that have a result's name only the
result is returned.  Long texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, pairwise
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewright.llm._shared import lean
from platewright.llm._text import SOLID, slices

FIT_ROWS = 6_000
#: A document is rejected only if it is clearly bad: probability of good below this.
REJECT_BELOW = 0.25
BITS = 12
DIMENSIONS = 1 << BITS
GOOD, BAD, NONE = 0, 1, 2
#: Share above which a labeller votes bad, and below which it votes good (None: it never does).
LABELLERS = {
    "symbols": (0.2, None),  # words that end in two or more symbols
    "capitals": (0.3, None),  # words of capitals alone
    "shouting": (0.3, None),  # words that end in exclamation marks
    "loose": (0.2, None),  # marks that stand alone
    "repeats": (0.3, None),  # words equal to the word before
    "monotony": (0.85, None),  # words seen before in the text, if it has 30 words or more
    "no function words": (0.97, 0.85),  # words that are not plain words of three letters or less
    "no prose": (0.5, 0.15),  # words that are marked in one of the ways above
}
SYMBOLS, SHOUT, LETTER = re.compile(r"[%&$#*^~=<>\\]{2,}$"), re.compile(r"!{2,}$"), re.compile(r"[^\W\d_]")
RUNS = re.compile(r"(.)\1+")
CACHE_ENTRIES = 500_000
#: Bytes of text whose words are looked at together: a worker holds them all.
AT_ONCE = 1 << 19


def shape(word: str) -> str:
    """A word's pattern: runs of A capitals, a small letters, 0 digits, and other characters as they are."""
    kinds = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    return RUNS.sub(r"\1\1", kinds)


def solid(text: str) -> list[str]:
    """The matches of SOLID: what `split` gives, but where a text has one of the four marks that only `split` takes for blanks."""
    return SOLID.findall(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()


class Words(dict):
    """Facts of words, each distinct word looked at once: flags, the hashed feature of its shape, and a number."""

    def __missing__(self, w: str) -> int:
        core = w.rstrip(".,;:")
        if core.isalpha() and len(w) - len(core) < 2:
            capitals = len(core) > 1 and core.isupper()
            flags, pattern = capitals << 1 | (capitals or len(core) > 3) << 4 | capitals << 5, ("aa" if core.islower() else "AA" if core.isupper() else "Aaa" if core.istitle() else "Aa") + w[len(core) :]
        else:
            letters = LETTER.search(w) is not None
            core = w.rstrip(".,;:!?")
            marked = (bool(SYMBOLS.search(w)), letters and len(core) > 1 and core.upper() == core and core.lower() != core, bool(SHOUT.search(w)), not letters and not any(c.isdigit() for c in w))
            flags, pattern = sum(f << k for k, f in enumerate(marked)) | 1 << 4 | any(marked) << 5, shape(w)
        self[w] = fact = flags | (crc32(pattern.encode()) % DIMENSIONS) << 8 | len(self) << 24
        return fact

    def facts(self, text: str) -> np.ndarray:
        words = SOLID.findall(text)
        if len(self) > CACHE_ENTRIES:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


    def facts_of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[str]]]:
        """Facts of all the words of `texts`, whether a word is the one before it in its text, where texts begin (and the last ends), and their words."""
        if len(self) > CACHE_ENTRIES:
            self.clear()
        split = [solid(t or "") for t in texts]
        at = np.cumsum([0, *map(len, split)])
        facts = np.fromiter(map(self.__getitem__, chain.from_iterable(split)), np.int64, at[-1])
        same = np.append(False, facts[1:] == facts[:-1])[: len(facts)]
        same[at[:-1][at[:-1] < len(facts)]] = False
        return facts, same, at, split


WORD_BEFORE = crc32(b"word before") % DIMENSIONS


def describe(words: Words, text: str | None) -> tuple[dict[str, float], np.ndarray, int]:
    """Labellers' shares, hashed features of the text's words, and the number of words."""
    facts = words.facts(text or "")
    n = len(facts)
    if not n:
        return {}, np.zeros(0, np.int64), 0
    share = lambda k: np.count_nonzero(facts & (1 << k)) / n
    same = np.append(False, facts[1:] == facts[:-1])
    repeats = int(np.count_nonzero(same))
    shares = {"symbols": share(0), "capitals": share(1), "shouting": share(2), "loose": share(3), "repeats": repeats / n, "no function words": share(4), "no prose": np.count_nonzero(same | (facts & 32 > 0)) / n}
    if n >= 30:
        shares["monotony"] = 1 - len(set(facts.tolist())) / n
    return shares, np.append(facts >> 8 & (DIMENSIONS - 1), np.full(repeats, WORD_BEFORE)), n


def pattern_of(shares: dict[str, float]) -> int:
    """Votes as a number in base 3."""
    code = 0
    for name, (bad, good) in LABELLERS.items():
        v = shares.get(name)
        code = 3 * code + (NONE if v is None else BAD if v > bad else GOOD if good is not None and v < good else NONE)
    return code


def patterns(words: Words, texts: list[str | None]) -> np.ndarray:
    """`pattern_of` each text's shares, all texts at a time."""
    facts, same, at, split = words.facts_of(texts)
    n = np.diff(at)
    words_ = np.maximum(n, 1)

    def share(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.append(0, np.cumsum(flags))[at]) / words_

    shares = {name: share(facts & 1 << k > 0) for k, name in enumerate(("symbols", "capitals", "shouting", "loose", "no function words"))}
    shares |= {"repeats": share(same), "no prose": share(same | (facts & 32 > 0))}
    shares["monotony"] = 1 - np.array([len(set(w)) for w in split], float) / words_
    code = np.zeros(len(n), np.int64)
    for name, (bad, good) in LABELLERS.items():
        v = shares[name]
        vote = np.where(v > bad, BAD, NONE if good is None else np.where(v < good, GOOD, NONE))
        code = 3 * code + np.where(n < (30 if name == "monotony" else 1), NONE, vote)
    return code


def votes_of(code: int) -> list[int]:
    out = []
    for _ in LABELLERS:
        out.append(code % 3)
        code //= 3
    return out[::-1]


def estimate(counts: dict[int, int], rounds: int = 200) -> tuple[dict[int, float], np.ndarray, float]:
    """Posterior of bad by pattern, the labellers' accuracies, and the share of bad documents.

    A labeller's votes are right with its accuracy, whatever the class, and it abstains alike in
    both classes; accuracies are held to be better than a coin.
    """
    codes = sorted(counts)
    votes = np.array([votes_of(c) for c in codes]).reshape(len(codes), len(LABELLERS))
    n = np.array([counts[c] for c in codes], float)
    side = (votes == BAD).astype(float) - (votes == GOOD)
    accuracy, bad, posterior = np.full(len(LABELLERS), 0.8), 0.3, np.zeros(len(codes))
    for _ in range(rounds):
        odds = np.log(bad / (1 - bad)) + side @ np.log(accuracy / (1 - accuracy))
        posterior = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        right = (n * posterior) @ (votes == BAD) + (n * (1 - posterior)) @ (votes == GOOD)
        accuracy = np.clip((right + 8) / (n @ (votes != NONE) + 10), 0.55, 0.99)
        bad = float(np.clip((n * posterior).sum() / max(n.sum(), 1), 1e-3, 1 - 1e-3))
    return dict(zip(codes, posterior.tolist(), strict=True)), accuracy, bad


def vector(features: np.ndarray, n: int) -> np.ndarray:
    """Square roots of the features' shares of the words."""
    return np.sqrt(np.bincount(features, minlength=DIMENSIONS) / max(n, 1))


def fit(rows: list[tuple[np.ndarray, np.ndarray, float]], rounds: int = 300, rate: float = 2.0, decay: float = 1e-4) -> np.ndarray:
    """Logistic weights (the last one the bias) for rows of (indices, values, target)."""
    w = np.zeros(DIMENSIONS + 1)
    if not rows:
        return w
    lengths = [len(i) for i, _, _ in rows]
    index, value = np.concatenate([i for i, _, _ in rows]), np.concatenate([v for _, v, _ in rows])
    row, target = np.repeat(np.arange(len(rows)), lengths), np.array([t for _, _, t in rows])
    # both classes weigh the same
    bad = target.sum()
    weight = np.where(target > 0.5, 0.5 / max(bad, 1), 0.5 / max(len(rows) - bad, 1))
    square = np.full(DIMENSIONS + 1, 1e-8)
    for _ in range(rounds):
        score = np.bincount(row, value * w[index], len(rows)) + w[-1]
        error = weight * (1 / (1 + np.exp(-np.clip(score, -500, 500))) - target)
        gradient = np.append(np.bincount(index, value * error[row], DIMENSIONS), error.sum()) + decay * np.append(w[:-1], 0)
        square += gradient**2
        w -= rate * gradient / np.sqrt(square) / 4
    return w


def classify(df: DataFrame, key: str = "doc_id", column: str = "text", fit_rows: int = FIT_ROWS, reject_below: float = REJECT_BELOW) -> DataFrame:
    """`key`, quality (probability of good) and keep, for every row of `df`."""
    shared = scorer(df, key, column, fit_rows)
    return scored(df.select(key, column), shared, column, "quality").select(key, "quality", (F.col("quality") >= reject_below).alias("keep"))


def good_documents(df: DataFrame, key: str = "doc_id", column: str = "text", fit_rows: int = FIT_ROWS, reject_below: float = REJECT_BELOW) -> DataFrame:
    """The rows of `df` that the classifier keeps, with their columns."""
    name = "quality"
    while name in df.columns:
        name = f"_{name}"
    return scored(df, scorer(df, key, column, fit_rows), column, name).where(F.col(name) >= reject_below).drop(name)


def scored(df: DataFrame, weights, column: str, name: str) -> DataFrame:
    """`df` and its texts' probability of being good; `weights` is a broadcast vector."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, w = Words(), weights.value
        for batch in batches:
            for part in slices(batch, column, AT_ONCE):
                facts, same, at, _ = words.facts_of(part.column(column).to_pylist())
                features, before, out = facts >> 8 & (DIMENSIONS - 1), np.append(0, np.cumsum(same))[at], []
                for k, (a, b) in enumerate(pairwise(at.tolist())):
                    f = np.append(features[a:b], np.full(before[k + 1] - before[k], WORD_BEFORE))
                    out.append(1 / (1 + np.exp(np.clip(vector(f, b - a) @ w[:-1] + w[-1], -500, 500))) if b > a else 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.float64())], [*part.schema.names, name])

    return df.mapInArrow(lean(score), T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())]))


def scorer(df: DataFrame, key: str, column: str, fit_rows: int):
    """Broadcast weights of the linear scorer."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for part in slices(batch, column, AT_ONCE):
                yield pa.RecordBatch.from_arrays([pa.array(patterns(words, part.column(column).to_pylist()), pa.int32())], ["pattern"])

    counted = df.select(column).mapInArrow(lean(vote), "pattern int").groupBy("pattern").agg(F.count("*").alias("n")).collect()  # 3 ** labellers rows at most
    counts = {r["pattern"]: r["n"] for r in counted}
    posterior, _, _ = estimate(counts)
    total = sum(counts.values())

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for part in slices(batch, column):
                rows = []
                for t in part.column(column).to_pylist():
                    shares, f, n = describe(words, t)
                    v = vector(f, n).astype(np.float32)
                    i = np.flatnonzero(v).astype(np.int32)
                    rows.append((pattern_of(shares), i, v[i]))
                p, i, v = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(i, pa.list_(pa.int32())), pa.array(v, pa.list_(pa.float32()))], ["pattern", "i", "v"])

    grains = 1 << 20
    below = grains if total <= fit_rows else max(1, int(grains * fit_rows / total))
    # rows that repeat an id and its text are in the sample once, so that no row can fill it
    drawn = df.select(F.xxhash64(F.col(key), F.lit(17)).alias("_luck"), F.xxhash64(F.col(key), F.col(column)).alias("_row"), F.col(column)).where(F.pmod("_luck", F.lit(grains)) < below).dropDuplicates(["_row"])
    sample = drawn.select(column).mapInArrow(lean(features), "pattern int, i array<int>, v array<float>")
    got = sample.toArrow() if total else None  # some fit_rows rows
    rows = sorted(((np.array(i, int), np.array(v, float), posterior.get(p, 0.5)) for p, i, v in zip(*(got[c].to_pylist() for c in ("pattern", "i", "v")), strict=True)), key=lambda r: (r[2], r[0].tobytes(), r[1].tobytes())) if total else []
    return df.sparkSession.sparkContext.broadcast(fit(rows))
