"""Exact nearest neighbours by cosine: a block matrix join with int8 product tiles.

Vectors are dealt into candidate blocks and queries into query blocks; queries are copied to every
candidate block, and each (candidate block, query block) tile is one task's matrix product.  Within
a tile the vectors are held as int8 with a scale each, so products are exact integers and every
cosine is known up to a bound that follows from the two quantisation errors.  Pairs whose upper
bound reaches the k-th best lower bound survive; they alone are recomputed in double precision on
the original components.  A query's lists of all tiles are merged by heaps.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part,
as query or candidate.  A query's candidates are the vectors of its own dimension.
Candidates with equal cosine rank by smaller id; a query is no candidate of its own; fewer
candidates than k give fewer rows; repeated ids are separate rows of one id.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Candidates of a block and queries of a block; a tile holds one of each.
CANDIDATES, QUERIES = 16_384, 2_048
#: Query rows multiplied at a time within a tile.
STRIP = 256


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector can take part, with the vector in double precision as `v`."""
    # a product of two floats never overflows as a double, so a finite sum of squares means finite components
    v = F.col(vector).cast("array<double>")
    squares = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    return df.withColumn("v", v).withColumn("_sq", squares).where("_sq > 0 and _sq < double('Infinity')").drop("_sq")


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, their scales, and norms of what they miss, for unit vectors."""
    scale = np.abs(x).max(1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    return q, scale, np.sqrt(((x - q * scale[:, None]) ** 2).sum(1))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise cosine; components are added in order, so equal vectors get equal values."""
    dot, x, y = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for k in range(a.shape[1]):
        dot += a[:, k] * b[:, k]
        x += a[:, k] * a[:, k]
        y += b[:, k] * b[:, k]
    return dot / (np.sqrt(x) * np.sqrt(y))


def tile(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, c: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query, candidate, cosine) of the k best candidates of each query in this tile."""
    unit = lambda x: x / np.sqrt((x * x).sum(1))[:, None]
    cq, cs, ce = quantised(unit(c))
    qq, qs, qe = quantised(unit(q))
    # |<x,y> - <x^,y^>| <= |x - x^| |y| + |x^| |y - y^| with |y| = 1 and |x^| <= 1 + |x - x^|; a hair for rounding
    found, columns = [], cq.astype(np.float32).T  # products up to 127 * 127 * dimension are exact in float32 below 1,024 components
    exact = q.shape[1] <= 1024
    for at in range(0, len(q), STRIP):
        rows = slice(at, at + STRIP)
        ints = qq[rows].astype(np.float32) @ columns if exact else qq[rows].astype(np.float64) @ columns.astype(np.float64)
        near = ints * (qs[rows, None] * cs[None, :])
        slack = qe[rows, None] + (1 + qe[rows, None]) * ce[None, :] + 1e-9
        own = query_ids[rows, None] == ids[None, :]
        low = np.where(own, -np.inf, near - slack)
        floor = np.partition(low, -k, 1)[:, -k] if low.shape[1] >= k else np.full(len(low), -np.inf)
        i, j = np.nonzero((near + slack >= floor[:, None]) & ~own)
        for part in range(0, len(i), 1 << 16):
            pi, pj = i[part : part + (1 << 16)], j[part : part + (1 << 16)]
            found.append((pi + at, pj, cosines(q[rows][pi], c[pj])))
    out = []
    if found:
        i, j, score = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        keep = rank < k
        out = list(zip(query_ids[i[keep]].tolist(), ids[j[keep]].tolist(), score[keep].tolist(), strict=True))
    return out


def nearest(vectors: DataFrame, is_query, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest candidates by cosine of each row where `is_query` (a Column) holds, against all rows.

    Columns: query_id, rank, vec_id, score.
    """
    spark = vectors.sparkSession
    good = usable(vectors.where(F.col(key).isNotNull()).select(key, vector, is_query.alias("_query")), vector)
    sizes = good.agg(F.count("*").alias("n"), F.sum(F.col("_query").cast("long")).alias("q")).first()
    schema = "query_id long, vec_id long, score double"
    if not sizes["n"] or not sizes["q"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    blocks, strips = -(-sizes["n"] // CANDIDATES), -(-sizes["q"] // QUERIES)
    good = good.withColumn("d", F.size("v"))  # a tile's vectors have one dimension
    # a block's rows travel packed; each tile gets one copy of its two blocks
    part = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    pieces = max(int(spark.conf.get("spark.sql.shuffle.partitions")) // blocks, 1) if blocks < 12 else 1
    candidates = good.withColumn("block", part(blocks * pieces)).select(F.col("d").alias("cd"), F.col("block").alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(strips - 1))).alias("cs"), F.col(key).alias("cid"), F.col("v").alias("cv"))
    queries = good.where("_query").select(F.col("d").alias("qd"), F.explode(F.sequence(F.lit(0), F.lit(blocks * pieces - 1))).alias("qb"), part(strips).alias("qs"), F.col(key).alias("qid"), F.col("v").alias("qv"))

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = tile(left["qid"].to_numpy(), np.array(left["qv"].tolist()), right["cid"].to_numpy(), np.array(right["cv"].tolist()), k) if len(left) and len(right) else []
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = queries.groupBy("qd", "qb", "qs").cogroup(candidates.groupBy("cd", "cb", "cs")).applyInPandas(work, schema)

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        best = heapq.nsmallest(k, zip((-group["score"]).tolist(), group["vec_id"].tolist(), strict=True))
        return pd.DataFrame({"query_id": group["query_id"].iloc[0], "rank": np.arange(1, len(best) + 1, dtype=np.int32), "vec_id": [v for _, v in best], "score": [-s for s, _ in best]})

    # k rows a tile and query; each query's are merged by a heap
    return found.groupBy("query_id").applyInPandas(merge, "query_id long, rank int, vec_id long, score double")
