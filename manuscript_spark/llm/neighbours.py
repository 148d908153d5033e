"""Approximate nearest neighbours by multi-index hashing.

Vectors get binary codes: the signs of a learned rotation (iterative quantisation on the principal
axes). A code is split into substrings, each with an index from its values to the rows that have it.
Codes within a Hamming radius of the query's agree with it in some substring up to the radius over
the number of substrings, or one bit less in the substrings behind the division's remainder (pigeonhole), so looking
up that ball of values in every substring's index finds all of them; what lies within the radius is ranked by the
vectors themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Bits of a code, substrings, rows of the sample that the rotation and the radius are fitted on.
BITS, PARTS, SAMPLE, SEED = 256, 16, 6000, 5
#: Queries whose true neighbours among all rows give the radius, and the share of these that it shall cover.
ASKED, COVER = 300, 0.96
#: Rows and queries of a grid cell, at most on average.
ROW_BLOCK, QUERY_BLOCK = 16384, 4096


class Codes:
    """A rotation into BITS sign bits, and the Hamming radius within which neighbours lie."""

    def __init__(self, mean: np.ndarray, rotation: np.ndarray, norm: float, radius: int):
        self.mean, self.rotation, self.norm, self.radius = mean, rotation, norm, radius

    def lift(self, x: np.ndarray) -> np.ndarray:
        """One more component, so that the largest inner product is the smallest angle."""
        rest = np.sqrt(np.maximum(0.0, self.norm**2 - (x * x).sum(1)))
        return np.concatenate((x, rest[:, None]), 1) / max(self.norm, 1e-300)

    def encode(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Codes as rows of PARTS substrings of 16 bits."""
        if query:
            v = np.concatenate((x, np.zeros((len(x), 1))), 1)
            v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        else:
            v = self.lift(x)
        return np.packbits((v - self.mean) @ self.rotation > 0, axis=1).view(np.uint16)


def fit(x: np.ndarray, norm: float) -> Codes:
    """Learn the rotation on a sample. The radius is still that of all codes."""
    rng = np.random.default_rng(SEED)
    codes = Codes(np.zeros(x.shape[1] + 1), np.zeros((x.shape[1] + 1, BITS)), norm, BITS)
    v = codes.lift(x)
    codes.mean = v.mean(0)
    c = v - codes.mean
    axes = np.linalg.eigh(c.T @ c)[1][:, ::-1]
    d = v.shape[1]
    blocks = []
    while sum(b.shape[1] for b in blocks) < BITS:  # as many rotations as the bits need
        w = min(d, BITS)
        p = axes[:, :w]
        r = np.linalg.qr(rng.standard_normal((w, w)))[0]
        y = c @ p
        for _ in range(20):
            u, _, vt = np.linalg.svd(np.where(y @ r >= 0, 1.0, -1.0).T @ y)
            r = (u @ vt).T
        blocks.append(p @ r)
    codes.rotation = np.concatenate(blocks, 1)[:, :BITS]
    return codes


def radius(v: DataFrame, codes: Codes, ids: np.ndarray, q: np.ndarray, k: int) -> int:
    """The Hamming radius that covers a share of the k nearest rows of some queries, found among all rows (vec_id, v): each
    batch gives its own k best of every query, so that little is shuffled. The more rows there are, the nearer
    their neighbours and the smaller the radius."""
    asked = codes.encode(q, True)

    def best(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if not len(part):
                continue
            x, own = np.array(part["v"].to_list()), part["vec_id"].to_numpy()
            s = q @ x.T
            s[ids[:, None] == own[None, :]] = -np.inf
            top = np.argsort(-s, axis=1, kind="stable")[:, :k]
            apart = np.bitwise_count(asked[:, None, :] ^ codes.encode(x)[top]).sum(2, dtype=np.int32)
            out = pd.DataFrame({"q": np.repeat(np.arange(len(q)), top.shape[1]), "score": np.take_along_axis(s, top, 1).ravel(), "apart": apart.ravel()})
            yield out[np.isfinite(out["score"])]

    found = v.select("vec_id", "v").mapInPandas(best, "q int, score double, apart int")
    nearest = found.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "apart"))).where(F.col("r") <= k)
    apart = sorted(r.apart for r in nearest.select("apart").collect())  # ASKED times k at most
    return apart[min(len(apart) - 1, math.ceil(COVER * len(apart)))] if apart else BITS


@lru_cache(maxsize=8)
def ball(radius: int) -> np.ndarray:
    """What a 16-bit value is changed by within a radius."""
    masks = np.arange(1 << 16, dtype=np.uint32).astype(np.uint16)
    return masks[np.bitwise_count(masks) <= radius]


class Index:
    """Multi-index over the codes of a block of rows: for each substring a table from its values to the rows that have each."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = [np.argsort(codes[:, p], kind="stable") for p in range(PARTS)]
        self.values = [np.unique(codes[:, p], return_counts=True) for p in range(PARTS)]
        self.starts = [np.searchsorted(codes[o, p], np.arange((1 << 16) + 1)) for p, o in enumerate(self.order)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose codes differ from a code in at most `radius` bits."""
        hit = np.zeros(len(self.codes), bool)
        for p in range(PARTS):
            # codes that are farther in every substring than this differ in more than `radius` bits in all
            reach = radius // PARTS - (p > radius % PARTS)
            if reach < 0:
                continue
            masks = ball(reach)
            values, counts = self.values[p]
            if len(masks) < len(values):  # look the values of the ball up
                near = masks ^ code[p]
                first, last = self.starts[p][near], self.starts[p][near.astype(np.int64) + 1]
                some = last > first
                first, size = first[some], (last - first)[some]
                at = np.repeat(first - np.concatenate(([0], np.cumsum(size)[:-1])) if len(size) else first, size) + np.arange(size.sum())
                hit[self.order[p][at]] = True
            else:  # the ball is larger than what there is: which of the values lie in it
                near = np.bitwise_count(values ^ code[p]) <= reach
                hit[self.order[p][np.repeat(near, counts)]] = True
        rows = np.flatnonzero(hit)
        apart = np.bitwise_count(self.codes[rows].view(np.uint64) ^ code.view(np.uint64)).sum(1, dtype=np.int32)
        return rows[apart <= radius]


def _usable(v: Column) -> Column:
    """Neither null nor zero, all components finite."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def neighbours(vectors: DataFrame, queries: Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k rows with the largest inner product (double precision)
    for each row that `queries` selects, among those within the radius; if a query finds fewer than
    k that way, among all rows. A row is no neighbour of its own id. Ties go to the smaller vec_id.

    Rows that are null, zero, hold null or non-finite components, have no vec_id or another dimension
    than most rows take no part; of rows that repeat a vec_id with the same vector one takes part.
    Other columns are not read. Rows and queries meet in blocks: every cell of the grid holds a bounded number of both.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & _usable(F.col("v")))
    sizes = v.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not sizes:
        return empty
    most = max(sizes, key=lambda r: (r.n, r.d))
    v = v.where(F.size("v") == most.d).distinct()
    n, n_queries = most.n, max(1, v.where(queries).count())
    share = min(1.0, SAMPLE / n)
    unit = F.pmod(F.xxhash64(F.lit("sample"), "vec_id"), F.lit(1_000_003)) / 1_000_003
    picked = v.where(unit < share).orderBy("vec_id").limit(2 * SAMPLE).collect()
    sample, ids = np.array([r.v for r in picked]).reshape(-1, most.d), np.array([r.vec_id for r in picked], np.int64)
    codes = fit(sample if len(sample) else np.ones((1, most.d)), math.sqrt(most.m))
    if n > 2 and len(sample):
        few = np.random.default_rng(SEED).choice(len(sample), min(ASKED, len(sample)), replace=False)
        codes.radius = radius(v, codes, ids[few], sample[few], k)
    row_blocks, query_blocks = max(1, math.ceil(n / ROW_BLOCK)), max(1, math.ceil(n_queries / QUERY_BLOCK))
    rb, qb = F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(row_blocks)).cast("int"), F.pmod(F.xxhash64(F.lit(2), "vec_id"), F.lit(query_blocks)).cast("int")
    rows = v.select(rb.alias("rb"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"), "vec_id", "v")
    asked = v.where(queries).select(F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("rb"), qb.alias("qb"), "vec_id", "v")

    def cell(own: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": [], "near": []}
        if len(own) and len(ask):
            own = own.sort_values("vec_id")
            ids, x = own["vec_id"].to_numpy(), np.array(own["v"].to_list())
            q = np.array(ask["v"].to_list())
            index, asked_codes = Index(codes.encode(x)), codes.encode(q, True)
            for i, (qid, c) in enumerate(zip(ask["vec_id"].tolist(), asked_codes)):
                near = index.within(c, codes.radius)
                near = near[ids[near] != qid]
                for at, flag in ((near, True), *(((np.flatnonzero(ids != qid), False),) if len(near) < k else ())):
                    s = (x[at] * q[i]).sum(1)
                    if len(at) > k:
                        least = np.partition(s, len(s) - k)[len(s) - k]
                        at, s = at[s >= least], s[s >= least]
                    top = np.lexsort((ids[at], -s))[:k]
                    out["query_id"] += [qid] * len(top)
                    out["vec_id"] += ids[at[top]].tolist()
                    out["score"] += s[top].tolist()
                    out["near"] += [flag] * len(top)
        return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64", "near": "bool"})

    found = rows.groupBy("rb", "qb").cogroup(asked.groupBy("rb", "qb")).applyInPandas(cell, "query_id long, vec_id long, score double, near boolean")
    # rows within the radius come first; others only fill up what they leave
    per = W.partitionBy("query_id")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.max("near").alias("near"))
    pick = once.withColumn("first", F.row_number().over(per.orderBy(F.desc("near"), F.desc("score"), "vec_id"))).where(F.col("first") <= k)
    return pick.withColumn("rank", F.row_number().over(per.orderBy(F.desc("score"), "vec_id")).cast("int")).select("query_id", "rank", "vec_id", "score")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)
