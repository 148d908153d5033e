"""Quality rules, and an isolation forest on their statistics.

Each text gets rule statistics. The forest splits documents at random values of random statistics;
documents that few splits set apart have short paths. It is grown from labelled documents of good
quality, so that what differs from these is anomalous, and the path length below which a document
goes is calibrated on labelled documents of both kinds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import documents, map_texts, written

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
UPPER, MARK = re.compile(r"[^\W\d_a-zß-öø-ÿ]"), re.compile(r"[^\w\s]")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATISTICS = ("word_length", "symbols", "repeats", "upper", "marks", "distinct")
#: Trees, documents in a tree (at least, if there are so many), their depth. No labelled document is left out of the fit.
TREES, IN_TREE, DEPTH, SEED = 120, 256, 8, 17
#: Share of good labelled documents that the calibrated threshold keeps at least.
KEEP = 0.99


def repeat_words(words: list[str]) -> int:
    """Words that lie in a window of three words which occurs twice or more."""
    n = len(words)
    if n < 4:
        return 0
    known: dict[str, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    if len(known) == n:
        return 0
    if len(known) < 1 << 21:
        key = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    else:
        _, two = np.unique(np.stack((ids[:-2], ids[1:-1]), 1), axis=0, return_inverse=True)
        _, key = np.unique(np.stack((two.ravel(), ids[2:]), 1), axis=0, return_inverse=True)
        key = key.ravel()
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(n, bool)
    for k in range(3):
        cover[k : n - 2 + k] |= twice
    return int(cover.sum())


def measure(text: str) -> tuple[list[int], list[float]]:
    """The rule counts of a text, and the statistics that the forest splits on."""
    words = WORD.findall(text)
    n, chars = len(words), sum(map(len, words))
    symbols = len(SYMBOL.findall(text))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup, repeats = len(lines) - len(set(lines)), repeat_words(words)
    counts = [n, chars, symbols, dup, repeats]
    if not n:
        return counts, [0.0] * len(STATISTICS)
    per = 1 / n
    return counts, [
        chars * per,
        symbols * per,
        max(0, repeats - 8 * dup) * per,  # a line that returns is no flaw by itself
        len(UPPER.findall(text)) / chars,
        len(MARK.findall(text)) * per,
        len(set(words)) / n**0.8,
    ]


class Forest:
    """An isolation forest: for each tree, nodes in arrays (children of node i: 2i+1 and 2i+2)."""

    def __init__(self, feature: np.ndarray, value: np.ndarray, length: np.ndarray):
        self.feature, self.value, self.length = feature, value, length

    @staticmethod
    def grow(x: np.ndarray, trees: int = TREES, size: int = IN_TREE, depth: int = DEPTH, seed: int = SEED, bounds: tuple[np.ndarray, np.ndarray] | None = None) -> Forest:
        """bounds: least and largest values of each statistic, if those of x are not all."""
        rng = np.random.default_rng(seed)
        nodes = 2 ** (depth + 1) - 1
        feature, value, length = np.full((trees, nodes), -1, np.int32), np.zeros((trees, nodes)), np.zeros((trees, nodes))
        lo_all, hi_all = bounds or (x.min(0), x.max(0))
        wide = (hi_all - lo_all) * 0.5 + 1e-9
        for t in range(trees):
            rows = x[rng.choice(len(x), min(size, len(x)), replace=False)]
            stack = [(0, np.arange(len(rows)), 0)]
            while stack:
                node, own, d = stack.pop()
                part = rows[own]
                n = len(own)
                if d >= depth or n < 2:
                    length[t, node] = d + _rest(n)
                    continue
                lo, hi = part.min(0), part.max(0)
                if d == 0:  # the first cut may fall outside what was seen, so that the unseen is set apart at once
                    lo, hi = lo - wide, hi + wide
                can = np.flatnonzero(hi > lo)
                if not len(can):
                    length[t, node] = d + _rest(n)
                    continue
                f = int(rng.choice(can))
                v = float(rng.uniform(lo[f], hi[f]))
                feature[t, node], value[t, node] = f, v
                left = part[:, f] < v
                stack += [(2 * node + 1, own[left], d + 1), (2 * node + 2, own[~left], d + 1)]
        return Forest(feature, value, length)

    def path(self, x: np.ndarray) -> np.ndarray:
        """Mean path length of each row."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for f, v, n in zip(self.feature, self.value, self.length):
            at = np.zeros(len(x), np.int64)
            while True:
                inner = f[at] >= 0
                if not inner.any():
                    break
                go = np.where(x[rows, np.maximum(f[at], 0)] < v[at], 1, 2)
                at = np.where(inner, 2 * at + go, at)
            total += n[at]
        return total / max(1, len(self.feature))


def _rest(n: int) -> float:
    """The mean length of an unsuccessful search among n: what an unsplit node stands for."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


class Verdict:
    """A forest, the scaling of its statistics and the path length below which documents go."""

    def __init__(self, forest: Forest | None, threshold: float):
        self.forest, self.threshold = forest, threshold

    def paths(self, x: np.ndarray) -> np.ndarray:
        return self.forest.path(x) if self.forest is not None and len(x) else np.full(len(x), np.inf)


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, counts, stats) of every whole text."""

    def make():
        def work(texts: list[str]) -> list[pa.Array]:
            got = [measure(t) for t in texts]
            return [pa.array([c for c, _ in got], pa.list_(pa.int64())), pa.array([s for _, s in got], pa.list_(pa.float64()))]

        return work

    return map_texts(docs, make, "counts array<long>, stats array<double>")


def _grown(good: DataFrame, n: int) -> Forest:
    """A forest of all rows of good (doc_id, stats): each is dealt to one tree by a hash of its id, or to several neighbouring
    trees if there are too few rows to fill them. A task grows whole trees; the driver gets their nodes."""
    bounds = good.agg(*[f(F.col("stats")[i]) for f in (F.min, F.max) for i in range(len(STATISTICS))]).first()
    lo, hi = (np.array(bounds[k * len(STATISTICS) : (k + 1) * len(STATISTICS)], float) for k in (0, 1))
    copies = min(TREES, -(-IN_TREE * TREES // n))
    first = F.pmod(F.xxhash64(F.lit("tree"), "doc_id"), F.lit(TREES))
    dealt = good.select("doc_id", "stats", F.explode(F.transform(F.sequence(F.lit(0), F.lit(copies - 1)), lambda k: ((first + k) % TREES).cast("int"))).alias("tree"))

    def grow(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("doc_id")
        x = np.array(part["stats"].tolist(), float)
        f = Forest.grow(x, trees=1, size=len(x), seed=SEED + int(key[0]), bounds=(lo, hi))
        return pd.DataFrame({"tree": [key[0]], "feature": [f.feature[0].tolist()], "value": [f.value[0].tolist()], "length": [f.length[0].tolist()]})

    rows = dealt.groupBy("tree").applyInPandas(grow, "tree int, feature array<int>, value array<double>, length array<double>").collect()
    rows.sort(key=lambda r: r.tree)
    return Forest(np.array([r.feature for r in rows], np.int32), np.array([r.value for r in rows]), np.array([r.length for r in rows]))


def learn(docs: DataFrame, labels: DataFrame) -> Verdict:
    """Grow and calibrate on all labelled documents (labels: doc_id, quality; more than one label: the lowest; of documents that
    repeat an id one). Without good labelled documents there is no forest, and only the base rules decide."""
    return learned(measured(docs), labels)


def learned(measures: DataFrame, labels: DataFrame) -> Verdict:
    """As `learn`, from documents as `measured` gives them."""
    y = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    # one row a labelled id, however often documents repeat it
    once = measures.join(y, "doc_id").groupBy("doc_id").agg(F.min(F.struct("counts", "stats", "quality")).alias("m"))
    c = lambda i: F.col("m.counts")[i]
    fails = (c(0) < 50) | (100 * c(4) > 50 * c(0))
    rows = written(once.where(~fails).select("doc_id", F.col("m.stats").alias("stats"), F.col("m.quality").cast("int").alias("quality")), "quality")
    n = {r.quality: r["count"] for r in rows.groupBy("quality").count().collect()}
    if n.get(1, 0) < 2:
        return Verdict(None, -np.inf)
    forest = _grown(rows.where("quality = 1"), n[1])

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column(0).to_pylist(), float).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(forest.path(x))], names=["quality", "path"])

    path = written(rows.select("stats", "quality").mapInArrow(paths, "quality int, path double"), "quality-paths")
    # the shortest paths of the good, up to the share that may go; the best threshold is one of them
    low = np.array([r.path for r in path.where("quality = 1").orderBy("path").limit(int((1 - KEEP) * n[1]) + 1).select("path").collect()])

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(low) + 1, np.int64)
        for b in batches:
            total += np.bincount(np.searchsorted(low, b.column(0).to_numpy(), side="right"), minlength=len(low) + 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["at", "n"])

    other = np.zeros(len(low) + 1, np.int64)
    for r in path.where("quality = 0").select("path").mapInArrow(below, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        other[r["at"]] = r["n"]
    gains = np.cumsum(other)[: len(low)] / max(1, n.get(0, 0)) - 4 * np.searchsorted(low, low, side="left") / n[1]
    return Verdict(forest, float(low[int(np.argmax(gains))]))


def judged(measures: DataFrame, verdict: Verdict) -> DataFrame:
    """As `judge`, of documents as `measured` gives them."""
    new = ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, path double"
    rows = measures.select("doc_id", "counts", "stats")
    out = StructType([rows.schema["doc_id"], *measures.sparkSession.createDataFrame([], new).schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = decided(np.array(b.column(1).to_pylist(), np.int64), np.array(b.column(2).to_pylist(), float), verdict)
            yield pa.RecordBatch.from_arrays([b.column(0), *made], names=out.names)

    return rows.mapInArrow(run, out)


def decided(counts: np.ndarray, stats: np.ndarray, verdict: Verdict) -> list[pa.Array]:
    counts = counts.reshape(-1, len(COUNTS))
    failed, path = base_failed(counts), verdict.paths(stats.reshape(-1, len(STATISTICS)))
    return [*(pa.array(counts[:, i]) for i in range(len(COUNTS))), pa.array(failed), pa.array(~failed & ~(path < verdict.threshold)), pa.array(path)]


def judge(docs: DataFrame, verdict: Verdict) -> DataFrame:
    """Rule counts, base verdict, path length and final verdict of every whole text (null: no words,
    so it fails the base rules). Repeated rows stay repeated; of other columns than doc_id and text nothing is read."""

    def make():
        def work(texts: list[str]) -> list[pa.Array]:
            got = [measure(t) for t in texts]
            return decided(np.array([c for c, _ in got], np.int64), np.array([s for _, s in got], float), verdict)

        return work

    return map_texts(docs, make, ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, path double")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    measures = written(measured(documents(spark, sf_dir)), "measures")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return judged(measures, learned(measures, labels.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)))
