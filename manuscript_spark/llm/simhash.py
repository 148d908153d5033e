"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has 64 bits; two fingerprints are linked if they differ in at most three. Half of
that radius is one and a half: every distinct fingerprint emits all variants with one flipped bit
(or none) of the fingerprint less one of three blocks of bits, which is the half. Two fingerprints
that differ in at most three bits have a variant in common:

- differing bits in two or three blocks, or at most two bits: leave out a block that holds exactly
  one of them, or a block without any if there are two; the rest differs in at most two bits, one
  flip on each side.
- three differing bits in a single block: leave that block out; the rest is the same.

Fingerprints that share a variant are verified; a bucket yields the links of a spanning forest of
its verified pairs, never all pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import documents, fresh_path, map_texts, written

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SEED = 42
RADIUS = 3
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 16
#: Variants that a task emits or compares, about; the number of tasks grows with the fingerprints.
PER_TASK = 1 << 20
BLOCKS = [((1 << (hi - lo)) - 1) << lo for lo, hi in ((0, 21), (21, 42), (42, 64))]
ALL = (1 << 64) - 1


def fingerprint(text: str, shingle: int = 3) -> int:
    """The SimHash of a text: see fingerprints()."""
    raw = text.encode("utf-8", "surrogatepass").translate(LOWER)
    words = WORD.findall(raw)
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = max(1, n - shingle + 1)
    h_of, view = xxhash.xxh64_intdigest, memoryview(joined)
    last = ends[min(shingle, n) - 1 :].tolist()
    first = starts[:k].tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, k, CHUNK):
        h = np.fromiter((h_of(view[a:b], SEED) for a, b in zip(first[at : at + CHUNK], last[at : at + CHUNK])), np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for part in range(0, len(bits), 255):  # so that a byte holds each sum
            counts += np.add.reduce(bits[part : part + 255], axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(counts * 2 > k, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp long): the SimHash of each whole text.

    A-Z are lower-cased, words are runs of characters other than space and \\t-\\r, features are the
    runs of `shingle` words joined by a space, repeats included (fewer words: the whole sequence), hashed with
    XXH64 (UTF-8, seed 42). A bit is one if it is set in more than half of the hashes. Null and
    empty texts, and texts of white space: fingerprint zero. fp holds the unsigned bits as a signed long.
    """

    def make():
        def work(texts: list[str]) -> list[pa.Array]:
            return [pa.array(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))]

        return work

    return map_texts(docs.select(F.col("doc_id").cast("long"), "text"), make, "fp long")


def variants() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each emitted variant of a fingerprint: its block, the mask of kept bits, the flip."""
    block, keep, flip = [], [], []
    for g, mask in enumerate(BLOCKS):
        rest = ALL ^ mask
        for f in [0] + [1 << i for i in range(64) if rest >> i & 1]:
            block.append(g)
            keep.append(rest)
            flip.append(f)
    return np.array(block, np.int8), np.array(keep, np.uint64), np.array(flip, np.uint64)


def _forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of the distinct fingerprints that differ in at most RADIUS bits."""
    n = len(fps)
    left = np.ones(n, bool)
    out: list[tuple[int, int]] = []
    if n > 4096:  # dense bucket: look up every neighbour within the radius rather than compare pairs
        return _forest_by_balls(fps)
    while left.any():
        root = int(np.flatnonzero(left)[0])
        left[root] = False
        queue = [root]
        while queue:
            x = queue.pop()
            rest = np.flatnonzero(left)
            if not len(rest):
                break
            near = rest[np.bitwise_count(fps[rest] ^ fps[x]) <= RADIUS]
            left[near] = False
            out.extend((int(fps[x]), int(fps[y])) for y in near)
            queue.extend(near.tolist())
    return out


def _forest_by_balls(fps: np.ndarray) -> list[tuple[int, int]]:
    """As _forest(); work grows with the number of fingerprints, not with its square."""
    masks = [np.uint64(sum(1 << i for i in c)) for r in range(1, RADIUS + 1) for c in combinations(range(64), r)]
    fps = np.sort(fps)
    parent = np.arange(len(fps))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for m in masks:
        other = fps ^ m
        at = np.minimum(np.searchsorted(fps, other), len(fps) - 1)
        for i in np.flatnonzero((fps[at] == other) & (fps < other)).tolist():
            a, b = find(i), find(int(at[i]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((int(fps[i]), int(other[i])))
    return out


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each bucket, from rows (g, key, fp) that come sorted by g and key."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def links_of(g, key, fp):
        change = np.flatnonzero((key[1:] != key[:-1]) | (g[1:] != g[:-1])) + 1
        start = np.concatenate(([0], change))
        end = np.concatenate((change, [len(key)]))
        big = np.flatnonzero(end - start > 1)
        a, b = [], []
        two = big[(end - start)[big] == 2]
        x, y = fp[start[two]], fp[start[two] + 1]
        ok = (x != y) & (np.bitwise_count(x ^ y) <= RADIUS)
        a.append(x[ok])
        b.append(y[ok])
        for i in big[(end - start)[big] > 2]:
            forest = _forest(np.unique(fp[start[i] : end[i]]))
            a.append(np.array([p for p, _ in forest], np.uint64))
            b.append(np.array([q for _, q in forest], np.uint64))
        a, b = np.concatenate(a), np.concatenate(b)
        if len(a):
            pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].view(np.int64)), pa.array(pairs[:, 1].view(np.int64))], schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        g, key = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
        held.append((g, key, batch.column(2).to_numpy().view(np.uint64)))
        if held[0][1][0] == key[-1] and held[0][0][0] == g[-1]:
            continue  # one bucket so far
        g, key, fp = (np.concatenate(c) for c in zip(*held))
        cut = int(np.flatnonzero((key != key[-1]) | (g != g[-1]))[-1]) + 1
        yield from links_of(g[:cut], key[:cut], fp[:cut])
        held = [(g[cut:], key[cut:], fp[cut:])]
    if held:
        yield from links_of(*(np.concatenate(c) for c in zip(*held)))


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """(a, b): links between the fingerprints of distinct (fp long, unique), enough to connect all
    that are within three bits of each other. distinct should be a table: its rows are counted first, as a
    task gets by how much it emits, not by the few bytes that it reads."""
    schema = pa.schema([("g", pa.int8()), ("key", pa.int64()), ("fp", pa.int64())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, keep, flip = variants()
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                fps = batch.column(0).slice(at, 2048).to_numpy().view(np.uint64)
                keys = (fps[:, None] & keep[None, :]) ^ flip[None, :]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(block, len(fps))), pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(fps, len(keep)).view(np.int64))], schema=schema
                )

    tasks = max(1, -(-distinct.count() * len(variants()[0]) // PER_TASK))
    balls = distinct.select("fp").repartition(tasks, "fp").mapInArrow(emit, "g byte, key long, fp long")
    return balls.repartition(tasks, "g", "key").sortWithinPartitions("key", "g").mapInArrow(_links, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp long, component_id): the component of each document under links of at most three
    differing bits; component_id is the smallest doc_id in it. Documents without a doc_id get a
    fingerprint and component too, but never name one (component_id null if no member has an id).
    Repeated rows stay repeated. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    path = fresh_path(spark, "fingerprints")
    fingerprints(docs, shingle).write.parquet(path)
    fp = spark.read.schema("doc_id long, fp long").parquet(path)
    distinct = written(fp.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    comp = components(fingerprint_links(distinct.select("fp")))
    root = distinct.join(comp, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    least = root.groupBy("root").agg(F.min("first").alias("component_id"))
    of_fp = root.join(least, "root").select("fp", "component_id")
    return fp.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def hex16(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")
