"""Toxicity by a weighted lexicon.

Texts are folded (case, accents, look-alike letters, digits that stand for letters), the lexicon is
matched by an Aho-Corasick automaton, matches inside exception phrases are dropped, and the sum of
weights is normalised by length. Lexicon and calibration are learned from labelled rows; exceptions
are a fixed list of harmless phrases and what labelled rows show to be harmless.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SLICE, documents, map_texts, written

# Letters of other scripts that look like Latin ones, and signs that stand for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ɑ": "a", "ɡ": "g",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
#: An exclamation mark stands for a letter only between letters, digits or signs that do.
WITHIN = re.compile(r"(?<=[^\W_]|[@$])!(?=[^\W_]|[@$])")
# Phrases in which words that are abuse elsewhere are harmless.
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "trash bag", "trash bags", "take out the trash", "clown fish", "circus clown", "soap scum", "pond scum", "idiot proof", "idiot light", "pathetic fallacy", "worthless check", "sore loser", "winner and loser", "stupid question", "no stupid questions", "kill switch", "killer whale", "dumb bell", "dumb waiter")

#: Bounds of the fit: labelled documents of each class that are learned from.
MAX_TOXIC, MAX_CLEAN = 4000, 8000
#: A term needs this share of the toxic sample (and five documents) and these log odds; with less
#: than the wide share, words of one much copied document would do, so it needs the higher odds.
SUPPORT, WIDE, LOG_ODDS, HIGH_ODDS = 0.01, 0.03, 3.0, 5.5
#: A phrase around a term is an exception if it comes so often in clean texts, and at most once in so many of them in toxic ones.
EXCEPTION, RARE = 3, 20
#: Words that a shorter text counts as when weights are normalised by length.
SHORT = 20
PREFIX = range(4, 11)


def _table() -> dict[int, str]:
    table: dict[int, str] = {ord(k): v for k, v in HOMOGLYPHS.items()} | {ord(k): v for k, v in DIGITS.items()}
    for c in range(0x20, 0x7F):
        if not chr(c).isalnum() and c not in table:
            table[c] = " "
    table |= {c: " " for c in (9, 10, 11, 12, 13, 0xA0, 0xAB, 0xBB, 0x2018, 0x2019, 0x201C, 0x201D, 0x2013, 0x2014, 0x2026)}
    table |= {c: "" for c in [0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, *range(0x300, 0x370)]}
    return table


TABLE = _table()
ASCII = bytes(ord(TABLE.get(c, chr(c))) if len(TABLE.get(c, chr(c))) == 1 else c for c in range(128)) + bytes(range(128, 256))


def fold(text: str) -> str:
    """A text for matching: lower case, no accents, look-alikes and digit signs as Latin letters,
    punctuation as spaces; a space before and after."""
    if "!" in text:
        text = WITHIN.sub("i", text)
    if text.isascii():
        return f" {text.lower().encode('ascii').translate(ASCII).decode('ascii')} "
    return f" {unicodedata.normalize('NFKD', text.lower()).translate(TABLE)} "


def terms_of(text: str) -> set[str]:
    """Whole words (" word ") and beginnings of words (" beg") that a text holds."""
    out = set()
    for w in set(fold(text).split()):
        if 3 <= len(w) <= 40:
            out.add(f" {w} ")
        for n in PREFIX:
            if n < len(w):
                out.add(f" {w[:n]}")
    return out


class Lexicon:
    """Weighted terms, exception phrases and the calibration of a score."""

    def __init__(self, weights: dict[str, float], exceptions: Iterable[str] = (), line: tuple[float, float] = (-3.0, 2.0)):
        self.weights, self.exceptions, self.line = weights, sorted(exceptions), line
        self.automaton = None

    def __reduce__(self):
        return Lexicon, (self.weights, self.exceptions, self.line)

    def matches(self, folded: str) -> list[tuple[int, int, str]]:
        """(start, end, term) of the matches outside exception phrases."""
        if self.automaton is None:
            a = ahocorasick.Automaton()
            for t, w in self.weights.items():
                a.add_word(t, (t, w))
            for e in self.exceptions:
                a.add_word(e, (e, None))
            if len(a):
                a.make_automaton()
            self.automaton = a
        if not len(self.automaton):
            return []
        hits, cover = [], []
        for end, (t, w) in self.automaton.iter(folded):
            (hits if w is not None else cover).append((end + 1 - len(t), end + 1, t))
        if not cover or not hits:
            return hits
        starts, reach, most = [c[0] for c in sorted(cover)], [], 0
        for _, e, _ in sorted(cover):
            most = max(most, e)
            reach.append(most)
        at = np.searchsorted(starts, [h[0] for h in hits], side="right") - 1
        return [h for h, i in zip(hits, at.tolist()) if i < 0 or reach[i] < h[1]]

    def evidence(self, text: str) -> tuple[float, int, int]:
        """Sum of weights, matches and words of a text."""
        folded = fold(text)
        hits = self.matches(folded)
        return sum(self.weights[t] for _, _, t in hits), len(hits), len(folded.split())

    def density(self, total: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The evidence normalised by length: a text joined to itself has the same."""
        return np.log1p(100 * np.asarray(total, float) / np.maximum(SHORT, np.asarray(words, float)))

    def scores(self, total: np.ndarray, words: np.ndarray) -> np.ndarray:
        z = self.line[0] + self.line[1] * self.density(total, words)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _calibrate(lexicon: Lexicon, total: np.ndarray, words: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression on the density with a slight pull of the slope to zero, by Newton steps; classes weigh
    alike. The slope stays at zero or above, so that more evidence never lowers a score."""
    x = np.stack([np.ones(len(total)), lexicon.density(total, words)], 1)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    b, pull = np.zeros(2), np.diag([1e-6, 0.5])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + pull, x.T @ (weight * (y - p)) - pull @ b)
        b += np.clip(step, -5, 5)
        if abs(step).max() < 1e-8:
            break
    return (float(b[0]), float(b[1])) if b[1] >= 0 else (0.0, 0.0)


def _counts(sample: DataFrame, only: set[str] | None) -> DataFrame:
    """(term, toxic, n): in how many texts of each class a term occurs; only: candidates that count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                for t, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    terms = terms_of(t or "")
                    found[y].update(terms if only is None else terms & only)
        for y, c in found.items():
            if c:
                yield pa.RecordBatch.from_arrays([pa.array(c.keys(), pa.string()), pa.array([y] * len(c), pa.int32()), pa.array(c.values(), pa.int64())], names=["term", "toxic", "n"])

    return sample.select("text", "toxic").mapInArrow(run, "term string, toxic int, n long").groupBy("term", "toxic").agg(F.sum("n").alias("n"))


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of at most MAX_TOXIC and MAX_CLEAN labelled texts, by a hash of their ids; each text once, and of
    documents that repeat an id one."""
    y = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    n = {r.toxic: r.n for r in y.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = {k: min(1.0, most / max(1, n.get(k, 0))) for k, most in ((1, MAX_TOXIC), (0, MAX_CLEAN))}
    unit = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_003)) / 1_000_003
    y = y.where(unit < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))
    # its size has the bounds above
    picked = docs.select("doc_id", "text").join(F.broadcast(y), "doc_id").where("text is not null")
    picked = picked.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").alias("toxic"))
    return picked.groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("toxic").cast("int").alias("toxic")).select("text", "toxic")


def learn(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """Lexicon, exceptions and calibration from the labelled documents (labels: doc_id, toxic; more than
    one label: the highest). Without labelled rows of both classes the lexicon is empty and every score the same low one."""
    sample = written(_sample(docs, labels).repartition(32), "toxicity-sample")
    n = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return Lexicon({})
    least = max(min(5, n1), math.ceil(SUPPORT * n1))
    # what the driver gets is bounded by the sample: a hundredth of its texts hold each of these terms
    toxic = {r.term: r.n for r in _counts(sample.where("toxic = 1"), None).where(F.col("n") >= least).collect()}
    clean = {r.term: r.n for r in _counts(sample.where("toxic = 0"), set(toxic)).collect()}
    odds = {t: math.log((k + 0.5) / (n1 + 1)) - math.log((clean.get(t, 0) + 0.5) / (n0 + 1)) for t, k in toxic.items()}
    telling = {t for t, w in odds.items() if w >= (LOG_ODDS if toxic[t] >= WIDE * n1 else HIGH_ODDS)}
    kept: dict[str, float] = {}
    for t in sorted(telling, key=lambda t: (len(t.strip()), t)):  # the shortest beginning stands for what continues it ...
        stem = t.strip()
        if any(f" {stem[:n]}" in kept for n in range(PREFIX.start, len(stem) + 1)):
            continue
        more = [x for x in telling if x != t and x.startswith(t.rstrip()) and len(x.strip()) > len(stem)]
        longer = max((toxic[x] for x in more), default=0)
        if any(toxic[x] >= 0.8 * toxic[t] and odds[x] >= odds[t] + 1 for x in more):
            continue  # most of it is a longer one that tells more
        whole = f" {stem} "
        if t == whole or not (longer >= 0.95 * toxic[t] or toxic.get(whole, 0) >= 0.95 * toxic[t]):  # ... unless a longer one has as many
            kept[t] = odds[t]
    fixed = {f" {e} " for e in EXCEPTIONS}
    lexicon = Lexicon(kept, fixed)

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = Counter()
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                f = fold(t)
                for s, e, term in lexicon.matches(f):
                    e = e - 1 if term.endswith(" ") else f.index(" ", e)
                    word, near = f[s + 1 : e], []
                    if s and f[s - 1] != " ":
                        near.append(f"{f[f.rindex(' ', 0, s) + 1 : s]} {word}")
                    if f[e + 1 : e + 2].strip():
                        near.append(f"{word} {f[e + 1 : f.index(' ', e + 1)]}")
                    found.update((y, f" {p} ") for p in near)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.int32()), pa.array([k[1] for k in found]), pa.array(found.values(), pa.int64())], names=["toxic", "phrase", "n"])

    in_clean = F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0))
    in_toxic = F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0))
    odd = sample.mapInArrow(phrases, "toxic int, phrase string, n long").groupBy("phrase").agg(in_clean.alias("c"), in_toxic.alias("t"))
    harmless = {r.phrase for r in odd.where((F.col("c") >= EXCEPTION) & (F.col("t") * RARE <= F.col("c"))).select("phrase").collect()}
    lexicon = Lexicon(kept, fixed | harmless)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [lexicon.evidence(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([g[0] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.int64())], names=["toxic", "total", "words"])

    seen = np.array([tuple(r) for r in sample.mapInArrow(measure, "toxic int, total double, words long").orderBy("toxic", "total", "words").collect()], float).reshape(-1, 3)
    return Lexicon(lexicon.weights, lexicon.exceptions, _calibrate(lexicon, seen[:, 1], seen[:, 2], seen[:, 0]))


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, score, n_hits, weight): the toxicity of every whole text, 0 to 1. Null and empty
    texts have no match and get the score of no evidence. Repeated rows stay repeated; of other columns than doc_id and
    text nothing is read."""

    def make():
        def work(texts: list[str]) -> list[pa.Array]:
            got = [lexicon.evidence(t) for t in texts]
            total = np.array([g[0] for g in got], float)
            return [pa.array(lexicon.scores(total, np.array([g[2] for g in got], float))), pa.array([g[1] for g in got], pa.int64()), pa.array(total)]

        return work

    return map_texts(docs, make, "score double, n_hits long, weight double")


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Labels of these rows are never learned from; false without an id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def learned(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Lexicon:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return learn(docs, labels.where(~held_out()))


THRESHOLD = 0.7


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    lexicon = learned(spark, docs, sf_dir)
    return score(docs, lexicon).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_hits", "weight")
