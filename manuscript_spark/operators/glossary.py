"""Near misses of glossary terms."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.spans import greedy_cover, matches, one_row
from ..functions.text import MATCH_STOP, fold, fold_one, jaccard, tokens_of_folded

THRESHOLD = 0.75
#: Glossaries with more index rows than this are joined by a shuffle, not broadcast.
BROADCAST_ROWS = 200_000
STOP = frozenset(MATCH_STOP)
TOKEN = re.compile("[A-Za-z0-9]+")


def terms(raw: DataFrame) -> DataFrame:
    """(slug, canonical, variants, stub, single_word_allowed) from rows (slug, term, definition,
    variants, single_word_allowed): base-N with the definition of base becomes its variant; a definition that
    begins with 'see "' makes a stub."""
    r = raw.where("slug is not null and term is not null and term <> ''").select("slug", "term", F.coalesce("definition", F.lit("")).alias("definition"), F.coalesce("variants", F.array().cast("array<string>")).alias("variants"), F.coalesce("single_word_allowed", F.lit(False)).alias("single_word_allowed"))
    base = F.regexp_extract("slug", "^(.+)-[0-9]+$", 1)
    d = r.withColumn("base", base).where("base <> '' and definition <> ''").alias("d")
    dup = d.join(r.alias("r"), (F.col("d.base") == F.col("r.slug")) & (F.col("d.definition") == F.col("r.definition"))).select(F.col("d.slug"), F.col("d.base"), F.concat(F.array("d.term"), F.col("d.variants")).alias("more"))
    extra = dup.groupBy("base").agg(F.flatten(F.collect_list("more")).alias("more"))
    kept = r.join(dup.select("slug"), "slug", "left_anti").join(extra, F.col("slug") == F.col("base"), "left")
    return kept.select("slug", F.col("term").alias("canonical"), F.array_distinct(F.concat("variants", F.coalesce("more", F.array().cast("array<string>")))).alias("variants"), F.lower("definition").startswith('see "').alias("stub"), "single_word_allowed")


def name_and_acronym(term: Column) -> tuple[Column, Column]:
    acronym = F.regexp_extract(term, r"\(([^\s()]{2,16})\)", 1)
    name = F.when(acronym != "", F.trim(F.regexp_replace(F.regexp_replace(term, r"\([^\s()]{2,16}\)", " "), r"\s+", " "))).otherwise(term)
    return name, acronym


def inflections(token: Column) -> Column:
    """A token, and its forms with or without a plural ending."""
    less = F.when((F.length(token) > 3) & token.endswith("s") & ~token.endswith("ss"), F.substring(token, F.lit(1), F.length(token) - 1))
    more = F.when(token.rlike("(s|x|z|ch|sh)$"), F.concat(token, F.lit("es")))
    return F.filter(F.array(token, less, F.concat(token, F.lit("s")), more), lambda x: x.isNotNull())


def index(terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """accepted (key, slugs): forms that are right as they stand; names (slug, name_key, tokens,
    token): names of two tokens or more that are looked for, a row for each of their tokens."""
    name, acronym = name_and_acronym(F.col("canonical"))
    t = terms.withColumns({"name": name, "acronym": acronym})
    forms = F.filter(F.concat(F.array("canonical", "name", "acronym"), "variants"), lambda x: x != "")
    f = t.select("slug", F.explode(F.array_distinct(forms)).alias("form")).withColumn("tok", tokens_of_folded(fold("form"))).where(F.size("tok") > 0)
    last = F.element_at("tok", -1)
    head = F.slice(F.col("tok"), F.lit(1), F.size("tok") - 1)
    keys = F.transform(inflections(last), lambda x: F.array_join(F.concat(head, F.array(x)), " "))
    accepted = f.select("slug", F.explode(keys).alias("key")).groupBy("key").agg(F.collect_set("slug").alias("slugs"), F.max(F.size(F.split("key", " "))).alias("n_tokens"))
    n = t.where("not stub").withColumn("tokens", tokens_of_folded(fold("name"))).where(F.size("tokens") >= 2)
    names = n.select("slug", "canonical", F.array_join("tokens", " ").alias("name_key"), "tokens", F.explode(F.array_distinct("tokens")).alias("token"))
    return accepted, names


def _content(t: Column) -> Column:
    kept = F.filter(t, lambda x: ~x.isin(MATCH_STOP))
    return F.when(F.size(kept) > 0, kept).otherwise(t)


def in_order(window: Column, candidate: Column) -> Column:
    """Do the shared tokens keep the candidate's order?"""
    at = F.filter(F.transform(window, lambda x: F.array_position(candidate, x)), lambda p: p > 0)
    return at == F.array_sort(at)


class Searcher:
    """The index in memory, for one document at a time; gives what `_by_shuffle` gives. accepted: right keys; names: (slug,
    name_key, tokens); most, longest: the most tokens of a name, and of a name or right key."""

    def __init__(self, accepted: set[str], names: list[tuple[str, str, list[str]]], most: int, longest: int, threshold: float):
        self.accepted, self.most, self.longest, self.threshold = accepted, most, longest, threshold
        self.names = [(slug, tokens, {t: i for i, t in reversed(list(enumerate(tokens)))}, self.content(tokens)) for slug, _, tokens in names]
        self.of_token: dict[str, list[int]] = {}
        for i, (_, _, first, _) in enumerate(self.names):
            for t in first:
                self.of_token.setdefault(t, []).append(i)
        self.words = {w for key in accepted for w in key.split(" ")}

    @staticmethod
    def content(tokens: list[str]) -> set[str]:
        return set([t for t in tokens if t not in STOP] or tokens)

    def best(self, phrase: list[str]) -> tuple[str, float] | None:
        """The one term that a phrase is nearest to, if near enough and in its order."""
        own = self.content(phrase)
        top, at = -1.0, []
        for i in {i for t in phrase for i in self.of_token.get(t, ())}:
            slug, tokens, first, content = self.names[i]
            if abs(len(tokens) - len(phrase)) <= 1:
                similarity = len(own & content) / len(own | content)
                if similarity > top:
                    top, at = similarity, [i]
                elif similarity == top:
                    at.append(i)
        if not at or not self.threshold <= top < 1 or len({self.names[i][0] for i in at}) != 1:
            return None
        for i in at:
            places = [self.names[i][2][t] for t in phrase if t in self.names[i][2]]
            if places == sorted(places):
                return self.names[i][0], top
        return None

    def search(self, text: str) -> list[tuple[str, int, int, str, float]]:
        """(slug, start, end, quoted, similarity) in order of place."""
        spans = [m.span() for m in TOKEN.finditer(text)] if text.isascii() else _token_spans(text)
        norm = [fold_one(text[a:b]) for a, b in spans]
        if not any(w in self.words or w in self.of_token for w in norm):
            return []
        par = [a > 0 and text[a - 1] == "(" and text[b : b + 1] == ")" for a, b in spans]
        total = len(norm)
        right, maybe = [], []
        for i in range(total):
            phrase: list[str] = []
            for n in range(1, min(self.longest + 1, total - i) + 1):
                if not par[i + n - 1]:
                    phrase = [*phrase, norm[i + n - 1]]
                key = " ".join(phrase)
                if not key:
                    continue
                if key in self.accepted:
                    if n <= self.longest:
                        right.append((-n, i))
                elif 2 <= n <= self.most + 1 and len(phrase) >= 2 and phrase[0] not in STOP and phrase[-1] not in STOP:
                    maybe.append((i, n, phrase))
        taken = bytearray(total)  # right forms, the longest first, none over another
        for less, i in sorted(right):
            if not any(taken[i : i - less]):
                taken[i : i - less] = b"\1" * -less
        short: dict[tuple[str, int], tuple[int, float, int, str]] = {}
        for i, n, phrase in maybe:
            if not any(taken[i : i + n]) and (found := self.best(phrase)):
                slug, similarity = found
                start, end = spans[i][0], spans[i + n - 1][1]
                if (slug, start) not in short or n < short[slug, start][0]:
                    short[slug, start] = (n, similarity, end, slug)
        out, upto = [], 0
        for start, less, _, end, slug in sorted((start, -similarity, n, end, slug) for (_, start), (n, similarity, end, slug) in short.items()):
            if start >= upto:  # in order of start, so an overlap is one with the last kept
                out.append((slug, start, end, text[start:end], -less))
                upto = end
        return out


def _token_spans(text: str) -> list[tuple[int, int]]:
    """Runs of letters, digits and marks."""
    kinds = "".join("x" if unicodedata.category(c)[0] in "LNM" else " " for c in text)
    return [m.span() for m in TOKEN.finditer(kinds)]


def _by_document(docs: DataFrame, accepted: DataFrame, names: DataFrame, threshold: float) -> DataFrame:
    """An index within BROADCAST_ROWS is held by each task, so that a document is searched where it is read, without a shuffle."""
    keys = {r.key for r in accepted.select("key").collect()}
    rows = names.select("slug", "name_key", "tokens").distinct().collect()
    most = max((len(r.tokens) for r in rows), default=0)
    longest = max([most, *(len(k.split(" ")) for k in keys)])
    index_ = docs.sparkSession.sparkContext.broadcast((keys, [(r.slug, r.name_key, list(r.tokens)) for r in rows], most, longest, threshold))

    @F.pandas_udf("array<struct<slug:string,start:int,end:int,quoted:string,similarity:double>>")
    def search(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        searcher = Searcher(*index_.value)
        for part in parts:
            yield pd.Series([[dict(zip(("slug", "start", "end", "quoted", "similarity"), x)) for x in searcher.search(t)] if t else [] for t in part], dtype=object)

    x = docs.select("doc_id", F.explode(search("text")).alias("x"))
    return x.select("doc_id", "x.slug", "x.start", "x.end", "x.quoted", F.round("x.similarity", 4).alias("similarity"))


def near_misses(docs: DataFrame, terms: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, slug, start, end, quoted, similarity): spans that nearly are a term, one term and no other."""
    accepted, names = index(terms)
    size = names.count()
    if size <= BROADCAST_ROWS and accepted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return _by_document(docs, accepted, names, threshold)
    return _by_shuffle(docs, accepted, names, size, threshold)


def _by_shuffle(docs: DataFrame, accepted: DataFrame, names: DataFrame, size: int, threshold: float) -> DataFrame:
    """Windows of all documents as rows that are joined to the index, whatever its size."""
    hint = F.broadcast if size <= BROADCAST_ROWS else (lambda d: d)
    most = names.agg(F.max(F.size("tokens"))).first()[0] or 0
    longest = max(most, accepted.agg(F.max("n_tokens")).first()[0] or 0)
    tok = F.filter(
        F.transform(matches("text", r"[\p{L}\p{N}\p{M}]+"), lambda m: F.struct(m["start"].alias("start"), (m["start"] + F.length(m["text"])).alias("end"), m["text"].alias("raw"))), lambda x: F.length(x["raw"]) > 0
    )
    d = one_row(docs, ["doc_id", "text"], tok=tok).where(F.size("tok") > 0)
    # one fold for each document: the joined tokens, cut apart again
    norm = F.split(fold(F.array_join(F.transform("tok", lambda x: x["raw"]), "\n")), "\n")
    around = lambda x: (F.substring(F.col("text"), x["start"], F.lit(1)) == "(") & (F.substring(F.col("text"), x["end"] + 1, F.lit(1)) == ")") & (x["start"] > 0)
    each = F.zip_with("tok", "norm", lambda x, w: F.struct(x["start"].alias("start"), x["end"].alias("end"), w.alias("norm"), around(x).alias("par")))
    d = one_row(d.withColumn("norm", norm), ["doc_id"], each=each)
    # from each token as many as a window may hold, so that no row carries the whole document
    w = d.select("doc_id", F.posexplode(F.transform("each", lambda x, i: F.slice("each", i + 1, F.lit(longest + 1)))).alias("i", "ahead"))
    w = w.select("doc_id", (F.col("i") + 1).alias("i"), "ahead", F.explode(F.sequence(F.lit(1), F.size("ahead"))).alias("n"))
    window = F.slice("ahead", F.lit(1), F.col("n"))
    words, flags = F.transform(window, lambda x: x["norm"]), F.transform(window, lambda x: x["par"])
    phrase = F.filter(F.zip_with(words, flags, lambda a, p: F.when(~p, a)), lambda x: x.isNotNull())
    w = w.select("doc_id", "n", "i", F.element_at("ahead", 1)["start"].alias("start"), F.element_at("ahead", F.col("n"))["end"].alias("end"), phrase.alias("phrase")).withColumn("key", F.array_join("phrase", " "))
    w = w.where("key <> ''")
    keys = hint(accepted.select("key"))
    right = w.where(F.col("n") <= longest).join(keys, "key", "left_semi")
    claimed = right.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("order"), "i", F.col("i").alias("start"), (F.col("i") + F.col("n")).alias("end")))).alias("c"))
    claimed = claimed.select(F.col("doc_id").alias("d"), greedy_cover(F.col("c")).alias("claimed"))
    first, last = F.element_at("phrase", 1), F.element_at("phrase", -1)
    c = w.where((F.col("n") >= 2) & (F.col("n") <= most + 1) & (F.size("phrase") >= 2) & ~first.isin(MATCH_STOP) & ~last.isin(MATCH_STOP)).join(keys, "key", "left_anti")
    found = c.withColumn("token", F.explode(F.array_distinct("phrase"))).join(hint(names), "token").where(F.abs(F.size("tokens") - F.size("phrase")) <= 1)
    found = found.select("doc_id", "n", "i", "start", "end", "phrase", "slug", "name_key", "tokens").dropDuplicates(["doc_id", "n", "i", "slug", "name_key"])
    found = found.join(claimed, F.col("doc_id") == F.col("d"), "left").where(~F.coalesce(F.exists("claimed", lambda k: (k["start"] < F.col("i") + F.col("n")) & (F.col("i") < k["end"])), F.lit(False)))
    found = found.withColumn("similarity", jaccard(_content(F.col("phrase")), _content(F.col("tokens"))))
    per = W.partitionBy("doc_id", "n", "i")
    best = found.withColumn("top", F.max("similarity").over(per)).where("similarity = top")
    best = best.withColumn("slugs", F.size(F.collect_set("slug").over(per))).where((F.col("slugs") == 1) & (F.col("top") >= threshold) & (F.col("top") < 1))
    best = best.where(in_order(F.col("phrase"), F.col("tokens"))).dropDuplicates(["doc_id", "n", "i", "slug"])
    short = best.withColumn("r", F.row_number().over(W.partitionBy("doc_id", "slug", "start").orderBy("n"))).where("r = 1")
    rows = short.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("start").alias("start"), (-F.col("similarity")).alias("less"), "n", "end", "slug"))).alias("s"))
    out = rows.select("doc_id", F.explode(greedy_cover(F.col("s"))).alias("x")).join(docs.select("doc_id", "text"), "doc_id")
    return out.select("doc_id", "x.slug", "x.start", "x.end", F.substring(F.col("text"), F.col("x.start") + 1, F.col("x.end") - F.col("x.start")).alias("quoted"), F.round(-F.col("x.less"), 4).alias("similarity"))
