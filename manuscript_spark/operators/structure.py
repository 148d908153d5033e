"""Sections, sentences, blocks, chunks and citation statements of manuscripts (doc_id, text)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.spans import bind, containing, matches, one_row, placed
from ..functions.text import WS, B, E, flow, word_count

# Abbreviations after which a full stop ends no sentence.
_ABBR = r"(?i:(?<![A-Za-z0-9_])(?:et al|e\.g|i\.e|cf|vs|fig|eq|ref|no|vol|pp)|approx)\."
SENTENCE = rf"(?s).*?(?:(?:[!?]|(?<!\d)\.(?<!{_ABBR}))[\"')\]]?[{WS}]++|(?<=\d)\.[\"')\]]?[{WS}]++(?!\d)|\z)"

# Headings that open a section of a kind.
HEADINGS = [
    ("abstract", "abstract"),
    ("references", "references|bibliography|works cited"),
    ("intro", "introduction|background|related work|literature review"),
    ("methods", "methods?|methodology|materials and methods|experimental setup|implementation|system design|approach"),
    ("results", "results?|findings|evaluation|experiments?|results and discussion"),
    ("discussion", "discussion|conclusions?|limitations?|future work"),
]
NUMBERING = rf"^[{WS}]*(?:[IVXLC]+\.|[A-H]\.|[0-9]+(?:\.[0-9]+)*\.?)[{WS}]*"
#: How every line ends that opens a section.
ENDING = rf"(?i:{'|'.join(w for _, w in HEADINGS)})[:.\u0085{WS}]*$"
#: A references section that leaves less of a document as prose is taken for a mistake.
MIN_PROSE = 0.1
TARGET_WORDS, MAX_WORDS = 200, 250
CLAIM_WORDS, CLAIM_LOWER = 12, 5
MAX_RANGE = 30


def trimmed(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, f"^[{WS}]+", ""), f"[{WS}]+$", "")


def heading_kind(line: Column) -> Column:
    """The kind of section that a line opens, else null."""

    def of(bare: Column) -> Column:
        out = F.lit(None).cast("string")
        for kind, words in reversed(HEADINGS):
            out = F.when(bare.rlike(f"^(?i:{words})$"), kind).otherwise(out)
        return F.when(F.size(F.split(bare, f"[{WS}]+")) <= 4, out)

    # no heading is longer, whatever its number, and each ends in its words: most lines need no more than one look
    short = (F.length(line) <= 80) & line.rlike(ENDING)
    return F.when(short, bind(F.trim(F.regexp_replace(F.regexp_replace(line, NUMBERING, ""), f"[:.{WS}]+$", "")), of))


def section_array(text: str | Column) -> Column:
    """array<struct<heading, kind, start, end>>: sections between recognised headings; what comes
    before the first is of kind other, and so is a text without any."""
    t = F.col(text) if isinstance(text, str) else text
    marked = placed(F.split(t, "\n"), lambda x: F.length(x) + 1, lambda at, x: F.struct(F.struct(trimmed(x).alias("heading"), heading_kind(trimmed(x)).alias("kind"), at.alias("start")).alias("h")))
    heads = F.filter(F.transform(marked, lambda m: m["h"]), lambda x: x["kind"].isNotNull())
    other = F.struct(F.lit("").alias("heading"), F.lit("other").alias("kind"), F.lit(0).alias("start"))
    lead = bind(heads, lambda h: F.when(F.coalesce(F.try_element_at(h, F.lit(1))["start"], F.lit(1)) > 0, F.concat(F.array(other), h)).otherwise(h))

    def closed(h: Column) -> Column:
        return F.transform(h, lambda x, i: F.struct(x["heading"].alias("heading"), x["kind"].alias("kind"), x["start"].alias("start"), F.coalesce(F.try_element_at(h, i + 2)["start"], F.length(t)).alias("end")))

    return F.filter(bind(lead, closed), lambda x: (x["end"] > x["start"]) | (F.length(t) == 0))


def sections(docs: DataFrame) -> DataFrame:
    s = docs.select("doc_id", F.posexplode(section_array("text")).alias("sec_no", "s"))
    return s.select("doc_id", "sec_no", "s.heading", "s.kind", "s.start", "s.end")


_BLANK = WS.replace(r"\t-\r", r"\t\x0B-\r")
#: Up to the last line that is a heading of kind references; the group ends where that line begins.
LAST_REFERENCES = rf"(?sd)\A(.*)(?m:^)[{_BLANK}]*(?:(?:[IVXLC]+\.|[A-H]\.|[0-9]+(?:\.[0-9]+)*\.?)[{_BLANK}]*)?(?i:{HEADINGS[1][1]})[:.{_BLANK}]*(?m:$)"


def prose_end(text: str | Column) -> Column:
    """Where the last references section begins; the length of the text if there is none or it begins too early."""
    t = F.col(text) if isinstance(text, str) else text
    before = F.length(F.regexp_extract(t, LAST_REFERENCES, 1))  # zero without a match
    return bind(before, lambda n: F.when(n >= F.length(t) * MIN_PROSE, n).otherwise(F.length(t)))


def sentence_array(text: str | Column) -> Column:
    """array<struct<start, end, text>> of sentences, which tile the text."""
    t = F.col(text) if isinstance(text, str) else text
    parts = F.filter(F.regexp_extract_all(t, F.lit(SENTENCE), F.lit(0)), lambda x: F.length(x) > 0)
    return placed(parts, F.length, lambda at, x: F.struct(at.alias("start"), (at + F.length(x)).alias("end"), x.alias("text")))


def sentences(docs: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    s = docs.select("doc_id", *keep, F.posexplode(sentence_array(text)).alias("sent_no", "s"))
    return s.select("doc_id", *keep, "sent_no", "s.start", "s.end", "s.text")


def prose_sentences(docs: DataFrame) -> DataFrame:
    """Sentences of the flowed text before the reference list."""
    flowed = docs.select("doc_id", F.substring(flow("text"), F.lit(1), prose_end("text")).alias("text"))
    return sentences(flowed)


def paragraph_blocks(docs: DataFrame) -> DataFrame:
    """Plain text to paragraph blocks: split at blank lines, trimmed, empty ones dropped, escaped."""
    parts = F.filter(F.transform(F.split("text", "\n{2,}"), trimmed), lambda x: x != "")
    esc = F.replace(F.replace(F.replace(F.col("t"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return docs.select("doc_id", F.posexplode(parts).alias("block_no", "t")).select("doc_id", "block_no", F.lit("paragraph").alias("type"), esc.alias("text"))


def serialized(blocks: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, block_no, start, end): the place of each block when all are joined by blank lines."""
    before = W.partitionBy("doc_id").orderBy("block_no").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(text) + 2).over(before), F.lit(0))
    return blocks.withColumn("start", start.cast("int")).withColumn("end", (start + F.length(text)).cast("int"))


def text_length(blocks: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, chars): the length of a document's blocks when all are joined by blank lines."""
    return blocks.groupBy("doc_id").agg((F.sum(F.length(text) + 2) - 2).alias("chars"))


def block_text(blocks: DataFrame) -> DataFrame:
    """The text of each block: list items by line, table cells by tab and line, an image's caption."""
    rows = F.array_join(F.transform("rows", lambda r: F.array_join(r, "\t")), "\n")
    text = F.when(F.col("type") == "list", F.array_join("items", "\n")).when(F.col("type") == "table", rows).when(F.col("type") == "image", F.coalesce("caption", F.lit(""))).otherwise(F.coalesce("text", F.lit("")))
    return blocks.withColumn("plain", text)


def rebased(findings: DataFrame, blocks: DataFrame) -> DataFrame:
    """findings (doc_id, span_start, span_end, ...) of the serialised text with block_no and the span's place in its block.
    blocks: as `serialized` gives them. Findings that begin between blocks or reach over the edge of one drop out."""
    x = containing(findings, blocks.select("doc_id", "block_no", "start", "end"), "doc_id", "span_start").where(F.col("span_end") <= F.col("end"))
    return x.select(*findings.columns, "block_no", (F.col("span_start") - F.col("start")).alias("start"), (F.col("span_end") - F.col("start")).alias("end"))


#: Of inline markup: a tag, an entity that stands for one character, or a character.
INLINE = re.compile(r"<[^>]*>|&(?:[a-zA-Z]+|#[0-9]+|#[xX][0-9a-fA-F]+);|.", re.S)


def mark_spans(html: str, spans: list[tuple[int, int, str]]) -> str:
    """html with <mark data-addr> around spans (start, end, address) of its plain text. A span that overlaps the one before
    it in order of start is left out. A mark is closed before a tag and opened again behind it; an entity isn't cut."""
    spans = sorted((s for s in spans if s[1] > s[0]), key=lambda s: s[0])
    spans = [s for i, s in enumerate(spans) if not i or s[0] >= spans[i - 1][1]]
    of = {}
    for start, end, addr in spans:
        of.update(dict.fromkeys(range(start, end), f'<mark data-addr="{addr}">'))
    out, at, now = [], 0, None
    for m in INLINE.finditer(html):
        tag = m[0][0] == "<" and m[0][-1] == ">" and len(m[0]) > 1
        want = None if tag else of.get(at)
        if want != now:
            out.append(("</mark>" if now else "") + (want or ""))
            now = want
        out.append(m[0])
        at += not tag
    return "".join(out) + ("</mark>" if now else "")


def marked_blocks(blocks: DataFrame, spans: DataFrame) -> DataFrame:
    """blocks (doc_id, block_no, type, text) with marks: spans (doc_id, block_no, start, end, address), as `rebased` places
    them. Only paragraphs, headings and quotes are marked."""

    @F.pandas_udf("string")
    def insert(text: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or f is None else mark_spans(t, [(s["start"], s["end"], s["address"]) for s in f]) for t, f in zip(text, found)], dtype=object)

    s = spans.groupBy(F.col("doc_id").alias("s_doc"), F.col("block_no").alias("s_block")).agg(F.collect_list(F.struct("start", "end", "address")).alias("spans"))
    x = blocks.join(s, (F.col("doc_id") == F.col("s_doc")) & (F.col("block_no") == F.col("s_block")), "left")
    there = F.col("type").isin("paragraph", "heading", "quote") & F.col("spans").isNotNull()
    return x.withColumn("text", F.when(there, insert("text", "spans")).otherwise(F.col("text"))).select(*blocks.columns)


def truncate_blocks(blocks: DataFrame, limit: int = 2_000_000) -> DataFrame:
    """Whole blocks while their lengths (and two for each joint) fit the limit; a first block that is
    too long itself is cut at the last space behind the middle, else hard."""
    total = F.sum(F.length("text") + 2).over(W.partitionBy("doc_id").orderBy("block_no").rowsBetween(W.unboundedPreceding, 0))
    n = blocks.withColumn("upto", total).withColumn("n", F.row_number().over(W.partitionBy("doc_id").orderBy("block_no")))
    head = F.substring("text", 1, limit)
    at = F.length(head) - F.instr(F.reverse(head), " ")
    cut = F.when((F.instr(head, " ") > 0) & (at > limit / 2), F.substring(head, F.lit(1), at)).otherwise(head)
    kept = n.where((F.col("upto") <= limit) | (F.col("n") == 1))
    over = F.col("upto") > limit
    return kept.select("doc_id", "block_no", F.when(over, cut).otherwise(F.col("text")).alias("text"), over.alias("cut"))


def chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, chunk_no, kind, start, end, words): sentences packed to TARGET_WORDS with one sentence
    of overlap, never over a section's edge, without references; a sentence of MAX_WORDS is its own chunk."""
    base = docs.select("doc_id", flow("text").alias("flowed"), F.explode(section_array("text")).alias("s")).where("s.kind <> 'references'")
    body = F.substring(F.col("flowed"), F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
    spans = F.transform(sentence_array(body), lambda x: F.struct((x["start"] + F.col("s.start")).alias("start"), (x["end"] + F.col("s.start")).alias("end"), word_count(x["text"]).alias("w")))
    state = "struct<out:array<struct<start:int,end:int,w:int>>,first:int,end:int,w:int,n:int,last:struct<start:int,end:int,w:int>>"
    zero = F.struct(F.array().cast("array<struct<start:int,end:int,w:int>>").alias("out"), F.lit(0).alias("first"), F.lit(0).alias("end"), F.lit(0).alias("w"), F.lit(0).alias("n"), F.lit(None).cast("struct<start:int,end:int,w:int>").alias("last")).cast(state)

    def item(a: Column, b: Column, w: Column) -> Column:
        return F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), w.cast("int").alias("w"))

    def make(out: Column, first: Column, end: Column, w: Column, n: Column, last: Column) -> Column:
        return F.struct(out.alias("out"), first.cast("int").alias("first"), end.cast("int").alias("end"), w.cast("int").alias("w"), n.cast("int").alias("n"), last.alias("last")).cast(state)

    def flushed(a: Column) -> Column:
        return F.when((a["n"] > 0) & (a["w"] > 0), F.concat(a["out"], F.array(item(a["first"], a["end"], a["w"])))).otherwise(a["out"])

    def step(a: Column, x: Column) -> Column:
        none = F.lit(None).cast("struct<start:int,end:int,w:int>")
        alone = make(F.concat(flushed(a), F.array(item(x["start"], x["end"], x["w"]))), F.lit(0), F.lit(0), F.lit(0), F.lit(0), none)
        first, w, n = F.when(a["n"] > 0, a["first"]).otherwise(x["start"]), a["w"] + x["w"], a["n"] + 1
        own = item(x["start"], x["end"], x["w"])
        grown = make(a["out"], first, x["end"], w, n, own)
        full = F.concat(a["out"], F.array(item(first, x["end"], w)))
        carried = F.when(n > 1, make(full, x["start"], x["end"], x["w"], F.lit(1), own)).otherwise(make(full, F.lit(0), F.lit(0), F.lit(0), F.lit(0), none))
        return F.when(x["w"] >= MAX_WORDS, alone).when(w >= TARGET_WORDS, carried).otherwise(grown)

    packed = base.select("doc_id", F.col("s.kind").alias("kind"), F.col("s.start").alias("sec_start"), F.aggregate(spans, zero, step, flushed).alias("out"))
    rows = packed.select("doc_id", "kind", "sec_start", F.explode("out").alias("c"))
    n = F.row_number().over(W.partitionBy("doc_id").orderBy("sec_start", "c.start", "c.end")) - 1
    return rows.select("doc_id", n.alias("chunk_no"), "kind", "c.start", "c.end", F.col("c.w").alias("words"))


def looks_like_claim(sentence: Column) -> Column:
    lower = F.regexp_count(sentence, F.lit(f"{B}[a-z]{{3,}}{E}"))
    return (word_count(sentence) >= CLAIM_WORDS) & (lower >= CLAIM_LOWER)


def _cut(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def reference_entries(docs: DataFrame) -> DataFrame:
    """(doc_id, number, start, end): entries of the last references section, from mark to mark."""
    e = docs.select("doc_id", F.explode(_entry_array("text")).alias("e"))
    return e.select("doc_id", "e.number", "e.start", "e.end")


def _entry_array(text: str) -> Column:
    """array<struct<number, start, end>> of the entries; null without a list."""

    def of(x: Column) -> Column:
        sec = F.element_at(F.filter(x["secs"], lambda s: s["kind"] == "references"), -1)
        return F.when(x["prose_end"] < F.length(text), bind(F.struct(sec["start"].alias("base"), sec["end"].alias("limit")), marked))

    def marked(x: Column) -> Column:
        m = matches(flow(_cut(F.col(text), x["base"], x["limit"])), r"\[[0-9]{1,3}\]")
        return bind(m, lambda m: F.transform(m, lambda k, i: F.struct(F.regexp_extract(k["text"], "[0-9]+", 0).cast("int").alias("number"), (k["start"] + x["base"]).alias("start"), F.coalesce(F.try_element_at(m, i + 2)["start"] + x["base"], x["limit"]).alias("end"))))

    return bind(F.struct(prose_end(text).alias("prose_end"), section_array(text).alias("secs")), of)


def statements(docs: DataFrame, identifiers: DataFrame) -> DataFrame:
    """Sentences that cite a work: (doc_id, start, end, sentence, markers, ids, linked_by).

    identifiers: doc_id, kind, id, offset. Markers link through the reference list (of a number that
    returns the last entry counts), identifiers in the sentence itself by place. One shuffle brings a document and its
    identifiers together; the rest is worked out on that row."""
    i = identifiers.groupBy(F.col("doc_id").alias("i_doc")).agg(F.array_sort(F.collect_list(F.struct("offset", "kind", "id"))).alias("found"))
    d = docs.select("doc_id", "text").join(i, F.col("doc_id") == F.col("i_doc"))
    sents = F.filter(sentence_array(F.substring(flow("text"), F.lit(1), prose_end("text"))), lambda s: looks_like_claim(s["text"]))
    d = one_row(d, ["doc_id", "found"], sents=sents, entries=F.coalesce(_entry_array("text"), F.array().cast("array<struct<number:int,start:int,end:int>>")))
    inside = lambda x: F.filter("found", lambda f: (f["offset"] >= x["start"]) & (f["offset"] < x["end"]))
    linking = F.filter(F.transform("entries", lambda e: F.struct(e["number"].alias("number"), inside(e).alias("ids"))), lambda e: F.size(e["ids"]) > 0)
    # at most as many numbers as three digits give, each with its last entry that holds an identifier
    last = bind(F.reverse(linking), lambda r: bind(F.transform(r, lambda e: e["number"]), lambda n: F.map_from_entries(F.transform(F.array_distinct(n), lambda k: F.struct(k.alias("number"), F.element_at(r, F.array_position(n, k).cast("int"))["ids"].alias("ids"))))))
    d = one_row(d, ["doc_id", "found", "sents"], last=last)
    sent = d.select("doc_id", "last", "found", F.explode("sents").alias("s"))
    marks = F.regexp_extract_all(F.col("s.text"), F.lit(r"\[[0-9]{1,3}\](?:[" + WS + r"]*[–—-][" + WS + r"]*\[[0-9]{1,3}\])?"), F.lit(0))
    ends = F.transform(marks, lambda m: F.transform(F.regexp_extract_all(m, F.lit(r"\[([0-9]{1,3})\]"), F.lit(1)), lambda x: x.cast("int")))
    none = F.array().cast("array<int>")
    numbers = F.transform(ends, lambda x: F.when(F.element_at(x, -1) < x[0], none).when(F.element_at(x, -1) - x[0] > MAX_RANGE, none).otherwise(F.sequence(x[0], F.element_at(x, -1))))
    sent = one_row(sent, ["doc_id", "s", "last", "found"], marks=F.array_distinct(F.flatten(numbers)))
    by_mark = F.flatten(F.filter(F.transform("marks", lambda n: F.try_element_at("last", n)), lambda x: x.isNotNull()))
    links = one_row(sent, ["doc_id", "s", "marks"], by_mark=by_mark, inline=inside(F.col("s"))).where((F.size("by_mark") > 0) | (F.size("inline") > 0))
    ids = F.array_distinct(F.transform(F.concat("by_mark", "inline"), lambda x: F.concat_ws(":", x["kind"], x["id"])))
    return links.select("doc_id", "s.start", "s.end", F.trim("s.text").alias("sentence"), F.array_sort("marks").alias("markers"), ids.alias("ids"), F.when(F.size("by_mark") > 0, "bracket").otherwise("inline").alias("linked_by"))
