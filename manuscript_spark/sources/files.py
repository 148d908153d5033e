"""Files as documents, glossaries, and history; sinks for findings."""

from __future__ import annotations

import io
import os
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.report import history_kept
from .html import BLOCK, FIELDS

NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def kind_of(content: str | Column) -> Column:
    """What the first bytes of a file say it is: pdf, docx, legacy-doc or unknown."""
    c = F.col(content) if isinstance(content, str) else content
    head = lambda n: F.hex(F.substring(c, 1, n))
    return F.when(head(5) == "255044462D", "pdf").when(head(4) == "504B0304", "docx").when(head(4) == "D0CF11E0", "legacy-doc").otherwise("unknown")


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", "content", kind_of("content").alias("kind"))


def docx_blocks_of(data: bytes) -> list[dict]:
    """Headings, paragraphs, lists and tables of a DOCX file; nothing of what can't be read."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{NS}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return []
    esc = lambda t: t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    text_of = lambda e: esc("".join(t.text or "" for t in e.iter(f"{NS}t"))).strip()
    out: list[dict] = []
    for e in body if body is not None else ():
        if e.tag == f"{NS}tbl":
            rows = [[text_of(c) for c in r.findall(f"{NS}tc")] for r in e.findall(f"{NS}tr")]
            if rows:
                out.append({"type": "table", "rows": rows})
        elif e.tag == f"{NS}p" and (text := text_of(e)):
            style = e.find(f"{NS}pPr/{NS}pStyle")
            name = (style.get(f"{NS}val") if style is not None else "") or ""
            if name.lower().startswith("heading") and name[-1:].isdigit():
                out.append({"type": "heading", "level": min(3, int(name[-1])), "text": text})
            elif e.find(f"{NS}pPr/{NS}numPr") is not None:
                if out and out[-1]["type"] == "list":
                    out[-1]["items"].append(text)
                else:
                    out.append({"type": "list", "ordered": False, "items": [text]})
            else:
                out.append({"type": "paragraph", "text": text})
    return out


@F.pandas_udf(BLOCK)
def _docx(content: pd.Series) -> pd.Series:
    return content.map(lambda c: [{f: b.get(f) for f in FIELDS} for b in docx_blocks_of(bytes(c or b""))])


def docx_blocks(files: DataFrame, key: str = "path") -> DataFrame:
    b = files.where(kind_of("content") == "docx").select(key, F.posexplode(_docx("content")).alias("block_no", "b"))
    return b.select(key, "block_no", *[f"b.{f}" for f in FIELDS])


def glossary_path(folder: str, env: str = "GLOSSARY_PATH") -> str:
    """Where the glossary is: the environment's word, else glossary.json, else the example."""
    if os.environ.get(env):
        return os.environ[env]
    own = os.path.join(folder, "glossary.json")
    return own if os.path.exists(own) else os.path.join(folder, "glossary.example.json")


ENTRY = "slug string, term string, definition string, variants array<string>, en struct<slug:string,term:string,definition:string>"


def glossary(spark: SparkSession, path: str) -> DataFrame:
    """(slug, term, definition, variants) of a glossary file: a bare array of entries, or an object with `terms`; an
    entry's English part counts if it has one. Entries without an English term drop out."""
    text = spark.read.text(path, wholetext=True)
    bare = F.from_json("value", f"array<struct<{_ddl(ENTRY)}>>")
    envelope = F.from_json("value", f"struct<terms:array<struct<{_ddl(ENTRY)}>>>")["terms"]
    e = text.select(F.explode(F.when(F.ltrim("value").startswith("["), bare).otherwise(envelope)).alias("e"))
    term = F.coalesce("e.en.term", "e.term")
    return e.select(F.coalesce("e.slug", "e.en.slug").alias("slug"), term.alias("term"), F.coalesce("e.en.definition", "e.definition", F.lit("")).alias("definition"), F.coalesce("e.variants", F.array().cast("array<string>")).alias("variants")).where("term is not null")


def _ddl(fields: str) -> str:
    import re

    return re.sub(r"(?:^|, )(\w+) ", lambda m: ("," if m[0].startswith(",") else "") + m[1] + ":", fields)


def jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Rows of a JSONL corpus; blank lines are none."""
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def write_findings(findings: DataFrame, path: str, format: str = "parquet", by: str | None = "check") -> None:
    w = findings.write.mode("overwrite").format(format)
    (w.partitionBy(by) if by else w).save(path)


def append_history(runs: DataFrame, path: str) -> None:
    """Append runs; columns that look like secrets are refused."""
    bad = [c for c in runs.columns if any(x in c.lower() for x in ("key", "secret", "token", "password"))]
    if bad:
        raise ValueError(f"history must not hold {bad}")
    runs.write.mode("append").parquet(path)


def history(spark: SparkSession, path: str, cap: int = 500) -> DataFrame:
    return history_kept(spark.read.parquet(path), cap)
