"""WARC archives: writing, and reading by boundary-chain verification.

An archive is read in blocks by many tasks. A task can't know whether the magic string that it sees
begins a record or lies inside a payload, so it emits every place as a candidate with the offset of
its successor. Pointer jumping from the start of each file, doubling the reach with each round,
marks the candidates that the chain of records visits; the others are rejected. Every step is made
of DataFrame operations.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .shared import fresh_path, remove, written

MAGIC = "WARC/1.0\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Records in a file, at most.
RECORDS = 4096
#: Classes of page_ids that hold a page whose payload occurs more than once: the bound of a broadcast.
CLASSES = 1 << 17
#: Files that are named to the reader when broken payloads are read again; with more, all files are read.
NAMED_FILES = 10_000


def base32(hexdigest: Column) -> Column:
    """Bare upper-case base32 of a SHA-1 in hexadecimal: ten digits are 40 bits, eight signs."""
    part = [F.lpad(F.conv(F.substring(hexdigest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*part), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def records_of(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, refers_to) with refers_to the page_id of the response that has
    the same payload, null for the response itself: the page (or all rows of it) with the smallest
    page_id. Pages without a page_id are responses only if no page with one has the payload. Other columns
    of pages are not read.

    Which payloads are equal is found from a table of ids and digests. Payloads aren't shuffled unless a page is in a
    class of page_ids with a revisit in it; with far more revisits than CLASSES nearly every class has one,
    and then every payload is shuffled once, by page_id and digest.
    """
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    hexdigest = F.sha1(F.col("payload").cast("binary"))
    narrow = written(pages.select("page_id", hexdigest.alias("hex")), "warc-digests")
    first = narrow.groupBy("hex").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("hex", "first")
    revisits = written(narrow.join(first, "hex").where("first is not null and not page_id <=> first").select("page_id", "hex", F.col("first").alias("refers_to")).distinct(), "warc-revisits")
    in_class = F.coalesce(F.pmod(F.xxhash64("page_id"), F.lit(CLASSES)), F.lit(-1))
    classes = F.broadcast(revisits.select(in_class.alias("class")).distinct())  # CLASSES + 1 rows at most
    pages = pages.withColumn("class", in_class)
    plain = pages.join(classes, "class", "left_anti").withColumn("refers_to", F.lit(None).cast("long"))
    r = revisits.select(F.col("page_id").alias("r_page"), F.col("hex").alias("r_hex"), "refers_to")
    looked = pages.join(classes, "class", "left_semi").withColumn("hex", hexdigest)
    looked = looked.join(r, F.col("page_id").eqNullSafe(F.col("r_page")) & (F.col("hex") == F.col("r_hex")), "left")
    cols = ("page_id", "url", "payload", "refers_to")
    return plain.select(*cols).unionByName(looked.select(*cols))


def write_archive(pages: DataFrame, path: str) -> None:
    """Write one record per page (page_id, url, html; null html: empty payload) to uncompressed WARC
    files. A revisit has no payload but tells the digest and length of the full one. A missing page_id
    or url leaves out its header; line ends in a url are removed."""
    r = records_of(pages).withColumn("hex", F.sha1(F.col("payload").cast("binary")))
    revisit = F.col("refers_to").isNotNull()
    eol = F.lit("\r\n")

    def header(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, eol), F.lit(""))

    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    text = F.concat(
        F.lit(MAGIC),
        F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), eol,
        header("WARC-Record-ID", urn(F.col("page_id"))),
        header("WARC-Target-URI", F.regexp_replace("url", "[\r\n]", "")),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z\r\n"),
        F.lit("WARC-Payload-Digest: sha1:"), base32(F.col("hex")), eol,
        header("WARC-Refers-To", urn(F.col("refers_to"))),
        F.lit("X-Payload-Length: "), F.octet_length("payload").cast("string"), eol,
        F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.octet_length("payload")).cast("string"), eol,
        eol,
        F.when(revisit, F.lit("")).otherwise(F.col("payload")),
        eol,  # the second line end of the record is the writer's
    )
    r.select(text.alias("value")).write.option("lineSep", "\r\n").option("maxRecordsPerFile", RECORDS).text(path)


def _pieces(spark: SparkSession, paths: list[str]) -> DataFrame:
    """What lies between the magic strings of files: file, block, seq (in order within a block), value."""
    raw = spark.read.option("lineSep", MAGIC).text(paths)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), "value")


def _placed(pieces: DataFrame) -> DataFrame:
    """Adds off, the place of the magic before each piece (negative: the file begins with the piece).
    Blocks follow each other without a gap, so that lengths add up to places: within a block, and over
    the blocks of a file."""
    size = len(MAGIC)
    order = W.partitionBy("file", "block").orderBy("seq")
    inner = pieces.withColumn("inner", F.sum(F.col("size") + size).over(order.rowsBetween(W.unboundedPreceding, -1)))
    totals = pieces.groupBy("file", "block").agg(F.sum(F.col("size") + size).alias("total"))
    before = totals.withColumn("before", F.sum("total").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)))
    placed = inner.join(before.select("file", "block", "before"), ["file", "block"])
    return placed.withColumn("off", F.coalesce("before", F.lit(0)) + F.coalesce("inner", F.lit(0)) - size).drop("inner", "before")


def _header(name: str) -> Column:
    return F.regexp_extract(F.concat(F.lit("\r\n"), F.col("head")), rf"(?i)\r\n{name}:[ \t]*([^\r\n]*)", 1)


def candidates(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Every place of the magic string: file, block, seq, off, next (of its successor; null: no
    record can begin here), header fields; whole: its payload ends before the next magic string; then
    also bytes and hexadecimal digest of the payload."""
    p = _pieces(spark, paths)
    p = p.withColumn("size", F.octet_length("value").cast("long"))
    p = p.withColumn("head", F.when(F.instr("value", "\r\n\r\n") > 0, F.substring_index("value", "\r\n\r\n", 1)))
    p = p.withColumn("head_size", (F.octet_length("head") + 4).cast("long")).withColumn("length", F.nullif(_header("Content-Length"), F.lit("")).try_cast("long"))
    p = p.withColumn("whole", F.coalesce(F.col("size") == F.col("head_size") + F.col("length") + 4, F.lit(False)))
    payload = F.substring(F.col("value").cast("binary"), (F.col("head_size") + 1).cast("int"), F.col("length").cast("int"))
    p = p.withColumn("hex", F.when(F.col("whole"), F.sha1(payload)))
    urn = lambda name: F.regexp_extract(_header(name), "<urn:page:(-?[0-9]+)>", 1)
    p = p.select(
        "file", "block", "seq", "size", "head_size", "length", "whole", "hex",
        F.lower(_header("WARC-Type")).alias("type"), F.nullif(urn("WARC-Record-ID"), F.lit("")).try_cast("long").alias("page_id"), F.nullif(urn("WARC-Refers-To"), F.lit("")).try_cast("long").alias("refers_to"),
        F.nullif(_header("X-Payload-Length"), F.lit("")).try_cast("long").alias("told_bytes"), F.regexp_extract(_header("WARC-Payload-Digest"), "sha1:([A-Z2-7]{32})", 1).alias("told_digest"),
    )
    p = _placed(written(p, "warc-pieces")).where("off >= 0")
    return p.withColumn("next", F.when((F.col("type") != "") & (F.col("length") >= 0), F.col("off") + len(MAGIC) + F.col("head_size") + F.col("length") + 4))


def reachable(cand: DataFrame) -> DataFrame:
    """(file, off) of the candidates on the chain that starts at offset zero of each file.

    Each round doubles how far pointers reach and marks what marked candidates point to, so that
    rounds grow with the logarithm of the records in a file. Each round is a table in the shared folder."""
    spark = cand.sparkSession
    path = fresh_path(spark, "warc-chain")
    cand.where("next is not null").select("file", "off", "next", (F.col("off") == 0).alias("reached")).write.parquet(path)
    nodes = spark.read.parquet(path)
    most = nodes.groupBy("file").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(math.ceil(math.log2(most + 1)) if most > 1 else 0):
        ahead = nodes.select("file", F.col("off").alias("next"), F.col("next").alias("next2"))
        marks = nodes.where("reached and next is not null").select("file", F.col("next").alias("off"), F.lit(True).alias("mark"))
        new = nodes.join(ahead, ["file", "next"], "left").join(marks, ["file", "off"], "left")
        new = new.select("file", "off", F.col("next2").alias("next"), (F.col("reached") | F.coalesce("mark", F.lit(False))).alias("reached"))
        then = fresh_path(spark, "warc-chain")
        new.write.parquet(then)
        remove(spark, path)
        path, nodes = then, spark.read.parquet(then)
    return nodes.where("reached").select("file", "off")


def _joined(spark: SparkSession, path: str, cand: DataFrame, broken: DataFrame) -> DataFrame:
    """(file, off, hex, got) of the records whose payload holds the magic string: payloads put together again from
    their pieces. Which pieces belong to a record is found from places alone; only these pieces are then moved."""
    files = broken.select("file").distinct()
    named = [r.file for r in files.limit(NAMED_FILES + 1).collect()]
    if not named:
        return spark.createDataFrame([], "file string, off long, hex string, got long")
    part = cand.join(files, "file", "left_semi") if len(named) > NAMED_FILES else cand.where(F.col("file").isin(named))
    starts = broken.select("file", "off", F.struct(F.col("off").alias("at"), (F.col("off") + len(MAGIC) + F.col("head_size") + F.col("length")).alias("end"), "head_size", F.col("length").alias("len")).alias("record"))
    upto = W.partitionBy("file").orderBy("off").rowsBetween(W.unboundedPreceding, 0)
    of = part.select("file", "off").join(starts, ["file", "off"], "left").withColumn("record", F.last("record", ignorenulls=True).over(upto)).where("off < record.end")
    pieces = _pieces(spark, [path] if len(named) > NAMED_FILES else named).withColumn("size", F.octet_length("value").cast("long"))
    moved = _placed(pieces).select("file", "off", "value").join(of, ["file", "off"])
    joined = moved.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("off", "value"))).alias("parts"))
    value = F.array_join(F.transform("parts", lambda x: x["value"]), MAGIC).cast("binary")
    payload = F.substring(value, (F.col("record.head_size") + 1).cast("int"), F.col("record.len").cast("int"))
    return joined.select("file", F.col("record.at").alias("off"), payload.alias("payload")).select("file", "off", F.sha1("payload").alias("hex"), F.octet_length("payload").cast("long").alias("got"))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(file, off, type, page_id, refers_to, payload_bytes, payload_digest) of every record that the
    chain of its file reaches. Bytes and digest are those of the payload as read; for revisits, which
    have none, those that the record tells of the full payload. What follows a broken record in a file isn't reached;
    a record whose payload the file doesn't hold in full is none. No files, no records.
    Records whose payload holds the magic string are put together again from their pieces."""
    cand = written(candidates(spark, [path]), "warc-candidates")
    found = written(cand.join(reachable(cand), ["file", "off"]), "warc-records")
    cols = ["file", "off", "type", "page_id", "refers_to", "told_bytes", "told_digest", "length", "hex"]
    broken = found.where("not whole")
    fixed = _joined(spark, path, cand, broken)
    rows = found.where("whole").select(*cols).unionByName(broken.drop("hex").join(fixed, ["file", "off"]).where("got = length").select(*cols))
    revisit = F.col("type") == "revisit"
    return rows.select(
        "file", "off", "type", "page_id", "refers_to",
        F.when(revisit, F.col("told_bytes")).otherwise(F.col("length")).alias("payload_bytes"), F.when(revisit, F.col("told_digest")).otherwise(base32(F.col("hex"))).alias("payload_digest"),
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the pages, read the archives back."""
    path = fresh_path(spark, "warc")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
    return read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")


#: Base32 of the SHA-1 from its hexadecimal digits, five at a time.
_SIGNS = " || ".join(
    f"substr('{BASE32}', 1 + ((('0x' || substr(h, {1 + 5 * i}, 5))::bigint >> {15 - 5 * k}) & 31)::bigint, 1)" for i in range(8) for k in range(4)
)
SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::bigint AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, {_SIGNS} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM q
"""
