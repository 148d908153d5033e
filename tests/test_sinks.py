import io
import json
import re
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from manuscript_spark.review import Config, review
from manuscript_spark.sources import files, html, sinks
from manuscript_spark.streaming import ingest

PAGE = "<h1>T &amp; <b>x</b></h1><p>one <i>two</i> three</p><ol><li>a</li><li>b</li></ol><table><tr><th>h</th><td>v</td></tr><tr><td>only</td></tr></table><pre>c = 1</pre>"


def test_docx_there_and_back(spark):
    blocks = html.html_blocks(spark.createDataFrame([(1, PAGE)], "doc_id long, html string"))
    made = sinks.documents_as(blocks, "docx")
    data = bytes(made.first().content)
    assert data == bytes(sinks.documents_as(blocks, "docx").first().content)
    assert zipfile.ZipFile(io.BytesIO(data)).testzip() is None
    back = files.docx_blocks(made.select(F.col("doc_id").cast("string").alias("path"), "content")).orderBy("block_no").collect()
    assert [b.type for b in back] == ["heading", "paragraph", "list", "table", "paragraph"]
    assert back[0].text == "T &amp;amp; x" and back[2]["items"] == ["a", "b"] and back[3].rows[1] == ["only", ""]
    with pytest.raises(ValueError):
        sinks.documents_as(blocks, "odt")


def test_pdf_is_whole():
    blocks = [{"type": "heading", "level": 1, "text": "T"}] + [{"type": "paragraph", "text": "word (x) \\ é 日 " * 40}] * 12 + [{"type": "table", "rows": [["a", "b"]] + [["c", "long " * 20]] * 60}]
    data = sinks.pdf(blocks, "Name")
    at = int(re.search(rb"startxref\n(\d+)\n", data)[1])
    assert data[at : at + 4] == b"xref"
    for n, place in enumerate(re.findall(rb"(\d{10}) 00000 n", data), 1):
        assert data[int(place) :].startswith(b"%d 0 obj" % n)
    assert int(re.search(rb"/Count (\d+)", data)[1]) > 1 and data == sinks.pdf(blocks, "Name")


def test_png_and_images(spark):
    raw = bytes(range(12))
    out = sinks.png(raw, 2, 2, None)
    body = zlib.decompress(out[out.index(b"IDAT") + 4 : out.index(b"IEND") - 8])
    assert body == b"\0" + raw[:6] + b"\0" + raw[6:] and sinks.pixel_size(out) == (2, 2)
    assert sinks.png(raw, 5, 5, None) is None and sinks.fitted((100_000, 1000))[0] == sinks.EMU_W
    df = spark.createDataFrame([(bytearray(raw), 2, 2, None)], "data binary, width int, height int, channels int")
    uri = df.select(sinks.png_uri(sinks.png_of("data", "width", "height", "channels")).alias("u")).first().u
    assert sinks.data_uri(uri) == out
    b = spark.createDataFrame([(1, 0, "image", uri), (1, 1, "image", "data:image/png;base64,!!"), (1, 2, "image", "x.png"), (1, 3, "paragraph", None)], "doc_id long, block_no int, type string, src string")
    assert sorted(r.block_no for r in sinks.not_embeddable(b).collect()) == [1, 2]


def test_runs_of_inline_markup():
    assert sinks.runs("a<b>c<i>d</b>e</x>f") == [("a", frozenset()), ("c", frozenset("b")), ("d", frozenset("bi")), ("e", frozenset("i")), ("f", frozenset("i"))]


def test_stream_reviews_each_text_once(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    row = {"text": "Figure 1: A.\nSee Figure 2.", "arrived": "2024-01-01T00:00:00Z"}
    (d / "a.json").write_text("\n".join(json.dumps({"doc_id": i, **row}) for i in (1, 2)) + "\n" + json.dumps({"doc_id": 3, "text": "It always returns each matching row.", "arrived": "2024-01-01T00:00:01Z"}))
    q = ingest.review(ingest.documents(spark, str(d)), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    found = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.check for r in found) == ["float-missing", "float-never-referenced", "overclaim"]


def test_review_counts_what_the_cap_drops(spark):
    many = lambda n: " ".join(f"It always returns each matching row of table {i}." for i in range(n))
    docs = spark.createDataFrame([(1, many(31)), (2, many(25)), (3, "Plain words."), (4, None), (5, "مرحبا بالعالم كله")], "doc_id long, text string")
    runs = {r.doc_id: (r.overclaim, r.overclaim_truncated) for r in review(docs, Config(overclaim_cap=24))[1].collect()}
    assert runs == {1: (24, 7), 2: (24, 1), 3: (0, 0), 4: (0, 0), 5: (0, 0)}


def test_review_and_history(spark, tmp_path):
    docs = spark.createDataFrame([(1, "It always returns each matching row. Got 7%.", "About 5% here."), (2, "مرحبا بالعالم كله", ""), (3, "Plain words.", None)], "doc_id long, text string, brief string")
    terms = spark.createDataFrame([("d", "Directed Acyclic Graph Scheduler", [], False, False)], "slug string, canonical string, variants array<string>, stub boolean, single_word_allowed boolean")
    findings, runs = review(docs, Config(views=True), terms=terms)
    assert sorted((r.doc_id, r.check, r.category) for r in findings.collect()) == [(1, "overclaim", "claim"), (1, "summary-drift", "consistency")]
    assert {r.doc_id: (r.findings, r.skipped_reason) for r in runs.collect()} == {1: (2, None), 2: (0, "language"), 3: (0, None)}
    assert spark.sql("select count(*) n from findings").first().n == 2
    files.write_findings(findings, str(tmp_path / "f"))
    files.append_history(spark.createDataFrame([(1, 5), (2, 9)], "id int, ts int"), str(tmp_path / "h"))
    assert [r.id for r in files.history(spark, str(tmp_path / "h"), 1).collect()] == [2]
    with pytest.raises(ValueError):
        files.append_history(spark.createDataFrame([(1,)], "api_key int"), str(tmp_path / "h"))
