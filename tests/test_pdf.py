import zlib

import pytest

from manuscript_spark.sources import files, pdf, sinks


def whole(objects: dict[int, bytes], tail: bytes = b"/Root 1 0 R") -> bytes:
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in objects.items()) + b"trailer << " + tail + b" >>\n%%EOF"


def stream(data: bytes, info: bytes = b"") -> bytes:
    return b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(data), info, data)


def one_page(content: bytes, resources: bytes = b"/Font << /F1 4 0 R >>", **more: bytes) -> bytes:
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 /Resources << %s >> >>" % resources, 3: b"<< /Type /Page /Parent 2 0 R /Contents 5 0 R >>", 4: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>", 5: stream(content)}
    return whole(objects | {int(k[1:]): v for k, v in more.items()})


def texts(data: bytes) -> list[str]:
    return [b["text"] for b in pdf.pdf_blocks_of(data) if b["type"] == "paragraph"]


def test_what_the_sink_writes_is_read():
    blocks = [{"type": "heading", "level": 1, "text": "A title"}, {"type": "paragraph", "text": "one (two) back\\slash \u00e9 \u2014 &amp; &lt;x&gt; " * 60}, {"type": "list", "items": ["first", "second"]}, {"type": "table", "rows": [["head", "tail"], ["a", "b"]]}]
    got = texts(sinks.pdf(blocks))
    assert got[0] == "A title" and got[1] == " ".join(["one (two) back\\slash \u00e9 \u2014 &amp; &lt;x&gt;"] * 60)
    assert got[2:4] == ["\u2022 first", "\u2022 second"] and "head tail" in got[4]


def test_spacing_and_paragraphs():
    assert texts(one_page(b"BT /F1 10 Tf 50 700 Td [(Hel) 20 (lo) -400 (wor) (ld)] TJ 0 -12 Td (goes on) Tj 0 -30 Td (far below) Tj ET")) == ["Hello world goes on", "far below"]
    assert texts(one_page(b"BT /F1 10 Tf 50 700 Td <48 69> Tj (\\101\\\n\\(\\)) Tj % a comment ) \n ET")) == ["HiA()"]
    assert texts(one_page(b"q 2 0 0 2 0 0 cm BT /F1 5 Tf 10 300 Td (one) Tj ET Q BT /F1 10 Tf 20 588 Td (two) Tj ET")) == ["one two"]


def test_a_sentence_goes_on_over_a_page():
    words = " ".join(f"word{i}" for i in range(2000))
    assert texts(sinks.pdf([{"type": "paragraph", "text": words}])) == [words]


def test_fonts_with_maps_and_differences():
    cmap = b"1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfchar <0003> <0020> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<03b1> <D835DC00>] endbfrange"
    font = b"<< /Type /Font /Subtype /Type0 /BaseFont /X /ToUnicode 6 0 R >>"
    assert texts(one_page(b"BT /F1 10 Tf 50 700 Td <001000110012000300200021> Tj ET", o4=font, o6=stream(cmap))) == ["abc \u03b1\U0001d400"]
    simple = b"<< /Type /Font /Subtype /Type1 /BaseFont /X /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [1 /fi /uni03B2 /B 40 /hyphen] >> >>"
    assert texts(one_page(b"BT /F1 10 Tf 50 700 Td <01024128 03> Tj ET", o4=simple)) == ["fi\u03b2A-B"]


@pytest.mark.parametrize("predictor", [1, 12])
def test_packed_objects(predictor):
    """Page and font in an object stream, its bytes Flate with and without a predictor."""
    page, font = b"<< /Type /Page /Parent 2 0 R /Contents 5 0 R >>", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"
    body = b"3 0 4 %d " % (len(page) + 1) + page + b" " + font
    first = len(b"3 0 4 %d " % (len(page) + 1))
    parms = b""
    if predictor == 12:  # rows of eight, each less the one above
        body += b" " * (-len(body) % 8)
        rows = [body[i : i + 8] for i in range(0, len(body), 8)]
        body = b"".join(b"\2" + bytes((x - y) & 255 for x, y in zip(r, before)) for r, before in zip(rows, [bytes(8), *rows]))
        parms = b"/DecodeParms << /Predictor 12 /Columns 8 >>"
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Resources << /Font << /F1 4 0 R >> >> >>", 5: stream(zlib.compress(b"BT /F1 10 Tf 50 700 Td (packed) Tj ET"), b"/Filter /FlateDecode"), 6: stream(zlib.compress(body), b"/Type /ObjStm /N 2 /First %d /Filter /FlateDecode %s" % (first, parms))}
    assert texts(whole(objects)) == ["packed"]


def test_pictures():
    rgb, jpeg = bytes(range(12)), b"\xff\xd8\xff\xe0rest"
    image = lambda data, rest: stream(data, b"/Subtype /Image /Width 2 /Height 2 " + rest)
    data = one_page(
        b"/I1 Do BT /F1 10 Tf 50 700 Td (text) Tj ET /I2 Do /I3 Do /I4 Do /I5 Do /X1 Do",
        b"/Font << /F1 4 0 R >> /XObject << /I1 6 0 R /I2 7 0 R /I3 8 0 R /I4 9 0 R /I5 10 0 R /X1 11 0 R >>",
        o6=image(zlib.compress(rgb), b"/ColorSpace /DeviceRGB /BitsPerComponent 8 /Filter /FlateDecode"),
        o7=image(jpeg, b"/ColorSpace /DeviceRGB /Filter /DCTDecode"),
        o8=image(b"none", b"/Filter /JPXDecode"),
        o9=image(b"\x40\x80", b"/ColorSpace [/Indexed /DeviceRGB 1 <000000 ff0102>] /BitsPerComponent 1"),
        o10=image(b"\x01", b"/ColorSpace /DeviceRGB /BitsPerComponent 8"),
        o11=stream(b"/I1 Do", b"/Subtype /Form"),
    )
    blocks = pdf.pdf_blocks_of(data)
    assert blocks[0] == {"type": "paragraph", "text": "text"} and all(b["page"] == 1 for b in blocks[1:])
    got = [sinks.data_uri(b["src"]) for b in blocks[1:]]
    assert got == [sinks.png(rgb, 2, 2), jpeg, sinks.png(b"\0\0\0\xff\1\2\xff\1\2\0\0\0", 2, 2), sinks.png(rgb, 2, 2)]


def test_what_cannot_be_read_gives_nothing():
    good = one_page(b"BT /F1 10 Tf 50 700 Td (text) Tj ET")
    assert texts(good) == ["text"]
    assert pdf.pdf_blocks_of(good.replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 9 0 R")) == []
    for data in (b"", b"%PDF-1.4", b"%PDF-1.4 1 0 obj << /Type /Catalog /Pages 1 0 R >> endobj", b"%PDF-1.4 1 0 obj " + b"[" * 5000, good[: len(good) // 2]):
        assert texts(data) in ([], ["text"])
    loop = one_page(b"BT /F1 10 Tf 50 700 Td (text) Tj ET /X1 Do", b"/Font << /F1 4 0 R >> /XObject << /X1 6 0 R >>", o6=stream(b"/X1 Do", b"/Subtype /Form"))
    assert texts(loop) == ["text"]


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(one_page(b"BT /F1 10 Tf 50 700 Td (first) Tj ET"))
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4 broken")
    (tmp_path / "c.docx").write_bytes(sinks.docx([{"type": "paragraph", "text": "second"}]))
    found = files.binary_files(spark, str(tmp_path))
    assert sorted(r.kind for r in found.collect()) == ["docx", "pdf", "pdf"]
    rows = pdf.pdf_blocks(found).collect()
    assert [(r.path[-5:], r.block_no, r.type, r.text, r.page) for r in rows] == [("a.pdf", 0, "paragraph", "first", None)]
    own = pdf.pdf_blocks(found, parser=lambda data: [{"type": "heading", "level": 2, "text": str(len(data))}])
    assert sorted(r.level for r in own.collect()) == [2, 2]
    assert pdf.pdf_blocks(found.where("false")).count() == 0


def test_widths():
    assert sinks.text_width("Hi.", 10) == pytest.approx(12.22) and sinks.text_width("Hi.", 10, bold=True) == pytest.approx(12.78)
    assert sinks.advance("\u00e9") == sinks.advance("e") == 556 and sinks.advance("\u2014") == 1000 and sinks.advance("\u2014", True) == pytest.approx(1100)
    assert sinks.text_width("abc", 10, mono=True) == 18
    line = "An unbreakable " + "x" * 300 + " end"
    cut = sinks.wrapped(line, 10, 200)
    assert "".join(cut).replace(" ", "") == line.replace(" ", "") and all(sinks.text_width(x, 10) <= 200 for x in cut)
