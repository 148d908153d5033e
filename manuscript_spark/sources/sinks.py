"""Documents as DOCX, PDF and PNG files: binary columns, one document a group."""

from __future__ import annotations

import base64
import io
import re
import struct
import unicodedata
import zipfile
import zlib
from functools import cache
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType


PAGE_W, PAGE_H, MARGIN = 595.0, 842.0, 56.0
#: Widest and tallest an image may be, in English metric units.
EMU_W, EMU_H = 5_486_400, 7_315_200


def xml(text: str) -> str:
    return re.sub(r"[^\t\n\r\x20-퟿-�\U00010000-\U0010FFFF]", "", text).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


# Named entities of inline text.
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0"}


def decoded(text: str) -> str:
    """Entities decoded once, from left to right; unknown ones stay as they are."""

    def one(m: re.Match) -> str:
        if m[1].startswith("#"):
            code = int(m[1][2:], 16) if m[1][1] in "xX" else int(m[1][1:])
            return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]
        return NAMED.get(m[1], m[0])

    return re.sub(r"&(#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|[a-z]+);", one, text)


def runs(inline: str) -> list[tuple[str, frozenset]]:
    """Inline markup as runs of text with styles; a close without an open is ignored, unknown tags lose their style."""
    out, open_ = [], []
    for part in re.split(r"(</?[a-zA-Z][^>]*>)", inline or ""):
        m = re.fullmatch(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)[^>]*>", part)
        if not m:
            if part:
                out.append((decoded(part), frozenset(open_)))
        elif m[1]:
            if m[2].lower() in open_:
                open_.reverse()
                open_.remove(m[2].lower())
                open_.reverse()
        else:
            open_.append(m[2].lower())
    return out


# Tags and their run properties.
STYLE = {"b": "<w:b/>", "strong": "<w:b/>", "i": "<w:i/>", "em": "<w:i/>", "u": '<w:u w:val="single"/>', "code": '<w:rFonts w:ascii="Courier New" w:hAnsi="Courier New"/>', "sub": '<w:vertAlign w:val="subscript"/>', "sup": '<w:vertAlign w:val="superscript"/>', "mark": '<w:highlight w:val="yellow"/>'}


def _run(text: str, tags: frozenset) -> str:
    props = "".join(dict.fromkeys(STYLE[t] for t in STYLE if t in tags))
    return f'<w:r>{"<w:rPr>" + props + "</w:rPr>" if props else ""}<w:t xml:space="preserve">{xml(text)}</w:t></w:r>'


def _par(inline: str, props: str = "") -> str:
    return f'<w:p>{"<w:pPr>" + props + "</w:pPr>" if props else ""}{"".join(_run(t, s) for t, s in runs(inline))}</w:p>'


def data_uri(src: str) -> bytes | None:
    """The bytes of a data URI; None if it isn't one or can't be read."""
    m = re.fullmatch(r"(?s)data:[^,]*?(;base64)?,(.*)", src or "")
    if not m:
        return None
    try:
        return base64.b64decode(m[2], validate=True) if m[1] else unquote_to_bytes(m[2])
    except ValueError:
        return None


def image_kind(data: bytes | None) -> str | None:
    head = data or b""
    return "png" if head[:8] == b"\x89PNG\r\n\x1a\n" else "jpeg" if head[:3] == b"\xff\xd8\xff" else "gif" if head[:6] in (b"GIF87a", b"GIF89a") else None


def pixel_size(data: bytes) -> tuple[int, int] | None:
    """Width and height from the header of a PNG, GIF or JPEG file."""
    kind = image_kind(data)
    try:
        if kind == "png":
            return struct.unpack(">II", data[16:24])
        if kind == "gif":
            return struct.unpack("<HH", data[6:10])
        at = 2
        while kind == "jpeg":
            if data[at] != 0xFF:
                return None
            mark, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return w, h
            at += 2 + size
    except (struct.error, IndexError):
        pass
    return None


def fitted(size: tuple[int, int] | None) -> tuple[int, int]:
    """A picture's size in English metric units, within the page, its shape kept; four by three inches if unknown."""
    w, h = (size[0] * 9525, size[1] * 9525) if size and size[0] and size[1] else (4 * 914_400, 3 * 914_400)
    scale = min(1.0, EMU_W / w, EMU_H / h)
    return max(1, int(w * scale)), max(1, int(h * scale))


def docx(blocks: list[dict]) -> bytes:
    """A DOCX file of blocks; the same blocks always give the same bytes."""
    body, media, rels, lists = [], [], [], 0
    for b in blocks:
        kind, text = b.get("type"), b.get("text") or ""
        if kind == "heading":
            body.append(_par(text, f'<w:pStyle w:val="Heading{b.get("level") or 1}"/>'))
        elif kind == "quote":
            body.append(_par(text, '<w:pStyle w:val="Quote"/><w:ind w:left="720"/>'))
        elif kind == "code":
            body += [f"<w:p>{_run(line, frozenset({'code'}))}</w:p>" for line in text.split("\n")]
        elif kind == "list":
            lists += bool(b.get("ordered"))
            number = lists + 1 if b.get("ordered") else 1
            body += [_par(i, f'<w:numPr><w:ilvl w:val="0"/><w:numId w:val="{number}"/></w:numPr>') for i in b.get("items") or ()]
        elif kind == "table":
            rows = [list(r) for r in b.get("rows") or ()]
            wide = max(map(len, rows), default=0)
            cells = ["".join(f"<w:tc><w:tcPr/>{_par(c or '')}</w:tc>" for c in r + [""] * (wide - len(r))) for r in rows]
            body.append(f"<w:tbl><w:tblPr/><w:tblGrid>{'<w:gridCol/>' * wide}</w:tblGrid>{''.join(f'<w:tr>{c}</w:tr>' for c in cells)}</w:tbl>")
        elif kind == "image":
            data = data_uri(b.get("src"))
            if (form := image_kind(data)) is not None:
                n = len(media) + 1
                media.append((f"word/media/image{n}.{form}", data))
                rels.append(f'<Relationship Id="rId{n + 10}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/image" Target="media/image{n}.{form}"/>')
                w, h = fitted(pixel_size(data))
                body.append(f'<w:p><w:r><w:drawing><wp:inline><wp:extent cx="{w}" cy="{h}"/><wp:docPr id="{n}" name="image{n}"/><a:graphic><a:graphicData uri="http://schemas.openxmlformats.org/drawingml/2006/picture"><pic:pic><pic:nvPicPr><pic:cNvPr id="{n}" name="image{n}"/><pic:cNvPicPr/></pic:nvPicPr><pic:blipFill><a:blip r:embed="rId{n + 10}"/><a:stretch><a:fillRect/></a:stretch></pic:blipFill><pic:spPr><a:xfrm><a:off x="0" y="0"/><a:ext cx="{w}" cy="{h}"/></a:xfrm><a:prstGeom prst="rect"/></pic:spPr></pic:pic></a:graphicData></a:graphic></wp:inline></w:drawing></w:r></w:p>')
            if b.get("caption"):
                body.append(_par(xml(b["caption"]), '<w:pStyle w:val="Caption"/>'))
        else:
            body.append(_par(text))
    main = "http://schemas.openxmlformats.org"
    levels = ['<w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:numFmt w:val="bullet"/><w:lvlText w:val="•"/></w:lvl></w:abstractNum>', '<w:abstractNum w:abstractNumId="1"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="decimal"/><w:lvlText w:val="%1."/></w:lvl></w:abstractNum>']
    numbers = ['<w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num>'] + [f'<w:num w:numId="{i + 2}"><w:abstractNumId w:val="1"/><w:lvlOverride w:ilvl="0"><w:startOverride w:val="1"/></w:lvlOverride></w:num>' for i in range(lists)]
    files = [
        ("[Content_Types].xml", f'<Types xmlns="{main}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Default Extension="png" ContentType="image/png"/><Default Extension="jpeg" ContentType="image/jpeg"/><Default Extension="gif" ContentType="image/gif"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/><Override PartName="/word/numbering.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.numbering+xml"/></Types>'),
        ("_rels/.rels", f'<Relationships xmlns="{main}/package/2006/relationships"><Relationship Id="rId1" Type="{main}/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'),
        ("word/_rels/document.xml.rels", f'<Relationships xmlns="{main}/package/2006/relationships"><Relationship Id="rId1" Type="{main}/officeDocument/2006/relationships/numbering" Target="numbering.xml"/>{"".join(rels)}</Relationships>'),
        ("word/numbering.xml", f'<w:numbering xmlns:w="{main}/wordprocessingml/2006/main">{"".join(levels + numbers)}</w:numbering>'),
        ("word/document.xml", f'<w:document xmlns:w="{main}/wordprocessingml/2006/main" xmlns:r="{main}/officeDocument/2006/relationships" xmlns:wp="{main}/drawingml/2006/wordprocessingDrawing" xmlns:a="{main}/drawingml/2006/main" xmlns:pic="{main}/drawingml/2006/picture"><w:body>{"".join(body)}<w:sectPr/></w:body></w:document>'),
    ]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in [*((n, ('<?xml version="1.0" encoding="UTF-8"?>' + d).encode()) for n, d in files), *media]:
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data)
    return out.getvalue()


# Widths of codes 32 to 126 in thousandths of the size, regular and bold, as the fonts' public metrics have them.
HELVETICA = (278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556, 1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556, 333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584)
HELVETICA_BOLD = (278, 333, 474, 556, 556, 889, 722, 238, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 333, 333, 584, 584, 584, 611, 975, 722, 722, 722, 722, 667, 611, 778, 722, 278, 556, 722, 611, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 333, 278, 333, 584, 556, 333, 556, 611, 556, 611, 556, 333, 611, 611, 278, 278, 556, 278, 889, 611, 611, 611, 611, 389, 556, 333, 611, 556, 778, 556, 556, 500, 389, 280, 389, 584)
# Widths of the other signs of the code page, regular; accented letters are as wide as their base letter.
SIGNS = {1000: "\u2026\u2030\u0152\u2014\u2122\u00c6", 944: "\u0153", 889: "\u00e6", 834: "\u00bc\u00bd\u00be", 737: "\u00a9\u00ae", 611: "\u00bf\u00df\u00f8", 584: "\u00ac\u00b1\u00d7\u00f7", 537: "\u00b6", 400: "\u00b0", 370: "\u00aa", 365: "\u00ba", 350: "\u2022", 333: "\u201e\u02c6\u2039\u201c\u201d\u02dc\u203a\u00a1\u00a8\u00ad\u00af\u00b2\u00b3\u00b4\u00b8\u00b9", 278: "\u00a0\u00b7", 260: "\u00a6", 222: "\u201a\u2018\u2019", 778: "\u00d8", 722: "\u00d0", 667: "\u00de"}
SIGN_WIDTH = {c: w for w, signs in SIGNS.items() for c in signs}
#: Of signs that nothing above has; signs in bold are taken to be a tenth wider.
OTHER_WIDTH, BOLD_SIGN = 556, 1.1


@cache
def advance(char: str, bold: bool = False) -> float:
    """A character's width in thousandths of the size."""
    table = HELVETICA_BOLD if bold else HELVETICA
    base = unicodedata.normalize("NFD", char)[:1] if char not in SIGN_WIDTH else char
    if " " <= base <= "~":
        return table[ord(base) - 32]
    return SIGN_WIDTH.get(char, OTHER_WIDTH) * (BOLD_SIGN if bold else 1)


def text_width(text: str, size: float, mono: bool = False, bold: bool = False) -> float:
    """The width of a line of Helvetica, or of Courier."""
    if mono:
        return 0.6 * size * len(text)
    return sum(advance(c, bold) for c in text) * size / 1000


def wrapped(text: str, size: float, width: float, mono: bool = False, bold: bool = False) -> list[str]:
    """Words in lines that fit; a word wider than a line is broken."""
    lines, used, blank = [""], 0.0, text_width(" ", size, mono, bold)
    for word in text.split():
        wide = text_width(word, size, mono, bold)
        while wide > width and len(word) > 1:
            cut, taken = 1, text_width(word[0], size, mono, bold)
            while cut < len(word) and (more := taken + text_width(word[cut], size, mono, bold)) <= width:
                cut, taken = cut + 1, more
            if lines[-1]:
                lines.append("")
            lines[-1], word = word[:cut], word[cut:]
            lines.append("")
            wide, used = text_width(word, size, mono, bold), 0.0
        if not word:
            continue
        if not lines[-1]:
            lines[-1], used = word, wide
        elif used + blank + wide <= width:
            lines[-1] += " " + word
            used += blank + wide
        else:
            lines.append(word)
            used = wide
    return [x for x in lines if x]


def single_byte(text: str) -> bytes:
    """Text in the single-byte code page of PDF's standard fonts; what it lacks is spelled out or becomes a question mark."""
    return "".join(c if c.encode("cp1252", "ignore") else unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode() or "?" for c in text).encode("cp1252", "replace")


def column_widths(rows: list[list[str]], size: float, total: float) -> list[float]:
    """Natural widths if they fit, else a least width each and the rest in proportion."""
    wide = max(map(len, rows), default=0)
    natural = [max((text_width(r[k], size, bold=not n) for n, r in enumerate(rows) if k < len(r)), default=0) + 8 for k in range(wide)]
    if sum(natural) <= total:
        return natural
    least = min(36.0, total / max(1, wide))
    spare, slack = total - least * wide, [max(0.0, n - least) for n in natural]
    return [least + spare * s / (sum(slack) or 1) for s in slack]


def pdf(blocks: list[dict], title: str = "") -> bytes:
    """A PDF file of blocks: wrapped text over pages, headings kept with what follows, table heads repeated."""
    pages: list[list[bytes]] = [[]]
    y = PAGE_H - MARGIN
    width = PAGE_W - 2 * MARGIN

    def turn() -> None:
        nonlocal y
        pages.append([])
        y = PAGE_H - MARGIN

    def put(line: str, x: float, size: float, font: str) -> None:
        s = single_byte(line).replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
        pages[-1].append(b"BT /%s %.1f Tf %.2f %.2f Td (%s) Tj ET" % (font.encode(), size, x, y, s))

    def write(text: str, size: float, font: str = "F1", indent: float = 0, keep: float = 0) -> None:
        nonlocal y
        lines = wrapped(text, size, width - indent, font == "F3", font == "F2")
        if y - len(lines[:2]) * size * 1.3 - keep < MARGIN and pages[-1]:
            turn()
        for line in lines:
            if y - size * 1.3 < MARGIN:
                turn()
            y -= size * 1.3
            put(line, MARGIN + indent, size, font)
        y -= size * 0.5

    plain = lambda s: "".join(t for t, _ in runs(s))
    for b in blocks:
        kind, text = b.get("type"), plain(b.get("text") or "")
        if kind == "heading":
            write(text, 20 - 3 * (b.get("level") or 1), "F2", keep=40)
        elif kind == "list":
            for n, i in enumerate(b.get("items") or (), 1):
                write((f"{n}. " if b.get("ordered") else "• ") + plain(i), 11, indent=14)
        elif kind == "code":
            for line in (b.get("text") or "").split("\n"):
                write(line, 9, "F3", 14)
        elif kind == "table":
            rows = [[plain(c or "") for c in r] for r in b.get("rows") or ()]
            widths = column_widths(rows, 10, width)
            for n, r in enumerate(rows):
                cells = [wrapped(c, 10, max(8.0, w - 8), bold=not n) for c, w in zip(r, widths)]
                height = 13 * max([1, *map(len, cells)])
                if y - height < MARGIN and pages[-1]:
                    turn()
                    if n:
                        head = y
                        for k, c in enumerate(rows[0]):
                            y = head - 13
                            put(c, MARGIN + sum(widths[:k]), 10, "F2")
                        y = head - 13
                top = y
                for k, lines in enumerate(cells):
                    for i, line in enumerate(lines):
                        y = top - 13 * (i + 1)
                        put(line, MARGIN + sum(widths[:k]), 10, "F1" if n else "F2")
                y = top - height
            y -= 6
        elif kind == "image":
            write(b.get("caption") or "", 9)
        else:
            write(text, 11, indent=20 if kind == "quote" else 0)
    kids = " ".join(f"{7 + 2 * i} 0 R" for i in range(len(pages)))
    font = "<< /Type /Font /Subtype /Type1 /BaseFont /%s /Encoding /WinAnsiEncoding >>"
    info = single_byte(title).replace(b"\\", b"").replace(b"(", b"").replace(b")", b"")
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} >>".encode(), *((font % f).encode() for f in ("Helvetica", "Helvetica-Bold", "Courier")), b"<< /Title (" + info + b") >>"]
    for i, lines in enumerate(pages):
        stream = b"\n".join(lines)
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {PAGE_W:g} {PAGE_H:g}] /Resources << /Font << /F1 3 0 R /F2 4 0 R /F3 5 0 R >> >> /Contents {8 + 2 * i} 0 R >>".encode())
        objects.append(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(stream), stream))
    out, places = b"%PDF-1.4\n", []
    for n, o in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (n, o)
    table = b"".join(b"%010d 00000 n \n" % p for p in places)
    return out + b"xref\n0 %d\n0000000000 65535 f \n%strailer << /Size %d /Root 1 0 R /Info 6 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, table, len(objects) + 1, len(out))


def _chunk(name: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))


def png(data: bytes, width: int, height: int, channels: int | None = None) -> bytes | None:
    """A PNG file of raw 8-bit samples; channels by exact length, then as declared (1, 3 or 4); None if nothing fits."""
    n = next((c for c in (1, 3, 4) if width > 0 and height > 0 and len(data) == c * width * height), None) or (channels if channels in (1, 3, 4) and len(data) >= channels * width * height > 0 else None)
    if n is None:
        return None
    rows = b"".join(b"\0" + data[r * width * n : (r + 1) * width * n] for r in range(height))
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 4: 6}[n], 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows, 9)) + _chunk(b"IEND", b"")


def plain_value(v):
    """A cell of a frame as Python's own: arrays as lists, missing as None."""
    if hasattr(v, "tolist") and hasattr(v, "__len__"):
        return [plain_value(x) for x in v]
    return v if isinstance(v, (list, str, bytes)) else None if pd.isna(v) else v


def documents_as(blocks: DataFrame, form: str, title: str = "") -> DataFrame:
    """(doc_id, content) of blocks (doc_id, block_no and the fields of a block) as docx or pdf files."""
    if form not in ("docx", "pdf"):
        raise ValueError(f"no such form: {form}")

    def make(p: pd.DataFrame) -> pd.DataFrame:
        rows = [{k: plain_value(v) for k, v in r.items()} for r in p.sort_values("block_no").to_dict("records")]
        for r in rows:
            r["level"] = int(r["level"]) if r.get("level") is not None else None
        return pd.DataFrame({"doc_id": [p["doc_id"].iloc[0]], "content": [docx(rows) if form == "docx" else pdf(rows, title)]})

    return blocks.groupBy("doc_id").applyInPandas(make, "doc_id long, content binary")


@F.pandas_udf(BinaryType())
def png_of(data: pd.Series, width: pd.Series, height: pd.Series, channels: pd.Series) -> pd.Series:
    return pd.Series([png(bytes(d), int(w), int(h), None if pd.isna(c) else int(c)) for d, w, h, c in zip(data, width, height, channels)], dtype=object)


def png_uri(content: str | Column) -> Column:
    c = F.col(content) if isinstance(content, str) else content
    return F.concat(F.lit("data:image/png;base64,"), F.regexp_replace(F.base64(c), "[\r\n]", ""))


def not_embeddable(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_no) of images whose source is no readable data URI of a PNG, JPEG or GIF file."""
    raw = F.try_to_binary(F.regexp_extract("src", r"(?s)^data:[^,]*;base64,(.*)$", 1), F.lit("base64"))
    head = F.hex(F.substring(raw, 1, 8))
    good = head.startswith("89504E470D0A1A0A") | head.startswith("FFD8FF") | head.startswith("474946383761") | head.startswith("474946383961")
    return blocks.where((F.col("type") == "image") & ~F.coalesce(good, F.lit(False))).select("doc_id", "block_no")
