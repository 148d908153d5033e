"""Personal data by fixed patterns and a semi-Markov conditional random field.

The patterns give the base spans. In what they leave of a text a semi-Markov CRF scores whole candidate
segments (their shape as a whole, digit groups, check digits, the word before) for each kind, and a
dynamic program over segments of bounded length chooses boundaries and kinds together. Its spans are
added. Only places that hold a candidate are worked on: elsewhere every token is outside for certain.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .shared import documents, map_texts

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can only begin with a whole run of digits, as it ends with one.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def small(part: str) -> bool:
    """At most 255, however many zeros lead."""
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: from each @ back over the whole local part, forward over the domain."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            free = m.end()
            out.append((start, free))
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base spans, in order."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(map(small, m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# ---- the semi-Markov CRF ----

#: Letters run on in a token, and so do digits; what else isn't a space stands alone.
TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\s+|[^\s]")
LETTER = re.compile(r"[^\W\d_]")
#: Tokens in an entity, at most: in numbers, in spelled-out addresses.
BOUND, BOUND_SPELLED = 23, 41
#: Digits of a number that can be an entity.
LEAST, MOST = 7, 19
#: From a digit to the next letter: numbers that are entities hold no letter.
NUMBERS = re.compile(r"[0-9][\W\d_]*")
_DOT = r"(?:\s{0,2}[\[({<]\s?(?i:dot)\s?[\])}>]\s{0,2}|\s{1,3}(?i:dot)\s{1,3})"
_LABEL = "[A-Za-z0-9-]++"
#: What a spelled-out address goes on with after the sign for "at", in brackets or as a mere word; after a word the first dot is spelled out too.
AFTER_BRACKET, AFTER_WORD = (re.compile(rf"{_LABEL}{first}{_LABEL}(?:(?:{_DOT}|\.){_LABEL})*+") for first in (rf"(?:{_DOT}|\.)", _DOT))
SIGN = re.compile(r"[\[({<]\s?[aA][tT]\s?[\])}>]|\s[aA][tT](?=\s)")
AT = re.compile(rf"[A-Za-z0-9._%+-]+(?:\s{{0,2}}[\[({{<]\s?(?i:at)\s?[\])}}>]\s{{0,2}}{AFTER_BRACKET.pattern}|\s{{1,3}}(?i:at)\s{{1,3}}{AFTER_WORD.pattern})\Z")
SPLIT_IP = re.compile(r"[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\s\.\s)[0-9]{1,3}){3}\Z")
#: The last word before a place, if it is near.
CUE = re.compile(r"(?<![^\W\d_])([^\W\d_]{1,12})[\W\d_]{0,6}\Z")
CUES = {
    "email": {"mail", "email", "write", "contact", "address"},
    "ip": {"ip", "host", "server", "address"},
    "card": {"card", "visa", "mastercard", "credit", "paid"},
    "phone": {"phone", "tel", "call", "mobile", "fax", "telephone", "ring"},
}
SHAPES = {"3-3-4", "3-4", "1-3-3-4", "2-3-3-4", "2-2-2-2-2", "3-2-2-2", "4-7", "4-6", "5-6", "2-4-4", "2-2-2-2", "4-2-4", "2-3-2-2"}
FEATURES = ["cue", "spelled", "split_ip", "luhn", "card_size", "fours", "phone_size", "phone_shape", "paren", "zeros", "glued", "date", "ends_digit", "bias", "tokens", "loose", "run", "comma", "even", "marks"]
CARDS = {"4-4-4-4", "4-6-5", "16", "4-4-4-4-3"}
RUN, GAP = re.compile(r"[0-9]+"), re.compile(r"[^0-9]{3,}")
AREA = re.compile(r"\+?[0-9]{0,3}[ -]?\([0-9]{2,4}\)[ -]?[0-9]")
DATE = re.compile(r"(?:19|20)[0-9]{2}[-/. :,](?:[01]?[0-9])(?![0-9])|[0-3]?[0-9][-/.][01]?[0-9][-/.](?:19|20)[0-9]{2}(?![0-9])")


def _segment(text: str, start: int, end: int, lo: int, hi: int) -> tuple[tuple[int, ...], list[float]]:
    """Kinds that text[start:end] can be, and its features as a whole span (all but the cue, which differs by
    kind). Of what is around it only text[lo:hi] is seen."""
    s = text[start:end]
    sizes = [len(g) for g in RUN.findall(s)]
    n, letters = sum(sizes), bool(LETTER.search(s))
    spelled, split_ip = letters and bool(AT.match(s)), not letters and bool(SPLIT_IP.match(s))
    kinds = (0,) * spelled + (1,) * split_ip + (2, 3) * (LEAST <= n <= MOST and not letters)
    if not kinds:
        return kinds, []
    groups, card_size = "-".join(map(str, sizes)), 14 <= n <= 19
    before, after = text[max(lo, start - 4) : start], text[end : min(hi, end + 4)]
    left, right = before.rstrip(), after.lstrip()
    glued = before[-1:] in LOCAL or before[-1:] in tuple('/="#') or after[:1].isalnum() or after[:1] in tuple("/-_") or after[:2].strip(".,")[:1].isdigit() and after[:1] in tuple(".,")
    between = {g for g in NOT_DIGIT.findall(s[1:]) if not g.startswith(")")}
    return kinds, [
        spelled,
        split_ip and all(map(small, RUN.findall(s))),
        card_size and luhn(NOT_DIGIT.sub("", s)),
        card_size,
        groups in CARDS,
        10 <= n <= 13,
        groups in SHAPES,
        bool(AREA.match(s)),
        s.startswith("00"),
        glued,
        bool(DATE.match(s)),
        s[-1].isdigit() and (s[0].isdigit() or s[0] in "+("),
        1,
        0.1 * len(TOKEN.findall(s)),
        not letters and (len(sizes) > 5 or bool(GAP.search(s)) or "/" in s),
        left[-1:].isdigit() or right[:1].isdigit(),
        "," in s,
        len(sizes) > 2 and len(between) == 1,
        not letters and any(c in ":;$%=#*\"'!?|&\n" for c in s),
    ]


def segments(text: str, tokens: list[str], bounds: list[int], lo: int = 0, hi: int | None = None) -> Iterator[tuple[int, int, int, list[float]]]:
    """Candidate segments (first token, token after, kind, features) by first token; of bounded length. bounds:
    places of the tokens in the text, of which text[lo:hi] is seen."""
    hi = len(text) if hi is None else hi
    for i, t in enumerate(tokens):
        # a spelled-out address begins where its local part does
        spelled = t[0] in LOCAL and not (bounds[i] > lo and text[bounds[i] - 1] in LOCAL)
        number = t[0] in "0123456789+("
        if not (spelled or number):
            continue
        cue, digits, dots = None, 0, False
        for j in range(i + 1, min(len(tokens), i + (BOUND_SPELLED if spelled else BOUND)) + 1):
            last = tokens[j - 1]
            digits += len(last) if last[0] in "0123456789" else 0
            dots |= last == "."
            number = number and digits <= MOST and j - i <= BOUND and not LETTER.match(last)
            if not (number or spelled):
                break
            if last.isspace() or not (number and (digits >= LEAST or digits >= 4 and dots)) and not (spelled and last[0] in LOCAL):
                continue
            kinds, f = _segment(text, bounds[i], bounds[j], lo, hi)
            for k in kinds:
                if spelled if k == 0 else number:
                    if cue is None:
                        m = CUE.search(text[max(lo, bounds[i] - 20) : bounds[i]])
                        cue = m[1].lower() if m else ""
                    yield i, j, k, [cue in CUES[KINDS[k]], *f]


def split(text: str, lo: int = 0, hi: int | None = None) -> tuple[list[str], list[int]]:
    """Tokens of text[lo:hi] and their boundaries."""
    tokens = TOKEN.findall(text, lo, len(text) if hi is None else hi)
    return tokens, [*accumulate(map(len, tokens), initial=lo)]


def _letter(c: str) -> bool:
    return c.isalnum() and not c.isdecimal()


def places(text: str, lo: int, hi: int) -> list[tuple[int, int]]:
    """Stretches of whole tokens, apart from each other and in order, that hold every candidate segment of
    text[lo:hi]: numbers from letter to letter, and whatever could be a spelled-out address."""
    out = []
    for m in NUMBERS.finditer(text, lo, hi):
        a, b = m.span()
        if b - a < LEAST:
            continue
        n = len(NOT_DIGIT.sub("", m[0]))
        if n >= LEAST or n >= 4 and "." in m[0]:
            while a > lo and not _letter(text[a - 1]):
                a -= 1
            out.append((a, b))
    for m in SIGN.finditer(text, lo, hi):
        word = m[0][0].isspace()
        end, start = m.end(), m.start()
        while end < hi and end - m.end() < 3 and text[end].isspace():
            end += 1
        d = (AFTER_WORD if word else AFTER_BRACKET).match(text, end, hi)
        while d and start > lo and m.start() - start < 3 and text[start - 1].isspace():
            start -= 1
        if not d or start == lo or text[start - 1] not in LOCAL:
            continue
        a, b = start, d.end()
        while a > lo and text[a - 1] in LOCAL:
            a -= 1
        while a > lo and _letter(text[a - 1]) and _letter(text[a]):
            a -= 1
        while b < hi and _letter(text[b - 1]) and _letter(text[b]):
            b += 1
        out.append((a, b))
    apart: list[tuple[int, int]] = []
    for a, b in sorted(out):
        if apart and a < apart[-1][1]:
            apart[-1] = (apart[-1][0], max(b, apart[-1][1]))
        else:
            apart.append((a, b))
    return apart


def lattice(text: str) -> tuple[list[int], list[tuple[int, int, int]], np.ndarray]:
    """Token boundaries; candidate segments (first token, token after, kind); their feature rows, for a fit."""
    tokens, bounds = split(text)
    found = list(segments(text, tokens, bounds))
    rows = np.zeros((len(found), len(KINDS), len(FEATURES)))
    for x, (_, _, k, f) in enumerate(found):
        rows[x, k] = f
    return bounds, [x[:3] for x in found], rows.reshape(len(found), len(KINDS) * len(FEATURES))


def decode(text: str, w: np.ndarray, start: int = 0, end: int | None = None, lo: int = 0, hi: int | None = None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the best segmentation of text[start:end], of which text[lo:hi] is seen: entity segments with
    their scores, single outside tokens with none. Segments are scored as they come, so memory grows with the tokens alone."""
    tokens, bounds = split(text, start, end)
    of_kind, n = w.reshape(len(KINDS), len(FEATURES)).tolist(), len(tokens)
    best, back = [0.0] + [-math.inf] * n, [None] * (n + 1)
    done = 0

    def settle(upto: int) -> None:
        nonlocal done
        while done < upto:
            done += 1
            if best[done - 1] >= best[done]:
                best[done], back[done] = best[done - 1], None

    for i, j, k, f in segments(text, tokens, bounds, lo, hi):
        settle(i)
        v = best[i] + sum(map(mul, of_kind[k], f))
        if v > best[j]:
            best[j], back[j] = v, (i, k)
    settle(n)
    out, j = [], n
    while j:
        if back[j] is None:
            j -= 1
        else:
            i, k = back[j]
            out.append((bounds[i], k, bounds[j]))
            j = i
    return out[::-1]


def _gradient(n: int, segments: list[tuple[int, int, int]], rows: np.ndarray, gold: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Of the log-likelihood of the gold segmentation: its features less their expectation (forward-backward;
    passages are short, so plain products of clipped scores don't overflow). Segments come by first token."""
    e = np.exp(np.clip(rows @ w, -30, 30))
    a, b = [1.0] + [0.0] * n, [0.0] * n + [1.0]
    done = 0
    for (i, j, _), v in zip(segments, e.tolist()):
        while done < i:
            done += 1
            a[done] += a[done - 1]
        a[j] += a[i] * v
    while done < n:
        done += 1
        a[done] += a[done - 1]
    done = n
    for (i, j, _), v in zip(reversed(segments), e.tolist()[::-1]):
        while done > i:
            done -= 1
            b[done] = b[done + 1]
        b[i] += v * b[j]
    p = np.array([a[i] * b[j] for i, j, _ in segments]) * e / a[n]
    return (gold - p) @ rows


def examples(seed: int = 7, n: int = 800) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Made-up passages with marked entities, and others with numbers that are none."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9)))

    def card(sep: str) -> str:
        body = r.choice("45") + d(14)
        digits = next(body + c for c in "0123456789" if luhn(body + c))
        return sep.join(digits[i : i + 4] for i in range(0, 16, 4))

    def email() -> str:
        at, dot = r.choice([("[at]", "[dot]"), ("(at)", "(dot)"), (" at ", " dot "), (" [at] ", " [dot] "), (" (at) ", "."), (" (at) ", " (dot) "), ("<at>", "."), ("[at]", " dot ")])
        local = r.choice([word, word, lambda: f"{word()}.{word()}", lambda: f"{word()}{d(2)}", lambda: "".join(word() for _ in range(9))])
        return f"{local()}{at}{dot.join(word() for _ in range(r.choice((1, 1, 2))))}{dot}{r.choice(['com', 'org', 'net', 'de'])}"

    def phone() -> str:
        sep = r.choice(["-", ".", " ", "\t", "_", ",", "-", " - "])
        return r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{r.randint(2, 9)}{d(2)}{sep}{d(3)}{sep}{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"1-{d(3)}-{d(3)}-{d(4)}", f"00{r.randint(1, 9)}{d(1)} {d(3)} {d(3)} {d(4)}", f"0{d(3)} {d(7)}", f"({d(3)}){d(3)}-{d(4)}", f"{d(3)}{sep}{d(3)}{sep}{d(4)}"])

    def number() -> str:
        year, small_ = f"{r.choice((19, 20))}{d(2)}", str(r.randint(1, 999))
        return r.choice([f"20{d(2)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{d(16)}", f"{d(3)} {d(3)} {d(3)} {d(3)} {d(3)} {d(3)}", f"{d(12)}", f"1{d(3)}-1{d(3)}", f"{d(2)}/{d(2)}/{d(4)}", f"{d(1)}.{d(2)}.{d(3)}.{d(4)}", f"#{d(9)}", f"{d(8)}", f"{d(5)}.{d(6)}", f"{word()} at {word()}", f"{d(2)} {d(2)} {d(2)} {d(2)} {d(2)} {d(2)} {d(2)}", f'"{d(13)}"', f"{d(9)}",
            f"{small_},{d(3)},{d(3)}", f"{small_},{d(3)},{d(3)}.{d(2)}", f"{small_},{d(3)},{d(3)},{d(3)}", f"{year}, {r.choice((19, 20))}{d(2)}, {year}", f"{year}, {small_},{d(3)}", f"0.{d(8)}", f"{r.randint(10, 28)}.{r.randint(10, 12)}.{year}", f"{year}-12-{r.randint(10, 28)} {r.randint(10, 23)}:{r.randint(10, 59)}:{r.randint(10, 59)}", f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", f"{d(2)}.{d(4)}, {d(1)}.{d(4)}", f"{small_} {d(3)} {d(3)}", f"${small_},{d(3)},{d(3)}", f"{d(4)}-{d(4)}", f"{word()} at {word()}. {word()}", f"{d(3)}; {d(3)}; {d(4)}", f"{d(3)}: {d(3)}: {d(4)}"])

    def row() -> str:
        sep, size = r.choice([" ", " ", "\t", "  ", "-", ". ", ", ", ",", "\n", "; "]), r.randint(1, 7)
        return sep.join(d(r.randint(max(1, size - r.randint(0, 3)), size)) for _ in range(r.randint(4, 14)))

    makers = {"email": email, "ip": lambda: r.choice(["[.]", "(.)"]).join(str(r.randint(0, 255)) for _ in range(4)), "card": lambda: card(r.choice([".", "/", "  ", ". ", "_", "\t", ","])), "phone": phone}
    out = []
    for i in range(n):
        kind = ("email", "ip", "card", "phone", "none", "none", "phone", "none")[i % 8]
        left, right = " ".join(word() for _ in range(3)), " ".join(word() for _ in range(3))
        cue = r.choice(sorted(CUES[kind])) if kind != "none" and r.random() < 0.4 else word()
        body = makers[kind]() if kind != "none" else row() if i % 8 == 7 else number()
        text = f"{left} {cue}{r.choice([' ', ': '])}"
        out.append((f"{text}{body}{r.choice(['', '.', ','])} {right}", [(kind, len(text), len(text) + len(body))] if kind != "none" else []))
    for i in range(n // 8):  # split addresses with short parts, and such with a part that is too large
        parts = [r.randint(0, r.choice((9, 99, 255))) for _ in range(4)]
        if i % 2:
            parts[r.randint(0, 3)] = r.randint(256, 999)
        text, body = f"{word()} {r.choice([*sorted(CUES['ip']), word()])} ", r.choice(["[.]", "(.)", " . "]).join(map(str, parts))
        out.append((f"{text}{body}{r.choice(['', '.', ','])} {word()}", [] if i % 2 else [("ip", len(text), len(text) + len(body))]))
    return out


@lru_cache(maxsize=1)
def weights() -> np.ndarray:
    """Weights of the CRF, fitted to the made-up passages by gradient ascent with a pull to zero."""
    data = []
    for text, spans in examples():
        bounds, segments, rows = lattice(text)
        at = {b: i for i, b in enumerate(bounds)}
        gold = {(at[s], at[e], KINDS.index(k)) for k, s, e in spans if s in at and e in at}
        if segments:
            data.append((len(bounds) - 1, segments, rows, np.array([float(x in gold) for x in segments])))
    w, total = np.zeros(len(KINDS) * len(FEATURES)), np.zeros(len(KINDS) * len(FEATURES))
    for _ in range(120):
        g = sum(_gradient(*x, w) for x in data) - 0.01 * w
        total += g * g
        w = w + 1.0 * g / np.sqrt(total + 1e-8)
    return w


def gaps(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What base spans leave of a text, in order."""
    out, at = [], 0
    for s, _, e in base:
        if s > at:
            out.append((at, s))
        at = max(at, e)
    return [*out, (at, len(text))]


def added_spans(text: str, base: list[tuple[int, int, int]], w: np.ndarray) -> list[tuple[int, int, int]]:
    """Spans that the CRF finds in what base spans leave of a text; each part is looked at by itself. The same as
    decoding each part whole, since no candidate segment reaches over the edge of a place."""
    return [x for lo, hi in gaps(text, base) if hi - lo >= LEAST for a, b in places(text, lo, hi) for x in decode(text, w, a, b, lo, hi)]


def spans_of(text: str, w: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    base = base_spans(text)
    return base, sorted(base + added_spans(text, base, w))


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{s}:{e}" for s, k, e in spans])


def find(docs: DataFrame) -> DataFrame:
    """Per document: counts of the base spans by kind, the digest of their list, the list of all
    spans (kind:start:end by start, then kind; code points, end exclusive). Null: empty. Texts
    without personal data have an empty list. Repeated rows stay repeated."""
    w = weights()

    def make():
        def work(texts: list[str]) -> list[pa.Array]:
            found = [spans_of(t, w) for t in texts]
            counts = [[sum(k == n for _, k, _ in base) for base, _ in found] for n in range(4)]
            return [*(pa.array(c, pa.int64()) for c in counts), pa.array([hashlib.sha256(_listed(base).encode()).hexdigest() for base, _ in found]), pa.array([_listed(a) for _, a in found])]

        return work

    return map_texts(docs, make, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(text: str, w: np.ndarray) -> str:
    """The text with every span replaced by its kind in angle brackets; where spans overlap, the first one that starts names the place."""
    out, at, until = [], 0, -1
    for s, k, e in spans_of(text, w)[1]:
        if s >= until:
            out.append(text[at:s])
            out.append(f"<{KINDS[k].upper()}>")
        until = max(until, e)
        at = until
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and the redacted text (null: empty)."""
    w = weights()

    def make():
        return lambda texts: [pa.array([redact(t, w) for t in texts])]

    return map_texts(docs, make, "text string", keep)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(documents(spark, sf_dir))
