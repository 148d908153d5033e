"""Scalar text operators as column expressions. Spans and lengths count code points."""

from __future__ import annotations

import unicodedata
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# White space of the manuscript format, as the inside of a character class.
WS = r"\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: A word edge that knows ASCII only, before and after.
B, E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"

# Words without weight in evidence ranking.
EVIDENCE_STOP = (
    "a an the of in on for to and or is are was were be been being with by as at from that this these those it its we our they "
    "their but not no than then so such can may might could would should has have had do does did which who what when where how"
).split()
# Words without weight in glossary matching.
MATCH_STOP = "the a an and or of for in on to with by from at as is are be that this it its".split()


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold_one(t: str) -> str:
    """Lower case, compatibility form, without combining marks."""
    if t.isascii():
        return t.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.category(c).startswith("M"))


@F.pandas_udf(StringType())
def fold(s: pd.Series) -> pd.Series:
    """`fold_one` of each. (Spark has no Unicode normal forms.)"""
    return s.map(fold_one, na_action="ignore")


@F.pandas_udf(StringType())
def to_fixed(value: pd.Series, decimals: pd.Series) -> pd.Series:
    """A double with so many decimals, its exact binary value rounded half up."""
    out = [None if v is None or d is None or v != v else str(Decimal(float(v)).quantize(Decimal(1).scaleb(-int(d)), ROUND_HALF_UP)) for v, d in zip(value, decimals)]
    return pd.Series(out, dtype=object)


def tokens_of_folded(folded: str | Column) -> Column:
    return F.filter(F.split(col(folded), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def tokens(text: str | Column) -> Column:
    """Folded runs of letters and digits."""
    return tokens_of_folded(fold(col(text)))


def key(text: str | Column) -> Column:
    return F.array_join(tokens(text), " ")


def jaccard(a: str | Column, b: str | Column) -> Column:
    """Of two arrays as sets; zero if either is empty."""
    a, b = col(a), col(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def sha256(text: str | Column) -> Column:
    return F.sha2(col(text), 256)


def language(text: str | Column) -> Column:
    """ar if there are more Arabic than Latin letters, else en."""
    t = col(text)
    return F.when(F.regexp_count(t, F.lit(r"[\u0600-\u06ff]")) > F.regexp_count(t, F.lit("[A-Za-z]")), "ar").otherwise("en")


def _steps(text: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, to in steps:
        text = F.regexp_replace(text, pattern, to)
    return text


# Entities and what they stand for; the order is part of the meaning.
ENTITIES = [("&nbsp;|&#160;", " "), ("&amp;|&#38;", "&"), ("&lt;|&#60;", "<"), ("&gt;|&#62;", ">"), ("&quot;|&#34;", '"'), ("&#0?39;|&apos;|&rsquo;|&#8217;", "'"), ("&mdash;|&#8212;|&ndash;|&#8211;", " "), ("&hellip;|&#8230;", "...")]


def strip_markup(text: str | Column) -> Column:
    """Markup to running text: CDATA unwrapped, scripts and styles gone, block ends as spaces."""
    before = [(r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"), (r"(?is)<(script|style).*?</\1>", " "), (r"(?i)<br[" + WS + r"]*/?>", " "), (r"(?i)</(p|div|li|h[1-6]|tr)>", " "), (r"<[^>]+>", "")]
    after = [(r"(?i)&[a-z]+;|&#[0-9]+;", " "), (f"[{WS}]+", " "), (r"^ | $", "")]
    return _steps(F.coalesce(col(text), F.lit("")), before + ENTITIES + after)


def inline_text(text: str | Column) -> Column:
    """Inline markup of a block to text."""
    return _steps(col(text), [(r"(?i)<br[" + WS + r"]*/?>", " "), (r"<[^>]+>", ""), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")])


def page_text(html: str | Column) -> Column:
    """A page to text for evidence: blocks end in blank lines. Of numeric entities those of ASCII are decoded."""
    head = [(r"(?is)<(script|style|math)[^>]*>.*?</\1>", " "), (r"(?i)</(p|div|section|article|li|h[1-6]|blockquote|tr|table)[" + WS + r"]*>", "\n\n"), (r"(?i)<(br|hr)[" + WS + r"]*/?>", "\n\n"), (r"(?i)<(h[1-6]|p|div|section|li)(?![A-Za-z0-9_])[^>]*>", "\n\n"), (r"<[^>]+>", " ")]
    named = [("&nbsp;|&#160;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')]
    numeric = [(f"&#0*{c};", "\\\\" + chr(c) if chr(c) in "\\$" else chr(c)) for c in (33, 34, 36, 37, 38, 39, 40, 41, 45, 58, 59, 60, 62, 91, 93)]
    return _steps(col(html), head + named + numeric + [("[ \t]+", " "), (r"\n[" + WS + r"]*\n+", "\n\n")])


def flow(text: str | Column) -> Column:
    """Every line break becomes one space, so that places stay."""
    return F.translate(col(text), "\r\n", "  ")


def trim_url(url: str | Column) -> Column:
    return F.regexp_replace(col(url), r"[.,;:!?'\"»«]+$", "")


def safe_decode(text: str | Column) -> Column:
    """Percent-decoded, or as it is where that fails."""
    t = col(text)
    return F.coalesce(F.try_url_decode(F.replace(t, F.lit("+"), F.lit("%2B"))), t)


def squeezed(text: str | Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(col(text), f"[{WS}]+", " "), "^ | $", ""))


def grounded(haystack: str | Column, needle: str | Column, least: int) -> Column:
    """Does a quote of at least so many characters occur, up to case and white space?"""
    n = squeezed(needle)
    return F.coalesce((F.length(n) >= least) & F.contains(squeezed(haystack), n), F.lit(False))


def words(text: str | Column) -> Column:
    return F.filter(F.split(col(text), f"[{WS}]+"), lambda x: x != "")


def word_count(text: str | Column) -> Column:
    return F.size(words(text))


def around(text: str | Column, offset: Column, before: int = 600, after: int = 200) -> Column:
    """The characters around an offset."""
    lo = F.greatest(offset - before, F.lit(0))
    return F.substring(col(text), lo + 1, offset + after - lo)


def quote(text: str | Column, start: Column, end: Column) -> Column:
    """An excerpt cut at whole words, with an ellipsis where it is cut within a line; the raw cut if no whole word is left."""
    t = col(text)
    lo, hi = F.greatest(start, F.lit(0)), F.least(end, F.length(t))
    raw = F.substring(t, lo + 1, hi - lo)
    front = (lo > 0) & ~F.substring(t, lo, F.lit(1)).rlike(f"[{WS}]") & ~F.substring(t, lo + 1, F.lit(1)).rlike(f"[{WS}]")
    back = (hi < F.length(t)) & ~F.substring(t, hi, F.lit(1)).rlike(f"[{WS}]") & ~F.substring(t, hi + 1, F.lit(1)).rlike(f"[{WS}]")
    body = F.when(front, F.regexp_replace(raw, f"^[^{WS}]+", "")).otherwise(raw)
    body = F.when(back, F.regexp_replace(body, f"[^{WS}]+$", "")).otherwise(body)
    body = F.regexp_replace(F.regexp_replace(body, f"^[{WS}]+", ""), f"[{WS}]+$", "")
    line = lambda at: (at < 1) | (at > F.length(t)) | F.substring(t, at, F.lit(1)).isin("\n", "\r")
    whole = F.concat(F.when(line(lo), "").otherwise("…"), body, F.when(line(hi + 1), "").otherwise("…"))
    return F.when(body == "", F.trim(raw)).otherwise(whole)


def entry_key(entry: str | Column) -> Column:
    """A reference entry for comparison: no number, lower case, runs of letters and digits."""
    return F.trim(_steps(F.lower(F.regexp_replace(col(entry), r"^\[[0-9]{1,3}\]", "")), [("[^a-z0-9]+", " ")]))


def number(text: str | Column) -> Column:
    """Digits, dots and commas of a number, its first comma as a dot."""
    return F.regexp_replace(F.regexp_replace(col(text), "[^0-9.,]", ""), "^([^,]*),", "$1.")


def evidence_tokens(text: str | Column) -> Column:
    kept = F.split(F.regexp_replace(F.lower(col(text)), f"[^a-z0-9{WS}-]", " "), f"[{WS}]+")
    return F.filter(kept, lambda x: (F.length(x) > 2) & ~x.isin(EVIDENCE_STOP))


def token_estimate(chars: Column) -> Column:
    return (F.ceil(chars / 3.4) + 300).cast("long")


def retry_after(value: str | Column, now: Column, fallback_ms: int) -> Column:
    """Milliseconds that a Retry-After header asks for: seconds, or a date; else the fallback."""
    v = F.trim(col(value))
    seconds = v.try_cast("double")
    date = F.try_to_timestamp(F.regexp_replace(v, r"^[A-Za-z]{3}, ([0-9]{2} [A-Za-z]{3} [0-9]{4} [0-9:]{8}) GMT$", "$1"), F.lit("dd MMM yyyy HH:mm:ss"))
    wait = (date.cast("double") - now.cast("double")) * 1000
    return F.coalesce(F.when(seconds >= 0, seconds * 1000), F.when(wait > 0, wait), F.lit(float(fallback_ms))).cast("long")


def rate_scope(body: str | Column) -> Column:
    return F.when(col(body).rlike(r"(?i)per day|(?<![A-Za-z0-9_])(tpd|rpd)(?![A-Za-z0-9_])"), "day").otherwise("minute")


def completions_url(base: str | Column, default: str) -> Column:
    """Where an endpoint setting leads: an origin, a /v1 base or a full path; anything else: the default."""
    b = F.regexp_replace(F.trim(col(base)), "/+$", "")
    path = F.regexp_extract(b, r"^https?://[^/\s?#]+([^?#\s]*)$", 1)
    ok = b.rlike(r"^(?i)https?://[^/\s?#]+[^?#\s]*$")
    return F.when(~F.coalesce(ok, F.lit(False)), F.lit(default)).when(path == "", F.concat(b, F.lit("/v1/chat/completions"))).when(path.endswith("/chat/completions"), b).otherwise(F.concat(b, F.lit("/chat/completions")))
