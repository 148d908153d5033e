"""Queries over written-out inputs, with the expected rows as SQL: what must be found, and what must stay silent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import adjudicate, citations, claims, evidence, geometry, glossary, references, report, structure
from ..sources import files, html

QUERIES: dict[str, tuple] = {}


def values(columns: str, rows: list[tuple]) -> str:
    """SQL that gives the rows."""

    def lit(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, float):
            return f"{v!r}::double"
        if isinstance(v, int):
            return str(v)
        return "'" + v.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) t({columns})"


def fixture(columns: str, rows: list[tuple], cast: str = ""):
    def add(f):
        sql = values(columns, rows)
        QUERIES[f.__name__] = (f, f"SELECT {cast} FROM ({sql})" if cast else sql)
        return f

    return add


E1, E2, E3 = "[1] P. Lee, A survey of stream joins, Journal, 2018.", "[2] Q. Roy, Notes on sorted indexes today, Workshop, 2020.", "[3] S. Kim, Bitmap layouts for wide tables, Press, 2021."


def paper(prose: str, *entries: str) -> str:
    return f"Introduction\n\n{prose}\n\nReferences\n\n" + "\n".join(entries) + "\n"


LISTS = [
    ("R1", paper("Earlier systems [1] and [2] differ, see [3].", E1, E2, E3)),
    ("R2", paper("Earlier systems [1] and [2] differ, see [3].", E1, E2, "[4] S. Kim, Bitmap layouts for wide tables, Press, 2021.")),
    ("R3", paper("Only [1] and [2] matter.", E1, E2, E3)),
    ("R4", paper("See [1], [2], [3].", E1, E2, E3, "[3] T. Fox, Another numbering slip in lists, Press, 2022.")),
    ("R5", paper("See [1], [2], [3], [4].", E1, E2, E3, "[4] P. Lee, A survey of stream joins, Journal, 2018.")),
    ("R6", paper("See [1], [2], [3].", E1, E2, "[3] S. Kim, Bitmap layouts for very wide tables, Press.")),
    ("R7", paper("See [1], [2], [3].", E1, E2, "[3] S. Kim, Bitmap layouts for very wide tables, in press.")),
    ("R8", paper("See [1-3].", E1, E2, E3)),
    ("R9", paper("See [1-2, 3].", E1, E2, E3)),
    ("R10", paper("Lee (2018) and Roy (2020) agree.", E1, E2, E3)),
    ("R11", paper("See [1] and [9].", E1, E2, E3)),
    ("R12", paper("See [1].", E1)),
    ("R13", "Only prose with [1] and [2] in it."),
]


@fixture("doc_id, \"check\", severity, number", [("R2", "cited-not-listed", "warning", 3), ("R2", "listed-not-cited", "info", 4), ("R3", "listed-not-cited", "info", 3), ("R4", "duplicate-reference", "info", 3), ("R5", "duplicate-reference", "info", 4), ("R6", "reference-missing-year", "info", 3), ("R9", "listed-not-cited", "info", 1), ("R9", "listed-not-cited", "info", 2), ("R11", "listed-not-cited", "info", 2), ("R11", "listed-not-cited", "info", 3)])
def fx_reference_list(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.createDataFrame(LISTS, "doc_id string, text string")
    return references.check_references(docs).select("doc_id", "check", "severity", "number")


CAPS = "Figure 1: A.\nFigure 2: B.\nFigure 3: C.\n"
FLOATS = [
    ("F1", "Prose only.\n\nFigure 1: Layout.\n"), ("F2", "As Figure 2 shows, it rises.\n\nFigure 1: Curve.\n"), ("F3", "See Figure 3 and Table 2."), ("F4", "See Figures 1-3.\n\n" + CAPS), ("F5", "See Figures 1, 2 and 3.\n\n" + CAPS),
    ("F6", "See Figures 1, 2, and 3.\n\n" + CAPS), ("F7", "Table 1 is discussed.\n\nFigure 1: X.\nTable 1: Y.\n"), ("F8", "Text here. Figure 1: Curve. More on Figure 1."), ("F9", "Fig. 1a helps.\n\nFigure 1 | Curve."), ("F10", "Figure 1 shows it.\n\nFigure 1: Curve."),
]


@fixture("doc_id, \"check\", family, number", [("F1", "float-never-referenced", "Figure", 1), ("F2", "float-missing", "Figure", 2), ("F2", "float-never-referenced", "Figure", 1), ("F6", "float-never-referenced", "Figure", 3), ("F7", "float-never-referenced", "Figure", 1)])
def fx_floats(spark, d):
    return references.check_floats(spark.createDataFrame(FLOATS, "doc_id string, text string")).drop("start")


BRIEFS = [
    ("C1", "Uptake hits 45% soon.", "No figures."), ("C2", "About 99% held.", "It was 99.13%."), ("C3", "About 99% held.", "It was 91.13%."), ("C4", "Exactly 99.20%.", "We saw 99.13%."),
    ("C5", "Up 30%.", "Rose 30 percent."), ("C6", "A gain of 45 percentage points.", "No figures."), ("C7", "Got 1.01%.", "Got 1.005%."),
]


@fixture("doc_id, quoted", [("C1", "45%"), ("C3", "99%"), ("C4", "99.20%"), ("C6", "45 percent"), ("C7", "1.01%")])
def fx_summary(spark, d):
    return claims.summary_drift(spark.createDataFrame(BRIEFS, "doc_id string, brief string, text string")).select("doc_id", "quoted")


SAYINGS = [
    ("1", "The index always returns every matching row quickly."), ("2", "Latency was strongly tied to the partition count here."), ("3", "Skewed keys are commonly seen in production event logs."), ("4", "Hence the planner must choose the smaller build side."),
    ("5", "Skewed keys cause stragglers in the final reduce stage."), ("6", "Skewed keys may cause stragglers in the reduce stage."), ("7", "We report that skewed keys cause stragglers in tests."), ("8", "It always wins."),
]


@fixture("doc_id, trigger", [("1", "strong-assertion"), ("2", "booster"), ("3", "generality"), ("4", "inferential"), ("5", "bare-causal")])
def fx_overclaims(spark, d):
    return claims.overclaims(spark.createDataFrame(SAYINGS, "doc_id string, text string")).select("doc_id", "trigger")


NUMBERS = [("1", "The run reached 91.4% recall on the set. A later run reached 88.0% recall on the set."), ("2", "We reached 99% recall. Precisely, we reached 99.13% recall."), ("3", "We used 5 samples. Later we used 12 samples.")]


@fixture("doc_id, metric, a_value, b_value", [("1", "recall", 91.4, 88.0)])
def fx_contradictions(spark, d):
    return claims.contradictions(spark.createDataFrame(NUMBERS, "doc_id string, text string")).select("doc_id", "metric", "a_value", "b_value")


TERM = "doc_id string, slug string, term string, definition string, variants array<string>, single_word_allowed boolean"
DAG, FIVE = ("dag-scheduler", "Directed Acyclic Graph Scheduler (DAGS)", "d", None, None), ("five", "Alpha Beta Gamma Delta Epsilon", "f", None, None)
NEAR = [
    ("1", "The directed graph scheduler stalled."), ("2", "Directed acyclic graph schedulers stalled. DAGS too."), ("3", "The directed cyclic graph scheduler stalled."), ("4", "The directed acyclic fast graph scheduler stalled."),
    ("5", "The scheduler graph directed stalled."), ("6", "alpha beta gamma delta x epsilon"),
]


@fixture("doc_id, slug, start, \"end\", quoted, similarity", [("1", "dag-scheduler", 4, 28, "directed graph scheduler", 0.75), ("4", "dag-scheduler", 4, 41, "directed acyclic fast graph scheduler", 0.8), ("6", "five", 0, 22, "alpha beta gamma delta", 0.8)])
def fx_glossary(spark, d):
    raw = spark.createDataFrame([DAG, FIVE], "slug string, term string, definition string, variants array<string>, single_word_allowed boolean")
    return glossary.near_misses(spark.createDataFrame(NEAR, "doc_id string, text string"), glossary.terms(raw))


@fixture("slug, canonical, n_variants, stub", [("g", "Graph Store", 1, False), ("h", "Hash Join Table", 0, False), ("h-2", "Hash Joining Table", 0, False), ("s", "Shown Elsewhere Term", 0, True)])
def fx_terms(spark, d):
    raw = spark.createDataFrame([("g", "Graph Store", "x", None, None), ("g-2", "Store of Graphs", "x", None, None), ("h", "Hash Join Table", "a", None, None), ("h-2", "Hash Joining Table", "b", None, None), ("s", "Shown Elsewhere Term", 'See "Graph Store".', None, None), (None, "Lost", "", None, None)], "slug string, term string, definition string, variants array<string>, single_word_allowed boolean")
    return glossary.terms(raw).select("slug", "canonical", F.size("variants").alias("n_variants"), "stub")


CITED = [("1", "Prior work (doi:10.1234/abc-1)."), ("2", "See arXiv:2101.01234v2 for more."), ("3", "At 10.1234/q?utm=1 now."), ("4", "In 10.1016/j.x.2021.\n103535 it is."), ("5", "In 10.1234/abc.\nNext part"), ("6", "Cut 10.1234/x<y"), ("7", "Coded 10.1234/a%2Fb there"), ("8", "No 110.1234/x and none10.1234/y")]


@fixture("doc_id, kind, id, manufactured", [("1", "doi", "10.1234/abc-1", False), ("2", "arxiv", "2101.01234", False), ("3", "doi", "10.1234/q", False), ("4", "doi", "10.1016/j.x.2021", True), ("5", "doi", "10.1234/abc", False), ("6", "doi", "10.1234/x", True), ("7", "doi", "10.1234/a%2fb", True)])
def fx_identifiers(spark, d):
    return citations.identifiers(spark.createDataFrame(CITED, "doc_id string, text string")).select("doc_id", "kind", "id", "manufactured")


@fixture("host, seq, start", [("a", 1, 0), ("a", 2, 3), ("a", 3, 20), ("a", 4, 23)])
def fx_pacing(spark, d):
    r = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("a", 3, 20), ("a", 4, 21)], "host string, seq int, arrival int")
    return citations.pacing(r, F.lit(3)).select("host", "seq", "start")


STATEMENT = "Introduction\nA later study by Vega et al. [2] measured how adaptive joins reduce the total shuffle volume across many large clusters.\n\nReferences\n[1] A. One, First, 2019.\n[2] B. Vega, Second, arXiv:2101.01234, 2021."


@fixture("doc_id, markers, ids, linked_by", [("1", "2", "arxiv:2101.01234", "bracket")])
def fx_statements(spark, d):
    docs = spark.createDataFrame([("1", STATEMENT), ("2", "Short with [1] only.\n\nReferences\n[1] doi:10.1234/x")], "doc_id string, text string")
    s = structure.statements(docs, citations.identifiers(docs))
    return s.select("doc_id", F.array_join(F.transform("markers", lambda x: x.cast("string")), ",").alias("markers"), F.array_join("ids", ",").alias("ids"), "linked_by")


@fixture("doc_id, sent_no, text", [("1", 0, "One ends here. "), ("1", 1, "Two et al. goes on. "), ("1", 2, "Three 91. 4 items! "), ("1", 3, "Four (ok.) "), ("1", 4, "Five"), ("2", 0, "See Fig. 3 now. "), ("2", 1, "The answer is no. Next part.")])
def fx_sentences(spark, d):
    docs = spark.createDataFrame([("1", "One ends here. Two et al. goes on. Three 91. 4 items! Four (ok.) Five"), ("2", "See Fig. 3 now. The answer is no. Next part.")], "doc_id string, text string")
    return structure.sentences(docs).select("doc_id", "sent_no", "text")


@fixture("doc_id, kind", [("1", "other"), ("1", "methods"), ("1", "results"), ("1", "references")])
def fx_sections(spark, d):
    docs = spark.createDataFrame([("1", "A title\nIntroduction to graphs\nIV. METHODS\nx\n3.1 Results:\ny\nBibliography\n[1] z")], "doc_id string, text string")
    return structure.sections(docs).select("doc_id", "kind")


@fixture("run_id, seq, refused", [("r", 1, None), ("r", 2, "call too long"), ("r", 3, None), ("r", 4, "characters used up"), ("r", 5, None)])
def fx_run_budget(spark, d):
    r = spark.createDataFrame([("r", 1, 100), ("r", 2, 24_001), ("r", 3, 200), ("r", 4, 900), ("r", 5, 700)], "run_id string, seq int, chars int")
    return adjudicate.run_budget(r, chars=1000).select("run_id", "seq", "refused")


@fixture("account, seq, wait_ms", [("a", 1, 0.0), ("a", 2, 30000.0), ("a", 3, 60000.0)])
def fx_token_bucket(spark, d):
    r = spark.createDataFrame([("a", 1, 0, 6000), ("a", 2, 0, 6000), ("a", 3, 30000, 9000)], "account string, seq int, arrival int, tokens int")
    return adjudicate.token_bucket(r).select("account", "seq", "wait_ms")


@fixture("request_id, verdict, finding", [("1", "unsupported", True), ("2", "unsupported", False), ("3", "supported", False), ("4", None, False), ("5", None, False)])
def fx_claim_verdicts(spark, d):
    doc, ev = "Adaptive joins reduce shuffle volume by half.", "We found that volume did not change at all."
    pairs = spark.createDataFrame([(str(i), "d", doc, ev) for i in range(1, 6)], "request_id string, doc_id string, document string, evidence string")
    quote = '{"verdict":"%s","claim_quote":"%s","source_quote":"volume  DID not change"}'
    v = spark.createDataFrame([("1", quote % ("unsupported", "joins reduce  shuffle")), ("2", quote % ("unsupported", "joins double shuffle")), ("3", quote % ("supported", "joins reduce shuffle")), ("4", "no JSON")], "request_id string, payload string")
    return adjudicate.claim_verdicts(pairs, v).select("request_id", "verdict", "finding")


def grid(start: float, leading: float, xs: list[float], cells: list[list[str]], width=lambda s: 5.0 * len(s)) -> list[tuple]:
    return [(s, x, start - r * leading, width(s), 10.0) for r, line in enumerate(cells) for s, x in zip(line, xs) if s]


PAGES = {
    1: grid(700, 14, [50, 150, 250], [["Name", "Size", "Age"], ["ab", "12", "3"], ["cd", "14", "5"], ["ef", "16", "7"]]),
    2: grid(700, 14, [50, 150, 250], [["Name", "Size", "Age"], ["ab", "12", "3"], ["cd", "", "5"], ["ef", "16", "7"]]),
    3: [("only", 50.0, 700.0, 20.0, 10.0), ("two", 150.0, 700.0, 15.0, 10.0)],
}


@fixture("page, n_rows, n_cols, confidence", [(1, 4, 3, 1.0), (2, 4, 3, 0.85)])
def fx_tables(spark, d):
    items = [(1, p, *[float(v) if not isinstance(v, str) else v for v in i]) for p, rows in PAGES.items() for i in rows]
    df = spark.createDataFrame(items, "doc_id long, page int, str string, x double, y double, width double, height double")
    return geometry.find_tables(df).select("page", F.size("rows").alias("n_rows"), F.size(F.col("rows")[0]).alias("n_cols"), F.round("confidence", 4).alias("confidence"))


PAGE = '<html><head><title>t</title></head><body><h1>A <b>bold</b> title</h1><p>See <a href="https://doi.org/10.1234/x">this work</a> now.<br>Then</p><ul><li>one</li><li>two</li></ul><table><tr><th>a</th><td>b &amp; c</td></tr></table><pre>x = 1</pre><h5>low</h5><img src="i.png" alt="pic"><div>bare</div></body></html>'


@fixture("block_no, type, body", [(0, "paragraph", "t"), (1, "heading", "A <b>bold</b> title"), (2, "paragraph", "See this work now. Then"), (3, "list", "one|two"), (4, "table", "a|b &amp;amp; c"), (5, "code", "x = 1"), (6, "heading", "low"), (7, "image", "pic"), (8, "paragraph", "bare")])
def fx_html_blocks(spark, d):
    b = html.html_blocks(spark.createDataFrame([(1, PAGE)], "doc_id long, html string"))
    body = F.coalesce(F.array_join("items", "|"), F.array_join(F.flatten("rows"), "|"), F.col("text"), F.col("caption"))
    return b.select("block_no", "type", body.alias("body"))


@fixture("href, anchor_text, \"offset\"", [("https://doi.org/10.1234/x", "this work", 17)])
def fx_html_links(spark, d):
    x = html.extract_html(spark.createDataFrame([(1, PAGE)], "doc_id long, content string"))
    return x.select(F.explode("links").alias("l")).select("l.href", "l.anchor_text", "l.offset")


@fixture("doc_id, href, anchor_text, \"offset\"", [("1", "https://a.org/x", "name", 4), ("1", "http://b.org/y", "http://b.org/y", 36)])
def fx_plain_links(spark, d):
    return html.plain_links(spark.createDataFrame([("1", "See [name](https://a.org/x) or also http://b.org/y. End")], "doc_id string, text string"))


@fixture("id, format", [("1", "plain"), ("2", "html"), ("3", "plain"), ("4", "html"), ("5", "plain")])
def fx_extract(spark, d):
    rows = [("1", "a < b", "auto"), ("2", "<p>x</p>", "auto"), ("3", "<p>x</p>", "plain"), ("4", "bare", "html"), ("5", "  ", "html")]
    return html.extract_content(spark.createDataFrame(rows, "doc_id string, content string, format string")).select(F.col("doc_id").alias("id"), "format")


@fixture("id, kind", [("1", "pdf"), ("2", "docx"), ("3", "legacy-doc"), ("4", "unknown")])
def fx_upload_kind(spark, d):
    rows = [("1", b"%PDF-1.7 x"), ("2", b"PK\x03\x04rest"), ("3", b"\xd0\xcf\x11\xe0more"), ("4", b"hello")]
    return spark.createDataFrame(rows, "id string, content binary").select("id", files.kind_of("content").alias("kind"))


@fixture("id, url", [("1", "https://h/v1/chat/completions"), ("2", "https://h/v1/chat/completions"), ("3", "https://h/v1/chat/completions"), ("4", "default"), ("5", "default")])
def fx_endpoint(spark, d):
    rows = [("1", "https://h"), ("2", "https://h/v1/"), ("3", "https://h/v1/chat/completions"), ("4", "ftp://h"), ("5", None)]
    return spark.createDataFrame(rows, "id string, base string").select("id", T.completions_url("base", "default").alias("url"))


@fixture("id, wait_ms, scope", [("1", 2500, "minute"), ("2", 60000, "day"), ("3", 5000, "day"), ("4", 5000, "minute")])
def fx_retry(spark, d):
    rows = [("1", "2.5", "rate limit: TPM"), ("2", "Fri, 01 Mar 2024 00:01:00 GMT", "requests per day"), ("3", None, "limit TPD reached"), ("4", "soon", "")]
    now = F.lit("2024-03-01 00:00:00").cast("timestamp")
    return spark.createDataFrame(rows, "id string, h string, body string").select("id", T.retry_after("h", now, 5000).alias("wait_ms"), T.rate_scope("body").alias("scope"))


@fixture("id, v", [("fold", "angstrom fi2 i"), ("tokens", "graph of stages gos"), ("decode", "10.1/a+b c"), ("bad decode", "%zz"), ("trim", "http://x.org/a"), ("number", "1.234,5"), ("fixed", "1.00"), ("inline", "a b < c"), ("entry", "p lee a survey 2018"), ("strip", "a < b & c")])
def fx_scalars(spark, d):
    rows = [("fold", "Ångström ﬁ² İ"), ("tokens", "Graph-of-Stages (GoS)"), ("decode", "10.1/a+b%20c"), ("bad decode", "%zz"), ("trim", "http://x.org/a.),;".replace(")", "")), ("number", "1,234,5%"), ("fixed", "1.005"), ("inline", "a<br>b &lt; <b>c</b>"), ("entry", "[12] P. Lee: A Survey, 2018."), ("strip", "<p>a &amp;lt; b</p><script>x</script>&amp; c")]
    t = spark.createDataFrame(rows, "id string, t string")
    out = F.when(F.col("id") == "fold", T.fold("t")).when(F.col("id") == "tokens", T.key("t")).when(F.col("id").contains("decode"), T.safe_decode("t")).when(F.col("id") == "trim", T.trim_url("t")).when(F.col("id") == "number", T.number("t"))
    return t.select("id", F.trim(out.when(F.col("id") == "fixed", T.to_fixed(F.col("t").try_cast("double"), F.lit(2))).when(F.col("id") == "inline", T.inline_text("t")).when(F.col("id") == "entry", T.entry_key("t")).otherwise(T.strip_markup("t"))).alias("v"))


@fixture("q_id, idx", [("q", 2)])
def fx_bm25(spark, d):
    s = spark.createDataFrame([("d", 0, "Bitmaps are small and quick here."), ("d", 1, "Sorting needs memory and time."), ("d", 2, "Adaptive joins lower shuffle volume."), ("d", 3, "Tables are wide.")], "id string, idx int, sentence string")
    q = spark.createDataFrame([("q", "d", "Do adaptive joins help?"), ("n", "d", "unrelated words")], "q_id string, id string, query string")
    return evidence.bm25(s, q).select("q_id", "idx")


@fixture("doc_id, overclaim_truncated", [("long", 6), ("full", 0), ("short", 0)])
def fx_overclaim_truncated(spark, d):
    said = lambda n: " ".join(f"It always returns each matching row of table {i}." for i in range(n))
    t = spark.createDataFrame([("long", said(31)), ("full", said(25)), ("short", "Plain words.")], "doc_id string, text string")
    found = spark.createDataFrame([], "doc_id string, check string")
    return report.run_counters(t, found).select("doc_id", "overclaim_truncated")


@fixture("doc_id, \"check\", address", [("d", "cited-not-listed", "05.1"), ("d", "cited-not-listed", "05.2"), ("d", "overclaim", "12.1")])
def fx_addresses(spark, d):
    f = spark.createDataFrame([("d", "cited-not-listed", 5, 1), ("d", "cited-not-listed", 9, 2), ("d", "overclaim", 0, None)], "doc_id string, check string, span_start int, number int")
    return report.addresses(f).select("doc_id", "check", "address")
