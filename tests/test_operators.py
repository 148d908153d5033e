import json
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from manuscript_spark import review as R
from manuscript_spark.functions import spans
from manuscript_spark.functions import text as T
from manuscript_spark.operators import adjudicate, citations, geometry, report, structure
from manuscript_spark.sources import files, html


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


TEXTS = st.lists(st.text(alphabet="ab .!?\n\"()1eé😀[]FigTl", max_size=60), min_size=1, max_size=12)


@settings(max_examples=8, deadline=None)
@given(TEXTS)
def test_sentences_tile_the_text(spark, texts):
    rows = structure.sentences(docs(spark, *texts)).orderBy("doc_id", "sent_no").collect()
    for i, t in enumerate(texts):
        own = [r for r in rows if r.doc_id == i]
        assert "".join(r.text for r in own) == t
        at = 0
        for r in own:
            assert (r.start, r.end) == (at, at + len(r.text))
            at = r.end


@settings(max_examples=8, deadline=None)
@given(TEXTS)
def test_matches_have_their_places(spark, texts):
    rows = spans.exploded(docs(spark, *texts), "text", "[a-b]+|[0-9]", "doc_id").collect()
    want = sorted((i, m.start(), m.end(), m[0]) for i, t in enumerate(texts) for m in re.finditer("[a-b]+|[0-9]", t))
    assert sorted((r.doc_id, r.start, r.end, r.text) for r in rows) == want


def test_chunks_by_brute_force(spark):
    word = "w" * 4
    texts = [" ".join([word] * 30 + ["end."]) + " ", "Introduction\n" + " ".join(" ".join([word] * n) + "." for n in (90, 120, 60, 260, 10, 5)) + "\nReferences\n[1] x"]
    got = structure.chunks(docs(spark, *texts)).orderBy("doc_id", "chunk_no").collect()
    for i, t in enumerate(texts):
        flowed, want = t.replace("\n", " "), []
        parts = structure.sections(docs(spark, t)).where("kind <> 'references'").orderBy("start").collect()
        for s in parts:
            sents = structure.sentences(spark.createDataFrame([(0, flowed[s.start : s.end])], "doc_id long, text string")).orderBy("sent_no").collect()
            have, w = [], 0
            for x in [(s.start + r.start, s.start + r.end) for r in sents]:
                n = len(flowed[x[0] : x[1]].split())
                if n >= 250:
                    if w:
                        want.append((have[0][0], have[-1][1]))
                    want.append(x)
                    have, w = [], 0
                    continue
                have, w = have + [x], w + n
                if w >= 200:
                    want.append((have[0][0], have[-1][1]))
                    have = have[-1:] if len(have) > 1 else []
                    w = sum(len(flowed[a:b].split()) for a, b in have)
            if w:
                want.append((have[0][0], have[-1][1]))
        assert [(r.start, r.end) for r in got if r.doc_id == i] == want


def test_empty_tables_and_nulls(spark):
    none = docs(spark).where("false") if False else spark.createDataFrame([], "doc_id long, text string")
    assert structure.chunks(none).count() == 0
    assert report.deterministic_findings(none).count() == 0
    one = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert report.doc_stats(one).first().words == 0
    assert report.deterministic_findings(one).count() == 0


def test_quote_keeps_whole_words(spark):
    t = "alpha beta gamma delta"
    q = spark.range(1).select(T.quote(F.lit(t), F.lit(2), F.lit(13)).alias("q")).first().q
    assert q == "…beta…"


def test_html_round(spark):
    text, links, joints = html.extract("<p>See 10.1234/x<sub>5</sub> and <a href='http://a'>b c</a>.</p><script>no</script>")
    assert text == "See 10.1234/x5 and b c." and links == [("http://a", "b c", 19)] and 13 in joints


def test_markup_makes_a_doi(spark):
    x = html.extract_html(spark.createDataFrame([(1, "<p>See 10.1234/x<sub>5</sub></p>")], "doc_id long, content string"))
    r = citations.identifiers(x.select("doc_id", "text", "inline_boundaries")).first()
    assert (r.id, r.manufactured) == ("10.1234/x5", True)


def test_link_clears_nothing_but_manufactured(spark):
    d = docs(spark, "See 10.1234/abc now")
    links = spark.createDataFrame([(0, "https://doi.org/10.1234/ABC", "it", 4)], "doc_id long, href string, anchor_text string, offset int")
    rows = citations.identifiers(d, links).collect()
    assert [(r.id, r.source) for r in rows] == [("10.1234/abc", "text")]


def test_bucket_is_not_a_plain_sum(spark):
    r = spark.createDataFrame([("r", i, 10) for i in range(125)], "run_id string, seq int, chars int")
    out = adjudicate.run_budget(r).where("refused is not null").collect()
    assert len(out) == 5 and {x.refused for x in out} == {"calls used up"}


def test_tables_shuffled_input(spark):
    from manuscript_spark.plans.fixtures import PAGES

    items = [(1, p, *map(lambda v: v if isinstance(v, str) else float(v), i)) for p, rows in PAGES.items() for i in reversed(rows)]
    df = spark.createDataFrame(items, "doc_id long, page int, str string, x double, y double, width double, height double")
    assert geometry.accepted_tables(df).where("page = 1").first().rows[1] == ["ab", "12", "3"]


def test_glossary_file(spark, tmp_path):
    p = tmp_path / "g.json"
    p.write_text('{"source": "x", "terms": [{"slug": "a", "en": {"term": "A b", "definition": "d"}}, {"slug": "c"}]}')
    assert [tuple(r)[:3] for r in files.glossary(spark, str(p)).collect()] == [("a", "A b", "d")]
    p.write_text('[{"term": "Q r", "slug": "q", "variants": ["v"]}]')
    assert [tuple(r) for r in files.glossary(spark, str(p)).collect()] == [("q", "Q r", "", ["v"])]


def test_starts_over_many_blocks(spark):
    for n in (0, 1, 63, 64, 65, 128, 1000, 5000):
        sizes = [(i * 7) % 13 for i in range(n)]
        got = spark.createDataFrame([(sizes,)], "s array<int>").select(spans.starts(F.col("s")).alias("x")).first().x
        want = [sum(sizes[:i]) for i in range(n)] if n < 200 else [0]
        assert len(got) == n and got[: len(want)] == want[:n] and all(b - a == s for a, b, s in zip(got, got[1:], sizes))


def test_marks_keep_markup_whole(spark):
    m = structure.mark_spans
    assert m("a <b>bold</b> word", [(2, 11, "1")]) == 'a <b><mark data-addr="1">bold</mark></b><mark data-addr="1"> word</mark>'
    assert m("x &amp; y", [(2, 3, "7")]) == 'x <mark data-addr="7">&amp;</mark> y'
    assert m("abcdef", [(0, 3, "1"), (2, 4, "2"), (4, 5, "3")]) == '<mark data-addr="1">abc</mark>d<mark data-addr="3">e</mark>f'
    assert m("abc", [(2, 2, "1"), (5, 9, "2")]) == "abc" and m("", [(0, 1, "1")]) == ""


def test_jsonl_skips_blank_lines(spark, tmp_path):
    p = tmp_path / "c.jsonl"
    p.write_text('{"doc_id": 1, "text": "a"}\n\n{"doc_id": 2, "text": "b"}\n')
    assert sorted((r.doc_id, r.text) for r in files.jsonl(spark, str(p), "doc_id long, text string").collect()) == [(1, "a"), (2, "b")]


def test_contradictions_by_plain_loops(spark):
    import random

    r = random.Random(5)
    docs_ = [(i, " ".join(f"Run {r.randint(0, 3)} came to {r.choice(['50', '50.4', '50.6', '61', '72.5'])}% {r.choice(['recall', 'precision'])} over all that was made ready for it in the whole of the last year by us." for _ in range(r.randint(0, 14)))) for i in range(12)]
    from manuscript_spark.operators import claims

    df = spark.createDataFrame(docs_, "doc_id long, text string")
    got = sorted(tuple(x) for x in claims.contradictions(df).select("doc_id", "rank", "a_start", "b_start", "metric", "a_value", "b_value").collect())
    want = []
    for i, _ in docs_:
        m = sorted((x.start, x.at, x.metric, x.value, x.sentence) for x in claims.number_mentions(df.where(F.col("doc_id") == i)).collect())
        seen, out = set(), []
        for a in range(len(m)):
            for b in range(a + 1, len(m)):
                (s, _, k, v, t), (s2, _, k2, v2, t2) = m[a], m[b]
                rounding = abs(v - v2) < 0.5 and int(v + 0.5) == int(v2 + 0.5)
                if k == k2 and v != v2 and not rounding and t != t2 and (s, s2, k) not in seen:
                    seen.add((s, s2, k))
                    out.append((i, len(out) + 1, s, s2, k, v, v2))
        want += out[:15]
    assert got == sorted(want)


PAPER = "Introduction\nA later study by Vega et al. [2] measured how adaptive joins reduce the total shuffle volume across many large clusters doi:10.1000/p6. The index always returns every matching row quickly. The run reached 91.4% recall on the set. A later run reached 88.0% recall on the set.\n\nMethods\n" + "We ran the engine on many inputs and counted every row. " * 20 + "\n\nReferences\n[1] A. One, First notes on sorted storage, 2019.\n[2] B. Vega, Second, doi:10.1000/p1, 2021.\n[3] C. Third, On tables and their many uses in storage.\n"


def test_review_with_verdicts(spark):
    from manuscript_spark.plans import registry

    papers = spark.createDataFrame([(1, PAPER, "It rose 77%."), (2, None, None), (3, "\u0645\u0631\u062d\u0628\u0627", "x")], "doc_id long, text string, brief string")
    reg = R.Registries(*registry._registries(spark, "/root/testdata/sf0.001"))
    reg.crossref = reg.crossref.withColumn("abstract", F.lit("Volume did not change at all in any of the many runs that we made. " * 4))
    full = spark.createDataFrame([("doi:10.1000/p6", 0, "Adaptive joins left the total volume as it was."), ("doi:10.1000/p6", 1, "Nothing else here.")], "id string, idx int, sentence string")
    links = spark.createDataFrame([(1, "https://doi.org/10.1000/p2", "it", 20)], "doc_id long, href string, anchor_text string, offset int")
    asked = R.requests(papers, registries=reg, sentences=full, links=links).collect()
    assert {a.layer for a in asked} == {"overclaims", "contradictions", "methodology", "claim-source"} and all(a.tokens > 300 for a in asked)
    evidence = {a.evidence for a in asked if a.layer == "claim-source"}
    assert any(e.startswith("Adaptive joins left") for e in evidence) and any(e.startswith("Volume did not") for e in evidence)

    def table(layer, make):
        return spark.createDataFrame([(a.request_id, json.dumps(make(a))) for a in asked if a.layer == layer], "request_id string, payload string")

    verdicts = R.Verdicts(
        claims=table("claim-source", lambda a: {"verdict": "unsupported", "claim_quote": "adaptive joins reduce", "source_quote": "volume did not change"}),
        contradictions=table("contradictions", lambda a: {"verdict": "same_quantity_conflict", "quote_a": "91.4% recall", "quote_b": "88.0% recall"}),
        overclaims=table("overclaims", lambda a: {"verdict": "fair", "quote": "always returns every"}),
        methodology=table("methodology", lambda a: {"gaps": [{"quote": "We ran the engine on many inputs", "reason": "no sizes"}]}),
        sentences=full,
    )
    findings, runs = R.review(papers, registries=reg, verdicts=verdicts, links=links)
    rows = findings.collect()
    by = {}
    for r in rows:
        by.setdefault(r.check, []).append(r)
        assert r.message and "{" not in r.message and r.doc_id == 1
    assert len(by["claim-unsupported"]) == 1 and by["claim-unsupported"][0].source_ref == "doi:10.1000/p1"  # the other evidence lacks the quote
    assert by["methodology-gap"][0].decided_by == by["internal-contradiction"][0].decided_by == "verdict" and "overclaim" not in by
    assert PAPER[by["methodology-gap"][0].span_start :].startswith("We ran the engine")
    assert [r.quoted_span for r in by["citation-not-found"]] == ["10.1000/p2"] and by["summary-drift"][0].quoted_span == "77%"
    state = {(r.doc_id, r.layer): (r.status, r.reason) for r in R.layers(papers, findings, registries=reg, verdicts=verdicts).collect()}
    assert state[1, "claim-source"] == ("ran", None) and state[1, "terminology"] == ("inactive", "no glossary") and state[2, "references"] == ("abstained", "no reference section") and state[3, "floats"] == ("skipped", "language")
    assert state[2, "methodology"] == ("abstained", "no methods or results section") and runs.count() == 3
    bare, _ = R.review(papers)
    assert {r.check for r in bare.collect()} >= {"overclaim", "internal-contradiction"}


def test_a_judge_is_asked(spark):
    from manuscript_spark.operators import adjudicate

    def connect():
        calls = {}

        def ask(layer, subject, evidence):
            n = calls[subject] = calls.get(subject, 0) + 1
            if subject == "never" or (subject == "later" and n == 1):
                raise adjudicate.Refused(1)
            if subject == "broken":
                raise OSError("no line")
            return json.dumps({"verdict": layer, "quote": evidence or ""})

        return ask

    rows = [("1", "overclaims", "now", None), ("2", "overclaims", "later", "seen"), ("3", "methodology", "never", None), ("4", "overclaims", "broken", None)]
    requests = spark.createDataFrame(rows, "request_id string, layer string, subject string, evidence string")
    got = {r.request_id: (r.payload and json.loads(r.payload), r.calls) for r in adjudicate.answered(requests, connect).collect()}
    assert got == {"1": ({"verdict": "overclaims", "quote": ""}, 1), "2": ({"verdict": "overclaims", "quote": "seen"}, 2), "3": (None, 3), "4": (None, 1)}
    assert adjudicate.answered(requests.where("false"), connect).count() == 0


def test_judging_can_be_switched_off(spark):
    papers = spark.createDataFrame([(1, PAPER)], "doc_id long, text string")
    off = R.Config(judged=False)
    assert R.requests(papers, off).count() == 0
    none = spark.createDataFrame([], "request_id string, payload string")
    verdicts = R.Verdicts(overclaims=none, contradictions=none, methodology=none)
    on, _ = R.review(papers, verdicts=verdicts)
    silent, _ = R.review(papers, off, verdicts=verdicts)
    assert not {"overclaim", "internal-contradiction"} & {r.check for r in on.collect()}
    assert {r.decided_by for r in silent.collect()} == {"rule"} and {"overclaim", "internal-contradiction"} <= {r.check for r in silent.collect()}
    state = {r.layer: r.reason for r in R.layers(papers, silent, verdicts=verdicts, config=off).collect()}
    assert state["methodology"] == "no verdicts"


def _rows(df):
    return sorted(repr(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())


def test_reference_states_from_one_parse(spark):
    from manuscript_spark.plans import registry

    listed = "\n".join(f"[{n}] Author of a work, Notes on {w} and its many uses in storage{y}" for n, w, y in [(1, "joins", ", 1995."), (2, "sorts", "."), (4, "scans", "."), (5, "joins", ", in press.")])
    paper = f"Introduction\n\nAs in [1], [3] and [2-4], all rows of a large set were read in full by two of us [9].\n\nReferences\n\n{listed}\n"
    d = docs(spark, paper, None, "", "no list [1]", "\u0645\u0631\u062d\u0628\u0627 [1]\n\nReferences\n\n[1] x", paper.replace("[1], [3] and [2-4]", "none of them"))
    checks = ("cited-not-listed", "reference-missing-year")
    slow = report.check_breakdown(d, report.deterministic_findings(d)).where(F.col("check").isin(*checks))
    got = report.reference_states(d)
    assert _rows(got) == _rows(slow)
    assert {(r.doc_id, r.check): r.findings for r in got.collect()}[0, "cited-not-listed"] == 1
    assert _rows(report.deterministic_findings(d, checks)) == _rows(report.deterministic_findings(d).where(F.col("check").isin(*checks)))
    # only the making of the papers shuffles
    plan = registry.QUERIES["check_states"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_headings_with_odd_ends(spark):
    lines = ["References", " 2.1 Results:. ", "References\u0085", "References.\u0085", "References\u0085.", "IV. Related Work", "xReferences", "Methods of x", "REFERENCES\u00a0", "A. " + " " * 90 + "Methods"]
    got = [r.k for r in docs(spark, *lines).orderBy("doc_id").select(structure.heading_kind(structure.trimmed(F.col("text"))).alias("k")).collect()]
    assert got == ["references", "results", "references", "references", "references", "intro", None, None, "references", None]


def test_glossary_by_document_equals_by_shuffle(spark, monkeypatch):
    from manuscript_spark.operators import glossary
    from manuscript_spark.plans import registry

    raw = [("dag-scheduler", "Directed Acyclic Graph Scheduler (DAGS)", "d", ["graph planner"], None), ("merge-table", "Sorted Merge Join Table", "m", None, None), ("merge-list", "Sorted Merge Join List", "m", None, None), ("cafe", "Caf\u00e9 of the Large Rows", "c", None, None), ("rr", "round by round robin", "r", None, None)]
    terms = glossary.terms(spark.createDataFrame(raw, "slug string, term string, definition string, variants array<string>, single_word_allowed boolean"))
    words = "directed acyclic graph scheduler schedulers dags (DAGS) sorted merge join table tables list of the caf\u00e9 cafe\u0301 CAFE large rows round by robin planner \u03a3\u03a3 x".split()
    rng = random.Random(1)
    parts = ["directed acyclic graph scheduler", "graph planner", "sorted merge join table", "sorted merge join lists", "cafe\u0301 of the large rows", "round by round robin", "(DAGS)"]
    # terms with words left out, put in and out of order
    pick = lambda p: [w for x in p.split(" ") if rng.random() < 0.8 for w in ([x, rng.choice(words)] if rng.random() < 0.15 else [x])]
    texts = [" ".join(w for _ in range(8) for w in pick(rng.choice(parts))) for _ in range(60)]
    texts += ["The directed graph scheduler, the directed acyclic (fast) graph scheduler. A sorted merge join.", "", None, "(", "the sorted merge table of the caf\u00e9 of large rows"]
    d = docs(spark, *texts)
    got = _rows(glossary.near_misses(d, terms))
    monkeypatch.setattr(glossary, "BROADCAST_ROWS", 0)
    assert got == _rows(glossary.near_misses(d, terms)) and len(got) > 20
    monkeypatch.undo()
    # only the making of the papers and the count of findings shuffle
    plan = registry.QUERIES["near_terms"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 2


def test_statements_on_one_row(spark):
    claim = "measured how adaptive joins reduce the total volume of all rows."
    text = f"Introduction\n\nA later study by others [1]–[3] {claim} A later study of 10.1000/p9 and others {claim} Others still [3] {claim} Short [2].\n\nReferences\n\n[1] A, 10.1000/p1.\n[2] B, 10.1000/p2, 10.1000/p1.\n[3] C.\n[1] D, arXiv:2101.00001.\n[1] E.\n"
    d = docs(spark, text, None, "no list 10.1000/p1 [1]")
    found = structure.statements(d, citations.identifiers(d))
    # of number 1 the last entry with an identifier counts; entry 3 has none
    assert [(r.ids, r.markers, r.linked_by) for r in found.orderBy("start").collect()] == [(["arxiv:2101.00001", "doi:10.1000/p2"], [1, 2, 3], "bracket"), (["doi:10.1000/p9"], [], "inline")]
    # sentences are not shuffled: identifiers by their own key, then documents and identifiers by doc_id
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 7
