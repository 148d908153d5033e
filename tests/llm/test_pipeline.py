"""Stages of the pipeline, each against plain Python on its own input."""

import corpus_pipeline as P
from test_llm import CLASH, SMALL, plain_mix

from manuscript_spark.llm import mixing, pii, shared, simhash, toxicity


def test_stages(spark):
    docs = shared.documents(spark, SMALL)
    columns = docs.columns
    lexicon = toxicity.learned(spark, docs, SMALL)
    for name, stage in P.STAGES:
        before = docs.collect()
        docs = shared.written(stage(spark, docs, SMALL), f"test-{name}")
        after = docs.collect()
        if name != "encoding":
            assert docs.columns == columns
        if name == "toxicity":
            keep = {r.doc_id for r in before if lexicon.scores([lexicon.evidence(r.text)[0]], [lexicon.evidence(r.text)[2]])[0] < 0.7}
            assert {r.doc_id for r in after} == keep
        elif name == "near_duplicates":
            fps = {r.doc_id: simhash.fingerprint(r.text) for r in before}
            left, keep = dict(fps), set()
            while left:
                first = min(left)
                keep.add(first)
                reach, seen = [left.pop(first)], set()
                while reach:
                    f = reach.pop()
                    seen.add(f)
                    near = [i for i, g in left.items() if bin(f ^ g).count("1") <= 3]
                    reach += [left.pop(i) for i in near]
            assert {r.doc_id for r in after} == keep
        elif name == "personal_data":
            w = pii.weights()
            assert {(r.doc_id, r.text, r.n_chars) for r in after} == {(r.doc_id, pii.redact(r.text, w), len(pii.redact(r.text, w))) for r in before}
        elif name == "mixing":
            rows = [tuple(r) for r in spark.createDataFrame(before, docs.schema).select("doc_id", mixing.default_domain().alias("d"), "lang", "source", mixing.n_words().alias("n")).collect()]
            assert sorted(r.doc_id for r in after) == sorted(r[0] for r in plain_mix(spark, rows, 0.9, 1))
        else:
            assert {r.doc_id for r in after} == {r.doc_id for r in before} and all(len(r.ids) == r.n_tokens for r in after)
            assert sorted(map(tuple, P.run(spark, SMALL).collect())) == sorted(map(tuple, after))


def test_run_and_edges(spark):
    more = tuple(range(len(CLASH)))
    odd = [(1, None, None, None, None, *more), (2, "", "en", "src1", 0, *more), (2, "", "en", "src1", 0, *more), (3, "w " * 40_000, "en", None, 80_000, *[None] * len(more)), (None, "no id", "en", "src2", 5, *more)]
    columns = ["doc_id", "text", "lang", "source", "n_chars", *CLASH]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` long" for c in CLASH))
    lexicon = toxicity.Lexicon({" idiot ": 7.0})
    held = toxicity.learned
    toxicity.learned = lambda *a: lexicon
    try:
        for name, stage in P.STAGES[:-1]:
            docs = shared.written(stage(spark, docs, SMALL), "test-edge")
            assert docs.columns == columns
            assert all(r["a.b"] in (None, CLASH.index("a.b")) and r["full"] in (None, CLASH.index("full")) for r in docs.collect())
            assert stage(spark, docs.where("false"), SMALL).count() == 0
        assert sorted(r.doc_id or 0 for r in docs.collect())[0] == 0
    finally:
        toxicity.learned = held
