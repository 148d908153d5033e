"""Findings in one schema, run counters, breakdowns and evaluation measures."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import language, sha256, word_count
from .adjudicate import methodology_input
from .claims import OVERCLAIM_CAP, contradictions, overclaims
from .references import REFERENCE_CHECKS, check_floats, check_references, counted, gates

# The checks, their category and layer, in the order of reports.
CHECKS = [
    ("near-miss-term", "glossary", "terminology"), ("citation-not-found", "citation", "citations"), ("citation-mismatch", "citation", "citations"), ("retracted-citation", "citation", "citations"),
    ("cited-not-listed", "reference", "references"), ("listed-not-cited", "reference", "references"), ("duplicate-reference", "reference", "references"), ("reference-missing-year", "reference", "references"),
    ("float-never-referenced", "reference", "floats"), ("float-missing", "reference", "floats"), ("summary-drift", "consistency", "consistency"),
    ("overclaim", "claim", "overclaims"), ("internal-contradiction", "claim", "contradictions"), ("claim-unsupported", "claim", "claim-source"), ("methodology-gap", "claim", "methodology"),
]
Z = 1.96
#: What a finding says: words, with names of columns in braces.
MESSAGES = {
    "near-miss-term": 'Reads "{quoted_span}", close to the glossary\'s "{source_ref}" but not the same.',
    "citation-not-found": "No registry knows {source_ref}.",
    "citation-mismatch": "What is said around {source_ref} names neither title, author nor year of the work it leads to.",
    "retracted-citation": "{source_ref} has been withdrawn.",
    "cited-not-listed": "The text cites number {source_ref}, which the list lacks.",
    "listed-not-cited": "Nothing in the text cites entry {source_ref}.",
    "duplicate-reference": "Entry {source_ref} is listed before.",
    "reference-missing-year": "Entry {source_ref} gives no year.",
    "float-never-referenced": "No text points at {source_ref}.",
    "float-missing": "The text points at {source_ref}, which has no caption.",
    "summary-drift": 'The summary says "{quoted_span}", the text does not.',
    "overclaim": "Strong wording ({source_ref}): is it borne out?",
    "internal-contradiction": "Two values for {source_ref}: {quoted_span}.",
    "claim-unsupported": "{source_ref}, cited for this, says otherwise.",
    "methodology-gap": "A gap in the methods: {source_ref}.",
}


def checks_table(spark) -> DataFrame:
    rows = [(i, *c) for i, c in enumerate(CHECKS)]
    return spark.createDataFrame(rows, "ordinal int, check string, category string, layer string")


def doc_stats(docs: DataFrame) -> DataFrame:
    """Per document: language, digest of the text, words, and whether the review skips it."""
    lang = language(F.coalesce("text", F.lit("")))
    t = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", lang.alias("language"), sha256(t).alias("content_hash"), word_count(t).alias("words"), F.when(lang != "en", "language").alias("skipped_reason"))


def deterministic_findings(docs: DataFrame, checks: Sequence[str] | None = None) -> DataFrame:
    """(doc_id, check, span_start, number) of the checks that need nothing but the text, or of some of them: operators that
    none of these needs don't run. Documents in another language are skipped."""
    d = docs.where(language("text") == "en").select("doc_id", "text")
    wanted = lambda *names: [c for c in names if checks is None or c in checks]
    parts = []
    if refs := wanted(*REFERENCE_CHECKS):
        parts.append(check_references(d, refs).select("doc_id", "check", "span_start", "number"))
    if floats := wanted("float-never-referenced", "float-missing"):
        parts.append(check_floats(d).where(F.col("check").isin(floats)).select("doc_id", "check", F.col("start").alias("span_start"), "number"))
    if wanted("overclaim"):
        parts.append(overclaims(d).where("not over_cap").select("doc_id", F.lit("overclaim").alias("check"), F.col("start").alias("span_start"), F.lit(None).cast("int").alias("number")))
    if wanted("internal-contradiction"):
        parts.append(contradictions(d).select("doc_id", F.lit("internal-contradiction").alias("check"), F.col("a_start").alias("span_start"), F.lit(None).cast("int").alias("number")))
    if not parts:
        return d.where("false").select("doc_id", F.lit("").alias("check"), F.lit(0).alias("span_start"), F.lit(None).cast("int").alias("number"))
    return reduce(DataFrame.unionByName, parts)


def run_counters(docs: DataFrame, findings: DataFrame, overclaim_cap: int = OVERCLAIM_CAP) -> DataFrame:
    """One row for every document, zeros included; overclaim_truncated: candidates beyond the cap, which no finding shows."""
    n = findings.groupBy("doc_id").agg(*[F.count_if(F.col("check") == c).alias(c.replace("-", "_")) for c, _, _ in CHECKS], F.count("*").alias("findings"))
    over = overclaims(docs.where(language("text") == "en").select("doc_id", "text"), overclaim_cap).groupBy("doc_id").agg(F.count_if("over_cap").alias("overclaim_truncated"))
    out = doc_stats(docs).join(n, "doc_id", "left").join(over, "doc_id", "left")
    return out.fillna(0, [c.replace("-", "_") for c, _, _ in CHECKS] + ["findings", "overclaim_truncated"])


def message() -> Column:
    """The wording of a finding (check, quoted_span, source_ref)."""
    out = F.lit(None).cast("string")
    for check, text in MESSAGES.items():
        said = F.lit(text)
        for name in ("quoted_span", "source_ref"):
            said = F.replace(said, F.lit("{" + name + "}"), F.coalesce(F.col(name), F.lit("")))
        out = F.when(F.col("check") == check, said).otherwise(out)
    return out


@dataclass(frozen=True)
class Inputs:
    """What a review was given; layers without what they need are inactive."""

    terms: bool = False
    registries: bool = False
    brief: bool = False
    claim_verdicts: bool = False
    methodology_verdicts: bool = False


def layer_states(docs: DataFrame, given: Inputs = Inputs()) -> DataFrame:
    """(doc_id, layer, status, reason): every layer of every document. skipped: the document's language, or no summary; inactive: an
    input is missing; abstained: the document doesn't support the check; else ran, with reason null. No findings are looked for."""
    text = F.coalesce("text", F.lit(""))
    docs = docs.select("doc_id", text.alias("text"), language(text).alias("lang"))
    x = gates(docs, "lang").select("doc_id", "lang", F.col("skipped_reason").alias("list_why"))
    if given.methodology_verdicts:
        x = x.join(methodology_input(docs.select("doc_id", "text")).select("doc_id", F.col("skipped_reason").alias("method_why")), "doc_id", "left")
    else:
        x = x.withColumn("method_why", F.lit(None).cast("string"))
    x = x.withColumn("layer", F.explode(F.array(*[F.lit(x) for x in sorted({layer for _, _, layer in CHECKS})])))
    layer, why = F.col("layer"), F.lit(None).cast("string")
    missing = {"terminology": (given.terms, "no glossary"), "citations": (given.registries, "no registries"), "claim-source": (given.claim_verdicts, "no verdicts"), "methodology": (given.methodology_verdicts, "no verdicts")}
    why = F.when(layer == "references", F.col("list_why")).when(layer == "methodology", F.col("method_why"))
    status = F.when(why.isNotNull(), "abstained").otherwise("ran")
    if not given.brief:
        status, why = F.when(layer == "consistency", "skipped").otherwise(status), F.when(layer == "consistency", "no summary").otherwise(why)
    for name, (there, reason) in missing.items():
        if not there:
            status, why = F.when(layer == name, "inactive").otherwise(status), F.when(layer == name, reason).otherwise(why)
    other = F.col("lang") != "en"
    return x.select("doc_id", "layer", F.when(other, "skipped").otherwise(status).alias("status"), F.when(other, "language").otherwise(why).alias("reason"))


def layer_breakdown(docs: DataFrame, findings: DataFrame, given: Inputs = Inputs()) -> DataFrame:
    """(doc_id, layer, findings, status, reason): every layer of every document, silent ones too, with its state (see `layer_states`)."""
    dim = checks_table(docs.sparkSession)
    n = findings.join(F.broadcast(dim.select("check", "layer")), "check").groupBy("doc_id", "layer").agg(F.count("*").alias("n"))
    x = layer_states(docs, given).join(n, ["doc_id", "layer"], "left")
    return x.select("doc_id", "layer", F.coalesce("n", F.lit(0)).cast("long").alias("findings"), "status", "reason")


def check_breakdown(docs: DataFrame, findings: DataFrame, given: Inputs = Inputs()) -> DataFrame:
    """(doc_id, check, category, findings, status, reason): every check of every document, with the state of its layer."""
    dim = checks_table(docs.sparkSession)
    n = findings.groupBy("doc_id", "check").agg(F.count("*").alias("n"))
    x = layer_states(docs, given).join(F.broadcast(dim.select("check", "category", "layer")), "layer").join(n, ["doc_id", "check"], "left")
    return x.select("doc_id", "check", "category", F.coalesce("n", F.lit(0)).cast("long").alias("findings"), "status", "reason")


def reference_states(docs: DataFrame) -> DataFrame:
    """As `check_breakdown` gives them, the rows of cited-not-listed and reference-missing-year: one parse of each document gives
    both its state and its findings, and nothing is shuffled."""
    text = F.coalesce("text", F.lit(""))
    x = counted(docs.select("doc_id", text.alias("text"), language(text).alias("lang")), "lang")
    other = F.col("lang") != "en"
    status = F.when(other, "skipped").when(F.col("skipped_reason").isNotNull(), "abstained").otherwise("ran")
    row = lambda check, n: F.struct(F.lit(check).alias("check"), F.lit("reference").alias("category"), F.when(other, F.lit(0).cast("long")).otherwise(F.col(n)).alias("findings"))
    rows = F.array(row("cited-not-listed", "cited_not_listed"), row("reference-missing-year", "reference_missing_year"))
    x = x.select("doc_id", F.explode(rows).alias("r"), status.alias("status"), F.when(other, "language").otherwise(F.col("skipped_reason")).alias("reason"))
    return x.select("doc_id", "r.check", "r.category", "r.findings", "status", "reason")


def top_samples(findings: DataFrame, by: str, order: list[str], n: int = 12) -> DataFrame:
    """The first n findings of each group, with their place."""
    return findings.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("place") <= n)


def addresses(findings: DataFrame) -> DataFrame:
    """Adds address, as in 05.2: the check's place in reports, the finding's place within the check."""
    dim = checks_table(findings.sparkSession).select("check", "ordinal")
    k = F.row_number().over(W.partitionBy("doc_id", "check").orderBy("span_start", F.coalesce("number", F.lit(0))))
    return findings.join(F.broadcast(dim), "check").withColumn("address", F.concat(F.lpad((F.col("ordinal") + 1).cast("string"), 2, "0"), F.lit("."), k.cast("string"))).drop("ordinal")


def rates(findings: DataFrame, docs: DataFrame) -> DataFrame:
    """(check, findings, per_1k_words, per_doc), three decimals."""
    total = docs.agg(F.sum(word_count("text")).alias("w"), F.count("*").alias("d"))
    n = findings.groupBy("check").agg(F.count("*").alias("findings"))
    return n.crossJoin(F.broadcast(total)).select("check", "findings", F.round(F.try_divide(F.col("findings") * 1000, F.col("w")), 3).alias("per_1k_words"), F.round(F.try_divide("findings", "d"), 3).alias("per_doc"))


def confusion(outcomes: DataFrame, by: str | None = None) -> DataFrame:
    """tp, fp, fn, tn, precision and recall of outcomes (expect, verdict booleans; null verdict: not answered, left out)."""
    o = outcomes.where("expect is not null and verdict is not null")
    hit = lambda e, v: F.count_if((F.col("expect") == e) & (F.col("verdict") == v))
    g = o.groupBy(*([by] if by else [])).agg(hit(True, True).alias("tp"), hit(False, True).alias("fp"), hit(True, False).alias("fn"), hit(False, False).alias("tn"))
    return g.withColumns({"precision": F.try_divide("tp", F.col("tp") + F.col("fp")), "recall": F.try_divide("tp", F.col("tp") + F.col("fn"))})


def wilson(k: str | Column, n: str | Column) -> tuple[Column, Column]:
    """The bounds of the 95 % interval of a share, within 0 and 1; zeros if nothing was tried."""
    k, n = (F.col(c) if isinstance(c, str) else c for c in (k, n))
    p = F.try_divide(k, n)
    mid, half = p + Z * Z / (2 * n), F.lit(Z) * F.sqrt(F.greatest(F.lit(0.0), p * (1 - p) / n + F.lit(Z * Z) / (4 * n * n)))
    scale = 1 + Z * Z / n
    zero = lambda c: F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))
    return zero((mid - half) / scale), zero((mid + half) / scale)


def recall_at_k(retrieved: DataFrame, gold: DataFrame) -> DataFrame:
    """(q_id, recall) of retrieved (q_id, found array<int>) against gold (q_id, gold array<int>)."""
    j = gold.join(retrieved, "q_id", "left")
    found = F.coalesce("found", F.array().cast("array<int>"))
    return j.select("q_id", F.try_divide(F.size(F.array_intersect(found, "gold")), F.size(F.array_distinct("gold"))).alias("recall"))


def balanced_sample(rows: DataFrame, cls: str, order: str, n: int) -> DataFrame:
    """n rows, dealt in turn to the classes in each one's own order."""
    turn = F.row_number().over(W.partitionBy(cls).orderBy(order))
    return rows.withColumn("turn", turn).orderBy("turn", cls).limit(n)


def stability(keys: DataFrame, runs: int = 3) -> DataFrame:
    """(doc_id, span_start, source_ref, runs, stable): in how many runs a finding returned."""
    g = keys.groupBy("doc_id", "span_start", "source_ref").agg(F.count_distinct("run").alias("runs"))
    return g.withColumn("stable", F.col("runs") == runs)


def distinct_recall(texts: DataFrame) -> DataFrame:
    """(label, texts, with_candidate, share): of rows (label, text, hit)."""
    d = texts.groupBy("label", "text").agg(F.max("hit").alias("hit"))
    return d.groupBy("label").agg(F.count("*").alias("texts"), F.count_if("hit").alias("with_candidate")).withColumn("share", F.try_divide("with_candidate", "texts"))


def category_scope(rows: DataFrame) -> DataFrame:
    """(category, certain, possible, total): counts by category and two severities."""
    return rows.groupBy("category").pivot("severity", ["certain", "possible"]).agg(F.count(F.lit(1))).fillna(0).withColumn("total", F.col("certain") + F.col("possible"))


def staleness(versions: DataFrame) -> DataFrame:
    """(doc_id, stale): does the latest version (doc_id, version, text, reviewed) differ from the latest reviewed one?"""
    v = versions.groupBy("doc_id").agg(F.max_by(sha256("text"), "version").alias("now"), F.max_by(sha256("text"), F.when(F.col("reviewed"), F.col("version"))).alias("then"))
    return v.select("doc_id", (~F.col("now").eqNullSafe(F.col("then"))).alias("stale"))


def ui_groups(findings: DataFrame) -> DataFrame:
    """(category, findings, worst): counts by category; worst: warning before info."""
    dim = checks_table(findings.sparkSession).select("check", "category")
    rank = F.max(F.when(F.col("severity") == "warning", 1).otherwise(0))
    return findings.join(F.broadcast(dim), "check").groupBy("category").agg(F.count("*").alias("findings"), F.when(rank == 1, "warning").otherwise("info").alias("worst"))


def history_kept(runs: DataFrame, cap: int = 500) -> DataFrame:
    """The newest runs (ts, id) up to the cap. Only the cap's rows leave each task."""
    return runs.orderBy(F.desc("ts"), F.desc("id")).limit(cap)


def run_id(ts: Column, seq: Column, content: Column) -> Column:
    """YYYYMMDDhhmmssmmm-seq-hash4."""
    return F.concat_ws("-", F.date_format(ts, "yyyyMMddHHmmssSSS"), F.when(seq < 10_000, F.lpad(seq.cast("string"), 4, "0")).otherwise(seq.cast("string")), F.substring(sha256(content), 1, 4))


