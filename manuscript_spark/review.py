"""The library's front door: a review of documents by rules and by verdicts, with registries and verdicts as tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import adjudicate, citations, claims, glossary, references, report, structure


@dataclass
class Registries:
    """Snapshots of the registries that identifiers are looked up in."""

    crossref: DataFrame
    datacite: DataFrame
    doi_ra: DataFrame
    arxiv: DataFrame
    openalex: DataFrame


@dataclass
class Verdicts:
    """Verdict tables (request_id, payload) from outside; a layer without its table is inactive, or shows its candidates
    as they are. `requests` says what they answer. sentences: full texts of cited works (id as kind:id, idx, sentence)."""

    claims: DataFrame | None = None
    contradictions: DataFrame | None = None
    overclaims: DataFrame | None = None
    methodology: DataFrame | None = None
    sentences: DataFrame | None = None


@dataclass
class Config:
    threshold: float = glossary.THRESHOLD
    overclaim_cap: int = claims.OVERCLAIM_CAP
    views: bool = False
    #: Whether verdicts count; if not, nothing is asked and verdict tables are left alone.
    judged: bool = True


def _overclaims(text: DataFrame, config: Config) -> DataFrame:
    over = claims.overclaims(text, config.overclaim_cap).where("not over_cap")
    return over.withColumn("request_id", adjudicate.request_id("doc_id", "start", "trigger"))


def _contradictions(text: DataFrame) -> DataFrame:
    return claims.contradictions(text).withColumn("request_id", adjudicate.request_id("doc_id", "a_start", "b_start", "metric"))


def _methodology(text: DataFrame) -> DataFrame:
    return adjudicate.methodology_input(text).withColumn("request_id", adjudicate.request_id("doc_id", "words"))


def requests(documents: DataFrame, config: Config | None = None, registries: Registries | None = None, links: DataFrame | None = None, sentences: DataFrame | None = None) -> DataFrame:
    """(request_id, layer, doc_id, subject, evidence, tokens): what a judge is to be asked about documents, layer by layer.
    Verdicts come back under the request_id. Nothing is asked if the config switches judging off."""
    config = config or Config()
    text = documents.where(report.language("text") == "en").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    none = F.lit(None).cast("string")
    cost = lambda *c: adjudicate.token_estimate(sum((F.length(x) for x in c), F.lit(0)))
    parts = [
        _overclaims(text, config).select("request_id", F.lit("overclaims").alias("layer"), "doc_id", F.col("sentence").alias("subject"), none.alias("evidence"), cost("sentence").alias("tokens")),
        _contradictions(text).withColumn("subject", F.concat_ws(" / ", "metric", F.col("a_value").cast("string"), F.col("b_value").cast("string"))).select("request_id", F.lit("contradictions").alias("layer"), "doc_id", "subject", none.alias("evidence"), cost("subject").alias("tokens")),
        _methodology(text).where("skipped_reason is null").select("request_id", F.lit("methodology").alias("layer"), "doc_id", F.col("section_text").alias("subject"), none.alias("evidence"), cost("section_text").alias("tokens")),
    ]
    if registries is not None:
        ids = citations.identifiers(text, links)
        pairs = adjudicate.claim_pairs(text, structure.statements(text, ids), _resolved(ids, registries), sentences)
        parts.append(pairs.select("request_id", F.lit("claim-source").alias("layer"), "doc_id", F.col("sentence").alias("subject"), "evidence", "tokens"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out if config.judged else out.where("false")


def _resolved(ids: DataFrame, r: Registries) -> DataFrame:
    return citations.resolve(ids, r.crossref, r.datacite, r.doi_ra, r.arxiv, r.openalex)


def review(documents: DataFrame, config: Config | None = None, terms: DataFrame | None = None, registries: Registries | None = None, verdicts: Verdicts | None = None, links: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings, runs) of documents (doc_id, text, and brief if they have one).

    findings: doc_id, category, check, severity, quoted_span, span_start, span_end, source_ref, decided_by, message.
    runs: one row for every document; overclaim_truncated counts the candidates beyond the cap, which
    are no findings. links: doc_id, href, anchor_text, offset of documents that were HTML. Layers whose inputs are missing are silent (`layers` says which and why).
    Candidates of overclaims and contradictions are findings of their own by rule; where verdicts are given only those
    that a verdict with quotes from the document confirms are, decided by verdict. Documents in
    another language than English are skipped. With `views` both are temp views, findings and runs.
    """
    config = config or Config()
    verdicts = verdicts if verdicts is not None and config.judged else Verdicts()
    docs = documents.where(report.language("text") == "en").withColumn("text", F.coalesce("text", F.lit("")))
    text = docs.select("doc_id", "text")
    parts = []

    def add(rows: DataFrame, check: str | None, severity: str | None, quoted, start, end, ref, by: str = "rule") -> None:
        parts.append(rows.select("doc_id", F.lit(check).alias("check") if check else F.col("check"), F.lit(severity).alias("severity") if severity else F.col("severity"), quoted.alias("quoted_span"), start.alias("span_start"), end.alias("span_end"), ref.cast("string").alias("source_ref"), F.lit(by).alias("decided_by")))

    c = F.col
    add(references.check_references(text), None, None, c("quoted_span"), c("span_start"), c("span_end"), c("number"))
    label = F.concat_ws(" ", "family", c("number").cast("string"))
    add(references.check_floats(text), None, "info", label, c("start"), c("start") + F.length(label), label)
    over, by = _overclaims(text, config), "rule"
    if verdicts.overclaims is not None:
        over, by = adjudicate.overclaim_verdicts(over.join(text.withColumnRenamed("text", "document"), "doc_id"), verdicts.overclaims).where("finding"), "verdict"
    add(over, "overclaim", "info", c("sentence"), c("start"), c("end"), c("trigger"), by)
    pairs, by = _contradictions(text), "rule"
    if verdicts.contradictions is not None:
        pairs, by = adjudicate.contradiction_verdicts(pairs.join(text.withColumnRenamed("text", "document"), "doc_id"), verdicts.contradictions).where("finding"), "verdict"
    add(pairs, "internal-contradiction", "info", F.concat_ws(" / ", c("a_value").cast("string"), c("b_value").cast("string")), c("a_start"), c("b_start"), c("metric"), by)
    if "brief" in documents.columns:
        add(claims.summary_drift(docs.select("doc_id", "brief", "text")), "summary-drift", "info", c("quoted"), c("start"), c("start") + F.length("quoted"), F.lit("brief"))
    if terms is not None:
        add(glossary.near_misses(text, terms, config.threshold), "near-miss-term", "info", c("quoted"), c("start"), c("end"), c("slug"))
    if registries is not None:
        ids = citations.identifiers(text, links)
        outcomes = _resolved(ids, registries)
        add(citations.compare(ids, outcomes), None, "warning", c("id"), c("offset"), c("offset") + F.length("id"), F.concat_ws(":", "kind", "id"))
        if verdicts.claims is not None:
            asked = adjudicate.claim_pairs(text, structure.statements(text, ids), outcomes, verdicts.sentences)
            judged = adjudicate.claim_verdicts(asked, verdicts.claims).where("finding")
            add(judged, "claim-unsupported", "warning", c("sentence"), c("start"), c("end"), c("id"), "verdict")
    if verdicts.methodology is not None:
        gaps = adjudicate.methodology_gaps(_methodology(text), verdicts.methodology).join(text, "doc_id")
        at = F.instr("text", c("quote")) - 1  # where the quote stands letter by letter; else the place is unknown
        place = F.when(at >= 0, at)
        add(gaps, "methodology-gap", "info", c("quote"), place, place + F.length("quote"), c("reason"), "verdict")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    dim = F.broadcast(report.checks_table(documents.sparkSession).select("check", "category"))
    findings = out.join(dim, "check").withColumn("message", report.message())
    runs = report.run_counters(documents.select("doc_id", "text"), findings, config.overclaim_cap)
    if config.views:
        findings.createOrReplaceTempView("findings")
        runs.createOrReplaceTempView("runs")
    return findings, runs


def given(documents: DataFrame, terms: DataFrame | None = None, registries: Registries | None = None, verdicts: Verdicts | None = None, config: Config | None = None) -> report.Inputs:
    """What a review gets, for the states of its layers."""
    v = verdicts if verdicts is not None and (config or Config()).judged else Verdicts()
    return report.Inputs(terms is not None, registries is not None, "brief" in documents.columns, registries is not None and v.claims is not None, v.methodology is not None)


def layers(documents: DataFrame, findings: DataFrame, terms: DataFrame | None = None, registries: Registries | None = None, verdicts: Verdicts | None = None, config: Config | None = None) -> DataFrame:
    """The state of each layer of each document in a review with the same inputs, and why a layer is silent."""
    return report.layer_breakdown(documents.select("doc_id", "text"), findings, given(documents, terms, registries, verdicts, config))
