"""All queries of the review engine, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import citations, claims, evidence, references, report, structure
from ..sources import html
from . import manuscripts as M

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- text ----

_WORDS = "len(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> ''))::int"


@query(f"""SELECT doc_id, CASE WHEN length(regexp_replace(coalesce(text, ''), '[^\\x{{0600}}-\\x{{06FF}}]', '', 'g')) > length(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) THEN 'ar' ELSE 'en' END AS language,
sha256(coalesce(text, '')) AS content_hash, {_WORDS} AS words, CAST(NULL AS varchar) AS skipped_reason FROM documents""")
def doc_stats(spark, d):
    return report.doc_stats(M.table(spark, d, "documents"))


@query("SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def content_dups(spark, d):
    t = M.table(spark, d, "documents").where("text is not null")
    return t.groupBy(T.sha256("text").alias("content_hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


@query("""WITH t AS (SELECT doc_id, list_filter(string_split_regex(strip_accents(lower(text)), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, len(w)::int AS n_tokens, len(list_distinct(w))::int AS n_distinct, md5(array_to_string(w, ' ')) AS key_md5 FROM t""")
def fold_tokens(spark, d):
    t = M.table(spark, d, "documents").select("doc_id", T.tokens("text").alias("w"))
    return t.select("doc_id", F.size("w").alias("n_tokens"), F.size(F.array_distinct("w")).alias("n_distinct"), F.md5(F.array_join("w", " ")).alias("key_md5"))


@query("""WITH t AS (SELECT conv_id, turn, list_distinct(list_filter(string_split_regex(strip_accents(lower(text)), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS w FROM conversations)
SELECT a.conv_id, a.turn, CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0.0::double ELSE round(len(list_intersect(a.w, b.w))::double / len(list_distinct(list_concat(a.w, b.w))), 9) END AS similarity
FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def jaccard_pairs(spark, d):
    t = M.table(spark, d, "conversations").select("conv_id", "turn", T.tokens("text").alias("w"))
    n = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("w2"))
    return t.join(n, ["conv_id", "turn"]).select("conv_id", "turn", F.round(T.jaccard("w", "w2"), 9).alias("similarity"))


_STRIP = "html"
for _a, _b in [("(?i)<script[\\s\\S]*?</script>", " "), ("(?i)<style[\\s\\S]*?</style>", " "), ("(?i)<br\\s*/?>", " "), ("(?i)</(p|div|li|h[1-6]|tr)>", " "), ("<[^>]+>", ""), *[(a, b.replace("'", "''")) for a, b in T.ENTITIES], ("(?i)&[a-z]+;|&#[0-9]+;", " "), ("\\s+", " "), ("^ | $", "")]:
    _STRIP = f"regexp_replace({_STRIP}, '{_a}', '{_b}', 'g')"


@query(f"SELECT page_id, length(s)::int AS n, md5(s) AS digest FROM (SELECT page_id, {_STRIP} AS s FROM pages)")
def strip_markup(spark, d):
    p = M.table(spark, d, "pages").select("page_id", T.strip_markup("html").alias("s"))
    return p.select("page_id", F.length("s").alias("n"), F.md5("s").alias("digest"))


@query("""SELECT doc_id, doc_id % 2 = 0 AND length(regexp_replace(regexp_replace(substr(text, 3, 40), '\\s+', ' ', 'g'), '^ | $', '', 'g')) >= 12 AS kept FROM documents WHERE text IS NOT NULL""")
def grounding(spark, d):
    t = M.table(spark, d, "documents").where("text is not null")
    quote = F.regexp_replace(F.translate(F.substring("text", 3, 40), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), " ", "\n ")
    said = F.when(F.col("doc_id") % 2 == 0, quote).otherwise(F.concat(F.lit("never said: "), quote))
    return t.select("doc_id", T.grounded("text", said, 12).alias("kept"))


# ---- structure ----


@query(f"""WITH {M.CITING}, s AS (SELECT doc_id, pos, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM sent)
SELECT s.doc_id, (r - 1)::int AS sent_no, (CASE WHEN r = 1 THEN 0 ELSE pos END)::int AS start, coalesce(nxt, prose_end)::int AS "end"
FROM s JOIN doc USING (doc_id) WHERE prose_end >= 0.1 * total""")
def sentence_spans(spark, d):
    papers = M.citing(spark, d)
    held = papers.where((structure.prose_end("text") < F.length("text")) & F.col("text").contains("Earlier"))
    return structure.prose_sentences(held).select("doc_id", "sent_no", "start", "end")


@query(f"""WITH {M.CITING} SELECT doc_id, 0 AS sec_no, 'intro' AS kind, 0 AS start, prose_end::int AS "end" FROM doc UNION ALL SELECT doc_id, 1, 'references', prose_end::int, total::int FROM doc""")
def sections(spark, d):
    return structure.sections(M.citing(spark, d)).select("doc_id", "sec_no", "kind", "start", "end")


@query(f"""WITH {M.CITING}, t AS (SELECT doc_id, 'Introduction' || chr(10) || chr(10) || coalesce((SELECT string_agg(t, ' ' ORDER BY k) FROM sent0 x WHERE x.doc_id = doc.doc_id), '') || chr(10) || chr(10) || 'References' || chr(10) || chr(10) || coalesce((SELECT string_agg(t, chr(10) ORDER BY k) FROM ent0 x WHERE x.doc_id = doc.doc_id), '') || chr(10) AS text FROM doc),
b AS (SELECT doc_id, unnest(list_filter(list_transform(string_split_regex(text, '\\n{{2,}}'), lambda x: trim(x, chr(10) || ' ')), lambda x: x <> '')) AS text, generate_subscripts(list_filter(list_transform(string_split_regex(text, '\\n{{2,}}'), lambda x: trim(x, chr(10) || ' ')), lambda x: x <> ''), 1) AS i FROM t)
SELECT doc_id, (i - 1)::int AS block_no, md5(text) AS digest, (coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::int AS start FROM b""")
def text_blocks(spark, d):
    return structure.serialized(structure.paragraph_blocks(M.citing(spark, d))).select("doc_id", "block_no", F.md5("text").alias("digest"), "start")


@query()
def chunks(spark, d):
    return structure.chunks(M.table(spark, d, "documents").where("text is not null"))


@query("""WITH b AS (SELECT conv_id AS doc_id, turn AS block_no, text, sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS upto FROM conversations)
SELECT doc_id, block_no, length(text)::int AS n FROM b WHERE upto <= 900 AND NOT (block_no = 0 AND upto > 900)""")
def truncate_blocks(spark, d):
    b = M.table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("block_no"), "text")
    return structure.truncate_blocks(b, 900).where("not cut").select("doc_id", "block_no", F.length("text").alias("n"))


# ---- reference lists ----


@query(f"WITH {M.CITING} SELECT doc_id, n AS number, pos::int AS start FROM ent JOIN doc USING (doc_id) WHERE prose_end >= 0.1 * total")
def ref_entries(spark, d):
    return references.entries(M.citing(spark, d)).select("doc_id", "number", "start")


@query(f"""WITH {M.CITING}, c AS (SELECT doc_id, number, pos AS "at" FROM cite UNION ALL
SELECT doc_id, n, pos::int FROM ent JOIN doc USING (doc_id) WHERE prose_end < 0.1 * total) SELECT doc_id, number, min("at") AS "at" FROM c GROUP BY 1, 2""")
def ref_cited(spark, d):
    return references.cited(M.citing(spark, d))


@query(f"WITH {M.CITING} SELECT doc_id, entries, why AS skipped_reason FROM gate")
def ref_gates(spark, d):
    return references.gates(M.citing(spark, d)).select("doc_id", "entries", "skipped_reason")


@query(f"""WITH {M.CITING} SELECT doc_id, number, pos AS start FROM cite c JOIN live USING (doc_id)
WHERE NOT EXISTS (SELECT 1 FROM ent e WHERE e.doc_id = c.doc_id AND e.n = c.number) AND number <= (SELECT max(n) FROM ent e WHERE e.doc_id = c.doc_id)""")
def ref_cited_not_listed(spark, d):
    return references.cited_not_listed(references.checked(M.citing(spark, d))).select("doc_id", "number", "start")


@query(f"""WITH {M.CITING} SELECT doc_id, n AS number, pos::int AS start, substr(t, 1, 120) AS quote FROM ent e JOIN live USING (doc_id) WHERE NOT EXISTS (SELECT 1 FROM cite c WHERE c.doc_id = e.doc_id AND c.number = e.n)""")
def ref_listed_not_cited(spark, d):
    return references.listed_not_cited(references.checked(M.citing(spark, d))).select("doc_id", "number", "start", "quote")


@query(f"""WITH {M.CITING}, x AS (SELECT *, row_number() OVER (PARTITION BY doc_id, n ORDER BY pos) AS r, first(n) OVER (PARTITION BY doc_id, s, p ORDER BY pos) AS f FROM ent JOIN live USING (doc_id))
SELECT doc_id, n AS number, pos::int AS start, 'number' AS kind FROM x WHERE r > 1 UNION ALL SELECT doc_id, n, pos::int, 'work' FROM x WHERE f <> n""")
def ref_duplicates(spark, d):
    return references.duplicates(references.checked(M.citing(spark, d))).select("doc_id", "number", "start", "kind")


@query(f"WITH {M.CITING} SELECT doc_id, n AS number, pos::int AS start FROM ent JOIN live USING (doc_id) WHERE p % 7 = 0")
def ref_missing_year(spark, d):
    return references.missing_year(references.checked(M.citing(spark, d))).select("doc_id", "number", "start")


@query(f"WITH {M.FLOATS} SELECT doc_id, family, number FROM cap")
def float_captions(spark, d):
    return references.captions(M.with_floats(spark, d)).select("doc_id", "family", "number").distinct()


@query(f"""WITH {M.FLOATS} SELECT doc_id, 'float-never-referenced' AS "check", family, number FROM (SELECT * FROM cap EXCEPT SELECT * FROM ment)
UNION ALL SELECT doc_id, 'float-missing', family, number FROM (SELECT * FROM ment EXCEPT SELECT * FROM cap) m WHERE EXISTS (SELECT 1 FROM cap c WHERE c.doc_id = m.doc_id AND c.family = m.family)""")
def float_findings(spark, d):
    return references.check_floats(M.with_floats(spark, d)).drop("start")


# ---- claims ----


@query("""WITH l AS (SELECT l_orderkey AS doc_id, round(l_discount * 100)::int AS v, l_quantity > 25 AS b FROM lineitem)
SELECT doc_id, v || '%' AS quoted, count(*) AS n FROM l a WHERE b AND NOT EXISTS (SELECT 1 FROM l c WHERE c.doc_id = a.doc_id AND NOT c.b AND c.v = a.v) GROUP BY 1, 2""")
def summary_drift(spark, d):
    return claims.summary_drift(M.with_rates(spark, d)).groupBy("doc_id", "quoted").agg(F.count("*").alias("n"))


_CASES = " ".join(f"WHEN {i} THEN '{t}'" for i, (_, t) in enumerate(M.CLAIMS) if t)


@query(f"""WITH c AS (SELECT l_orderkey AS doc_id, CASE (l_linenumber - 1) % {len(M.CLAIMS)} {_CASES} END AS trigger FROM lineitem)
SELECT doc_id, trigger, count(*) AS n FROM c WHERE trigger IS NOT NULL GROUP BY 1, 2""")
def overclaim(spark, d):
    return claims.overclaims(M.with_claims(spark, d)).groupBy("doc_id", "trigger").agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT l_orderkey AS doc_id, l_suppkey AS s, round(l_discount * 100)::int AS v, ['recall', 'precision', 'coverage'][(l_suppkey % 3)::int + 1] AS metric,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount) AS k FROM lineitem),
p AS (SELECT a.doc_id, a.metric, a.v AS va, b.v AS vb, row_number() OVER (PARTITION BY a.doc_id ORDER BY a.k, b.k) AS r FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.metric = b.metric AND b.k > a.k AND a.v <> b.v)
SELECT doc_id, r::int AS rank, metric, va::double AS a_value, vb::double AS b_value FROM p WHERE r <= 15""")
def contradictions(spark, d):
    return claims.contradictions(M.with_measures(spark, d)).select("doc_id", "rank", "metric", "a_value", "b_value")


# ---- citations ----

_ST = "CASE p_partkey % 6 WHEN 0 THEN 'found' WHEN 1 THEN 'found' WHEN 2 THEN 'not-found' WHEN 3 THEN 'unverified' WHEN 4 THEN 'found' ELSE 'unverified' END"


def _registries(spark, d):
    """Snapshots in which a part's remainder by six says how its DOI fares: 0 and 1 found (1 withdrawn),
    2 unknown to all, 3 server error, 4 found by the second registry, 5 owned by another agency."""
    p = M.table(spark, d, "part").withColumn("k", F.col("p_partkey") % 6).withColumn("id", F.concat(F.lit("10.1000/p"), F.col("p_partkey").cast("string")))
    notice = F.array(F.struct(F.lit("10.1/n").alias("doi"), F.lit("Retraction").alias("type"), F.lit("publisher").alias("source"), F.array(F.lit(2020), F.lit(3)).alias("date_parts")))
    none = F.array().cast("array<struct<doi:string,type:string,source:string,date_parts:array<int>>>")
    status = F.when(F.col("k") <= 1, 200).when(F.col("k") == 3, 500).otherwise(404)
    crossref = p.select("id", status.alias("http_status"), F.array("p_name").alias("title"), (F.lit(1990) + F.col("p_size") % 20).alias("year"), F.array(F.lit("Zzyzx")).alias("authors"), F.lit(None).cast("string").alias("abstract"), F.when(F.col("k") == 1, notice).otherwise(none).alias("updated_by"))
    datacite = p.where("k in (2, 4, 5)").select("id", F.when(F.col("k") == 4, 200).otherwise(404).alias("http_status"), F.col("p_name").alias("title"), F.lit(None).cast("int").alias("year"), F.array(F.lit("Zzyzx")).alias("creators"), F.array().cast("array<struct<type:string,text:string>>").alias("descriptions"))
    ra = p.where("k in (2, 5)").select("id", F.lit(200).alias("http_status"), F.when(F.col("k") == 5, "JaLC").alias("ra"), F.when(F.col("k") == 2, "DOI does not exist").alias("status"))
    arxiv = spark.createDataFrame([], "id string, http_status int, entry_title string, published string, names array<string>, summary string")
    openalex = spark.createDataFrame([], "id string, http_status int, title string, year int, authors array<string>")
    return crossref, datacite, ra, arxiv, openalex


@query(f"WITH {M.FIRST} SELECT doc_id, '10.1000/p' || p AS id, false AS manufactured, 'text' AS source FROM x")
def identifiers(spark, d):
    return citations.identifiers(M.with_dois(spark, d)).select("doc_id", "id", "manufactured", "source")


@query(f"""SELECT 'doi' AS kind, '10.1000/p' || p_partkey AS id, {_ST} AS status, CASE WHEN p_partkey % 6 IN (0, 1, 4) THEN p_name END AS title,
CASE WHEN p_partkey % 6 <= 1 THEN 1990 + p_size % 20 END AS year, CASE WHEN p_partkey % 6 = 1 THEN '2020-03-01' END AS retracted, CASE WHEN p_partkey % 6 <= 1 THEN 'crossref' WHEN p_partkey % 6 = 4 THEN 'datacite' END AS via FROM part""")
def resolve(spark, d):
    ids = M.table(spark, d, "part").select(F.lit("doi").alias("kind"), F.concat(F.lit("10.1000/p"), F.col("p_partkey").cast("string")).alias("id"))
    return citations.resolve(ids, *_registries(spark, d)).select("kind", "id", "status", "title", "year", F.col("retracted.date").alias("retracted"), "via")


@query(f"""WITH {M.FIRST} SELECT doc_id, '10.1000/p' || p AS id, 'citation-not-found' AS "check" FROM x WHERE k = 2
UNION ALL SELECT doc_id, '10.1000/p' || p, 'retracted-citation' FROM x WHERE k = 1
UNION ALL SELECT doc_id, '10.1000/p' || p, 'citation-mismatch' FROM x WHERE k IN (0, 1, 4) AND (s % 3 = 0 OR NOT regexp_matches(name, '[a-z]{{4}}'))""")
def citation_compare(spark, d):
    ids = citations.identifiers(M.with_dois(spark, d))
    return citations.compare(ids, citations.resolve(ids, *_registries(spark, d))).select("doc_id", "id", "check")


_NOW = "TIMESTAMP '2024-01-20 00:00:00'"


@query(f"""WITH c AS (SELECT user_id AS id, event_type AS status, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events),
l AS (SELECT id, status, ts + CASE status WHEN 'click' THEN INTERVAL 30 DAY WHEN 'error' THEN INTERVAL 1 HOUR ELSE INTERVAL 90 DAY END > {_NOW} AS hit FROM c WHERE r = 1)
SELECT 'user' AS kind, id::varchar AS id, CASE WHEN hit THEN CASE status WHEN 'click' THEN 'found' WHEN 'error' THEN 'unverified' ELSE 'not-found' END END AS status, hit FROM l""")
def cache_hits(spark, d):
    e = M.table(spark, d, "events")
    status = F.when(F.col("event_type") == "click", "found").when(F.col("event_type") == "error", "unverified").otherwise("not-found")
    last = e.groupBy("user_id").agg(F.max_by(F.struct("ts", status.alias("status")), F.struct("ts", "event_id")).alias("x"))
    rows = e.select(F.lit("user").alias("kind"), F.col("user_id").cast("string").alias("id"), status.alias("status"), "ts", "event_id")
    latest = rows.join(last.select(F.col("user_id").cast("string").alias("id"), F.col("x.ts").alias("ts"), F.col("x.status").alias("status")), ["id", "ts", "status"])
    older = rows.join(latest.select("id", F.col("ts").alias("last")), "id").where("ts < last")
    cache = citations.cache_rows(latest, F.col("ts")).withColumn("checked_at", F.expr("checked_at"))
    both = cache.unionByName(older.select("kind", "id", "status", F.col("ts").alias("checked_at"), F.col("ts").alias("expires_at")))
    return citations.cache_hits(rows, both, F.expr(_NOW))


@query("""WITH r AS (SELECT user_id AS host, event_id AS seq, (event_id // 4) AS arrival, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events)
SELECT host, seq, i * 120 + max(arrival - i * 120) OVER (PARTITION BY host ORDER BY seq ROWS UNBOUNDED PRECEDING) AS start FROM r""")
def pacing_schedule(spark, d):
    e = M.table(spark, d, "events").select(F.col("user_id").alias("host"), F.col("event_id").alias("seq"), F.floor(F.col("event_id") / 4).alias("arrival"))
    return citations.pacing(e, F.lit(citations.PAUSE["other"])).select("host", "seq", "start")


# ---- evidence ----

_STOP = ", ".join(f"'{w}'" for w in T.EVIDENCE_STOP)
_TOK = f"list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9\\s-]', ' ', 'g'), '\\s+'), lambda x: length(x) > 2 AND x NOT IN ({_STOP}))"


@query(f"""WITH t AS (SELECT conv_id AS id, turn AS idx, {_TOK} AS t FROM conversations),
st AS (SELECT id, count(*) AS n, avg(len(t)) AS mean FROM t GROUP BY 1),
u AS (SELECT id, idx, len(t) AS l, unnest(t) AS tok FROM t), tf AS (SELECT id, idx, l, tok, count(*) AS tf FROM u GROUP BY ALL),
df AS (SELECT id, tok, count(*) AS df FROM tf GROUP BY ALL), q AS (SELECT DISTINCT id, tok FROM u WHERE idx = 0),
sc AS (SELECT id, idx, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * l / mean))), 9) AS score FROM q JOIN tf USING (id, tok) JOIN df USING (id, tok) JOIN st USING (id) GROUP BY 1, 2)
SELECT id, idx, round(score, 6) AS score, r::int AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, idx) AS r FROM sc WHERE score > 0) WHERE r <= 5""")
def bm25_topk(spark, d):
    c = M.table(spark, d, "conversations")
    s = c.select(F.col("conv_id").alias("id"), F.col("turn").alias("idx"), F.col("text").alias("sentence"))
    q = c.where("turn = 0").select(F.col("conv_id").alias("q_id"), F.col("conv_id").alias("id"), F.col("text").alias("query"))
    return evidence.bm25(s, q).select("id", "idx", F.round("score", 6).alias("score"), "rank")


@query()
def body_sentences(spark, d):
    p = M.table(spark, d, "pages").select(F.col("page_id").alias("id"), "html")
    return evidence.body_sentences(p, 100)


# ---- HTML ----


@query()
def html_blocks(spark, d):
    return html.html_blocks(M.table(spark, d, "pages"), "html", "page_id")


@query("SELECT page_id, (length(html) - length(replace(html, '<a href=', ''))) // 8 AS n_links FROM pages")
def html_links(spark, d):
    x = html.extract_html(M.table(spark, d, "pages"), "html", "page_id")
    return x.select("page_id", F.size("links").cast("long").alias("n_links"))


# ---- reports ----


@query(f"""WITH {M.CITING}, f AS (
 SELECT doc_id, 'cited-not-listed' AS c FROM cite c JOIN live USING (doc_id) WHERE NOT EXISTS (SELECT 1 FROM ent e WHERE e.doc_id = c.doc_id AND e.n = c.number) AND number <= (SELECT max(n) FROM ent e WHERE e.doc_id = c.doc_id)
 UNION ALL SELECT doc_id, 'listed-not-cited' FROM ent e JOIN live USING (doc_id) WHERE NOT EXISTS (SELECT 1 FROM cite c WHERE c.doc_id = e.doc_id AND c.number = e.n)
 UNION ALL SELECT doc_id, 'reference-missing-year' FROM ent JOIN live USING (doc_id) WHERE p % 7 = 0)
SELECT doc.doc_id, count(*) FILTER (WHERE c = 'cited-not-listed') AS cited_not_listed, count(*) FILTER (WHERE c = 'listed-not-cited') AS listed_not_cited, count(*) FILTER (WHERE c = 'reference-missing-year') AS reference_missing_year
FROM doc LEFT JOIN f USING (doc_id) GROUP BY 1""")
def run_counters(spark, d):
    papers = M.citing(spark, d)
    return report.run_counters(papers, report.deterministic_findings(papers)).select("doc_id", "cited_not_listed", "listed_not_cited", "reference_missing_year")


@query(f"""WITH {M.CITING} SELECT doc_id, 'references' AS layer, CASE WHEN why IS NULL THEN 'ran' ELSE 'abstained' END AS status, why AS reason FROM gate UNION ALL
SELECT doc_id, 'terminology', 'inactive', 'no glossary' FROM doc UNION ALL SELECT doc_id, 'citations', 'inactive', 'no registries' FROM doc UNION ALL SELECT doc_id, 'consistency', 'skipped', 'no summary' FROM doc UNION ALL
SELECT doc_id, unnest(['floats', 'overclaims', 'contradictions']), 'ran', NULL FROM doc UNION ALL SELECT doc_id, unnest(['claim-source', 'methodology']), 'inactive', 'no verdicts' FROM doc""")
def layer_breakdown(spark, d):
    papers = M.citing(spark, d)
    return report.layer_breakdown(papers, report.deterministic_findings(papers)).select("doc_id", "layer", "status", "reason")


@query("""WITH o AS (SELECT quality = 1 AS e, toxic = 1 AS v FROM labels), c AS (SELECT count(*) FILTER (WHERE e AND v) AS tp, count(*) FILTER (WHERE NOT e AND v) AS fp, count(*) FILTER (WHERE e AND NOT v) AS fn, count(*) FILTER (WHERE NOT e AND NOT v) AS tn FROM o)
SELECT tp, fp, fn, tn, tp / (tp + fp) AS "precision", tp / (tp + fn) AS recall FROM c""")
def confusion(spark, d):
    return report.confusion(M.table(spark, d, "labels").select((F.col("quality") == 1).alias("expect"), (F.col("toxic") == 1).alias("verdict")))


@query("""WITH g AS (SELECT o_orderpriority AS grp, count(*) FILTER (WHERE o_orderstatus = 'F') AS k, count(*) AS n FROM orders GROUP BY 1), x AS (SELECT *, k / n AS p FROM g)
SELECT grp, round(greatest(0, (p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)), 9) AS lo, round(least(1, (p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)), 9) AS hi FROM x""")
def wilson(spark, d):
    g = M.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("grp")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("k"), F.count("*").alias("n"))
    lo, hi = report.wilson("k", "n")
    return g.select("grp", F.round(lo, 9).alias("lo"), F.round(hi, 9).alias("hi"))


@query("""WITH f AS (SELECT o_custkey AS q_id, list(DISTINCT o_orderkey % 10) AS found FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), g AS (SELECT o_custkey AS q_id, list(DISTINCT o_orderkey % 10) AS gold FROM orders GROUP BY 1)
SELECT q_id, round(coalesce(len(list_intersect(found, gold)), 0)::double / len(gold), 9) AS recall FROM g LEFT JOIN f USING (q_id)""")
def recall_at_k(spark, d):
    o = M.table(spark, d, "orders").select(F.col("o_custkey").alias("q_id"), (F.col("o_orderkey") % 10).cast("int").alias("x"), "o_orderstatus")
    r = report.recall_at_k(o.where("o_orderstatus = 'F'").groupBy("q_id").agg(F.collect_set("x").alias("found")), o.groupBy("q_id").agg(F.collect_set("x").alias("gold")))
    return r.select("q_id", F.round("recall", 9).alias("recall"))


@query("SELECT o_orderkey AS id, o_orderdate AS ts FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 500")
def history_cap(spark, d):
    return report.history_kept(M.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ts")))


@query("""WITH t AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS turn FROM events)
SELECT event_type, event_id, turn::int AS turn FROM t ORDER BY turn, event_type LIMIT 50""")
def balanced_sample(spark, d):
    return report.balanced_sample(M.table(spark, d, "events").select("event_type", "event_id"), "event_type", "event_id", 50)


@query("""SELECT l_orderkey AS doc_id, l_linenumber AS span_start, l_returnflag AS source_ref, count(DISTINCT l_suppkey % 3) AS runs, count(DISTINCT l_suppkey % 3) = 3 AS stable FROM lineitem GROUP BY 1, 2, 3""")
def run_stability(spark, d):
    li = M.table(spark, d, "lineitem")
    return report.stability(li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("span_start"), F.col("l_returnflag").alias("source_ref"), (F.col("l_suppkey") % 3).alias("run")))


@query("""WITH x AS (SELECT p_type AS label, p_name AS text, bool_or(p_size > 25) AS hit FROM part GROUP BY 1, 2)
SELECT label, count(*) AS texts, count(*) FILTER (WHERE hit) AS with_candidate, round(count(*) FILTER (WHERE hit) / count(*), 9) AS share FROM x GROUP BY 1""")
def distinct_recall(spark, d):
    p = M.table(spark, d, "part").select(F.col("p_type").alias("label"), F.col("p_name").alias("text"), (F.col("p_size") > 25).alias("hit"))
    return report.distinct_recall(p).withColumn("share", F.round("share", 9))


@query("""SELECT p_brand AS category, count(*) FILTER (WHERE p_size > 25) AS certain, count(*) FILTER (WHERE p_size <= 25) AS possible, count(*) AS total FROM part GROUP BY 1""")
def category_scope(spark, d):
    return report.category_scope(M.table(spark, d, "part").select(F.col("p_brand").alias("category"), F.when(F.col("p_size") > 25, "certain").otherwise("possible").alias("severity")))


@query("""WITH v AS (SELECT user_id AS doc_id, event_id AS version, event_type AS text, value > 10 AS reviewed FROM events)
SELECT doc_id, arg_max(text, version) IS DISTINCT FROM arg_max(text, version) FILTER (WHERE reviewed) AS stale FROM v GROUP BY 1""")
def staleness(spark, d):
    e = M.table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("version"), F.col("event_type").alias("text"), (F.col("value") > 10).alias("reviewed"))
    return report.staleness(e)


from . import fixtures as _fixtures  # noqa: E402
from . import tables as _tables  # noqa: E402

QUERIES |= _tables.QUERIES
SQL |= _tables.SQL

for _name, (_make, _sql) in _fixtures.QUERIES.items():
    QUERIES[_name] = _make
    SQL[_name] = _sql
