"""Manuscripts made from relational rows, so that what the text holds is known from the columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _joined(when: Column | None, text: Column, sep: str) -> Column:
    """The texts of an order's lines, in order, joined."""
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", text.alias("t"))
    lines = F.array_sort(F.collect_list(F.when(when, item) if when is not None else item))
    return F.array_join(F.transform(lines, lambda x: x["t"]), sep)


def citing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): an order as a paper. Lines of a quantity over ten cite [line number]; lines whose part is no
    multiple of five are entries of the list, without a year if the part is one of seven."""
    li = table(spark, sf_dir, "lineitem")
    n, s, p = (F.col(c).cast("string") for c in ("l_linenumber", "l_suppkey", "l_partkey"))
    sentence = F.concat(F.lit("Earlier systems such as S"), s, F.lit("X are described in ["), n, F.lit("] at length."))
    year = F.when(F.col("l_partkey") % 7 != 0, ", 1995.").otherwise(".")
    entry = F.concat(F.lit("["), n, F.lit("] Author S"), s, F.lit("X, Notes on part P"), p, F.lit("X and its many uses in storage, Venue"), year)
    d = li.groupBy(F.col("l_orderkey").alias("doc_id")).agg(_joined(F.col("l_quantity") > 10, sentence, " ").alias("prose"), _joined(F.col("l_partkey") % 5 != 0, entry, "\n").alias("list"))
    return d.select("doc_id", F.concat(F.lit("Introduction\n\n"), "prose", F.lit("\n\nReferences\n\n"), "list", F.lit("\n")).alias("text"))


#: The same papers in DuckDB: sentences and entries with their places. li: lines in order; doc: places of a paper's parts.
CITING = """
li AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, l_quantity AS q, l_discount AS disc,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount) AS k FROM lineitem),
sent0 AS (SELECT *, 'Earlier systems such as S' || s || 'X are described in [' || n || '] at length.' AS t FROM li WHERE q > 10),
ent0 AS (SELECT *, '[' || n || '] Author S' || s || 'X, Notes on part P' || p || 'X and its many uses in storage, Venue' || CASE WHEN p % 7 <> 0 THEN ', 1995.' ELSE '.' END AS t FROM li WHERE p % 5 <> 0),
doc AS (SELECT o.doc_id, 14 + coalesce(a.len, 0) + 2 AS prose_end, 14 + coalesce(a.len, 0) + 2 + 12 AS list_at, 14 + coalesce(a.len, 0) + 2 + 12 + coalesce(b.len, 0) + 1 AS total, coalesce(a.c, 0) AS n_sent, coalesce(b.c, 0) AS n_ent
  FROM (SELECT DISTINCT doc_id FROM li) o
  LEFT JOIN (SELECT doc_id, sum(length(t) + 1) - 1 AS len, count(*) AS c FROM sent0 GROUP BY 1) a USING (doc_id)
  LEFT JOIN (SELECT doc_id, sum(length(t) + 1) - 1 AS len, count(*) AS c FROM ent0 GROUP BY 1) b USING (doc_id)),
sent AS (SELECT *, 14 + coalesce(sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM sent0),
ent AS (SELECT e.*, d.list_at + coalesce(sum(length(t) + 1) OVER (PARTITION BY e.doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos,
         coalesce(d.list_at + sum(length(t) + 1) OVER (PARTITION BY e.doc_id ORDER BY k ROWS UNBOUNDED PRECEDING), 0) AS next FROM ent0 e JOIN doc d USING (doc_id)),
cite AS (SELECT doc_id, n AS number, min(pos + strpos(t, '[') - 1)::int AS pos FROM sent GROUP BY 1, 2),
gate AS (SELECT doc_id, CASE WHEN prose_end < 0.1 * total THEN 'no reference section' WHEN n_ent < 3 THEN 'too few numbered entries' WHEN n_sent = 0 THEN 'no numeric citations' END AS why,
         CASE WHEN prose_end < 0.1 * total THEN 0 ELSE n_ent END AS entries, (SELECT count(*) FROM cite c WHERE c.doc_id = doc.doc_id) AS cited FROM doc),
live AS (SELECT doc_id FROM gate WHERE why IS NULL)
"""


def with_floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): lines whose part is no multiple of three have a caption, lines over a quantity of twenty a pointer."""
    li = table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber").cast("string")
    kind = F.when(F.col("l_suppkey") % 2 == 0, "Table").otherwise("Figure")
    d = li.groupBy(F.col("l_orderkey").alias("doc_id")).agg(
        _joined(F.col("l_quantity") > 20, F.concat(F.lit("As "), kind, F.lit(" "), n, F.lit(" shows, stock rose.")), " ").alias("prose"), _joined(F.col("l_partkey") % 3 != 0, F.concat(kind, F.lit(" "), n, F.lit(": Stock of the part.")), "\n").alias("captions")
    )
    return d.select("doc_id", F.concat("prose", F.lit("\n\n"), "captions", F.lit("\n")).alias("text"))


FLOATS = """
fl AS (SELECT l_orderkey AS doc_id, l_linenumber AS number, CASE WHEN l_suppkey % 2 = 0 THEN 'Table' ELSE 'Figure' END AS family, l_partkey % 3 <> 0 AS cap, l_quantity > 20 AS ment FROM lineitem),
cap AS (SELECT DISTINCT doc_id, family, number FROM fl WHERE cap), ment AS (SELECT DISTINCT doc_id, family, number FROM fl WHERE ment)
"""


def with_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, brief, text): lines up to a quantity of 25 give their discount in the body, the others in the brief."""
    li = table(spark, sf_dir, "lineitem")
    pct = F.round(F.col("l_discount") * 100).cast("int").cast("string")
    d = li.groupBy(F.col("l_orderkey").alias("doc_id")).agg(_joined(F.col("l_quantity") > 25, F.concat(F.lit("We report "), pct, F.lit("% here.")), " ").alias("brief"), _joined(F.col("l_quantity") <= 25, F.concat(F.lit("The discount was "), pct, F.lit(" percent there.")), " ").alias("text"))
    return d


#: Sentences for each kind of line, with what an overclaim check finds in them.
CLAIMS = [
    ("The index always returns each matching row of P", "strong-assertion"),
    ("Latency was strongly tied to the partition count of P", "booster"),
    ("Skewed keys are commonly seen in the event logs of P", "generality"),
    ("Hence the planner must choose the smaller side of P", "inferential"),
    ("Skewed keys cause stragglers in the final stage of P", "bare-causal"),
    ("Skewed keys may cause stragglers in the final stage of P", None),
    ("We report that skewed keys cause stragglers in P", None),
]


def with_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): a sentence for each line, by its line number."""
    li = table(spark, sf_dir, "lineitem")
    text = F.element_at(F.array(*[F.lit(t) for t, _ in CLAIMS]), ((F.col("l_linenumber") - 1) % len(CLAIMS)).cast("int") + 1)
    sentence = F.concat(text, F.col("l_partkey").cast("string"), F.lit("X."))
    return li.groupBy(F.col("l_orderkey").alias("doc_id")).agg(_joined(None, sentence, " ").alias("text"))


METRICS = ("recall", "precision", "coverage")


def with_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): a measured percentage for each line; the metric goes by the supplier."""
    li = table(spark, sf_dir, "lineitem")
    metric = F.element_at(F.array(*[F.lit(m) for m in METRICS]), (F.col("l_suppkey") % 3).cast("int") + 1)
    sentence = F.concat(F.lit("Run S"), F.col("l_suppkey").cast("string"), F.lit("X came to "), F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit("% "), metric, F.lit(" over the whole of the large set that was made ready for it in the year before."))
    return li.groupBy(F.col("l_orderkey").alias("doc_id")).agg(_joined(None, sentence, " ").alias("text"))


def with_dois(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): the first line of an order cites the DOI of its part, with the part's name as title if
    the supplier is no multiple of three."""
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    first = li.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.min(line).alias("x")).select("doc_id", "x.*")
    x = first.join(part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    said = F.when(F.col("l_suppkey") % 3 != 0, F.col("p_name")).otherwise("stock levels rose over many months")
    sentence = F.concat(F.lit("The work on "), said, F.lit(" was done with great care and patience there (doi:10.1000/P"), F.col("l_partkey").cast("string"), F.lit(")."))
    return x.select("doc_id", sentence.alias("text"))


#: The first line of each order, and its part.
FIRST = """x AS (SELECT l_orderkey AS doc_id, l_partkey AS p, l_suppkey AS s, p_partkey % 6 AS k, p_name AS name FROM
  (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem) JOIN part ON l_partkey = p_partkey WHERE r = 1)"""
