"""Evidence retrieval: body sentences of a page, and BM25 within a document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import WS, E, evidence_tokens, page_text

K1, BETA, TOP, LEAST_WORDS = 1.2, 0.75, 5, 1200
# Headings of what is no evidence.
DROPPED = rf"^(?i:[{WS}]*(?:references|bibliography|acknowledge?ments?|appendix|appendices|supplementary){E})"


def body_sentences(pages: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(id, idx, sentence) of pages (id, html) up to the last dropped heading in the second half;
    sentences of six words at least; nothing of a page with fewer than `least_words` words in them."""
    trim = lambda x: F.regexp_replace(F.regexp_replace(x, f"^[{WS}]+", ""), f"[{WS}]+$", "")
    blocks = F.filter(F.transform(F.split(page_text("html"), "\n{2,}"), trim), lambda x: x != "")
    p = pages.select("id", blocks.alias("blocks"))
    n = F.size("blocks")
    heads = F.filter(F.transform("blocks", lambda b, i: F.when(b.rlike(DROPPED) & (i >= F.floor(n / 2)), i)), lambda i: i.isNotNull())
    p = p.withColumn("cut", F.coalesce(F.array_max(heads), n))
    parts = F.flatten(F.transform(F.slice("blocks", F.lit(1), F.col("cut")), lambda b: F.split(b, rf"(?<=[.!?])[{WS}]+(?=[A-Z(])")))
    clean = F.filter(F.transform(parts, lambda s: F.regexp_replace(trim(s), f"[{WS}]+", " ")), lambda s: F.size(F.split(s, " ")) >= 6)
    p = p.select("id", clean.alias("s"))
    total = F.aggregate("s", F.lit(0), lambda a, x: a + F.size(F.split(x, " ")))
    return p.where(total >= least_words).select("id", F.posexplode("s").alias("idx", "sentence"))


def bm25(sentences: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """(q_id, id, idx, score, rank): the k sentences of document `id` with the highest BM25 score for a query
    (q_id, id, query); statistics are the document's own; ties go to the earlier sentence."""
    t = sentences.select("id", "idx", evidence_tokens("sentence").alias("t")).withColumn("len", F.size("t"))
    stats = t.groupBy("id").agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
    tf = t.select("id", "idx", "len", F.explode("t").alias("token")).groupBy("id", "idx", "len", "token").agg(F.count("*").alias("tf"))
    df = tf.groupBy("id", "token").agg(F.count("*").alias("df"))
    asked = queries.select("q_id", "id", F.explode(F.array_distinct(evidence_tokens("query"))).alias("token"))
    x = asked.join(tf, ["id", "token"]).join(df, ["id", "token"]).join(stats, "id")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - BETA + BETA * F.col("len") / F.col("mean")))
    score = x.groupBy("q_id", "id", "idx").agg(F.round(F.sum(part), 9).alias("score")).where("score > 0")
    rank = F.row_number().over(W.partitionBy("q_id", "id").orderBy(F.desc("score"), "idx"))
    return score.withColumn("rank", rank).where(F.col("rank") <= k)


def evidence_text(top: DataFrame, sentences: DataFrame) -> DataFrame:
    """(q_id, id, evidence): the chosen sentences in the document's order."""
    j = top.join(sentences, ["id", "idx"]).groupBy("q_id", "id").agg(F.array_sort(F.collect_list(F.struct("idx", "sentence"))).alias("s"))
    return j.select("q_id", "id", F.array_join(F.transform("s", lambda x: x["sentence"]), " ").alias("evidence"))
