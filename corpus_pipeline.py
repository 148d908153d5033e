"""A pipeline over documents: each stage gets the documents that the one before kept.

Part of the subpackage llm: it calls its operators and nothing else. Documents may have further columns
with any names; every stage but the last returns all of them. No stage fails on an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from manuscript_spark.llm import bpe, mixing, pii, simhash, toxicity
from manuscript_spark.llm.shared import documents, filter_texts, named, packed, unpacked, written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold of the query; null and empty texts stay."""
    lexicon = toxicity.learned(spark, docs, sf_dir)

    def make():
        def accept(texts: list[str]) -> list[bool]:
            got = [lexicon.evidence(t) for t in texts]
            return (lexicon.scores([g[0] for g in got], [g[2] for g in got]) < toxicity.THRESHOLD).tolist()

        return accept

    return filter_texts(docs, make)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id; of rows that repeat a
    doc_id one stays (by a hash of the text). Rows without a doc_id stay, as no id can name them."""
    found = simhash.near_duplicates(docs.select("doc_id", "text"))
    names = found.where("component_id is not null").select(F.col("component_id").alias("name")).distinct()
    rows = docs.select(packed(docs), F.col("doc_id").alias("id"), F.xxhash64("text").alias("tie"))
    kept = rows.where("id is not null").join(names, F.col("id") == F.col("name"), "left_semi")
    one = F.row_number().over(W.partitionBy("id").orderBy("tie"))
    return kept.withColumn("n", one).where("n = 1").select("row").union(rows.where("id is null").select("row")).select(*unpacked(docs.columns))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every span of personal data replaced by its kind; n_chars follows the text.
    A null text becomes an empty one; repeated rows stay repeated."""
    out = pii.redacted(docs, tuple(c for c in docs.columns if c != "text"))
    new = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return out.select(*[new[c].alias(c) if c in new else named(c) for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the words, dealt to domains, languages and sources by the weights of the query;
    one epoch, so that a document comes at most once. Null lang and source are leaves of their own; documents
    without words cost nothing; rows that tie in doc_id and words come in the order of a hash of the text."""
    return mixing.mix(docs, mixing.n_words(), share=0.9, weights=mixing.WEIGHTS, epochs=1).select(*[named(c) for c in docs.columns])


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, with their number and digests; a null or empty text has none. Very long texts are
    encoded whole, repeated rows stay repeated, columns other than doc_id and text are left behind."""
    return bpe.encode(docs, bpe.tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_copies),
    ("personal_data", without_personal_data),
    ("mixing", mixed),
    ("encoding", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again as the documents of the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: A fitted lexicon, components and a seeded mix can't be expressed in SQL; tests/llm checks the stages by brute force.
ORACLE_SQL = None
