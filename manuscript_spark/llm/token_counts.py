"""Token counts through a digest cache.

The cache is a table of (content digest, count), one folder for each digest of the tokenizer. Texts
are digested, digests joined to the stored counts; of those without a count each distinct text is
encoded once, and its count appended to the cache.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, fresh_path, map_texts

CACHE = "digest binary, n_tokens long"


def tokenizer_version(path: str) -> str:
    """The digest of a tokenizer: of its file, and of how this module uses it."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + b"|no special tokens|whole texts").hexdigest()


def counter(path: str):
    """A function from texts to token counts, by the library of the file's kind."""
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return lambda texts: [len(t.encode(x, add_special_tokens=False).ids) for x in texts]


def stored(spark: SparkSession, where: str) -> DataFrame:
    """The cached counts of a tokenizer version, one row a digest even where two runs at a time appended
    the same one; empty if there are none yet."""
    p = spark._jvm.org.apache.hadoop.fs.Path(where)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(where).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_misses(texts: DataFrame, path: str) -> DataFrame:
    def make():
        count = counter(path)
        return lambda part: [pa.array(count(part), pa.int64())]

    return map_texts(texts, make, "n_tokens long", keep=("digest",))


def count_tokens(docs: DataFrame, path: str, cache: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text; null: empty. The normal form of a
    text is the text itself with null taken as empty, as any further change could alter a count.
    `cache` is a folder of the shared file system; counts that it lacks are appended to it.
    Repeated rows stay repeated; rows without a doc_id are counted too."""
    spark = docs.sparkSession
    where = f"{cache.rstrip('/')}/{tokenizer_version(path)}"
    text = F.coalesce(F.col("text"), F.lit(""))
    seen = docs.select("doc_id", F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    once = seen.groupBy("digest").agg(F.first("text").alias("text"))
    known = stored(spark, where)
    misses = once.join(known.select("digest"), "digest", "left_anti")
    count_misses(misses, path).write.mode("append").parquet(where)
    counts = stored(spark, where)
    return seen.select("doc_id", "digest", "n_bytes").join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The count of every text. The query starts from an empty cache of its own, so that each run does the whole work."""
    from .bpe import tokenizer_path

    return count_tokens(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"), fresh_path(spark, "token-counts"))
