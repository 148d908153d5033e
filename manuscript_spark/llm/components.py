"""Connected components of an undirected graph, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh_path, remove


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b): component is the smallest node reachable.

    Alternates large stars (every larger neighbour is linked to the smallest one) and small stars
    (smaller neighbours are linked to the smallest one) until the set of links no longer changes;
    the number of rounds grows with the logarithm of the longest path. No step holds a node's
    neighbours in memory: minima come from partial aggregates, and links return by an equi join
    that Spark may split where one node is hot. Each round is a table in the shared folder.
    """
    spark = edges.sparkSession
    links = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    path = fresh_path(spark, "links")
    links.write.parquet(path)
    before = None
    for _ in range(max_rounds):
        e = spark.read.parquet(path)
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        mid = fresh_path(spark, "links")
        large.write.parquet(mid)
        e2 = spark.read.parquet(mid)
        low2 = e2.groupBy("u").agg(F.min("v").alias("m"))
        j = e2.join(low2, "u")
        small = j.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        new = fresh_path(spark, "links")
        small.write.parquet(new)
        r = spark.read.parquet(new).agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        remove(spark, path)
        remove(spark, mid)
        path = new
        if (r[0], r[1]) == before:
            break
        before = (r[0], r[1])
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = spark.read.schema("u long, v long").parquet(path)
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
