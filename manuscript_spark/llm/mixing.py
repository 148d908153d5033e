"""Mixing sources to target weights by hierarchical budgets.

Documents are leaves' tokens in a tree of domain, language and source. A budget of tokens is
propagated from the root by weights; a node that has less than its share passes the shortage to its
siblings, and only what all siblings can't take goes to the level above. Each leaf then takes a
prefix of seeded epochs: whole passes over its documents, and of the last pass, in an order that
seed and epoch give, the documents before the first that doesn't fit. What is left of its budget is
not given to siblings.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .shared import documents, packed, unpacked, written

LEVELS = ("domain", "lang", "source")
#: Buckets of the order within an epoch are its first 12 bits: a leaf's window over buckets has at most 4,096 rows, and only
#: one bucket of a leaf is summed up row by row, without its texts.
BUCKET_BITS = 12
#: Leaves that are broadcast, at most; with more, their table is joined by a shuffle, in which each leaf has
#: as many copies as salts, so that the documents of a hot one go to many tasks.
BROADCAST_LEAVES, SALTS = 50_000, 32


def default_domain() -> Column:
    """Sources fall into four domains by the number in their name; without one, or a source, the fifth."""
    n = F.regexp_extract(F.col("source"), "([0-9]{1,9})", 1)
    return F.when(n != "", F.concat(F.lit("domain"), (F.expr("try_cast(nullif(regexp_extract(source, '([0-9]{1,9})', 1), '') as int)") % 4).cast("string"))).otherwise(F.lit("other"))


def n_words(text: str = "text") -> Column:
    """Tokens, for budgets: words of a text; null: none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _same(left: list[str], right: list[str]) -> Column:
    """Paths are equal; null is a name like any other."""
    out = F.lit(True)
    for a, b in zip(left, right):
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def _weighted(nodes: DataFrame, level: int, weights: Mapping[tuple, float]) -> DataFrame:
    """Adds w to the nodes of a level: their weight among their siblings, one where none is given."""
    at = LEVELS[:level]
    given = [(*path, float(max(w, 0.0))) for path, w in weights.items() if len(path) == level]
    if not given:
        return nodes.withColumn("w", F.lit(1.0))
    table = nodes.sparkSession.createDataFrame(given, ", ".join(f"w_{k} string" for k in at) + ", given double")
    return nodes.join(table, _same(list(at), [f"w_{k}" for k in at]), "left").withColumn("w", F.coalesce("given", F.lit(1.0))).drop("given", *[f"w_{k}" for k in at])


def budgets(leaves: DataFrame, total: float, weights: Mapping[tuple, float], epochs: int) -> DataFrame:
    """leaves (domain, lang, source, n tokens) with budget: the tokens that each gets of a total. weights: path of any node -> its weight
    among its siblings, one where it is missing; zero or less: nothing. No leaf gets more than `epochs` times its tokens.

    Water-filling, level by level, as window functions: siblings in the order of capacity over weight; one is full if its
    capacity is at most its share of what the ones before leave, and the first that isn't sets the share of all behind.
    What siblings can't take has been kept from their parent before, so that it goes to the ancestors' other children.
    """
    nodes = _weighted(leaves, len(LEVELS), weights).withColumn("capacity", F.when(F.col("w") > 0, F.col("n").cast("double") * epochs).otherwise(0.0))
    tree = [nodes]  # the nodes of each level, the leaves first; each level's capacity is what its children can take
    for level in range(len(LEVELS) - 1, 0, -1):
        up = _weighted(tree[-1].groupBy(*LEVELS[:level]).agg(F.sum("capacity").alias("capacity")), level, weights)
        tree.append(up.withColumn("capacity", F.when(F.col("w") > 0, F.col("capacity")).otherwise(0.0)))
    parents: DataFrame | None = None
    for level, children in enumerate(reversed(tree), 1):
        above = LEVELS[: level - 1]
        if parents is None:
            c = children.withColumn("budget", F.lit(float(total)))
        else:
            p = parents.select(*[F.col(k).alias(f"p_{k}") for k in above], F.col("given").alias("budget"))
            c = children.join(p, _same(list(above), [f"p_{k}" for k in above])).drop(*[f"p_{k}" for k in above])
        family = W.partitionBy(*above)
        order = family.orderBy("ratio", *LEVELS[:level])
        before = order.rowsBetween(W.unboundedPreceding, -1)
        c = c.withColumn("open", F.when(F.col("capacity") > 0, F.col("w")).otherwise(0.0)).withColumn("ratio", F.when(F.col("open") > 0, F.col("capacity") / F.col("open")))
        rest = F.sum("open").over(family) - F.coalesce(F.sum("open").over(before), F.lit(0.0))
        c = c.withColumn("left", F.greatest(F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0.0)), F.lit(0.0))).withColumn("share", F.try_divide(F.col("left"), rest))
        c = c.withColumn("unit", -F.min(F.when(F.col("ratio") > F.col("share"), F.struct("ratio", (-F.col("share")).alias("less")))).over(family)["less"])
        c = c.withColumn("given", F.when(F.coalesce(F.col("open"), F.lit(0.0)) <= 0, 0.0).when(F.col("unit").isNull(), F.col("capacity")).otherwise(F.least("capacity", F.col("open") * F.col("unit"))))
        parents = c.select(*LEVELS[:level], *(["n"] if level == len(LEVELS) else []), "given")
    return parents.select(*LEVELS, "n", F.col("given").alias("budget"))


def mix(docs: DataFrame, tokens: Column, total: float | None = None, share: float = 0.9, weights: Mapping[tuple, float] | None = None, epochs: int = 1, seed: int = 20, domain: Column | None = None) -> DataFrame:
    """The selected rows of docs (all its columns) with __epoch, __domain and __n_tokens; rows of a leaf that
    has more budget than tokens come once for each epoch.

    docs: doc_id, text, lang, source; other columns may have any names (one of the three new names gives way to ours).
    tokens: what a document costs. total: the budget; by default `share` of all tokens. In a leaf's
    last epoch documents come in the order of a hash of seed, epoch and doc_id (ties: doc_id, tokens, a hash of the text) and the longest
    prefix that fits is taken. Null lang and source are leaves of their own. Documents without tokens are taken
    in every whole epoch, and in the last one as far as the prefix goes; a null text has none. Very long texts cost what they have;
    one that doesn't fit ends its leaf's prefix. An empty table gives an empty result.
    """
    own = [c for c in docs.columns if c not in ("__epoch", "__domain", "__n_tokens")]
    keys = list(LEVELS)
    row = {"domain": domain if domain is not None else default_domain(), "lang": F.col("lang"), "source": F.col("source"), "n": F.coalesce(tokens, F.lit(0)).cast("long"), "doc_id": F.col("doc_id")}
    row["tie"] = F.xxhash64("text")
    df = docs.select(packed(docs, own, "doc"), *[c.alias(k) for k, c in row.items()])
    # all that is worked out about the epochs reads these narrow rows; the texts are read twice only, for them and for the result
    narrow = written(docs.select(*[c.alias(k) for k, c in row.items()]), "mix-rows")
    leaves = written(narrow.groupBy(*keys).agg(F.sum("n").alias("n")), "mix-leaves")
    found = leaves.agg(F.count("*").alias("leaves"), F.sum("n").alias("n")).first()
    small = found.leaves <= BROADCAST_LEAVES
    given = budgets(leaves, share * (found.n or 0) if total is None else total, weights or {}, epochs)
    whole_tokens = F.floor(F.col("budget") + 1e-6)
    full = F.when(F.col("n") > 0, F.least(F.lit(epochs), F.floor(whole_tokens / F.greatest(F.col("n"), F.lit(1))))).otherwise(epochs).cast("int")
    # rest: tokens for the last epoch, which isn't whole; -1: there is none
    rest = F.when(full < epochs, whole_tokens - full * F.col("n")).otherwise(-1).cast("long")
    table = written(given.select(*[F.col(k).alias(f"p_{k}") for k in keys], full.alias("full"), rest.alias("rest")), "mix-budgets")

    def with_leaf(d: DataFrame, t: DataFrame) -> DataFrame:
        """Documents with what the table says of their leaf."""
        on = _same(keys, [f"p_{k}" for k in keys])
        if small:
            return d.join(F.broadcast(t), on, "left").drop(*[f"p_{k}" for k in keys])
        salted = t.withColumn("p_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return d.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, on & (F.col("salt") == F.col("p_salt")), "left").drop("salt", "p_salt", *[f"p_{k}" for k in keys])

    order = F.xxhash64(F.lit(seed), F.col("full"), F.col("doc_id"))
    bucket = F.shiftrightunsigned(order, 64 - BUCKET_BITS).cast("int")
    # the bucket of a leaf in which its last epoch ends, and what lies before it
    per = with_leaf(narrow, table).where("rest >= 0").groupBy(*keys, bucket.alias("bucket")).agg(F.sum("n").alias("n"), F.first("rest").alias("rest"))
    upto = F.sum("n").over(W.partitionBy(*keys).orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))
    over = per.withColumn("upto", upto).where("upto > rest").groupBy(*keys).agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before")), "bucket").alias("end"))
    end = over.select(*[F.col(k).alias(f"e_{k}") for k in keys], F.col("end.bucket").alias("end_bucket"), F.col("end.before").alias("before"))
    table = written(table.join(end, _same([f"p_{k}" for k in keys], [f"e_{k}" for k in keys]), "left").select(*table.columns, "end_bucket", "before"), "mix-ends")

    # in that bucket, the last place that fits, and how many of the rows that share it do
    place = F.struct(order.alias("order"), F.col("doc_id").isNotNull().alias("named"), F.coalesce("doc_id", F.lit(0)).alias("id"), "n", "tie")
    last = with_leaf(narrow, table).where("rest >= 0").where(bucket == F.col("end_bucket")).select(*keys, "n", "rest", "before", place.alias("place"))
    running = F.sum("n").over(W.partitionBy(*keys).orderBy("place").rowsBetween(W.unboundedPreceding, 0))
    fits = last.withColumn("upto", running + F.col("before")).groupBy(*keys, "place").agg(F.count_if(F.col("upto") <= F.col("rest")).alias("copies"), F.count("*").alias("rows")).where("copies > 0")
    ends = fits.groupBy(*keys).agg(F.max(F.struct("place", "copies", "rows")).alias("last"))
    cut = ends.select(*[F.col(k).alias(f"c_{k}") for k in keys], F.col("last.place").alias("cut"), F.col("last.copies").alias("copies"), (F.col("last.copies") < F.col("last.rows")).alias("parted"))
    table = written(table.join(cut, _same([f"p_{k}" for k in keys], [f"c_{k}" for k in keys]), "left").select(*table.columns, "cut", "copies", "parted"), "mix-cuts")

    df = with_leaf(df, table).withColumns({"place": place, "bucket": bucket})
    in_last = F.col("bucket") == F.col("end_bucket")
    sure = F.col("end_bucket").isNull() | (F.col("bucket") < F.col("end_bucket")) | (in_last & F.coalesce((F.col("place") < F.col("cut")) | ((F.col("place") == F.col("cut")) & ~F.col("parted")), F.lit(False)))
    times = F.col("full") + F.when((F.col("rest") >= 0) & sure, 1).otherwise(0)
    whole = df.where(times > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), times - 1)))
    cols = [*unpacked(own, "doc"), F.col("epoch").cast("int").alias("__epoch"), F.col("domain").alias("__domain"), F.col("n").alias("__n_tokens")]
    if table.where("parted").isEmpty():
        return whole.select(*cols)
    # a cut that parts rows of the same doc_id and text
    nth = F.row_number().over(W.partitionBy(*keys).orderBy("place"))
    edge = df.where(F.col("parted") & in_last & (F.col("place") == F.col("cut"))).withColumn("nth", nth).where("nth <= copies").withColumn("epoch", F.col("full"))
    return whole.select(*cols).unionByName(edge.select(*cols))


#: The targets of the query: English half of each domain, the others alike; all domains and sources alike.
WEIGHTS = {(f"domain{i}", "en"): 3.0 for i in range(4)}


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    out = mix(docs, n_words(), share=0.9, weights=WEIGHTS, epochs=3)
    return out.select("doc_id", F.col("__domain").alias("domain"), "lang", "source", F.col("__epoch").alias("epoch"), F.col("__n_tokens").alias("n_tokens"))
