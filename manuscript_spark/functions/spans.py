"""Operators on spans: places of matches, points in intervals, greedy covers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import col


def bind(value: Column, f) -> Column:
    """f of a value that is worked out once; an expression used inside a lambda is worked out for every element."""
    return F.element_at(F.transform(F.array(value), f), 1)


#: Sizes that are added up at a time; see `starts`.
BLOCK = 64


def starts(sizes: Column) -> Column:
    """The sum of the sizes before each. A fold copies what it has gathered at each step, so sizes are added up
    within blocks, and block by block: an array of n takes about n * BLOCK / 2 copies in place of n * n / 2."""

    def total(b: Column) -> Column:
        return F.aggregate(b, F.lit(0), lambda a, x: a + x)

    def running(b: Column) -> Column:
        return F.aggregate(b, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))

    def placed_blocks(blocks: Column) -> Column:
        return F.flatten(F.zip_with(blocks, running(F.transform(blocks, total)), lambda b, at: F.when(b.isNotNull(), F.transform(F.slice(running(b), 1, F.size(b)), lambda x: x + at)).otherwise(F.array().cast("array<int>"))))

    def of(s: Column) -> Column:
        last = F.floor((F.size(s) - 1) / BLOCK).cast("int")
        return F.when(F.size(s) > 0, bind(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.slice(s, i * BLOCK + 1, F.lit(BLOCK))), placed_blocks)).otherwise(F.array().cast("array<int>"))

    return bind(sizes, of)


def placed(parts: Column, size, item) -> Column:
    """item(place, part) for each part of an array; size: what a part takes up."""
    return bind(parts, lambda p: F.zip_with(p, starts(F.transform(p, size)), lambda x, at: item(at, x)))


def one_row(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """The kept columns and new ones that are worked out once for each row: what comes later reads them as they
    are. (Filters and projections are moved through a plain projection, and then work out its expressions again.)"""
    made = df.select(*keep, F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("__row"))
    return made.select(*keep, *[F.col(f"__row.{n}").alias(n) for n in columns])


def matches(text: str | Column, pattern: str) -> Column:
    """array<struct<start, text>>: the matches of a pattern (never empty ones) and where they begin."""
    t = col(text)
    pieces = F.zip_with(F.split(t, pattern, -1), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("m")))
    found = F.filter(pieces, lambda x: x["m"].isNotNull())
    return placed(found, lambda x: x["gap"] + F.length(x["m"]), lambda at, x: F.struct((at + x["gap"]).alias("start"), x["m"].alias("text")))


def exploded(df: DataFrame, text: str, pattern: str, *keep: str) -> DataFrame:
    """A row (kept columns, pos, start, end, text) for every match."""
    rows = df.select(*keep, F.posexplode(matches(text, pattern)).alias("pos", "m"))
    return rows.select(*keep, "pos", F.col("m.start").alias("start"), (F.col("m.start") + F.length("m.text")).alias("end"), F.col("m.text").alias("text"))


def greedy_cover(spans: Column) -> Column:
    """Of an array of structs with start and end, those that overlap none taken before, in the array's order."""
    empty = F.filter(spans, lambda x: F.lit(False))
    return F.aggregate(spans, empty, lambda kept, x: F.when(F.exists(kept, lambda k: (k["start"] < x["end"]) & (x["start"] < k["end"])), kept).otherwise(F.concat(kept, F.array(x))))


def containing(points: DataFrame, intervals: DataFrame, on: str | list[str], at: str = "offset", how: str = "inner") -> DataFrame:
    """Points joined to the half-open intervals (start, end) of the same key that contain them: a hash
    join on the key with the range as a residual."""
    keys = [on] if isinstance(on, str) else on
    i = intervals.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in intervals.columns if c not in keys])
    cond = F.col("start") <= F.col(at)
    cond = cond & (F.col(at) < F.col("end"))
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"__{k}"))
    return points.join(i, cond, how).drop(*[f"__{k}" for k in keys])
