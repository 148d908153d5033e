"""Helpers that the operators of this subpackage have in common."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Texts that are turned into Python strings at a time; bounds the memory of a Python worker.
SLICE = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only in a local session that leaves it
    unset a folder of this machine is made and set; a cluster without the setting is an error, as executors
    would write to disks of their own."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not where and sc._jsc.sc().getCheckpointDir().isDefined():
        where = sc._jsc.sc().getCheckpointDir().get()
    if not where:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="manuscript-spark-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read back: cuts the lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(work) -> None:
    """At the end of a task: what it remembered is dropped, and its memory goes back to the system, as the
    Python worker lives on for tasks of other stages."""
    getattr(work, "close", lambda: None)()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps the memory for later
        pass


def named(column: str) -> Column:
    """A column by its whole name, dots and backticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def packed(df: DataFrame, columns: list[str] | None = None, name: str = "row") -> Column:
    """All columns (or some) as one struct, so that none of their names can clash with one of ours."""
    return F.struct(*[named(c) for c in (df.columns if columns is None else columns)]).alias(name)


def unpacked(columns: list[str], name: str = "row") -> list[Column]:
    """The columns of a struct again, under their own names."""
    return [F.col(name).getField(c).alias(c) for c in columns]


def map_texts(
    df: DataFrame,
    make: Callable[[], Callable[[list[str]], list[pa.Array]]],
    schema: str,
    keep: tuple[str, ...] = ("doc_id",),
    text: str = "text",
) -> DataFrame:
    """Apply a function to every whole text (null: empty), slice by slice.

    `make` is called once per task and returns the function (so that tokenizers and automata are
    built where they are used); the function gets a list of texts and returns one Arrow array per
    new column. `schema` is the DDL of the new columns, which come after the kept ones.
    """
    spark = df.sparkSession
    new = spark.createDataFrame([], schema).schema
    rows = df.select(packed(df, list(keep)), named(text).alias("text"))
    out = StructType([rows.schema["row"], *new.fields])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                columns = [part.column(0)] + work([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(columns, arrow)], schema=arrow)
        release(work)

    # kept columns that a new one has the name of give way to it
    kept = [c for c in keep if c not in new.names]
    return rows.mapInArrow(run, out).select(*unpacked(kept), *[named(n) for n in new.names])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def filter_texts(df: DataFrame, make: Callable[[], Callable[[list[str]], list[bool]]], text: str = "text") -> DataFrame:
    """The rows of df, with all columns, whose whole text (null: empty) a function accepts."""
    rows = df.select(packed(df))
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        accept = make()
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                texts = part.column(0).field(at).to_pylist()
                yield part.filter(pa.array(accept([t or "" for t in texts]), pa.bool_()))
        release(accept)

    return rows.mapInArrow(run, rows.schema).select(*unpacked(df.columns))
