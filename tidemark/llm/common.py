"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import share_package, shared_root

#: Rows in an Arrow batch: bounds what a Python worker holds when texts are long.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> SparkSession:
    """Settings that the operators rely on. The checkpoint folder is the one that the session names; shared_root() says
    what holds where it names none."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    context = spark.sparkContext
    share_package(spark)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(spark))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def id_field(df: DataFrame, id_col: str) -> T.StructField:
    return T.StructField(id_col, df.schema[id_col].dataType)


def schema_of(id_field: T.StructField, ddl: str) -> T.StructType:
    return T.StructType([id_field, *T.StructType.fromDDL(ddl).fields])


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without a detour over str."""
    return column.cast(pa.binary()).to_pylist()


def sliding(x: np.ndarray, width: int, better: np.ufunc) -> np.ndarray:
    """The best of each width neighbours; element i covers i .. i + width - 1."""
    out, have = x, 1
    while 2 * have <= width:
        out = better(out[: len(out) - have], out[have:])
        have *= 2
    rest = width - have
    return better(out[: len(out) - rest], out[rest:]) if rest else out


def map_texts(df: DataFrame, id_col: str, text_col: str, ddl: str, kernel: Callable[[], Callable[[list], list[list]]], binary: bool = False) -> DataFrame:
    """(id, kernel's columns) per row. kernel() runs once in a task and gives a function from a batch's
    texts (None stays None) to one list for each output column."""
    schema = schema_of(id_field(df, id_col), ddl)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = kernel()
        for batch in batches:
            if batch.num_rows:
                texts = as_bytes(batch.column(1)) if binary else batch.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, type=t) for c, t in zip(apply(texts), types, strict=True))], names=names)

    types = [arrow_type(f.dataType) for f in schema.fields[1:]]
    return df.select(id_col, text_col).mapInArrow(run, schema)


def filter_texts(df: DataFrame, text_col: str, kernel: Callable[[], Callable[[list], list[bool]]], binary: bool = False) -> DataFrame:
    """The rows, with all columns as they are, for which kernel says True."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = kernel()
        for batch in batches:
            if batch.num_rows:
                texts = as_bytes(batch.column(at)) if binary else batch.column(at).to_pylist()
                yield batch.filter(pa.array(apply(texts), type=pa.bool_()))

    return df.mapInArrow(run, df.schema)


def arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def connected_components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component) of an undirected graph given as edges (a, b) of longs; component is the smallest node
    that can be reached. Alternating large and small stars: each round is two joins on the edge list, the number
    of edges never grows, and a hub's edges are split by the skew join rather than gathered. The edge list is
    checkpointed to the shared folder each round. Loops and repeated edges are ignored."""
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct().checkpoint()
    before = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = small.filter("u != v").distinct().checkpoint()
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
