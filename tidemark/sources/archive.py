"""Archives of the change log: Parquet by server, day and hour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.expressions import archive_path
from tidemark.operators.search import Search, predicate
from tidemark.schema import CHANGELOG

PARTITIONS = ("server_id", "event_date", "event_hour")


def read_archive(spark: SparkSession, root: str, s: Search | None = None, loose: list[str] | None = None) -> DataFrame:
    """The archive under root; columns that old files lack are null. A search restricts the partitions too. loose: files
    outside the layout, which are read in any case."""
    schema = T.StructType([*CHANGELOG.fields, *T.StructType.fromDDL("server_id string, event_date date, event_hour int").fields])
    out = spark.read.schema(schema).option("basePath", root).parquet(root)
    if s is not None:
        out = out.filter(predicate(s, out.columns))
    if loose:
        own = spark.read.schema(CHANGELOG).parquet(*loose)
        out = out.unionByName(own if s is None else own.filter(predicate(s, own.columns)), allowMissingColumns=True)
    return out


def columns(log: DataFrame) -> list[Column]:
    """The columns of an archive; what a log lacks is null."""
    return [F.col(f.name).cast(f.dataType) if f.name in log.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in CHANGELOG.fields]


def write_archive(log: DataFrame, root: str, server_id: str | None = None, codec: str = "zstd", rows_per_file: int = 0, by_key: bool = False, group_bytes: int = 8 << 20, once: bool = False) -> None:
    """Hours of a log as partitions, each file in order of event_id; hours that are there already are replaced. An hour
    is spread over tasks by its rows, so a hot hour is many files. With by_key files are in order of the row's key instead, in
    small row groups with bloom filters of keys, so that a search for a few keys skips nearly all of an hour. once: of events
    of an hour with one id one stays; they meet in the exchange that spreads the hour."""
    own = log if server_id is None else log.withColumn("server_id", F.lit(server_id))
    own = own.withColumns({"event_date": F.to_date("event_timestamp"), "event_hour": F.hour("event_timestamp")})
    order = ["pk_values", "event_id"] if by_key else ["event_id"]
    spread = own.select(*columns(own), *PARTITIONS).repartitionByRange(*PARTITIONS, *order)
    spread = (spread.dropDuplicates([*PARTITIONS, *order]) if once else spread).sortWithinPartitions(*PARTITIONS, *order)
    writer = spread.write.partitionBy(*PARTITIONS).option("compression", codec).option("partitionOverwriteMode", "dynamic").mode("overwrite")
    if by_key:
        writer = writer.option("parquet.bloom.filter.enabled#pk_values", "true").option("parquet.block.size", str(group_bytes)).option("parquet.bloom.filter.adaptive.enabled", "true")
    (writer.option("maxRecordsPerFile", rows_per_file) if rows_per_file else writer).parquet(root)


def archive_roots(ledger: DataFrame) -> DataFrame:
    """(server_id, root): one for each server, local before remote."""
    remote = F.concat(F.lit("s3a://"), "s3_bucket", F.lit("/"), "s3_key")
    best = ledger.groupBy("server_id").agg(F.min("local_path").alias("local"), F.min(remote).alias("remote"))
    return best.select("server_id", archive_path(F.coalesce("local", "remote"))[0].alias("root")).filter("root <> ''")


def usable(spark: SparkSession, roots: list[str], strict: bool = False) -> tuple[list[str], dict[str, str]]:
    """(roots that can be read, reasons for the others). strict raises if none can."""
    good, bad = [], {}
    for root in roots:
        try:
            spark.read.parquet(root).schema  # noqa: B018
            good.append(root)
        except Exception as e:  # another source may do
            bad[root] = str(e).split("\n")[0]
    if strict and roots and not good:
        raise OSError(f"no source can be read: {bad}")
    return good, bad


def write_payload(payload: DataFrame, root: str) -> None:
    payload.write.partitionBy("server_id", "schema_table", "date").mode("append").parquet(root)


def jdbc_log(spark: SparkSession, url: str, table: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A live event table, read in ranges of event_id."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn="event_id", lowerBound=str(low), upperBound=str(high), numPartitions=str(parts), **options).load()
