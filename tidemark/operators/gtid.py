"""GTID sets as interval tables (uuid, lo, hi)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def parse_sets(df: DataFrame, column: str) -> DataFrame:
    """(uuid, lo, hi) of all sets in a text column, uuid:1-5:7,uuid2:3."""
    entry = df.select(F.explode(F.split(F.col(column), ",")).alias("e")).select(F.split(F.trim("e"), ":").alias("p")).filter(F.size("p") > 1)
    span = entry.select(F.col("p")[0].alias("uuid"), F.explode(F.slice("p", F.lit(2), F.size("p"))).alias("s")).select("uuid", F.split("s", "-").alias("b"))
    return span.select("uuid", F.col("b")[0].try_cast("bigint").alias("lo"), F.coalesce(F.get("b", F.lit(1)), F.col("b")[0]).try_cast("bigint").alias("hi"))


def intervals(log: DataFrame, column: str = "gtid", buckets: int = 1 << 20) -> DataFrame:
    """(uuid, lo, hi): maximal runs of the transaction numbers in the log. Runs are found within blocks of numbers, so
    that a server's whole history is not one window, and the blocks' few runs are then joined."""
    parts = F.split(F.col(column), ":")
    n = log.filter(F.col(column).isNotNull()).select(parts[0].alias("uuid"), parts[1].cast("bigint").alias("n")).distinct()
    block = F.floor(F.col("n") / buckets)
    runs = n.withColumn("block", block).withColumn("i", F.col("n") - F.row_number().over(W.partitionBy("uuid", "block").orderBy("n"))).groupBy("uuid", "block", "i").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    return joined(runs.select("uuid", "lo", "hi"))


def joined(spans: DataFrame, block: int = 1 << 20) -> DataFrame:
    """Overlapping and adjacent intervals united. Intervals are sorted within blocks of numbers, so that a server's history
    is not one window; what passes from block to block is one row for each: how far those before it reach, and where the
    next united interval begins. A united interval ends where all before the next one's begin reach to."""
    own, across = ["uuid", "block"], W.partitionBy("uuid").orderBy("block")
    rows = spans.select("uuid", "lo", "hi", F.floor(F.col("lo") / block).alias("block"))
    ends = rows.groupBy(*own).agg(F.max("hi").alias("most"))
    carried = ends.select(*own, F.max("most").over(across.rowsBetween(W.unboundedPreceding, -1)).alias("carried"), F.max("most").over(W.partitionBy("uuid")).alias("most"))
    w = W.partitionBy(*own).orderBy("lo", "hi")
    reach = F.greatest(F.max("hi").over(w.rowsBetween(W.unboundedPreceding, -1)), F.col("carried"))
    starts = rows.join(carried, own).withColumn("reach", reach).filter(F.col("reach").isNull() | (F.col("lo") > F.col("reach") + 1))
    firsts = starts.groupBy(*own).agg(F.min(F.struct("lo", "reach")).alias("first"))
    following = firsts.select(*own, F.lead("first.reach").over(across).alias("following"))
    hi = F.coalesce(F.lead("reach").over(W.partitionBy(*own).orderBy("lo")), "following", "most")
    return starts.join(following, own).select("uuid", "lo", hi.alias("hi"))


def set_text(spans: DataFrame) -> DataFrame:
    """(uuid, gtid_set) as uuid:lo-hi:lo."""
    text = F.transform(F.sort_array(F.collect_list(F.struct("lo", "hi"))), lambda x: F.when(x["lo"] == x["hi"], x["lo"].cast("string")).otherwise(F.concat(x["lo"].cast("string"), F.lit("-"), x["hi"].cast("string"))))
    return spans.groupBy("uuid").agg(F.concat_ws(":", "uuid", F.array_join(text, ":")).alias("gtid_set"))


def not_contained(inner: DataFrame, outer: DataFrame, block: int = 1 << 20) -> DataFrame:
    """Intervals of inner that no interval of outer holds; outer is united first, so that its intervals lie apart. An
    interval of inner can only lie in the last one of outer that begins no later: they are sorted together within blocks of
    numbers, and a block starts with the last interval of those before it."""
    o = joined(outer).select("uuid", "lo", "hi", F.lit(0).alias("kind"))
    both = o.unionByName(inner.select("uuid", "lo", "hi", F.lit(1).alias("kind"))).withColumn("block", F.floor(F.col("lo") / block))
    ends = both.groupBy("uuid", "block").agg(F.max(F.when(F.col("kind") == 0, F.struct("lo", "hi"))).alias("last"))
    before = ends.select("uuid", "block", F.last("last", ignorenulls=True).over(W.partitionBy("uuid").orderBy("block").rowsBetween(W.unboundedPreceding, -1)).alias("before"))
    own = F.last(F.when(F.col("kind") == 0, F.struct("lo", "hi")), ignorenulls=True).over(W.partitionBy("uuid", "block").orderBy("lo", "kind").rowsBetween(W.unboundedPreceding, 0))
    found = both.withColumn("_own", own).join(before, ["uuid", "block"]).withColumn("_holder", F.coalesce("_own", "before"))
    return found.filter((F.col("kind") == 1) & ~F.coalesce(F.col("_holder.hi") >= F.col("hi"), F.lit(False))).select("uuid", "lo", "hi")


def sets_equal(a: DataFrame, b: DataFrame) -> bool:
    return not_contained(joined(a), b).isEmpty() and not_contained(joined(b), a).isEmpty()


def gtid_gap(purged: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """Purged intervals that a checkpoint has not seen: what the source can no longer send."""
    return not_contained(purged, checkpoint).select("uuid", "lo", "hi")


def position_gap(checkpoints: DataFrame, files: DataFrame) -> DataFrame:
    """(server_id, file, position, status, earliest_file): ok; fillable if the checkpoint's file is there but not the
    newest; unfillable if it is gone or the position lies beyond its end. files: (server_id, file, size)."""
    known = files.groupBy("server_id").agg(F.min("file").alias("earliest_file"), F.max("file").alias("latest_file"))
    out = checkpoints.join(files.select("server_id", "file", "size"), ["server_id", "file"], "left").join(known, "server_id", "left")
    status = F.when(F.col("size").isNull() | (F.col("position") > F.col("size")), "unfillable").when(F.col("file") < F.col("latest_file"), "fillable").otherwise("ok")
    return out.select("server_id", "file", "position", status.alias("status"), "earliest_file")
