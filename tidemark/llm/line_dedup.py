"""Line deduplication by site-relative frequency, in DataFrame functions only.

A line is boilerplate of a site if the share of the site's pages that hold it exceeds a ratio. Lines are compared
without surrounding spaces, by 128 bits of SHA-256; blank lines are never boilerplate. Each page counts a line once and
lines are pre-aggregated before they are dealt by (site, line). The boilerplate lines of a site number at most its
mean lines per page divided by the ratio, however many pages it has.

Null text stays null and null ids are kept; a null site is a site of its own. Repeated rows are pages of their own for
the shares. All columns of the input are returned, with the text cut, and a column that clashes with an internal name
is safe, as internal columns live in structs with names of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a line's key in a broadcast, and the largest broadcast.
KEY_BYTES, BROADCAST_BYTES = 32, 32 << 20
#: Prefix of internal columns.
OWN = "__line_dedup_"


def line_key(line: Column) -> Column:
    return F.unhex(F.substring(F.sha2(F.trim(line), 256), 1, 32))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def boilerplate_lines(df: DataFrame, ratio: float, min_pages: int, site: Column, text_col: str) -> DataFrame:
    """(site, line) keys of lines on more than ratio of the site's pages and on min_pages of them at least."""
    lines = F.filter(lines_of(F.col(text_col)), lambda x: F.trim(x) != "")
    pages = df.select(site.alias(OWN + "site"), F.array_distinct(F.transform(F.coalesce(lines, F.array().cast("array<string>")), line_key)).alias(OWN + "keys"))
    totals = pages.groupBy(OWN + "site").agg(F.count("*").alias(OWN + "total"))
    counts = pages.select(OWN + "site", F.explode(OWN + "keys").alias(OWN + "key")).groupBy(OWN + "site", OWN + "key").agg(F.count("*").alias(OWN + "pages")).filter(F.col(OWN + "pages") >= min_pages)
    joined = counts.alias("c").join(totals.alias("t"), F.col("c." + OWN + "site").eqNullSafe(F.col("t." + OWN + "site")))
    return joined.filter(F.col(OWN + "pages") > ratio * F.col(OWN + "total")).select(F.col("c." + OWN + "site").alias(OWN + "site"), OWN + "key")


def drop_boilerplate(df: DataFrame, ratio: float = 0.1, min_pages: int = 3, site_col: str = "source", text_col: str = "text", counts: bool = False) -> DataFrame:
    """The rows with boilerplate lines cut from the text, all columns as they are; with counts also n_lines and
    n_dropped. A text all of whose lines go becomes empty; the row stays."""
    site = F.col(site_col).cast("string")
    drop = boilerplate_lines(df, ratio, min_pages, site, text_col)
    drop = drop.groupBy(OWN + "site").agg(F.collect_set(OWN + "key").alias(OWN + "drop")).checkpoint()
    # The pages need not move if the boilerplate of all sites is small; else they are joined by site, hot ones split.
    held = drop.agg(F.coalesce(F.sum(F.size(OWN + "drop") + 4), F.lit(0))).first()[0] * KEY_BYTES
    drop = F.broadcast(drop) if held <= BROADCAST_BYTES else drop
    joined = df.withColumn(OWN + "own", site).join(drop, F.col(OWN + "own").eqNullSafe(F.col(OWN + "site")), "left")
    gone = F.coalesce(F.col(OWN + "drop"), F.array().cast("array<binary>"))
    kept = F.filter(lines_of(F.col(text_col)), lambda x: ~F.array_contains(gone, line_key(x)))
    out = joined.withColumn(OWN + "kept", kept)
    before, after = F.size(lines_of(F.col(text_col))), F.size(OWN + "kept")
    extra = [F.coalesce(F.when(F.col(text_col).isNotNull(), before), F.lit(0)).alias("n_lines"), F.coalesce(F.when(F.col(text_col).isNotNull(), before - after), F.lit(0)).alias("n_dropped")] if counts else []
    columns = [F.array_join(OWN + "kept", "\n").alias(c) if c == text_col else F.col(c) for c in df.columns if not (counts and c in ("n_lines", "n_dropped"))]
    return out.select(*columns, *extra)
