"""SimHash near-duplicate groups, with deletion-variant signatures as the index.

Words of a text give 3-word shingles; a 64-bit fingerprint has a bit set where over half of the shingles' hashes have.
Two fingerprints with at most 3 differing bits have, among their two 32-bit segments, one that differs in at most one
bit. So each segment is indexed once as it is and once with each bit as wildcard; an equality join of the variants finds
all candidates, and the whole fingerprints verify them in the join. In a wildcard variant one side has the bit set and
the other has it clear, hence no pair is met twice and each fingerprint sends one row a bit.

Only distinct fingerprints are joined, represented by their smallest id: copies never meet in pairs. Groups come from
alternating-star components. Null text counts as empty; a text without words has fingerprint zero, linked like any
other. Repeated rows get a result each; null ids get a component like others but never name one. Extra columns are not
returned.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import connected_components, map_texts

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
SEGMENT = 32
#: Shingles whose bits are counted at once.
COUNTED = 1 << 16
#: Most fingerprints that are broadcast as those of many rows.
HOT_PRINTS = 1024
#: Internal columns of keep_one.
OWN_ID, OWN_ROW = "__simhash_id", "__simhash_row"


def fingerprint(text: bytes | None, size: int = SHINGLE_WORDS) -> int:
    """Signed 64-bit fingerprint. bytes.lower and bytes.split know ASCII only, which is what the definition asks."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    hashed = partial(xxhash.xxh64_intdigest, seed=SEED)
    shingles = map(b" ".join, zip(*[words[i:] for i in range(size)], strict=False)) if len(words) >= size else [b" ".join(words)]
    hashes = np.fromiter(map(hashed, shingles), dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), COUNTED):
        counts += np.unpackbits(hashes[at : at + COUNTED].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) per row."""
    return map_texts(df, id_col, text_col, "fp long", lambda: lambda texts: [[fingerprint(t) for t in texts]], binary=True)


def segment(fp: Column, variant: Column) -> Column:
    return F.when(variant <= SEGMENT, fp.bitwiseAND(F.lit((1 << SEGMENT) - 1))).otherwise(F.shiftrightunsigned(fp, SEGMENT))


def variants(distinct: DataFrame) -> DataFrame:
    """(fp, rep, variant, bit, key): variant 0..32 of the low segment and 33..65 of the high one; the last of each has
    no wildcard (bit null)."""
    out = distinct.select("fp", "rep", F.explode(F.sequence(F.lit(0), F.lit(2 * SEGMENT + 1))).alias("variant"))
    place = F.col("variant") % (SEGMENT + 1)
    wild = F.expr(f"shiftleft(1L, variant % {SEGMENT + 1})")
    value = segment(F.col("fp"), F.col("variant"))
    bit = F.when(place < SEGMENT, value.bitwiseAND(wild) != 0)
    key = F.expr("shiftleft(cast(variant as bigint), 32)").bitwiseOR(value.bitwiseAND(F.bitwise_not(wild)))
    return out.select("fp", "rep", "variant", bit.alias("bit"), key.alias("key"))


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b) of representatives whose fingerprints differ in at most max_bits bits; each link once."""
    if not 0 <= max_bits <= 3:
        raise ValueError("two segments with one wildcard find up to 3 differing bits")
    index = variants(distinct)
    left = index.filter("bit IS NULL OR NOT bit").select("key", "variant", F.col("fp").alias("fp_a"), F.col("rep").alias("a"), F.col("bit").isNull().alias("exact"))
    right = index.filter("bit IS NULL OR bit").select("key", F.col("fp").alias("fp_b"), F.col("rep").alias("b"))
    differing = F.col("fp_a").bitwiseXOR(F.col("fp_b"))
    low = F.bit_count(differing.bitwiseAND(F.lit((1 << SEGMENT) - 1)))
    once = (F.col("variant") <= SEGMENT) | (low > 1)
    # Spark sizes the variants as if there were one a fingerprint: unasked, it would broadcast all of them.
    found = left.join(right.hint("merge"), (left["key"] == right["key"]) & (F.bit_count(differing) <= max_bits) & once & (~F.col("exact") | (F.col("fp_a") < F.col("fp_b"))))
    return found.select("a", "b")


def groups(df: DataFrame, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) per row."""
    own = fingerprints(df, id_col, text_col).checkpoint()
    distinct = own.groupBy("fp").agg(F.min(id_col).alias("rep"), F.count("*").alias("rows"))
    edges = links(distinct.filter(F.col("rep").isNotNull()), max_bits)
    components = connected_components(edges)
    named = distinct.join(components, distinct["rep"] == components["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"), "rows")
    # Fingerprints of many rows, at most HOT_PRINTS by their share of them, go to the rows; the rest meet in a shuffle.
    share = F.lit(-(-own.count() // HOT_PRINTS))
    hot = named.filter(F.col("rows") > share).select("fp", F.col("component_id").alias("hot_id"), F.lit(True).alias("hot"))
    marked = own.join(F.broadcast(hot), "fp", "left")
    cold = marked.filter("hot IS NULL").select(id_col, "fp").join(named.select("fp", "component_id"), "fp").select(id_col, "fp", "component_id")
    out = marked.filter("hot").select(id_col, "fp", F.col("hot_id").alias("component_id")).unionByName(cold)
    return out.withColumn("component_id", F.col("component_id").cast(df.schema[id_col].dataType))


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(df: DataFrame, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, all columns as they are, whose id names their group: one document of each group. Of rows with that id one
    stays, the least by a hash of its columns; rows with a null id stay."""
    keep = groups(df, max_bits, id_col, text_col).filter(F.col(id_col) == F.col("component_id")).select(id_col).distinct()
    named = df.filter(F.col(id_col).isNotNull()).join(keep, id_col, "left_semi").select(df.columns)
    hashed = [f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    row = F.struct(*[F.col(c) for c in df.columns])
    one = named.groupBy(F.col(id_col).alias(OWN_ID)).agg(F.min_by(row, F.xxhash64(*hashed)).alias(OWN_ROW)).select(f"{OWN_ROW}.*")
    return one.unionByName(df.filter(F.col(id_col).isNull()))
