"""Document fingerprints by content-defined chunking.

A gear hash of the last 32 bytes cuts a text's UTF-8 bytes where its top bits are zero. Chunk sizes are normalised: up to
the normal size a cut needs more zero bits, beyond it fewer. A fingerprint is the set of the chunks' digests with their
lengths; the likeness of one to another is the share of its length that the other has too. Text that is moved or shifted
keeps its chunks.

Null text counts as empty; an empty text has an empty fingerprint, like itself alone. Rows with one id stand beside each
other in the order of ids, by text; null ids come first. Extra columns are not returned.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_texts, schema_of

LEAST, NORMAL, MOST = 32, 64, 256
#: Zero bits of a cut before and after the normal size.
STRICT_BITS, LOOSE_BITS = 7, 4
GEAR = np.random.default_rng(20240601).integers(0, 1 << 32, 256, dtype=np.uint32)
#: Bytes that are hashed at once; the hash looks back 31 bytes.
HASHED = 4 << 20


def candidates(data: bytes) -> tuple[list[int], list[int]]:
    """Ends of possible chunks under the strict and the loose rule."""
    strict, loose = [], []
    for at in range(0, len(data), HASHED):
        back = min(at, 31)
        h = GEAR[np.frombuffer(data[at - back : at + HASHED], dtype=np.uint8)]
        for width in (1, 2, 4, 8, 16):
            h[width:] += h[:-width] << np.uint32(width)
        h = h[back:]
        found = np.flatnonzero(h < np.uint32(1 << (32 - LOOSE_BITS)))
        loose += (found + at + 1).tolist()
        strict += (found[h[found] < np.uint32(1 << (32 - STRICT_BITS))] + at + 1).tolist()
    return strict, loose


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks."""
    strict, loose = candidates(data)
    out, start, n, i, j = [], 0, len(data), 0, 0
    while start < n:
        i = bisect_left(strict, start + LEAST, i)
        if i < len(strict) and strict[i] <= start + NORMAL:
            end = strict[i]
        else:
            j = bisect_left(loose, start + NORMAL, j)
            end = min(loose[j] if j < len(loose) else n, start + MOST, n)
        out.append(end)
        start = end
    return out


def chunks(text: str) -> dict[int, int]:
    """Digest to length of the chunk."""
    data, start, out = text.encode(), 0, {}
    for end in cuts(data):
        out[xxhash.xxh64_intdigest(data[start:end])] = end - start
        start = end
    return out


def written(own: dict[int, int]) -> str:
    return ",".join([f"{d:016x}:{n}" for d, n in sorted(own.items())])


def likeness(own: dict[int, int], other: dict[int, int]) -> float:
    if not own or not other:
        return float(not own and not other)
    return sum(n for d, n in own.items() if d in other) / sum(own.values())


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, n_chunks) per row."""

    def kernel():
        def run(texts):
            found = [chunks(t or "") for t in texts]
            return [[written(f) for f in found], [len(f) for f in found]]

        return run

    return map_texts(df, id_col, text_col, "fingerprint string, n_chunks int", kernel)


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def neighbours(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per row, where a document
    is edited with the next one's start, in ascending order of id, the first following the last.

    The ids are cut into ranges at quantiles; the first row of each range also goes, as a guard, to the range before it,
    so that each range has all it needs and the texts move once."""
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 62)))
    bounds = sorted(set(df.agg(F.percentile_approx(key, [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0] or [])) if n > 1 else []
    place = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x <= F.col("key"))) if bounds else F.lit(0)
    dealt = df.select(F.col(id_col).alias("id"), key.alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("place", place)
    firsts = dict(sorted((r.place, r.first) for r in dealt.groupBy("place").agg(F.min("key").alias("first")).collect()))
    # By place: the range's first key, and the range before it (the last one before the first), where the guard goes.
    before = dict(zip(firsts, [*list(firsts)[-1:], *list(firsts)[:-1]], strict=True))
    of = lambda known, kind: F.get(F.array(*[F.lit(known.get(i)).cast(kind) for i in range(len(bounds) + 1)]), F.col("place"))
    guard = F.when(F.col("key") == of(firsts, "long"), F.struct(of(before, "int").alias("place"), F.lit(True).alias("guard")))
    sent = dealt.select("id", "key", "text", F.explode(F.array_compact(F.array(F.struct(F.col("place").cast("int").alias("place"), F.lit(False).alias("guard")), guard))).alias("to")).select("id", "key", "text", "to.place", "to.guard")
    ordered = sent.repartitionById(len(bounds) + 1, F.col("place")).sortWithinPartitions("place", "guard", "key", "text")
    schema = schema_of(df.schema[id_col], "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")

    def run(batches):
        held = None  # (id, text, chunks) whose next document is to come
        place = None
        rows: list[tuple] = []

        def finish(text, own):
            if held is None:
                return
            changed = edited(held[1], text)
            other = chunks(changed)
            rows.append((held[0], len(held[1]), hashlib.sha256(changed.encode()).hexdigest(), written(held[2]), written(other), likeness(held[2], other), likeness(held[2], own)))

        for batch in batches:
            for key, text, at, guard in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if at != place:
                    held, place = None, at
                if guard and held is None:
                    continue
                own = chunks(text)
                finish(text, own)
                held = None if guard else (key, text, own)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()], strict=True)], names=schema.names)
                rows.clear()

    return ordered.mapInArrow(run, schema)
