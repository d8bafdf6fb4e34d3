"""Fill-in-middle transformation, with cuts located through content-defined chunks whose summaries are kept.

A polynomial hash of the last 32 bytes cuts a text's UTF-8 bytes into chunks. A Python worker keeps, by the bytes of a
chunk and so verified by them, the chunk's boundary summary: how many code points start in it, its first and last bytes as
far as a sentinel could reach over its edges, and whether a sentinel lies inside. Chunks that texts share are summed up
once; a text's length in code points, its sentinels and the places of its cuts come from combining the summaries, and
only the one or two chunks that hold a cut are looked into.

Cuts, form and order are drawn from SHA-256 of "<seed>:<id>", so a row gets the same result wherever it runs. A text that is
empty or holds a sentinel stays plain. Null text counts as empty; a null id is drawn as the empty string. Repeated rows
give repeated results; extra columns are not returned.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import as_bytes, schema_of

#: The marks of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Smallest, usual and largest chunk in bytes; the hash looks at WINDOW bytes, which lie within the chunk.
LEAST, USUAL, MOST, WINDOW = 256, 1024, 4096, 32
#: Bytes of chunks that a worker keeps; beyond it the store starts anew (speed only).
KEPT_BYTES = 32 << 20
#: Bytes that are hashed at once.
HASHED = 1 << 20
BASE = 0x9E3779B97F4A7C15
CONTINUING = bytes(range(0x80, 0xC0))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


POWER, INVERSE = powers(BASE, HASHED + WINDOW), powers(pow(BASE, -1, 1 << 64), HASHED + WINDOW)
SCATTER = np.random.default_rng(20240913).integers(0, 1 << 63, 256, dtype=np.uint64)


def candidates(data: bytes) -> list[int]:
    """Ends at which the hash of the last WINDOW bytes is below its bound. The hash of a window is a difference of two
    prefix sums of byte values times powers, brought back by the inverse power."""
    out = []
    for at in range(0, len(data), HASHED):
        start = max(0, at - WINDOW + 1)
        part = np.frombuffer(data[start : at + HASHED], dtype=np.uint8)
        if len(part) < WINDOW:
            continue
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(SCATTER[part] * POWER[: len(part)], dtype=np.uint64)])
        hashed = (sums[WINDOW:] - sums[:-WINDOW]) * INVERSE[: len(part) - WINDOW + 1]
        hashed ^= hashed >> np.uint64(29)
        hashed *= np.uint64(0xBF58476D1CE4E5B9)
        out += (np.flatnonzero(hashed < np.uint64((1 << 64) // USUAL)) + (start + WINDOW)).tolist()
    return out


def chunk_ends(data: bytes) -> list[int]:
    """Ends of the chunks; where a chunk ends depends on its own bytes alone."""
    found, out, start, n, i = candidates(data) if len(data) > LEAST else [], [], 0, len(data), 0
    while start < n:
        i = bisect_left(found, start + LEAST, i)
        start = min(found[i] if i < len(found) else n, start + MOST, n)
        out.append(start)
    return out


class Summaries:
    """Boundary summaries of chunks, kept by their bytes."""

    def __init__(self, sentinels: tuple[str, ...] = SENTINELS, kept_bytes: int = KEPT_BYTES):
        self.marks = [s.encode() for s in sentinels]
        self.reach = max(map(len, self.marks)) - 1
        self.kept: dict[bytes, tuple[int, bytes, bytes, bool]] = {}
        self.held, self.kept_bytes, self.found = 0, kept_bytes, 0

    def of(self, chunk: bytes) -> tuple[int, bytes, bytes, bool]:
        """(code points that start here, first bytes, last bytes, holds a sentinel)"""
        known = self.kept.get(chunk)
        if known is None:
            if self.held > self.kept_bytes:
                self.kept.clear()
                self.held = 0
            known = self.kept[chunk] = (len(chunk.translate(None, CONTINUING)), chunk[: self.reach], chunk[len(chunk) - self.reach :] if len(chunk) > self.reach else chunk, any(m in chunk for m in self.marks))
            self.held += len(chunk) + 200
        else:
            self.found += 1
        return known

    def marked(self, parts: list[tuple[int, bytes, bytes, bool]]) -> bool:
        """Whether a sentinel lies in a chunk or across chunks."""
        tail = b""
        for _, first, last, inside in parts:
            if inside or any(m in tail + first for m in self.marks):
                return True
            tail = (tail + last)[-self.reach :]
        return False


def place(data: bytes, ends: list[int], upto: list[int], unit: int) -> int:
    """The byte at which code point `unit` starts. upto: code points that start before the end of each chunk."""
    if not upto or unit >= upto[-1]:
        return len(data)
    k = bisect_left(upto, unit + 1)
    start, before = (ends[k - 1], upto[k - 1]) if k else (0, 0)
    own = np.frombuffer(data[start : ends[k]], dtype=np.uint8)
    return start + int(np.flatnonzero(own & 0xC0 != 0x80)[unit - before])


def drawn(key: str) -> list[int]:
    digest = hashlib.sha256(key.encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def infilled(data: bytes, key: str, own: Summaries, rate: int = 90, suffix_first: int = 20) -> tuple[int, str, int | None, int | None, bytes]:
    """(n, form, prefix_chars, middle_chars, output)"""
    ends = chunk_ends(data)
    parts = [own.of(data[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
    upto = list(accumulate(p[0] for p in parts))
    n = upto[-1] if upto else 0
    h1, h2, h3, h4 = drawn(key)
    if not n or h3 % 100 >= rate or own.marked(parts):
        return n, "plain", None, None, data
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = place(data, ends, upto, low), place(data, ends, upto, high)
    first, last, between = own.marks
    if h4 % 100 < suffix_first:
        return n, "spm", low, high - low, b"".join([last, data[b:], first, data[:a], between, data[a:b]])
    return n, "psm", low, high - low, b"".join([first, data[:a], last, data[b:], between, data[a:b]])


def transform(df: DataFrame, seed: int = 1, rate: int = 90, suffix_first: int = 20, sentinels: tuple[str, str, str] = SENTINELS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) per row. rate: percent of the texts that are transformed;
    suffix_first: percent of those whose suffix comes first (form spm, else psm)."""
    schema = schema_of(df.schema[id_col], "n long, form string, prefix_chars long, middle_chars long, output string")
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())

    def run(batches):
        own = Summaries(sentinels)
        for batch in batches:
            if batch.num_rows:
                rows = [infilled(t or b"", k, own, rate, suffix_first) for t, k in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True)]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns[:-1], columns[-1].cast(pa.string())], names=schema.names)

    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return df.select(F.col(id_col), F.col(text_col), key.alias("key")).mapInArrow(run, schema)


def restored(output: Column | str, form: Column | str, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The exact text, from output and form alone: a text that holds sentinels is never cut, so they part the output."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    parts = F.split(output, "|".join("\\Q" + s + "\\E" for s in sentinels), -1)
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)
