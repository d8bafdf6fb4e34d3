"""Benchmark decontamination with one Aho-Corasick automaton over normalised items.

Items are cut into words; each run of 10 words of an item (or the whole of a shorter item) is a window. Words become
one character each, so that the automaton reads a document word by word, once. It holds shorter items whole, and of each
window the ANCHOR_WORDS words in a row that are rarest among the items, with all places where these stand; where a document
has them, the words around are compared with those of the item as far as they are equal, so that every window of a run of 10
or more is found, and nothing else. That takes a tenth of the nodes that whole windows need. Hit words are mapped to
character offsets of the original text.

The items travel in one broadcast up to AUTOMATON_BYTES. A larger benchmark is dealt by item into parts of that size, one
broadcast and one pass over the documents after the other: a pass writes what it finds to the shared folder and its
broadcast goes, so that neither the driver nor a worker ever holds more than one part. What was found is then joined to the
documents by id and a hash of the text.

Null or wordless texts and items have no words and hit nothing. Items with a null id contaminate but are not listed;
repeated items count once. Repeated documents get a result each. Extra columns are not returned by contamination();
drop_contaminated() returns all columns as they are.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import arrow_type, as_bytes, filter_texts, id_field, map_texts, schema_of, sliding

WINDOW_WORDS = 10
#: Words of a window that the automaton holds.
ANCHOR_WORDS = 3
#: Bytes of item text in one automaton, for each of which a Python worker needs some 20 bytes.
AUTOMATON_BYTES = 64 << 20
#: Stands between items, beyond all characters of words.
END = "\U0010ffff"
MIX = np.uint64(0x9E3779B97F4A7C15)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Lower-cases A-Z and turns every byte that is not part of a word into a space; bytes from 0x80 on are part of words.
TO_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(TO_WORDS).split() if text else []


class Windows:
    """The automaton of some items: [(item id or None, text bytes)]."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], size: int = WINDOW_WORDS):
        import ahocorasick

        self.character: dict[bytes, str] = {}
        self.size = size
        self.short: dict[str, set[str | None]] = {}
        self.ids: list[str | None] = []
        parts, starts, at = [], [], 0
        for item, text in items:
            own = "".join([self.character.setdefault(w, self.code(len(self.character))) for w in words(text)])
            if len(own) >= size:
                self.ids.append(item)
                parts.append(own)
                starts.append(at)
                at += len(own) + 1
            elif own:
                self.short.setdefault(own, set()).add(item)
        self.text = "".join([part + END for part in parts])
        self.starts = np.array(starts, np.int64)
        where, self.bounds = self.anchors(min(size, ANCHOR_WORDS))
        self.places = where
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        # A key's value is the number of its anchor, beyond them that of a short item; an anchor that is one too, its anchor's.
        self.keys = list(self.short)
        numbers = {key: len(self.bounds) - 1 + i for i, key in enumerate(self.keys)}
        self.also: dict[int, str] = {}
        width = min(size, ANCHOR_WORDS)
        for i, place in enumerate(where[self.bounds[:-1]].tolist()):
            key = self.text[place : place + width]
            if key in numbers:
                del numbers[key]
                self.also[i] = key
            self.automaton.add_word(key, i)
        for key, i in numbers.items():
            self.automaton.add_word(key, i)
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()

    def anchors(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the anchors, those of one anchor side by side, and where each anchor's begin, with the end."""
        x = np.frombuffer(self.text.encode("utf-32-le"), dtype=np.uint32)
        if not len(x):
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        gram = x[: len(x) - width + 1].astype(np.uint64)
        valid = x[: len(gram)] != ord(END)
        for i in range(1, width):
            gram = gram << np.uint64(21) | x[i : len(gram) + i].astype(np.uint64)
            valid &= x[i : len(gram) + i] != ord(END)
        _, number, count = np.unique(gram, return_inverse=True, return_counts=True)
        # The rarest first, then any order of the words alone; zero where an item ends.
        order = np.where(valid, count[number].astype(np.uint64) << np.uint64(32) | (gram * MIX) >> np.uint64(32), np.uint64(0))
        del gram
        many = self.size - width + 1
        pad = np.zeros(many - 1, np.uint64)
        best = sliding(np.concatenate([pad, sliding(order, many, np.minimum), pad]), many, np.maximum)
        at = np.flatnonzero((order > 0) & (best == order))
        at = at[np.argsort(number[at], kind="stable")]
        new = np.flatnonzero(np.concatenate([[True], np.diff(number[at]) > 0])[: len(at)])
        return at.astype(np.uint32), np.concatenate([new, [len(at)]])

    @staticmethod
    def code(i: int) -> str:
        """U+0000 stands for any word that no item has, END for the end of an item."""
        if i > 0x10F000:
            raise ValueError("too many distinct words in one automaton: lower AUTOMATON_BYTES")
        return chr(i + 1 if i + 1 < 0xD800 else i + 0x801)

    def hits(self, own: list[bytes], marks: bytearray, ids: set[str | None]) -> None:
        """Marks the words inside occurrences of windows and adds the ids of their items."""
        if self.empty or not own:
            return
        known = self.character.get
        text = "".join([known(w, "\0") for w in own])
        n = len(self.bounds) - 1
        width = min(self.size, ANCHOR_WORDS)
        until: dict[int, int] = {}
        for end, i in self.automaton.iter(text):
            key = self.also.get(i) if i < n else self.keys[i - n]
            if key is not None:
                marks[end + 1 - len(key) : end + 1] = b"\1" * len(key)
                ids |= self.short[key]
            if i < n:
                p = end + 1 - width
                for q in self.places[self.bounds[i] : self.bounds[i + 1]].tolist():
                    if until.get(q - p, -1) < p:  # not inside a run that was compared before
                        until[q - p] = self.run(text, p, q, width, marks, ids)

    def run(self, text: str, p: int, q: int, width: int, marks: bytearray, ids: set[str | None]) -> int:
        """Marks the equal words around place p of a document and place q of the items if they hold a window; their end."""
        own, a, b = self.text, p, p + width
        shift = q - p
        while a and a + shift and text[a - 1] == own[a - 1 + shift]:
            a -= 1
        last = min(len(text), len(own) - shift)
        while b < last and text[b] == own[b + shift]:
            b += 1
        if b - a >= self.size:
            marks[a:b] = b"\1" * (b - a)
            ids.add(self.ids[int(np.searchsorted(self.starts, q, side="right")) - 1])
        return b - width


def dealt(benchmark: DataFrame, item_col: str, text_col: str, limit: int) -> tuple[DataFrame, int]:
    """(part, item, text) of the items, and the number of parts, each of about limit bytes of text."""
    plain = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    n = -(-(plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // limit) or 1
    return plain.select(F.expr(f"pmod(xxhash64(item, text), {n})").alias("part"), "item", "text"), n


def broadcast(items: DataFrame, part: int):
    """A broadcast of the items of one part."""
    rows = [(r.item, r.text.encode() if r.text is not None else None) for r in items.filter(F.col("part") == part).toLocalIterator()]
    return items.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, rows))


def searcher(held, size: int) -> Callable:
    """A kernel: texts to [(words, marks, item ids)]."""

    def kernel():
        own = automaton(held, size)

        def run(texts):
            out = []
            for text in texts:
                found = words(text)
                marks, ids = bytearray(len(found)), set()
                own.hits(found, marks, ids)
                out.append((found, marks, ids))
            return out

        return run

    return kernel


_BUILT: dict[tuple, Windows] = {}


def automaton(held, size: int) -> Windows:
    """Built once for each broadcast and Python worker, which holds one at a time."""
    name, items = held.value
    if (name, size) not in _BUILT:
        _BUILT.clear()
        _BUILT[name, size] = Windows(items, size)
    return _BUILT[name, size]


def text_hash(text: Column) -> Column:
    """96 bits and the length of a text; null for null."""
    return F.when(text.isNotNull(), F.concat_ws("-", F.xxhash64(text).cast("string"), F.hash(text).cast("string"), F.octet_length(text).cast("string")))


def ranges(marks: bytearray) -> list[tuple[int, int]]:
    """Runs of hit words."""
    return [m.span() for m in re.finditer(b"\1+", marks)]


def passes(docs: DataFrame, items: DataFrame, n: int, size: int) -> DataFrame:
    """(id, hash, hits array<struct<start,end>>, items) of the documents (id, text) in which one of n parts of the items
    has windows, a row for each such part. hash: of the text, so that id and hash stand for the row."""
    schema = "id string, hash string, hits array<struct<start: int, end: int>>, items array<string>"

    def found_in(held) -> Callable:
        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            apply = searcher(held, size)()
            for batch in batches:
                marked = apply(as_bytes(batch.column(2)))
                at = [i for i, (_, marks, _) in enumerate(marked) if any(marks)]
                hits = [[{"start": a, "end": b} for a, b in ranges(marked[i][1])] for i in at]
                listed = [sorted(marked[i][2] - {None}) for i in at]
                at = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(hits, kinds[2]), pa.array(listed, kinds[3])], names=["id", "hash", "hits", "items"])

        return run

    kinds = [arrow_type(f.dataType) for f in T.StructType.fromDDL(schema).fields]
    hashed = docs.select(F.col("id").cast("string").alias("id"), text_hash(F.col("text")).alias("hash"), "text")
    out = None
    for part in range(n):
        held = broadcast(items, part)
        own = hashed.mapInArrow(found_in(held), schema).checkpoint()
        held.destroy()
        out = own if out is None else out.unionByName(own)
    return out


def spans(text: bytes | None, hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character ranges of runs of hit words in the original text."""
    if not hits:
        return []
    lower = text.decode().translate({c: c + 32 for c in range(0x41, 0x5B)})
    at = [m.span() for m in WORD.finditer(lower)]
    return [(at[a][0], at[b - 1][1]) for a, b in hits]


FOUND = "n_words long, n_hit long, items array<string>, spans array<struct<start: int, end: int>>"


def contamination(df: DataFrame, benchmark: DataFrame, size: int = WINDOW_WORDS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", limit: int = AUTOMATON_BYTES) -> DataFrame:
    """(id, n_words, n_hit, items array<string>, spans array<struct<start,end>>) per row; items are sorted."""
    items, n = dealt(benchmark, item_col, item_text_col, limit)

    def columns(texts, found):
        """found: (number of words, runs of hit words, items) of each text."""
        return [[w for w, _, _ in found], [sum(b - a for a, b in h) for _, h, _ in found], [i for _, _, i in found], [[{"start": a, "end": b} for a, b in spans(t, h)] for t, (_, h, _) in zip(texts, found, strict=True)]]

    if n == 1:
        search = searcher(broadcast(items, 0), size)

        def kernel():
            run = search()
            return lambda texts: columns(texts, [(len(w), ranges(m), sorted(i - {None})) for w, m, i in run(texts)])

        return map_texts(df, id_col, text_col, FOUND, kernel, binary=True)
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = passes(docs, items, n, size).groupBy(F.col("id").alias("key"), F.col("hash").alias("own")).agg(F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = docs.join(found, F.col("id").cast("string").eqNullSafe(F.col("key")) & (text_hash(F.col("text")) == F.col("own")), "left").select(F.col("id").alias(id_col), "text", "hits", "items")
    schema = schema_of(id_field(df, id_col), FOUND)
    kinds = [arrow_type(f.dataType) for f in schema.fields[1:]]

    def merge(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts, own = as_bytes(batch.column(1)), []
            for text, hits, listed in zip(texts, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                marks = bytearray(len(words(text)))
                for h in hits or []:
                    marks[h["start"] : h["end"]] = b"\1" * (h["end"] - h["start"])
                own.append((len(marks), ranges(marks), listed or []))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns(texts, own), kinds, strict=True))], names=schema.names)

    return joined.mapInArrow(merge, schema)


def drop_contaminated(df: DataFrame, benchmark: DataFrame, size: int = WINDOW_WORDS, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", limit: int = AUTOMATON_BYTES) -> DataFrame:
    """The rows without a hit word, all columns as they are."""
    items, n = dealt(benchmark, item_col, item_text_col, limit)
    if n == 1:
        search = searcher(broadcast(items, 0), size)

        def kernel():
            run = search()
            return lambda texts: [not any(m) for _, m, _ in run(texts)]

        return filter_texts(df, text_col, kernel, binary=True)
    text = F.col(text_col)
    found = passes(df.select(F.lit(None).cast("string").alias("id"), text.alias("text")), items, n, size).select(F.col("hash").alias("_own_hash")).distinct()
    return df.join(found, text_hash(text) == F.col("_own_hash"), "left_anti")
