"""Exact substring deduplication by a distributed merge sort of suffixes that knows common prefixes.

A byte goes if a string of WIDTH bytes over it also starts in a document with a smaller id. The documents are dealt into
chunks by a hash of their id. Suffixes are sorted not at every byte but at anchors: the smallest of the k-mer hashes
inside a window of WIDTH bytes is an anchor, equal windows have equal anchors at equal places, and so every window is
decided at its own anchor. The steps:

1. Each chunk sends its distinct anchor hashes, sorted, to the hash's bucket.
2. A bucket names those that stand in two documents or more; only they can be anchors of a repeated window.
3. A chunk sorts the suffixes at its named anchors (the bytes from the anchor on, then the bytes before it, backwards),
   keeps each distinct one with its smallest document, and sends each bucket a front-coded run: for each suffix the
   length of the prefix that it shares with the one before it, and the rest.
4. A bucket combines the runs with a loser tree that compares suffixes only beyond prefixes known to be common. The
   common prefix lengths that come out decide every window exactly, and the bytes to remove go back to their chunk.
5. A chunk cuts the bytes out.

An anchor that stands in over HOT_DOCUMENTS documents, such as one at the rim of a passage that a third of all documents
hold, is sent window by window, dealt by the windows' own bytes, so that no bucket gathers it. The chunks' texts are
compressed row by row and shuffled once; steps 1, 3 and 5 read the same exchange. The number of chunks follows the bytes of text, so a task holds
about CHUNK_BYTES and what one document has beyond. Nothing but that number passes through the driver.

Between chunks and buckets blobs travel, compressed by planes of bytes: sorted numbers go as their steps, and of a key only
the bytes within its windows' reach. Their number, that of the chunks times that of the buckets, follows the bytes of text
and not the partitions, so that they don't become too short to compress.

Null text counts as empty. Rows with the same id never remove from each other; a null id neither loses bytes nor costs
others any. Repeated rows get a result each; extra columns are not returned.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import as_bytes, schema_of, sliding

WIDTH = 50
KMER = 20
WINDOWS = WIDTH - KMER + 1  # k-mers in a window; also the places an anchor can have in one
KEY = WIDTH + KMER + WINDOWS - 1 - KMER + 2  # right context, left context, first and last place
HOT_DOCUMENTS = 1000
#: Most bytes of text in a chunk, on average; there is a bucket for SPREAD chunks. Less text has a bucket for each shuffle
#: partition, LEAST_BUCKETS at most.
CHUNK_BYTES, SPREAD, LEAST_BUCKETS = 8 << 20, 4, 64
#: Levels of zstd: of texts and blobs, and of runs, which are most of what is sent.
LEVEL, RUN_LEVEL = 1, 6

_RANDOM = np.random.default_rng(50)
_BYTE = _RANDOM.integers(1, 1 << 32, 256, dtype=np.uint32)
_ORDER = np.uint32(0x9E3779B1)
_PLACES = _RANDOM.integers(0, 1 << 62, KEY, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Chunk:
    """The documents of a chunk, in order of id and text, as one buffer; those without an id come last. Text is a string, or
    squeezed bytes."""

    def __init__(self, table: pa.Table):
        ids, text = table.column("id").to_pylist(), table.column("text")
        texts = [unzstd(t) for t in text.to_pylist()] if pa.types.is_binary(text.type) else as_bytes(text)
        rows = sorted(zip(ids, texts, strict=True), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        self.ids = [i for i, _ in rows]
        self.texts = [t for _, t in rows]
        self.buffer = np.frombuffer(b"".join(self.texts), dtype=np.uint8)
        self.ends = np.cumsum([len(t) for t in self.texts], dtype=np.int64) if rows else np.zeros(0, np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64) if rows else np.zeros(0, np.int64)
        self.known = sum(i is not None for i in self.ids)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, 64-bit hash, document) of the anchors, and keeps the windows' smallest hashes."""
        none = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        n = int(self.ends[self.known - 1]) if self.known else 0
        if n < WIDTH:
            return none
        h = hashes(self.buffer[:n])
        low = sliding(h, WINDOWS, np.minimum)
        inside = np.zeros(len(low), dtype=bool)
        for a, b in zip(self.starts[: self.known].tolist(), self.ends[: self.known].tolist(), strict=True):
            if b - a >= WIDTH:
                inside[a : b - WIDTH + 1] = True
        low[~inside] = 0
        pad = np.zeros(WINDOWS - 1, np.uint32)
        self.low = np.concatenate([pad, low, pad])  # low of the window that starts at i is self.low[i + WINDOWS - 1]
        self.order = h
        at = np.flatnonzero(sliding(self.low, WINDOWS, np.maximum) == h)
        if not len(at):
            return none
        mers = self.buffer[at[:, None] + np.arange(KMER)]
        return at, mixed(mers, KMER), np.searchsorted(self.ends, at, side="right")

    def places(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last place r that an anchor has in the windows it is the anchor of; they lie side by side."""
        own = self.low[at[:, None] + (WINDOWS - 1) - np.arange(WINDOWS)] == self.order[at][:, None]
        return own.argmax(axis=1), WINDOWS - 1 - own[:, ::-1].argmax(axis=1)

    def contexts(self, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Keys: WIDTH bytes from the anchor on, WINDOWS - 1 before it backwards, as far as its windows reach and zero
        beyond, then the places."""
        keys = np.zeros((len(at), KEY), dtype=np.uint8)
        top = len(self.buffer) - 1
        right, left = np.arange(WIDTH), np.arange(WINDOWS - 1)
        keys[:, :WIDTH] = self.buffer[np.minimum(at[:, None] + right, top)] * (right < (WIDTH - first)[:, None])
        keys[:, WIDTH : WIDTH + WINDOWS - 1] = self.buffer[np.maximum(at[:, None] - 1 - left, 0)] * (left < last[:, None])
        keys[:, -2], keys[:, -1] = first + 1, last + 1
        return keys


def hashes(data: np.ndarray) -> np.ndarray:
    """A 32-bit hash, never zero, of each k-mer, by doubling."""
    h = {1: _BYTE[data]}
    w = 1
    while 2 * w <= KMER:
        h[2 * w] = h[w][: len(h[w]) - w] * np.uint32(pow(int(_ORDER), w, 1 << 32)) + h[w][w:]
        w *= 2
    out, have = h[w], w
    while have < KMER:
        w = max(v for v in h if v <= KMER - have)
        n = len(data) - have - w + 1
        out = out[:n] * np.uint32(pow(int(_ORDER), w, 1 << 32)) + h[w][have : have + n]
        have += w
    out ^= out >> np.uint32(16)
    out *= np.uint32(0x85EBCA6B)
    out ^= out >> np.uint32(13)
    return np.maximum(out, np.uint32(1))


def mixed(rows: np.ndarray, width: int) -> np.ndarray:
    h = np.zeros(len(rows), np.uint64)
    for j in range(width):
        h += (rows[:, j].astype(np.uint64) + np.uint64(1)) * _PLACES[j]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def short(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, 32 further bits) of a hash."""
    return ((h & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int64), (h >> np.uint64(32)).astype(np.uint32)


def zstd(data: bytes, level: int = LEVEL) -> bytes:
    """Compressed, behind four bytes that tell the size; UNPACKED instead, if that is shorter."""
    out = pa.Codec("zstd", compression_level=level).compress(data, asbytes=True)
    return len(data).to_bytes(4, "little") + out if len(out) < len(data) else UNPACKED + data


UNPACKED = b"\xff" * 4


def unzstd(data: bytes) -> bytes:
    return data[4:] if data[:4] == UNPACKED else pa.decompress(data[4:], decompressed_size=int.from_bytes(data[:4], "little"), codec="zstd", asbytes=True)


def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, chunk) with the text's bytes compressed."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([zstd(t) for t in as_bytes(batch.column(1))], pa.binary()), batch.column(2)], names=["id", "text", "chunk"])


def pack(*arrays: np.ndarray, level: int = LEVEL) -> bytes:
    """The arrays in one blob: all first bytes of an array's numbers, then all second ones."""
    head = np.array([len(a) * a.itemsize for a in arrays], dtype="<u4").tobytes()
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays]
    return zstd(head + b"".join(planes), level)


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    data = unzstd(blob)
    at, out = 4 * len(kinds), []
    for size, kind in zip(np.frombuffer(data[:at], dtype="<u4").tolist(), kinds, strict=True):
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(data[at : at + size], dtype=np.uint8).reshape(width, size // width).T).view(kind).ravel())
        at += size
    return out


def steps(ascending: np.ndarray) -> np.ndarray:
    """Ascending numbers of 32 bits as their differences; np.cumsum gives them back."""
    return np.diff(ascending, prepend=ascending.dtype.type(0)).astype("<u4")


def by_bucket(bucket: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(bucket, indices in their order) of each bucket that occurs."""
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    return [(int(bucket[part[0]]), part) for part in np.split(order, edges[1:]) if len(part)]


def table_of(rows: list[tuple], names: list[str]) -> pa.Table:
    kinds = {"blob": pa.binary()}
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.table({n: pa.array(c, kinds.get(n, pa.int64())) for n, c in zip(names, columns, strict=True)})


def send_anchors(buckets: int):
    """Step 1: (bucket, chunk, blob of sorted hashes and the number of documents of each)."""

    def run(table: pa.Table) -> pa.Table:
        at, h, docs = Chunk(table).anchors()
        bucket, value = short(h, buckets)
        rows = []
        if len(at):
            key = np.unique((bucket.astype(np.uint64) << np.uint64(32)) | value, return_inverse=True)
            distinct = np.unique(key[1].astype(np.int64) * (int(docs[-1]) + 1) + docs) // (int(docs[-1]) + 1)
            many = np.minimum(np.bincount(distinct, minlength=len(key[0])), 255).astype(np.uint8)
            for b, part in by_bucket((key[0] >> np.uint64(32)).astype(np.int64)):
                rows.append((b, table.column("chunk")[0].as_py(), pack(steps(key[0][part].astype("<u4")), many[part])))
        return table_of(rows, ["bucket", "chunk", "blob"])

    return run


def name_repeated(table: pa.Table) -> pa.Table:
    """Step 2: (chunk, bucket, blob of bits: which of the chunk's hashes stand in two documents or more, and which of these
    in many)."""
    got = [(np.cumsum(v, dtype=np.uint32), m) for v, m in (unpack(b, "<u4", "u1") for b in table.column("blob").to_pylist())]
    values, at = np.unique(np.concatenate([v for v, _ in got]), return_inverse=True)
    docs = np.bincount(at, weights=np.concatenate([m for _, m in got]))
    rows, bucket, start = [], table.column("bucket")[0].as_py(), 0
    for chunk, (v, _) in zip(table.column("chunk").to_pylist(), got, strict=True):
        n = docs[at[start : start + len(v)]]
        start += len(v)
        if (n > 1).any():
            rows.append((chunk, bucket, pack(np.packbits(n > 1), np.packbits(n[n > 1] > HOT_DOCUMENTS))))
    return table_of(rows, ["chunk", "bucket", "blob"])


def distinct_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stable order of the keys, and which of the ordered are the first of their kind."""
    order = np.argsort(np.ascontiguousarray(keys).view(f"S{KEY}").ravel(), kind="stable")
    own = keys[order]
    return order, np.concatenate([[True], (own[1:] != own[:-1]).any(axis=1)])


def front_code(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys as the lengths of the prefix shared with the one before, and the rests."""
    differs = keys[1:] != keys[:-1]
    shared = np.concatenate([[0], np.where(differs.any(axis=1), differs.argmax(axis=1), KEY)]).astype(np.uint8)
    return shared, keys[np.arange(KEY) >= shared[:, None]]


def within(places: np.ndarray) -> np.ndarray:
    """Which bytes of keys with these places lie within their windows' reach."""
    byte = np.arange(WIDTH + WINDOWS - 1)
    first, last = places[:, :1].astype(np.int64) - 1, places[:, 1:].astype(np.int64) - 1
    return np.where(byte < WIDTH, byte < WIDTH - first, byte < WIDTH + last)


def run_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shared lengths, places, rests): sorted keys front-coded, the rests without what the places tell."""
    shared = front_code(keys)[0]
    sent = within(keys[:, -2:]) & (np.arange(KEY - 2) >= shared[:, None])
    return shared, np.ascontiguousarray(keys[:, -2:].T).ravel(), keys[:, :-2][sent]


def rests(shared: np.ndarray, places: np.ndarray, sent: np.ndarray) -> np.ndarray:
    """The rests of front_code, of what run_of gives."""
    keys = np.zeros((len(shared), KEY), dtype=np.uint8)
    keys[:, -2:] = places.reshape(2, len(shared)).T
    wide = np.arange(KEY) >= shared[:, None]
    keys[:, :-2][within(keys[:, -2:]) & wide[:, :-2]] = sent
    return keys[wide]


def spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint ascending ranges as the steps of their starts, and their lengths."""
    return steps(starts), (ends - starts).astype("<u4")


def unspanned(begun: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.cumsum(begun, dtype=np.uint32)
    return starts, starts + long


def send_runs(buckets: int):
    """Step 3: (bucket, chunk, blob of a front-coded run: shared lengths, places, rests, documents, positions; and bytes of the
    chunk itself that are known to go, as spans)."""

    def run(docs: pa.Table, named: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if not (docs.num_rows and named.num_rows):
            return table_of(rows, ["bucket", "chunk", "blob"])
        own, number = Chunk(docs), docs.column("chunk")[0].as_py()
        at, h, doc = own.anchors()
        bucket, value = short(h, buckets)
        key = (bucket.astype(np.uint64) << np.uint64(32)) | value
        distinct = np.unique(key)
        edges = np.searchsorted(distinct, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))
        known, hot = [], []
        for b, blob in sorted(zip(named.column("bucket").to_pylist(), named.column("blob").to_pylist(), strict=True)):
            bits, m = unpack(blob, "u1", "u1")
            known.append(distinct[edges[b] : edges[b + 1]][np.unpackbits(bits, count=int(edges[b + 1] - edges[b])).astype(bool)])
            hot.append(np.unpackbits(m, count=len(known[-1])).astype(bool))
        known, hot = np.concatenate(known), np.concatenate(hot)
        place = np.minimum(np.searchsorted(known, key), len(known) - 1)
        is_named = known[place] == key
        at, bucket, doc, hot = at[is_named], bucket[is_named], doc[is_named], hot[place[is_named]]
        if not len(at):
            return table_of(rows, ["bucket", "chunk", "blob"])
        first, last = own.places(at)
        ids = np.array(own.ids[: own.known], dtype=np.int64)[doc]
        if hot.any():
            many = np.where(hot, last - first + 1, 1)
            back = np.repeat(np.arange(len(at)), many)
            step = np.arange(len(back)) - np.repeat(np.cumsum(many) - many, many)
            at, bucket, ids, hot, first, last = at[back], bucket[back], ids[back], hot[back], first[back] + step, np.where(hot[back], first[back] + step, last[back])
        keys = own.contexts(at, first, last)
        if hot.any():
            bucket[hot] = short(mixed(keys[hot], KEY), buckets)[0]
        order, new = distinct_keys(keys)
        least = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        gone = ids[order] > ids[order[least]]
        g = order[gone]
        local = merged(at[g] - last[g], at[g] - first[g] + WIDTH)
        order = order[new | (ids[order] == ids[order[least]])]  # every place of the smallest document waits for an answer
        for b, part in by_bucket(bucket[order]):
            part = order[part]
            rows.append((b, number, pack(*run_of(keys[part]), ids[part].astype("<i8"), at[part].astype("<u4"), *(x[:0] for x in local), level=RUN_LEVEL)))
        if len(local[0]):
            none = np.zeros(0, np.uint8)
            rows.append((number % buckets, number, pack(none, none, none, none.astype("<i8"), none.astype("<u4"), *spans(*local))))
        return table_of(rows, ["bucket", "chunk", "blob"])

    return run


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges united, as unsigned 32-bit starts and ends."""
    if not len(starts):
        return np.zeros(0, "<u4"), np.zeros(0, "<u4")
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    return starts[new].astype("<u4"), reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(starts) - 1]])].astype("<u4")


class Run:
    """A front-coded run that is read from the front."""

    __slots__ = ("at", "index", "key", "n", "number", "rest", "shared")

    def __init__(self, number: int, shared: np.ndarray, rest: np.ndarray):
        self.number, self.shared, self.rest = number, shared.tolist(), rest.tobytes()
        self.n, self.at, self.index, self.key = len(self.shared), 0, -1, b""

    def next(self) -> int:
        """Moves on; the length shared with the key before, or -1 at the end."""
        self.index += 1
        if self.index == self.n:
            return -1
        shared = self.shared[self.index]
        end = self.at + KEY - shared
        self.key = self.key[:shared] + self.rest[self.at : end]
        self.at = end
        return shared


def loser_tree(runs: list[Run]):
    """(run, index, key, length shared with the key before) in sorted order. A candidate that shares more with the last
    winner is smaller; only candidates that share equally much are compared, from there on."""
    k = len(runs)
    shared = [0] * k
    alive = [r.next() >= 0 for r in runs]

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's shared length becomes that with the winner."""
        if not alive[b]:
            return a, b
        if not alive[a]:
            return b, a
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        known = shared[a]
        x, y = int.from_bytes(runs[a].key[known:], "big"), int.from_bytes(runs[b].key[known:], "big")
        w, loser = (a, b) if x < y or x == y and a < b else (b, a)
        shared[loser] = KEY - ((x ^ y).bit_length() + 7) // 8
        return w, loser

    size = 1
    while size < k:
        size *= 2
    losers = [-1] * size
    level = [i if i < k else -1 for i in range(size)]
    base = size
    while base > 1:
        up = []
        for i in range(0, base, 2):
            a, b = level[i], level[i + 1]
            w, loser = (a, b) if b < 0 else play(a, b)
            losers[(base + i) // 2] = loser
            up.append(w)
        level, base = up, base // 2
    w = level[0]
    while alive[w]:
        run = runs[w]
        yield run.number, run.index, run.key, shared[w]
        s = run.next()
        if s < 0:
            alive[w] = False
        else:
            shared[w] = s
        node = (size + w) // 2
        while node:
            other = losers[node]
            if other >= 0:
                w, losers[node] = play(w, other)
            node //= 2


def combine(table: pa.Table) -> pa.Table:
    """Step 4: (chunk, blob of spans of bytes to remove)."""
    chunks, runs, docs, spots, rows = table.column("chunk").to_pylist(), [], [], [], []
    for number, blob in enumerate(table.column("blob").to_pylist()):
        shared, places, sent, ids, at, begun, long = unpack(blob, "u1", "u1", "u1", "<i8", "<u4", "<u4", "<u4")
        if len(begun):
            rows.append((chunks[number], pack(begun, long)))
        docs.append(ids)
        spots.append(at)
        if len(shared):
            runs.append(Run(number, shared, rests(shared, places, sent)))
    if runs:
        keys, common, of, index = bytearray(), bytearray(), array("q"), array("q")
        for n, i, key, shared in loser_tree(runs):
            keys += key
            common.append(shared)
            of.append(n)
            index.append(i)
        number = np.frombuffer(of, dtype=np.int64)
        offset = np.cumsum([0, *map(len, docs)])
        flat = offset[number] + np.frombuffer(index, dtype=np.int64)
        starts, ends, entry = decide(np.frombuffer(keys, dtype=np.uint8).reshape(len(number), KEY), np.frombuffer(common, dtype=np.uint8), np.concatenate(docs)[flat], np.concatenate(spots)[flat].astype(np.int64))
        for chunk, part in by_bucket(np.array(chunks)[number[entry]]) if len(entry) else []:
            rows.append((chunk, pack(*spans(*merged(starts[part], ends[part])))))
    return table_of(rows, ["chunk", "blob"])


def decide(keys: np.ndarray, shared: np.ndarray, docs: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, entry) of bytes to remove: at place r, two entries hold the same window if they share WIDTH - r bytes
    from the anchor on and r bytes before it."""
    first, last = keys[:, -2].astype(np.int64) - 1, keys[:, -1].astype(np.int64) - 1
    left = np.ascontiguousarray(keys[:, WIDTH : WIDTH + WINDOWS - 1])
    order = np.argsort(left.view(f"S{WINDOWS - 1}").ravel(), kind="stable")
    differs = left[order][1:] != left[order][:-1]
    before = np.concatenate([[0], np.where(differs.any(axis=1), differs.argmax(axis=1), WINDOWS - 1)])
    repeated = np.zeros((len(keys), WINDOWS + 2), dtype=np.int8)
    rank = np.empty(len(keys), np.int64)
    for r in range(WINDOWS):
        own = np.flatnonzero((first <= r) & (r <= last))
        if not len(own):
            continue
        rank[order] = np.cumsum(before < r) if r else 0
        group = np.cumsum(shared < WIDTH - r)[own] * len(keys) + rank[own]
        by = np.argsort(group, kind="stable")
        edges = np.flatnonzero(np.diff(group[by], prepend=-1))
        least = np.minimum.reduceat(docs[own][by], edges)
        sizes = np.diff(edges, append=len(by))
        repeated[own[by], r + 1] = docs[own][by] > np.repeat(least, sizes)
    change = np.diff(repeated, axis=1)
    entry, low = np.nonzero(change == 1)
    _, high = np.nonzero(change == -1)
    return at[entry] - (high - 1), at[entry] - low + WIDTH, entry


def cut_out(docs: pa.Table, gone: pa.Table) -> pa.Table:
    """Step 5: (id, text, spans) of the chunk's documents."""
    own = Chunk(docs)
    change = np.zeros(len(own.buffer) + 1, dtype=np.int32)
    for blob in gone.column("blob").to_pylist():
        starts, ends = unspanned(*unpack(blob, "<u4", "<u4"))
        np.add.at(change, starts, 1)
        np.add.at(change, ends, -1)
    covered = np.cumsum(change[:-1]) > 0
    kept, starts, ends = [], [], []
    for a, b in zip(own.starts.tolist(), own.ends.tolist(), strict=True):
        part = covered[a:b]
        if part.any():
            edges = np.flatnonzero(np.diff(part.astype(np.int8), prepend=0, append=0))
            kept.append(own.buffer[a:b][~part].tobytes())
            starts.append(edges[::2].tolist())
            ends.append(edges[1::2].tolist())
        else:
            kept.append(own.buffer[a:b].tobytes())
            starts.append([])
            ends.append([])
    return pa.table({"id": pa.array(own.ids, pa.int64()), "n_bytes": pa.array([len(t) for t in own.texts], pa.int64()), "kept": pa.array(kept, pa.binary()), "starts": pa.array(starts, pa.list_(pa.int32())), "ends": pa.array(ends, pa.list_(pa.int32()))})


def dedup_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, kept binary, starts, ends array<int>) per row: the bytes that stay, and the maximal removed runs as
    byte ranges of the input. Ids are integers."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(1, min(LEAST_BUCKETS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), -(-size // (SPREAD * CHUNK_BYTES)))
    docs = docs.withColumn("chunk", F.pmod(F.xxhash64("id", F.when(F.col("id").isNull(), F.col("text"))), F.lit(SPREAD * n)).cast("long")).mapInArrow(squeeze, "id long, text binary, chunk long")
    anchors = docs.groupBy("chunk").applyInArrow(send_anchors(n), "bucket long, chunk long, blob binary")
    named = anchors.groupBy("bucket").applyInArrow(name_repeated, "chunk long, bucket long, blob binary")
    runs = docs.groupBy("chunk").cogroup(named.groupBy("chunk")).applyInArrow(send_runs(n), "bucket long, chunk long, blob binary")
    gone = runs.groupBy("bucket").applyInArrow(combine, "chunk long, blob binary")
    out = docs.groupBy("chunk").cogroup(gone.groupBy("chunk")).applyInArrow(cut_out, "id long, n_bytes long, kept binary, starts array<int>, ends array<int>")
    return out.select(F.col("id").cast(df.schema[id_col].dataType).alias(id_col), "n_bytes", "kept", "starts", "ends")
