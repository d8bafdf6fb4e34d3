"""Token counts of documents without their ids: each distinct pre-token is counted once and joined to the
pre-token frequencies of the documents.

A task turns a block of documents into one row per distinct pre-token with the documents that hold it and how often.
A hot pre-token so has one row per block, not one per document. Rows are dealt and sorted by pre-token; each distinct
pre-token is counted by the library once and joined to its rows, and frequency times count is summed per document.
Rows of a pre-token that many documents of a block hold are dealt over all partitions, each of which counts it.

Each row of the input gives one row. Null text counts as empty: no tokens. Sums are kept by id; rows with the same id and
different texts, null ids among them, are told apart by a hash of the text and summed in a pass of their own. Ids are
integers, or text that can be cast to one. Extra columns are not returned.
"""

from __future__ import annotations

import json
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe import byte_characters

#: Bytes of text that a task turns into one block of frequencies.
BLOCK_BYTES = 32 << 20
#: Postings that a task sums up before it hands the sums on.
HELD_SUMS = 2_000_000
#: Ids whose sums travel in one row.
BLOCK_IDS = 1 << 12
#: Below this code point, letter and digit classes are alike in all Unicode versions and all text is in NFC.
PLAIN_BELOW = 0x0250
#: A pre-token that so many documents of a block hold may be hot: its rows are dealt over all partitions.
HOT_DOCUMENTS = 64
#: Ids with different texts that are broadcast, 8 bytes each.
BROADCAST_IDS = 1 << 20


class PreTokens:
    """The library's pre-tokens of a text, in their own characters; special tokens stay whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        described = json.loads(self.library.to_str())
        self.special = {t["content"] for t in described["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special))) + ")") if self.special else None
        self.pattern = regex.compile(described["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.odd = regex.compile(rf"[^\x00-{chr(PLAIN_BELOW - 1)}]")
        self.letters = byte_characters()

    def pieces(self, text: str) -> list[str]:
        """Plain text is cut by the file's own pattern here, other text by the library: both alike, the first faster."""
        parts = self.cut.split(text) if self.cut is not None and self.cut.search(text) else [text]
        found: list[str] = []
        for part in parts:
            if part in self.special:
                found.append(part)
            elif self.odd.search(part):
                normal = self.library.normalizer.normalize_str(part)
                found += [normal[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(normal)]
            else:
                found += self.pattern.findall(part.lower())
        return found

    def count(self, piece: str) -> int:
        return 1 if piece in self.special else len(self.library.model.tokenize("".join([self.letters[b] for b in piece.encode()])))


@lru_cache(maxsize=4)
def pre_tokens(path: str) -> PreTokens:
    return PreTokens(path)


def narrow(values: list[int] | np.ndarray) -> bytes:
    """Non-negative integers in the least width that holds them; the reader knows how many there are."""
    top = int(max(values, default=0))
    return np.array(values, dtype="<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8").tobytes()


def wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<u{len(data) // n}").astype(np.int64)


def posting(found: list[int]) -> tuple[int, int, bytes, bytes]:
    """(documents, first id, steps to the others, times) from id, times, id, times ..."""
    if len(found) == 2:
        return 1, found[0], b"", narrow(found[1:])
    pairs = sorted(zip(found[::2], found[1::2], strict=True))
    ids = [i for i, _ in pairs]
    return len(ids), ids[0], narrow([b - a for a, b in zip(ids, ids[1:], strict=False)]), narrow([t for _, t in pairs])


def frequencies(path: str, spread: int):
    """Arrow batches of (key, text) to rows of pre-token postings. deal: 0, or one of spread numbers for rows of many
    documents."""

    def rows(postings: dict[str, list[int]]) -> Iterator[pa.RecordBatch]:
        items = list(postings.items())
        for at in range(0, len(items), 50_000):
            part = items[at : at + 50_000]
            made = list(zip(*[posting(x) for _, x in part], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in part], pa.string()), *(pa.array(c, t) for c, t in zip(made, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)), pa.array([first % spread if n >= HOT_DOCUMENTS else 0 for n, first in zip(made[0], made[1], strict=True)], pa.int32())], names=["piece", "n", "first", "steps", "times", "deal"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = pre_tokens(path)
        postings: dict[str, list[int]] = defaultdict(list)
        size = 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for piece, times in Counter(cutter.pieces(text)).items():
                    postings[piece] += (key, times)
                size += len(text)
            if size > BLOCK_BYTES:
                yield from rows(postings)
                postings, size = defaultdict(list), 0
        yield from rows(postings)

    return run


def summed(path: str):
    """Postings in order of their pre-token to sums per document, packed for blocks of BLOCK_IDS ids. A pre-token is
    counted when its first row passes, and that count is joined to all its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = pre_tokens(path)
        keys: list[np.ndarray] = []
        sums: list[np.ndarray] = []
        held, last, tokens = 0, None, 0

        def flush() -> Iterator[pa.RecordBatch]:
            own, at = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(at, weights=np.concatenate(sums)).astype("<u8")
            block = own // BLOCK_IDS
            edges = np.flatnonzero(np.diff(block, prepend=block[0] - 1))
            ends = [*edges[1:].tolist(), len(own)]
            parts = list(zip(edges.tolist(), ends, strict=True))
            inside = (own - block * BLOCK_IDS).astype("<u2")
            yield pa.RecordBatch.from_arrays([pa.array(block[edges]), pa.array([inside[a:b].tobytes() for a, b in parts], pa.binary()), pa.array([narrow(total[a:b]) for a, b in parts], pa.binary())], names=["block", "inside", "sums"])
            keys.clear()
            sums.clear()

        for batch in batches:
            counts = []
            for piece in batch.column(0).to_pylist():
                if piece != last:
                    last, tokens = piece, cutter.count(piece)
                counts.append(tokens)
            counts = np.array(counts, dtype=np.int64)
            n, first = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            steps, times = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for i in np.flatnonzero(n > 1).tolist():
                keys.append(first[i] + np.concatenate([[0], np.cumsum(wide(steps[i], n[i] - 1))]))
                sums.append(wide(times[i], n[i]) * counts[i])
            one = np.flatnonzero(n == 1)
            keys.append(first[one])
            sums.append(counts[one] * np.array([int.from_bytes(times[i], "little") for i in one.tolist()], dtype=np.int64))
            held += int(n.sum())
            if held > HELD_SUMS:
                yield from flush()
                held = 0
        if held:
            yield from flush()

    return run


def added(table: pa.Table) -> pa.Table:
    """The sums of a block of ids."""
    places = [np.frombuffer(x, "<u2") for x in table.column("inside").to_pylist()]
    inside = np.concatenate(places)
    sums = np.bincount(inside, weights=np.concatenate([wide(x, len(p)) for x, p in zip(table.column("sums").to_pylist(), places, strict=True)]), minlength=BLOCK_IDS)
    there = np.flatnonzero(np.bincount(inside, minlength=BLOCK_IDS))
    return pa.table({"key": pa.array(there + table.column("block")[0].as_py() * BLOCK_IDS), "tokens": pa.array(sums[there].astype(np.int64))})


def sums_by_key(texts: DataFrame, path: str) -> DataFrame:
    """(key, tokens) of texts (key long, text string), for the keys that have tokens."""
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.mapInArrow(frequencies(path, n), "piece string, n int, first long, steps binary, times binary, deal int").repartition("piece", "deal").sortWithinPartitions("piece")
    return dealt.mapInArrow(summed(path), "block long, inside binary, sums binary").groupBy("block").applyInArrow(added, "key long, tokens long")


def token_counts(df: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) per row, as the tokenizers file at path counts."""
    plain = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = plain.select("id", F.xxhash64("text").alias("hash"), F.octet_length("text").cast("long").alias("n_bytes")).groupBy("id", "hash", "n_bytes").agg(F.count("*").alias("repeats")).checkpoint()
    # Ids with one text are their own keys. Any others, usually none, are found beforehand and have the text's hash in the key.
    unlike = own.groupBy("id").agg(F.count("*").alias("texts")).filter("texts > 1 OR id IS NULL").select("id").checkpoint()
    key = F.xxhash64("id", "hash")
    if not (many := unlike.count()):
        each = own.join(sums_by_key(plain.select(F.col("id").alias("key"), "text"), path), F.col("id") == F.col("key"), "left").withColumn("times", F.col("repeats"))
    else:
        is_unlike = unlike.select(F.col("id").alias("unlike_id"), F.lit(True).alias("other"))
        is_unlike = F.broadcast(is_unlike) if many <= BROADCAST_IDS else is_unlike
        marked = lambda x: x.join(is_unlike, F.col("id").eqNullSafe(F.col("unlike_id")), "left").drop("unlike_id")
        texts, own = marked(plain.withColumn("hash", F.xxhash64("text"))), marked(own)
        alike = sums_by_key(texts.filter("other IS NULL").select(F.col("id").alias("key"), "text"), path)
        others = sums_by_key(texts.filter("other").dropDuplicates(["id", "hash"]).select(key.alias("key"), "text"), path)
        each = own.filter("other IS NULL").join(alike, F.col("id") == F.col("key"), "left").withColumn("times", F.col("repeats"))
        each = each.unionByName(own.filter("other").join(others, key == F.col("key"), "left").withColumn("times", F.lit(1).cast("long")))
    each = each.withColumn("n_tokens", F.expr("coalesce(tokens, 0L) div times"))
    each = each.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))))
    return each.select(F.col("id").cast(df.schema[id_col].dataType).alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
