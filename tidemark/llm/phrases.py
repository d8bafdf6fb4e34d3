"""Phrase collocations by dynamic itemset counting over shards of the corpus.

The rows are dealt into shards, which are scanned in a cycle, one Spark job a step. Lengths are interleaved: words are counted
from the first step on; a longer phrase becomes active at the step after both of its subphrases (all but its last word,
all but its first) have been counted min_count times, wherever in the cycle that is, and is complete when it has been
counted for one full cycle from there. A phrase that occurs min_count times has subphrases that do, so each gets active
by the time that they are complete, and its count is exact.

What a task needs to know of earlier steps is the step at which a phrase reached the threshold. It stands in a table of
bytes of fixed size, the one thing that is broadcast: a phrase marks two places with its step unless they are marked, and
its step is read as the later of its two places. A place that others have marked can make it look earlier than it was,
but always the same from then on, so such a phrase is counted for one full cycle too, and nothing depends on the table but how
much is counted. A task sums up its text before anything is shuffled; the longest phrases, which activate nothing, are shuffled
once, at the end.

Null text counts as empty, null lang as "und". Repeated rows count each. Other columns play no part. An empty table gives
no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import as_bytes
from tidemark.session import remove, share_package, shared_root

SHARDS = 3
#: Words that a task counts at once, which bounds its memory.
COUNTED_WORDS = 1 << 20
#: Places of the table of steps, a byte each; a larger table only saves counting.
PLACES = 1 << 24
NEVER = 255
# What ends a piece. All become a full stop, which stands between words as one of its own.
STOPS = b".,;:!?\n\x0b\x0c\r"
TO_STOP = bytes.maketrans(STOPS, b"." * len(STOPS))
ROWS = "lang string, phrase string, words int, since int, count long"
#: Bytes of a row group of the files between steps; a task writes one for each shard at once.
GROUP_BYTES = 1 << 25
MIX = np.uint64(0xBF58476D1CE4E5B9)


def words_of(text: bytes) -> tuple[pa.Array, np.ndarray]:
    """(distinct words, number of each word) of a text, "." where a piece ends; it comes first and is 0. bytes.lower and the
    split know ASCII only."""
    spaced = (b". " + text.lower().translate(TO_STOP).replace(b".", b" . ")).rstrip()
    words = pc.ascii_split_whitespace(pa.array([spaced], pa.large_binary()).view(pa.large_string())).values.dictionary_encode()
    return words.dictionary.cast(pa.binary()), words.indices.to_numpy().astype(np.int64)


def word_marks(lang: str, words: pa.Array) -> np.ndarray:
    seed = xxhash.xxh32_intdigest(lang)
    return np.array([xxhash.xxh64_intdigest(w, seed) for w in words.to_numpy(zero_copy_only=False)], dtype=np.uint64)


def mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    h = left * np.uint64(0x9E3779B97F4A7C15) + right
    h ^= h >> np.uint64(31)
    h *= MIX
    return h ^ (h >> np.uint64(29))


def places(marks: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places in a table of `size`, a power of two, for each mark."""
    last = np.uint64(size - 1)
    return marks & last, (marks >> np.uint64(32)) & last


def reached(table: np.ndarray, marks: np.ndarray) -> np.ndarray:
    a, b = places(marks, len(table))
    return np.maximum(table[a], table[b]).astype(np.int32)


def counted(texts: list[bytes], lang: str, step: int, shards: int, longest: int, table: np.ndarray) -> Iterator[tuple]:
    """(phrase, words, since, mark, count) arrays of the phrases that are active at this step; words 0 is the number of words."""
    names, x = words_of(b".".join(texts))
    marks = word_marks(lang, names)
    size, own = len(names), marks[x]
    key, valid, since = x, x > 0, np.zeros(len(x), np.int32)
    for n in range(1, longest + 1):
        if n > 1:
            step_of = reached(table, marks)[x] if n == 2 else reached(table, own)
            since = np.maximum(step_of[:-1], step_of[1:]) + 1
            valid = valid[:-1] & (x[n - 1 :] > 0)
            if len(key) and (int(key.max()) + 1) * size >= 1 << 63:
                _, key = np.unique(key, return_inverse=True)
            key, own = key[:-1] * size + x[n - 1 :], mixed(own[:-1], marks[x[n - 1 :]])
        active = np.flatnonzero(valid & (since <= step) & (step < since + shards))
        if n == 1 and len(active):
            yield pa.array([b""], pa.binary()), 0, np.zeros(1, np.int32), np.zeros(1, np.uint64), np.array([len(active)])
        if len(active):
            _, first, count = np.unique(key[active], return_index=True, return_counts=True)
            at = active[first]
            parts = [names.take(pa.array(x[at + i])) for i in range(n)]
            yield pc.binary_join_element_wise(*parts, b" ") if n > 1 else parts[0], n, since[at], own[at], count


def count_step(df: DataFrame, step: int, shards: int, longest: int, table) -> DataFrame:
    """Sums of each task over (lang, text), as ROWS."""
    at_once = COUNTED_WORDS

    def batches_of(held: dict[str, list[bytes]]):
        for lang, texts in held.items():
            for phrase, n, since, _, count in counted(texts, lang, step, shards, longest, table.value):
                rows = len(phrase)
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, rows), phrase.view(pa.string()), pa.array(np.full(rows, n, np.int32)), pa.array(since.astype(np.int32)), pa.array(count.astype(np.int64))], names=["lang", "phrase", "words", "since", "count"])

    def run(batches):
        held: dict[str, list[bytes]] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                if text:
                    held.setdefault(lang, []).append(text)
                    size += len(text)
                if size > at_once * 6:
                    yield from batches_of(held)
                    held, size = {}, 0
        yield from batches_of(held)

    return df.mapInArrow(run, ROWS)


def mark_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, words) to the marks that counted() gives the phrases."""
    for batch in batches:
        for (lang, n), own in batch.to_pandas().groupby(["lang", "words"])["phrase"]:
            words = pc.split_pattern(pa.array(own, pa.string()), " ").values.dictionary_encode()
            first, *rest = word_marks(lang, words.dictionary.cast(pa.binary()))[words.indices.to_numpy()].reshape(-1, n).T
            for mark in rest:
                first = mixed(first, mark)
            yield pa.RecordBatch.from_arrays([pa.array(first.view(np.int64))], names=["mark"])


def mark_table(found: DataFrame, table: np.ndarray, step: int) -> int:
    """Marks the places of found (mark long) with the step; the phrases' number. Bits of places are united by block of 32768
    on the executors, so that the driver gets one bit a place at most."""
    last = F.lit(len(table) - 1)
    # Spark's bitmaps count places from 1.
    place = F.explode(F.array(F.col("mark").bitwiseAND(last) + 1, F.shiftrightunsigned("mark", 32).bitwiseAND(last) + 1)).alias("place")
    own = found.select(place).groupBy((F.bitmap_bucket_number(F.col("place")) - 1).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("place"))).alias("bits"), F.count("*").alias("n"))
    n = 0
    for r in own.toLocalIterator():
        bits = np.flatnonzero(np.unpackbits(np.frombuffer(r.bits, dtype=np.uint8), bitorder="little"))
        at = r.block * 32768 + bits
        at = at[at < len(table)]
        table[at] = np.minimum(table[at], step)
        n += r.n
    return n


def count_phrases(df: DataFrame, min_count: int = 10, longest: int = 3, shards: int = SHARDS, size: int = PLACES, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, count) of phrases of up to `longest` words that occur min_count times, (lang, n): words of each
    lang). The results lie in the shared folder."""
    spark = df.sparkSession
    share_package(spark)
    if not 0 < shards * longest < NEVER:
        raise ValueError("shards times words must be below 255")
    root = f"{shared_root(spark)}/phrases-{uuid.uuid4().hex}"
    dealt = df.select(F.coalesce(F.col(lang_col), F.lit("und")).cast("string").alias("lang"), F.col(text_col).alias("text"), F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int").alias("shard"))
    # Files between steps are written as the rows come: some files are open at once instead of a sort.
    writers = "spark.sql.maxConcurrentOutputFileWriters"
    usual = spark.conf.get(writers, None)
    spark.conf.set(writers, str(max(2, shards)))
    write = lambda rows, by, to: rows.write.option("compression", "zstd").option("parquet.block.size", GROUP_BYTES).partitionBy(by).parquet(f"{root}/{to}")
    write(dealt, "shard", "shards")
    corpus = spark.read.schema("lang string, text string, shard int").parquet(f"{root}/shards")
    table = np.full(size, NEVER, np.uint8)
    counts = lambda: spark.read.schema(ROWS + ", step int, long boolean").parquet(f"{root}/counted")
    sums = lambda: spark.read.schema(ROWS + ", before long, step int, complete boolean").parquet(f"{root}/sums")
    columns = ["lang", "phrase", "words", "since"]
    pending, step, until = spark.createDataFrame([], ROWS), 0, shards
    while step < until:
        sent = spark.sparkContext.broadcast(table)
        own = count_step(corpus.filter(F.col("shard") == step % shards).select("lang", "text"), step, shards, longest, sent)
        write(own.withColumn("long", F.col("words") == longest), "long", f"counted/step={step}")
        sent.destroy()
        new = counts().filter((F.col("step") == step) & ~F.col("long")).select(*columns, "count", F.lit(0).cast("long").alias("before"))
        both = new.unionByName(pending.select(*columns, "count", F.col("count").alias("before"))).groupBy(*columns).agg(F.sum("count").alias("count"), F.sum("before").alias("before"))
        both = both.withColumn("complete", F.lit(step) >= F.col("since") + (shards - 1)).filter((F.col("count") >= min_count) | ~F.col("complete") | (F.col("words") == 0))
        write(both, "complete", f"sums/step={step}")
        state = sums().filter(F.col("step") == step)
        if mark_table(state.filter((F.col("words") > 0) & (F.col("count") >= min_count) & (F.col("before") < min_count)).select("lang", "phrase", "words").mapInArrow(mark_rows, "mark long"), table, step):
            until = step + 1 + shards
        pending = state.filter("NOT complete")
        remove(spark, f"{root}/sums/step={step - 1}/complete=false")
        remove(spark, f"{root}/counted/step={step}/long=false")
        step += 1
    spark.conf.set(writers, usual) if usual is not None else spark.conf.unset(writers)
    remove(spark, f"{root}/shards")
    short = sums().filter("complete")
    last = counts().filter("long").groupBy("lang", "phrase", "words").agg(F.sum("count").alias("count")).filter(F.col("count") >= min_count)
    short.filter("words > 0").select("lang", "phrase", "words", "count").unionByName(last).filter("words > 0").write.parquet(f"{root}/found")
    short.filter("words = 0").groupBy("lang").agg(F.sum("count").alias("n")).write.parquet(f"{root}/sizes")
    for name in ("counted", "sums"):
        remove(spark, f"{root}/{name}")
    return tuple(spark.read.schema(kinds).parquet(f"{root}/{name}") for name, kinds in (("found", "lang string, phrase string, words int, count long"), ("sizes", "lang string, n long")))


def joined(words: Column, start, length) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(df: DataFrame, min_count: int = 10, longest: int = 3, top: int = 2000, keep_percent: int = 50, shards: int = SHARDS, size: int = PLACES, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` phrases of each lang. a is the phrase's count; l and r are
    those of its two parts at the cut with the lowest score floor(1000000 a a / (l r)), the first such; n is the number of
    the lang's words. A phrase goes if keep_percent of its occurrences or more are those of one longer candidate. Scores
    are exact decimals."""
    counts, sizes = count_phrases(df, min_count, longest, shards, size, lang_col, text_col)
    split = counts.filter("words > 1").withColumn("w", F.split("phrase", " "))
    cut = split.select("lang", "phrase", F.col("count").alias("a"), "words", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", joined(F.col("w"), 1, F.col("k")).alias("left"), joined(F.col("w"), F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    side = lambda name, to: counts.select("lang", F.col("phrase").alias(name), F.col("count").alias(to))
    both = cut.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    both = both.withColumn("score", F.expr("(cast(a as decimal(15,0)) * cast(a as decimal(15,0)) * cast(1000000 as decimal(7,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))"))
    lowest = both.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("s")).select("lang", "phrase", "s.*")
    # Each candidate marks the phrases inside it that it nearly always comes with.
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: joined(F.col("w"), i, n))))
    longer = split.filter("words > 2").select("lang", F.col("count").alias("f"), F.explode(F.array_distinct(inner)).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    kept = lowest.join(longer, ["lang", "phrase"], "left").filter(F.coalesce(F.col("f") * 100 < F.col("a") * keep_percent, F.lit(True)))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
