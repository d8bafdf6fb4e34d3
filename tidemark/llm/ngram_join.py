"""Groups of documents by Jaccard similarity of their word n-gram sets, by T-occurrence search with DivideSkip.

Two sets link if 100 |A & B| >= percent |A | B|. Documents with equal sets are one set, named by 128 bits of its hash, and
never meet. Spark brings sets together that can link, and a search in each such group finds the links:

1. Sets that can link have sizes in the same or neighbouring size classes and differ in at most k shingles, where k follows
   from the class's largest size. Shingles are dealt by hash into more than k cells (in small sets each shingle is a cell), so
   a linked pair has some number of cells in common, and a set with fewer cells that another one has goes. Of the others
   each keeps its rarest cells, so many that a linked pair can't miss to have one of them in common; sets that do are joined
   into groups (connected components of stars). Cells cross the network once, as two longs. Cells of very many sets, known
   from a sample, are dealt over SALTS tasks and count as the most frequent ones, which changes no result.
2. A group of more than BLOCK sets is first refined: shingles are counted within it, each set keeps the rarest of its
   shingles that a link can't all avoid, and only sets that share one of those stay together. What is still larger is cut
   into blocks, and each pair of blocks is a task, so that memory is bounded.
3. In a task sets come by ascending size. A set's inverted lists are divided: the longest are left out and the short ones
   are merged with a heap that skips what can't reach the threshold; those that reach it are probed in the long ones by
   binary search. Sets that are known to be connected aren't probed again, and lists of the largest connected group are
   kept apart and left out for a set that links to one of its last members, as only connection counts.

Every pair that can link meets in a task, so no link between groups is lost. Null text, or text without words, has an empty
set: it is linked with nothing. Null ids are linked like others but name a group only if it has no other id (then null).
Repeated rows get a result each. Extra columns are not returned.
"""

from __future__ import annotations

import hashlib
import heapq
import uuid
from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Callable, Iterator
from itertools import chain
from math import log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import as_bytes, connected_components, schema_of
from tidemark.session import checkpointed, share_package, shared_root

SHINGLE_WORDS, PERCENT = 4, 85
#: Up to this size each shingle of a set is a cell.
SMALL = 32
#: Cells beyond those that a linked pair can differ in: some, of which a few may be empty, and one for each SPARE_EACH.
SPARE, SPARE_EACH = 2, 8
#: Bits of a node that name the set; the others hold how many cells a link takes.
NAMED = 52
#: Share of the carriers that are looked at for hot cells; those with more of them than HOT_SAMPLED, HOT_CELLS at most, are
#: dealt over SALTS tasks each.
SAMPLE, HOT_SAMPLED, HOT_CELLS, SALTS = 0.01, 1000, 4096, 64
#: Most sets, and most shingles of sets, of a group that is one task.
BLOCK, BLOCK_SHINGLES = 4096, 1 << 21
#: Most sets of groups that are broadcast to the texts, 50 bytes each; more of them meet the texts in a shuffle.
BROADCAST_SETS = 250_000
#: Words whose hashes a worker keeps.
KEPT_WORDS = 500_000
#: Members of the largest connected group that a set is held against first.
PIVOTS = 8
#: Weight of a probe against a merged entry in the choice of how many lists are long.
LONG_WEIGHT = 0.0085
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def scattered(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Numbers(dict):
    """Numbers words as they come and keeps their hashes."""

    def __init__(self):
        super().__init__()
        self.hashes: list[int] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        self.hashes.append(xxhash.xxh64_intdigest(word, seed=42))
        return code


class Shingler:
    """Sets of hashed shingles, ascending. bytes.lower and bytes.split know ASCII only."""

    def __init__(self, width: int = SHINGLE_WORDS):
        self.width, self.numbers = width, Numbers()

    def sets(self, texts: list[bytes | None]) -> list[np.ndarray]:
        if len(self.numbers) > KEPT_WORDS:
            self.numbers = Numbers()
        words = [(t or b"").lower().split() for t in texts]
        codes = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(words)), dtype=np.int64)
        hashes = np.array(self.numbers.hashes, dtype=np.uint64)[codes]
        out, at = [], 0
        for own in words:
            n = len(own)
            size = min(self.width, n)
            h = np.zeros(max(0, n - size + 1) if n else 0, np.uint64)
            for i in range(size):
                h = h * MULTIPLIER + hashes[at + i : at + i + len(h)]
            out.append(np.unique(scattered(h + np.uint64(size))) if n else h)
            at += n
        return out


def name_of(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def size_classes(percent: int, most: int = 1 << 40) -> list[int]:
    """First size of each class; sets that link are in one class or in two neighbouring ones."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, out[-1] * 100 // percent + 1))
    return out


def least_overlap(n: int, percent: int) -> int:
    """Shingles that a set of n has in common with any that it links to, at least."""
    m = -(-n * percent // 100)
    return -(-percent * (n + m) // (100 + percent))


def cells(own: np.ndarray, firsts: list[int], percent: int) -> list[tuple[int, int, np.ndarray]]:
    """For the set's size class and the next one: (class, cells that a linked set has too at least, hashes of the cells)."""
    at = bisect_left(firsts, len(own) + 1)
    out = []
    for k in (at, at + 1):
        most = firsts[k] - 1
        if most <= SMALL:
            out.append((k, least_overlap(len(own), percent), scattered(own + np.uint64(k << 40))))
            continue
        differing = 2 * most * (100 - percent) // (100 + percent)
        number = differing + 1 + SPARE + differing // SPARE_EACH
        cell = (own >> np.uint64(33)) % np.uint64(number)
        order = np.argsort(cell, kind="stable")
        held, first = np.unique(cell[order], return_index=True)
        sums = np.add.reduceat(scattered(own[order] + np.uint64(k)), first)
        # A pair has number - differing cells in common, of which no more are empty than this set's.
        need = len(held) - differing
        if need < 1:  # it can't do without the empty ones
            full = np.zeros(number, np.uint64)
            full[held.astype(np.int64)] = sums
            need, held, sums = 1, np.arange(number, dtype=np.uint64), full
        out.append((k, need, scattered(sums + scattered(held + np.uint64(k << 40)))))
    return out


def described(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, n_shingles, name, text) per row; text only in the first row of a set that a task meets."""
    schema = schema_of(df.schema[id_col], "n_shingles long, name binary, text string")

    def run(batches):
        shingler, met = Shingler(width), set()
        for batch in batches:
            if not batch.num_rows:
                continue
            sets = shingler.sets(as_bytes(batch.column(1)))
            names = [name_of(s) if len(s) else None for s in sets]
            new = []
            for x in names:
                new.append(x is not None and x not in met)
                met.add(x)
            if len(met) > KEPT_WORDS:
                met.clear()
            texts = pc.if_else(pa.array(new), batch.column(1), pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array(names, pa.binary()), texts], names=schema.names)

    return df.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)


def node_of(name: bytes, size_class: int) -> int:
    return xxhash.xxh64_intdigest(name, seed=size_class) >> (64 - NAMED)


def send_cells(carriers: DataFrame, width: int, percent: int) -> DataFrame:
    """(cell, node) longs. A node is a set within a size class; its upper bits say how many of its cells a link takes."""
    firsts = size_classes(percent)

    def run(batches):
        shingler = Shingler(width)
        for batch in batches:
            if not batch.num_rows:
                continue
            found, nodes = [], []
            for own, name in zip(shingler.sets(as_bytes(batch.column(1))), batch.column(0).to_pylist(), strict=True):
                for k, need, hashes in cells(own, firsts, percent):
                    found.append(hashes)
                    nodes.append(np.full(len(hashes), min(need, (1 << (63 - NAMED)) - 1) << NAMED | node_of(name, k), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(nodes))], names=["cell", "node"])

    return carriers.select("name", "text").mapInArrow(run, "cell long, node long")


def candidate_edges(carriers: DataFrame, width: int, percent: int) -> DataFrame:
    """Edges (a, b) between nodes, without the upper bits, such that two sets that link are connected."""
    rows = send_cells(carriers, width, percent)
    hot = send_cells(carriers.sample(SAMPLE, seed=1), width, percent).groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > HOT_SAMPLED).orderBy(F.desc("n"), "cell").limit(HOT_CELLS).select("cell", F.lit(True).alias("hot"))
    dealt = rows.join(F.broadcast(hot), "cell", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.col("node"), F.lit(SALTS))).otherwise(0))
    df = F.when(F.col("hot"), F.lit(1 << 62)).otherwise(F.count("*").over(W.partitionBy("cell", "salt")))
    shared = dealt.withColumn("df", df).filter("df > 1")
    own = shared.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "cell"))).alias("own"))
    kept = F.size("own") - F.shiftrightunsigned("node", NAMED).cast("int") + 1
    # A set that several tasks have met is there as often, which only makes more of its cells stay.
    rare = own.filter(kept > 0).select(F.col("node").bitwiseAND(F.lit((1 << NAMED) - 1)).alias("node"), F.explode(F.slice("own", F.lit(1), kept)).alias("x")).select("node", F.col("x.cell").alias("cell"))
    return tied(checkpointed(rare), ["cell"], "node").distinct()


def tied(rows: DataFrame, key: list[str], node: str) -> DataFrame:
    """Edges (a, b) of nodes that have a key in common: each to the least, which is found before any row moves."""
    least = rows.groupBy(*key).agg(F.min(node).alias("a"), F.max(node).alias("most")).filter("a <> most").drop("most")
    return rows.join(least, key).filter(F.col(node) != F.col("a")).select("a", F.col(node).alias("b"))


def whole_components(edges: DataFrame) -> DataFrame:
    """(node, group), the node that names a component included."""
    found = connected_components(edges)
    return found.select("node", F.col("component").alias("group")).union(found.select("component", "component").distinct())


def named_groups(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (node, ...) that have an edge, with the column group."""
    return nodes.join(whole_components(edges), "node")


class Lists:
    """Inverted lists of a group's sets, which come by ascending size, and what is known to be connected."""

    def __init__(self, percent: int):
        self.percent = percent
        self.sets: list[np.ndarray] = []
        self.sizes: list[int] = []
        self.parent: list[int] = []
        #: Lists of the sets outside and inside the main connected group.
        self.rest: dict[int, list[int]] = {}
        self.main: dict[int, list[int]] = {}
        self.core, self.last = -1, deque(maxlen=PIVOTS)

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def needed(self, n: int, m: int) -> int:
        """Least overlap of linked sets of these sizes."""
        return -(-self.percent * (n + m) // (100 + self.percent))

    def linked(self, own: np.ndarray, i: int) -> bool:
        other = self.sets[i]
        need = self.needed(len(own), len(other))
        return min(len(own), len(other)) >= need and int(np.count_nonzero(other[np.minimum(np.searchsorted(other, own), len(other) - 1)] == own)) >= need

    def search(self, lists: list[list[int]], size: int, passed: Callable[[int], bool]) -> Iterator[int]:
        """Sets that link to one of this size, by the lists of its shingles; passed(i) says that i need not be found."""
        least = least_overlap(size, self.percent)
        if len(lists) < least:
            return
        low, high = bisect_left(self.sizes, -(-size * self.percent // 100)), bisect_right(self.sizes, size * 100 // self.percent)
        lists.sort(key=len)
        long = min(least - 1, int(least / (LONG_WEIGHT * log2(len(lists[-1]) + 1) + 1)))
        short, probed, wanted = lists[: len(lists) - long], lists[len(lists) - long :], least - long
        heap = [(x[at], j, at) for j, x in enumerate(short) if (at := bisect_left(x, low)) < len(x)]
        heapq.heapify(heap)
        while len(heap) >= wanted and heap[0][0] < high:
            top, popped = heap[0][0], []
            while heap and heap[0][0] == top:
                popped.append(heapq.heappop(heap))
            following = top + 1
            if len(popped) >= wanted:
                if not passed(top):
                    need, count = self.needed(size, self.sizes[top]), len(popped)
                    for left, x in zip(range(len(probed), 0, -1), probed, strict=True):
                        if count >= need or count + left < need:
                            break
                        at = bisect_left(x, top)
                        count += at < len(x) and x[at] == top
                    if count >= need:
                        yield top
            else:  # wanted - 1 lists alone can't do: they skip to where the next one stands
                while heap and len(popped) < wanted - 1:
                    popped.append(heapq.heappop(heap))
                if not heap:
                    break
                following = max(following, heap[0][0])
            for _, j, at in popped:
                at = bisect_left(short[j], following, at)
                if at < len(short[j]):
                    heapq.heappush(heap, (short[j][at], j, at))

    def meet(self, own: np.ndarray, tokens: list[int]) -> list[int]:
        """One set of each connected group that a set links to. tokens: its shingles that other sets have too."""
        found: list[int] = []
        groups: set[int] = set()
        passed = lambda i: self.root(i) in groups
        for i in self.last:
            if self.linked(own, i):
                found.append(i)
                groups.add(self.root(i))
                break
        for i in self.search([x for t in tokens if (x := self.rest.get(t))], len(own), passed):
            found.append(i)
            groups.add(self.root(i))
        if self.core >= 0 and not passed(self.core):
            for i in self.search([x for t in tokens if (x := self.main.get(t))], len(own), passed):
                found.append(i)
                break
        return found

    def connect(self, found: list[int]) -> None:
        for j in found[1:]:
            self.parent[self.root(j)] = self.root(found[0])

    def add(self, own: np.ndarray, tokens: list[int], found: list[int]) -> None:
        """The set joins the lists, and the groups of those found are one."""
        i = len(self.sets)
        self.sets.append(own)
        self.sizes.append(len(own))
        self.parent.append(i)
        if found and self.core < 0:
            self.core = found[0]
        self.connect([*found, i])
        inside = self.core >= 0 and self.root(i) == self.root(self.core)
        if inside:
            self.last.append(i)
        lists = self.main if inside else self.rest
        for t in tokens:
            lists.setdefault(t, []).append(i)


def links_of(index: dict[bytes, np.ndarray], queries: dict[bytes, np.ndarray], percent: int) -> Iterator[tuple[bytes, bytes]]:
    """Links of the sets of index among themselves and of queries with them, as many as connect what is connected."""
    if len(index) + len(queries) < 2:
        return
    every, times = np.unique(np.concatenate([*index.values(), *queries.values()]), return_counts=True)
    shared = every[times > 1]
    if not len(shared):
        return

    def tokens(own: np.ndarray) -> list[int]:
        at = np.minimum(np.searchsorted(shared, own), len(shared) - 1)
        return at[shared[at] == own].tolist()

    lists, names = Lists(percent), []
    for name, own in sorted(index.items(), key=lambda x: (len(x[1]), x[0])):
        found = lists.meet(own, known := tokens(own))
        yield from ((name, names[j]) for j in found)
        names.append(name)
        lists.add(own, known, found)
    for name, own in queries.items():
        found = lists.meet(own, tokens(own))
        yield from ((name, names[j]) for j in found)
        lists.connect(found)


def search_groups(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b) names of linked sets. rows: (task long, probing boolean, name, text); sets with probing false are the index of
    a task, and the others are held against it."""
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.repartition(n, "task").sortWithinPartitions("task")

    def run(batches):
        shingler = Shingler(width)
        task, index, queries = None, {}, {}

        def finish():
            out = list(links_of(index, queries, percent))
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.binary()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(3)]
            for at, probing, name, own in zip(*columns, shingler.sets(as_bytes(batch.column(3))), strict=True):
                if at != task:
                    if task is not None:
                        yield finish()
                    task, index, queries = at, {}, {}
                (queries if probing else index)[name] = own
        if task is not None:
            yield finish()

    return ordered.mapInArrow(run, "a binary, b binary")


def refined(big: DataFrame, carriers: DataFrame, width: int, percent: int) -> DataFrame:
    """(name, n, group) of the sets of large groups, in smaller ones: sets stay together if they share one of the shingles that
    are rarest in the group, of which a set keeps so many that a link can't miss them all. A set without any such shingle
    that another has goes."""

    def run(batches):
        shingler = Shingler(width)
        for batch in batches:
            sets = shingler.sets(as_bytes(batch.column(3)))
            sizes = np.array([len(s) for s in sets])
            own = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            at = pa.array(np.repeat(np.arange(len(sets)), sizes))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at), pa.array(own.view(np.int64))], names=["name", "n", "group", "shingle"])

    shingles = big.join(carriers.select("name", "text"), "name").select("name", "n", "group", "text").mapInArrow(run, "name binary, n long, group long, shingle long").distinct()
    counts = shingles.groupBy("group", "shingle").agg(F.count("*").alias("df"))
    ranked = shingles.join(counts, ["group", "shingle"]).groupBy("group", "name", "n").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("own"))
    prefix = F.slice("own", F.lit(1), (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int"))
    kept = ranked.select("group", "name", "n", F.explode(F.filter(prefix, lambda x: x["df"] > 1)).alias("x")).select("group", "name", "n", F.col("x.shingle").alias("shingle"), F.xxhash64("name", "group").alias("node"))
    kept = checkpointed(kept)
    nodes = kept.select("node", "name", "n").distinct()
    return named_groups(nodes, tied(kept, ["group", "shingle"], "node")).select("name", "n", "group")


def components(df: DataFrame, percent: int = PERCENT, width: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(id, n_shingles, component_id) per row."""
    spark = df.sparkSession
    share_package(spark)
    root = f"{shared_root(spark)}/ngrams-{uuid.uuid4().hex}"
    described(df, id_col, text_col, width).write.parquet(f"{root}/described")
    own = spark.read.parquet(f"{root}/described")
    carriers = own.filter("text IS NOT NULL AND name IS NOT NULL").select("name", F.col("n_shingles").alias("n"), "text")
    firsts = size_classes(percent)
    edges = checkpointed(candidate_edges(carriers, width, percent))
    # The same nodes as send_cells has: a set in its size class and in the next one.
    nodes = carriers.select("name", "n").distinct().mapInArrow(nodes_of(firsts), "name binary, n long, node long")
    members = named_groups(nodes, edges).select("name", "n", "group").distinct()
    members = checkpointed(members)
    sizes = members.groupBy("group").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
    large = (F.col("sets") > block) | (F.col("shingles") > block_shingles)
    if sizes.filter(large).limit(1).count():
        big = members.join(sizes.filter(large).select("group"), "group")
        small = members.join(sizes.filter(large).select("group"), "group", "left_anti")
        members = checkpointed(small.unionByName(refined(big, carriers, width, percent)))
        sizes = members.groupBy("group").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
    blocks = F.ceil(F.greatest(F.col("sets") / block, F.col("shingles") / block_shingles)).cast("int")
    dealt = members.join(sizes.select("group", blocks.alias("blocks")), "group").withColumn("at", F.pmod(F.xxhash64("name"), "blocks").cast("int"))
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda y: F.struct(F.least(y, "at").alias("i"), F.greatest(y, "at").alias("j"))))
    tasks = dealt.select("name", "group", "at", pair.alias("p")).select("name", F.xxhash64("group", "p.i", "p.j").alias("task"), (F.col("at") != F.col("p.i")).alias("probing"))
    tasks = checkpointed(tasks)
    tasks = F.broadcast(tasks) if tasks.count() <= BROADCAST_SETS else tasks
    found = search_groups(carriers.select("name", "text").join(tasks, "name").select("task", "probing", "name", "text"), width, percent).distinct()
    # Sets are numbered for the components, so that no two ever share a number.
    named = own.filter("name IS NOT NULL").groupBy("name").agg(F.min(id_col).alias("least"), F.count("*").alias("rows"))
    named.withColumn("number", F.monotonically_increasing_id()).write.parquet(f"{root}/named")
    named = spark.read.parquet(f"{root}/named")
    number = lambda c: named.select(F.col("name").alias(c), F.col("number").alias(f"number_{c}"))
    ties = found.join(number("a"), "a").join(number("b"), "b").select(F.col("number_a").alias("a"), F.col("number_b").alias("b"))
    joined = named_groups(named.withColumnRenamed("number", "node"), ties).select("name", "least", "group")
    least = joined.groupBy("group").agg(F.min("least").alias("component_id"))
    of = joined.join(least, "group").select("name", F.col("component_id").alias("linked"))
    copied = named.filter("rows > 1").join(of, "name", "left_anti").select("name", F.col("least").alias("linked"))
    out = own.select(id_col, "n_shingles", "name").join(of.unionByName(copied), "name", "left")
    return out.select(id_col, "n_shingles", F.coalesce("linked", F.col(id_col)).alias("component_id"))


def nodes_of(firsts: list[int]):
    def run(batches):
        for batch in batches:
            names, sizes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = [(x, n, node_of(x, k)) for x, n in zip(names, sizes, strict=True) for at in (bisect_left(firsts, n + 1),) for k in (at, at + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ((), (), ()), (pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["name", "n", "node"])

    return run
