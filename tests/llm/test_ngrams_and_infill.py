"""Phrases, n-gram groups and fill-in-middle against brute force, on real and on awkward rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import infill, ngram_join, phrases
from tidemark.llm.common import prepare

LONG = " ".join(f"word{i % 977} the {i * i % 31}" for i in range(20_000))
AWKWARD = [
    (1, None, "en"), (2, "", "en"), (3, "x", None), (4, "   \n\n \t ", "de"), (5, "Ünïcödé ĀŁ 日本語 한국 🙂👍🏽 é İSTANBUL ß; Ünïcödé ĀŁ", "en"),
    (6, "has <P> inside", "en"), (7, "De " * 700, "de"), (8, "De " * 700, "de"), (8, "De " * 700, "de"), (9, LONG, "en"),
    (10, LONG[:40_000] + " and then something else " + LONG[40_000:], ""), (11, "\x00\x01\u0085 ᠎ a b\x0b\x0cA\rB", "en"), (None, "no id here, but words " * 5, "en"),
    (12, "".join(map(chr, range(0x20, 0x3000))), "en"), (13, "a a a a a a. a a! a", None), (14, "- - -- --- .5,5;", "und"), (None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    prepare(spark)
    return AWKWARD + [(r.doc_id + 100, r.text, r.lang) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


def frame(spark, rows):
    df = prepare(spark).createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    return df.selectExpr("*", "1 AS count", "'x' AS phrase", "doc_id AS node", "'y' AS name", "2L AS n", "'z' AS output", "3 AS shard")


def phrases_by_hand(rows, least, longest, top, percent):
    found, sizes = Counter(), Counter()
    for _, text, lang in rows:
        lang, text = "und" if lang is None else lang, re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^ \t]+", piece)
            sizes[lang] += len(words)
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    found[(lang, tuple(words[i : i + n]))] += 1
    out = defaultdict(list)
    chosen = {k: a for k, a in found.items() if len(k[1]) > 1 and a >= least}
    covered = Counter()
    for (lang, words), a in chosen.items():
        for n in range(2, len(words)):
            for i in range(len(words) - n + 1):
                key = (lang, words[i : i + n])
                covered[key] = max(covered[key], a)
    for (lang, words), a in chosen.items():
        cuts = [(found[(lang, words[:k])], found[(lang, words[k:])]) for k in range(1, len(words))]
        score, _, l, r = min((1_000_000 * a * a // (x * y), k, x, y) for k, (x, y) in enumerate(cuts))
        if 100 * covered[(lang, words)] < percent * a:
            out[lang].append((-score, -a, " ".join(words).encode(), l, r))
    return Counter((lang, i + 1, p.decode(), -a, l, r, sizes[lang], -s) for lang, xs in out.items() for i, (s, a, p, l, r) in enumerate(sorted(xs)[:top]))


@pytest.mark.parametrize(("shards", "longest", "size", "words"), [(4, 3, 1 << 24, 1 << 21), (3, 4, 1 << 10, 500), (1, 2, 1 << 16, 1 << 21)])
def test_phrases(spark, docs, monkeypatch, shards, longest, size, words):
    """With a table that is far too small too, and counting often."""
    monkeypatch.setattr(phrases, "COUNTED_WORDS", words)
    got = Counter(tuple(r) for r in phrases.collocations(frame(spark, docs), 4, longest, 50, 60, shards, size).collect())
    assert got == phrases_by_hand(docs, 4, longest, 50, 60) and len(got) > 50


def test_phrases_are_activated_late_and_counted_for_a_cycle():
    """A table of steps: a phrase is counted from the step after its halves' on, for as many steps as there are shards."""
    table = np.full(1 << 16, phrases.NEVER, np.uint8)
    text = [b"New York new york. York"]
    first = list(phrases.counted(text, "en", 0, 4, 3, table))
    assert [(p.to_pylist(), n, c.tolist()) for p, n, _, _, c in first] == [([b""], 0, [5]), ([b"new", b"york"], 1, [2, 3])]
    for mark, step in zip(first[1][3], (1, 3)):
        for x in phrases.places(np.array([mark]), len(table)):
            table[x] = step
    of = lambda step: [(p.to_pylist(), n, s.tolist(), c.tolist()) for p, n, s, _, c in phrases.counted(text, "en", step, 4, 3, table) if n > 1]
    assert of(3) == [] and of(8) == [] and all(of(s) == [([b"new york", b"york new"], 2, [4, 4], [2, 1])] for s in (4, 7))


def test_phrases_carry_no_marks_between_steps():
    """Rows between steps have no mark; of phrases that reached the threshold it is found again, as counted() has it."""
    assert "mark" not in phrases.ROWS
    table = np.zeros(1 << 10, np.uint8)
    for lang in ("en", "und"):
        for phrase, n, _, mark, _ in phrases.counted([b"New York\xc3\xa9 new york. York a\x1cb new york\t york", b"x"], lang, 1, 4, 3, table):
            if n:
                rows = pa.RecordBatch.from_arrays([pa.repeat(lang, len(phrase)), phrase.cast(pa.string()), pa.array([n] * len(phrase), pa.int32())], names=["lang", "phrase", "words"])
                assert [m for out in phrases.mark_rows([rows]) for m in out.column(0).to_pylist()] == mark.view(np.int64).tolist()


def test_words_end_at_ascii_space_only():
    rng = random.Random(3)
    letters = [*map(chr, range(128)), "\u00e9", "\u65e5", "\u00a0", "\u2028", "\u0085", " ", ". "]
    for _ in range(2000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(40))).encode()
        names, x = phrases.words_of(text)
        words = [names[i].as_py() for i in x.tolist()]
        assert words[0] == b"." and words[1:] == text.lower().translate(phrases.TO_STOP).replace(b".", b" . ").split()


def test_phrases_scores_are_exact(spark):
    """Products beyond 64 bits."""
    rows = [(1, "p q " * 300_000, "en"), (2, "p q", "en")]
    got = phrases.collocations(frame(spark, rows), 10, 2, 10, 50, 2, 1 << 12).collect()
    want = phrases_by_hand(rows, 10, 2, 10, 50)
    assert Counter(tuple(r) for r in got) == want


def test_phrases_of_nothing(spark):
    assert phrases.collocations(frame(spark, []), 2).collect() == []
    assert phrases.collocations(frame(spark, [(1, None, None)]), 2).collect() == []


def groups_by_hand(rows, percent, width):
    sets = []
    for i, text, _ in rows:
        words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append((i, frozenset(" ".join(words[a : a + width]) for a in range(max(1, len(words) - width + 1))) if words else frozenset()))
    distinct = list({s for _, s in sets if s})
    parent = {s: s for s in distinct}

    def root(s):
        while parent[s] is not s:
            s = parent[s]
        return s

    held = defaultdict(list)
    for s in distinct:
        shared = Counter(t for x in s for t in held[x])
        for t, n in shared.items():
            if 100 * n >= percent * len(s | t):
                parent[root(t)] = root(s)
        for x in s:
            held[x].append(s)
    least = {}
    for i, s in sets:
        if s and i is not None:
            least[root(s)] = min(i, least.get(root(s), i))
    return Counter((i, len(s), least.get(root(s)) if s else i) for i, s in sets)


def near_copies(rng, texts):
    """Chains of edits, dense groups, a passage that many share, and small sets."""
    out, number = [], 10_000
    words = [f"w{i}" for i in range(300)]
    for group in range(12):
        base = rng.choices(words, k=rng.choice([1, 3, 4, 5, 9, 30, 80, 150]))
        for _ in range(rng.choice([2, 10, 40])):
            own = list(base)
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(own) + 1)
                own[at : at + rng.randrange(2)] = [rng.choice(words)] * rng.randrange(3)
            if group % 2:
                base = own or base
            out.append((number, " ".join(own), None))
            number += 1
    passage = rng.choices(words, k=60)
    for _ in range(60):
        out.append((number, " ".join([*rng.choices(words, k=rng.randrange(14)), *passage, *rng.choices(words, k=rng.randrange(14))]), None))
        number += 1
    return out + [(number + i, t + " at the end", None) for i, (_, t, _) in enumerate(texts[:20]) if t]


@pytest.mark.parametrize(("percent", "width", "block", "shingles"), [(85, 4, 4096, 1 << 20), (85, 4, 16, 1500), (60, 2, 30, 4000)])
def test_ngram_groups(spark, docs, percent, width, block, shingles):
    rows = docs + near_copies(random.Random(percent + block), docs[30:])
    got = Counter(tuple(r) for r in ngram_join.components(frame(spark, rows), percent, width, block=block, block_shingles=shingles).collect())
    want = groups_by_hand(rows, percent, width)
    assert got == want
    assert max(Counter(c for (_, n, c), k in want.items() if n).values()) > 5


def test_ngram_groups_of_nothing(spark):
    assert ngram_join.components(frame(spark, [])).collect() == []
    assert [tuple(r) for r in ngram_join.components(frame(spark, [(1, None, None)])).collect()] == [(1, 0, 1)]


@pytest.mark.parametrize("percent", [50, 85, 100])
def test_divide_skip(percent):
    """The search's connections are those of all pairs, whatever the order, the main group and the skips do."""
    rng = np.random.default_rng(percent)
    for _ in range(60):
        base = [rng.choice(400, rng.integers(1, 60), replace=False) for _ in range(3)]
        sets = {}
        for i in range(rng.integers(2, 40)):
            own = set(base[rng.integers(3)].tolist())
            for _ in range(rng.integers(0, 8)):
                own ^= {int(rng.integers(400))}
            if own:
                sets[bytes([i])] = np.array(sorted(own), np.uint64)
        names = list(sets)
        cut = rng.integers(0, len(names) + 1) if rng.integers(2) else len(names)
        index, queries = {k: sets[k] for k in names[:cut]}, {k: sets[k] for k in names[cut:]}
        parent = {k: k for k in names}
        whole = dict(parent)

        def root(p, k):
            while p[k] != k:
                k = p[k]
            return k

        for a, b in ngram_join.links_of(index, queries, percent):
            n = len(np.intersect1d(sets[a], sets[b]))
            assert 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)
            parent[root(parent, a)] = root(parent, b)
        for i, a in enumerate(names):
            for b in names[:i]:
                n = len(np.intersect1d(sets[a], sets[b]))
                if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n) and (b in index or a in index):
                    whole[root(whole, a)] = root(whole, b)
        same = lambda p: {(a, b) for a in names for b in names if root(p, a) == root(p, b)}
        assert same(parent) == same(whole)


def infill_by_hand(i, text, rate=90, first=20):
    text = text or ""
    n, digest = len(text), hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return i, n, "plain", None, None, text
    if h[3] % 100 < first:
        return i, n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return i, n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def test_infill(spark, docs):
    awkward = [(20_000 + i, t, None) for i, t in enumerate(["<" * 50, "<P", "<S> ", "é<" + "<P" * 9, "🙂" * 5000, "é" * 255 + "<P>" + "é" * 900, "a>" * 3000, "<M"] * 12)]
    rows = docs + awkward
    out = infill.transform(frame(spark, rows)).withColumn("back", infill.restored("output", "form")).collect()
    assert Counter(tuple(r)[:6] for r in out) == Counter(infill_by_hand(i, t) for i, t, _ in rows)
    assert Counter((r.doc_id, r.back) for r in out) == Counter((i, t or "") for i, t, _ in rows)
    assert {r.form for r in out} == {"plain", "psm", "spm"} and infill.transform(frame(spark, [])).collect() == []


def test_chunks_are_shared_and_summed_once():
    rng = random.Random(2)
    shared = "".join(rng.choice("abc é🙂<PSM> ") for _ in range(40_000)).replace("<P>", "").replace("<S>", "").replace("<M>", "")
    own = infill.Summaries()
    infill.infilled(("x" * 777 + shared).encode(), "1", own)
    before = len(own.kept)
    infill.infilled(("yy" * 999 + shared + "tail").encode(), "2", own)
    assert own.found > 0.8 * before and len(own.kept) < 1.4 * before
    for chunk, (n, first, last, inside) in own.kept.items():
        assert n == sum(b & 0xC0 != 0x80 for b in chunk) and chunk.startswith(first) and chunk.endswith(last) and not inside


def test_chunks_cover_and_sentinels_across_them_are_found():
    rng = random.Random(3)
    for _ in range(40):
        data = bytes(rng.choice(b"<PSM>ab") for _ in range(rng.randrange(9000)))
        for kind in (data, data.replace(b"<P>", b"").replace(b"<S>", b"").replace(b"<M>", b"")):
            ends = infill.chunk_ends(kind)
            assert ends == sorted(set(ends)) and (not kind or ends[-1] == len(kind)) and all(b - a <= infill.MOST for a, b in zip([0, *ends], ends))
            own = infill.Summaries()
            parts = [own.of(kind[a:b]) for a, b in zip([0, *ends], ends)]
            assert own.marked(parts) == any(m in kind for m in own.marks)
    one = infill.Summaries()
    assert one.marked([one.of(b"<"), one.of(b"P"), one.of(b">")]) and not one.marked([one.of(b"<"), one.of(b"P"), one.of(b"x")])
