"""The operators against brute force, the libraries themselves or exact round trips, on real and on awkward rows."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from tidemark.llm import bpe, chain_dedup, decontam, fingerprint, html_text, langid, line_dedup, simhash, suffix_dedup, token_counts
from tidemark.llm.common import connected_components, prepare
from tidemark.llm.queries import byte_bpe, tokenizer_file

LONG = " ".join(f"word{i % 977} the {i * i % 31}" for i in range(20_000))
AWKWARD = [
    (1, None, "a"), (2, "", "a"), (3, "x", None), (4, "   \n\n \t ", "b"), (5, "Ünïcödé ĀŁ 日本語 한국 🙂👍🏽 é İSTANBUL ß", "a"),
    (6, "<|endoftext|> and <|startoftext|><|endoftext|>", "a"), (7, "De " * 700, "b"), (8, "De " * 700, "b"), (8, "De " * 700, "b"),
    (9, LONG, "a"), (10, LONG[:40_000] + " and then something else " + LONG[40_000:], "c"), (11, "\x00\x01\u0085 ᠎ a b", "a"), (None, "no id here, but words " * 5, "a"),
    (12, "".join(map(chr, range(0x20, 0x3000))), "d"), (13, "'s 't it's IT'S 1234567 ½ ²", "a"), (14, "- - -- --- .5,5;", "e"),
]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    prepare(spark)
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()]


@pytest.fixture(scope="module")
def mixed(docs):
    return [*AWKWARD, *((i + 100, t, s) for i, t, s in docs)]


def frame(spark, rows, schema="doc_id long, text string, source string"):
    return prepare(spark).createDataFrame(rows, schema).repartition(3)


def test_bpe_is_tiktoken(spark, mixed):
    import tiktoken

    path, pattern = byte_bpe()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    got = Counter(tuple(r) for r in bpe.round_trip(frame(spark, mixed), path, pattern).collect())
    want = Counter()
    for i, t, _ in mixed:
        ids = library.encode_ordinary(t or "")
        want[(i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert got == want


def test_bpe_offsets_and_split_characters(spark):
    path, pattern = byte_bpe()
    rows = [(1, "Grüße 🙂 日本語 the end", "a"), (2, None, "a")]
    out = {r.doc_id: r for r in bpe.encode(frame(spark, rows), path, pattern).collect()}
    text, row = rows[0][1], out[1]
    assert row.char_start[0] == 0 and row.char_end[-1] == len(text) and all(a < b for a, b in zip(row.char_start, row.char_end))
    own = bpe.codec(path, pattern)
    for i, a, b in zip(row.ids, row.char_start, row.char_end):
        assert own.table[i] in text[a:b].encode()
    assert out[2].n_tokens == 0 and out[2].ids == []
    cut = spark.createDataFrame([(1, row.ids[:4]), (2, None)], "doc_id long, ids array<int>")
    back = {r.doc_id: r for r in bpe.decode(cut, path, pattern).collect()}
    assert bytes(back[1].decoded) == b"".join(own.table[i] for i in row.ids[:4]) and back[2].text == ""


def test_suffix_dedup(spark, docs, monkeypatch):
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(400))
    planted = [(1000 + i, "".join(rng.choice("ijklmnop ") for _ in range(rng.randrange(200))) + passage[rng.randrange(50) :] + "".join(rng.choice("qrst ") for _ in range(90)), "z") for i in range(60)]
    rows = AWKWARD + [(i + 100, t, s) for i, t, s in docs[:120]] + planted
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 30_000)
    first = {}
    known = sorted((i, (t or "").encode()) for i, t, _ in rows if i is not None)
    for i, t in known:
        for a in range(len(t) - 49):
            first.setdefault(t[a : a + 50], i)
    want = Counter()
    for i, t, _ in rows:
        t = (t or "").encode()
        marks = bytearray(len(t))
        for a in range(len(t) - 49):
            if i is not None and first[t[a : a + 50]] < i:
                marks[a : a + 50] = b"\1" * 50
        want[(i, len(t), bytes(x for x, m in zip(t, marks) if not m), tuple(m.start() for m in re.finditer(b"\1+", bytes(marks))))] += 1
    got = Counter((r.doc_id, r.n_bytes, bytes(r.kept), tuple(r.starts)) for r in suffix_dedup.dedup_substrings(frame(spark, rows)).collect())
    assert got == want


def test_suffix_dedup_hot_anchors():
    """Windows that are dealt one by one give the same result as whole anchors."""
    import pyarrow as pa

    rng = random.Random(6)
    passage = b"".join(rng.choice([b"ab", b"cd", b" e"]) for _ in range(100)).decode()
    texts = ["".join(rng.choice("uvwxyz") for _ in range(120)) + passage + "".join(rng.choice("uvwxyz") for _ in range(120)) for _ in range(40)]
    results = []
    for hot in (1000, 2):
        suffix_dedup.HOT_DOCUMENTS = hot
        chunks = [pa.table({"id": list(range(c, 40, 4)), "text": texts[c::4], "chunk": [c] * 10}) for c in range(4)]
        sent = [r for c in chunks for r in suffix_dedup.send_anchors(8)(c).to_pylist()]
        named = grouped(sent, "bucket", suffix_dedup.name_repeated)
        runs = [r for i, c in enumerate(chunks) for r in suffix_dedup.send_runs(8)(c, rows_of([x for x in named if x["chunk"] == i])).to_pylist()]
        gone = grouped(runs, "bucket", suffix_dedup.combine)
        results.append([r for i, c in enumerate(chunks) for r in suffix_dedup.cut_out(c, rows_of([x for x in gone if x["chunk"] == i])).to_pylist()])
    suffix_dedup.HOT_DOCUMENTS = 1000
    assert results[0] == results[1] and sum(bool(r["starts"]) for r in results[0]) == 39


def rows_of(rows):
    import pyarrow as pa

    return pa.Table.from_pylist(rows) if rows else pa.table({"blob": pa.array([], pa.binary())})


def grouped(rows, by, f):
    groups = defaultdict(list)
    for r in rows:
        groups[r[by]].append(r)
    return [x for g in groups.values() for x in f(rows_of(g)).to_pylist()]


def test_loser_tree_sorts_and_measures():
    import numpy as np

    rng = np.random.default_rng(3)
    runs, everything = [], []
    for number in range(7):
        keys = np.zeros((rng.integers(1, 60), suffix_dedup.KEY), np.uint8)
        keys[:] = rng.integers(1, 3, keys.shape)
        keys[:, :70] = rng.integers(1, 3, (1, 70)) if number % 2 else 1
        order, _ = suffix_dedup.distinct_keys(keys)
        keys = keys[order]
        everything += [bytes(k) for k in keys]
        runs.append(suffix_dedup.Run(number, *suffix_dedup.front_code(keys)))
    out = list(suffix_dedup.loser_tree(runs))
    assert [x[2] for x in out] == sorted(everything)
    for a, b in zip(out, out[1:]):
        assert b[3] == next((i for i, (x, y) in enumerate(zip(a[2], b[2])) if x != y), suffix_dedup.KEY)


def test_fuzzy_passages(spark, docs):
    rng = random.Random(1)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage = words(70)
    fuzzy = list(passage)
    fuzzy[20] = "changed"
    del fuzzy[45]
    rows = [(1, " ".join(words(100) + passage + words(50)), "a"), (2, " ".join(words(30) + passage), "a"), (3, " ".join(fuzzy + words(200)), "a"), (4, " ".join(words(300)), "a"), (5, " ".join(passage[:40]), "a"), (6, None, "a"), (7, "", "b"), (None, " ".join(passage), "a"), (8, " ".join(words(10)).upper(), "c")]
    got = {(r.doc_id, r.first_doc_id): r for r in chain_dedup.passages(frame(spark, rows)).collect()}
    assert set(got) == {(2, 1), (3, 1), (3, 2)}  # the first document and the one just before
    before = got[(3, 2)]
    assert (before.word_start, before.word_end, before.first_word_start, before.first_word_end) == (0, 69, 30, 100)
    exact = got[(2, 1)]
    assert (exact.word_start, exact.word_end, exact.first_word_start, exact.first_word_end, exact.identity) == (30, 100, 100, 170, 1.0)
    near = got[(3, 1)]
    assert (near.word_start, near.word_end, near.first_word_start, near.first_word_end) == (0, 69, 100, 170) and 0.96 < near.identity < 1


def test_passages_of_text_that_repeats_itself(spark):
    """Documents that share 50 words of such text with an earlier one have a passage, however often its k-mers stand elsewhere."""
    rng = random.Random(12)
    rows = [(i, f"a{i} " + " ".join(["and"] * (20 + i)) + f" b{i} " + " ".join(["x", "y", "z"] * (5 + i // 3)), "a") for i in range(40)]
    rows += [(100 + i, " ".join(" ".join([rng.choice("pqr")] * rng.randrange(5, 60)) for _ in range(rng.randrange(1, 9))), "a") for i in range(60)]
    seen, expected = {}, set()
    for key, text, _ in rows:
        words = text.split()
        own = {tuple(words[i : i + 50]) for i in range(len(words) - 49)}
        if any(seen.setdefault(w, key) != key for w in own):
            expected.add(key)
    out = chain_dedup.passages(frame(spark, rows)).collect()
    assert len(expected) > 40 and expected <= {r.doc_id for r in out}
    texts = {key: text.split() for key, text, _ in rows}
    for r in out:
        assert r.first_doc_id < r.doc_id and r.word_end - r.word_start >= 50 and r.first_word_end - r.first_word_start >= 50
        if r.identity == 1:
            assert texts[r.doc_id][r.word_start : r.word_end] == texts[r.first_doc_id][r.first_word_start : r.first_word_end]


def test_passages_against_brute_force(spark, docs):
    """Every document with 50 words of an earlier one has a passage; every passage is as alike as it says, by edit distance."""
    texts = {i: [w.decode() for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())] for i, t, _ in docs}
    seen, expected = {}, set()
    for i in sorted(texts):
        own = {tuple(texts[i][a : a + 50]) for a in range(len(texts[i]) - 49)}
        if any(seen.setdefault(w, i) != i for w in own):
            expected.add(i)
    out = chain_dedup.passages(frame(spark, docs)).collect()
    assert expected and expected <= {r.doc_id for r in out}
    for r in out:
        a, b = texts[r.doc_id][r.word_start : r.word_end], texts[r.first_doc_id][r.first_word_start : r.first_word_end]
        row = list(range(len(b) + 1))
        for i, x in enumerate(a if a != b else [], 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        wrong = 0 if a == b else row[-1]
        assert r.first_doc_id < r.doc_id and min(len(a), len(b)) >= 50 and 1 - wrong / max(len(a), len(b)) >= r.identity - 1e-5 and r.identity >= 0.8


def test_passages_of_hot_seeds(spark, monkeypatch):
    """Dealing hot seeds over partitions changes no link to the first document, and loses none."""
    rng = random.Random(8)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    shared, rarer = words(70), words(60)
    rows = [(i, f"{words(rng.randrange(20))} {shared} {words(15)} {rarer if i in (5, 30) else words(9)}", "a") for i in range(40)]
    key = lambda r: (r.doc_id, r.word_start, r.word_end, r.first_word_start, r.first_word_end, r.identity)
    plain = {key(r) for r in chain_dedup.passages(frame(spark, rows)).collect() if r.first_doc_id == 0}
    monkeypatch.setattr(chain_dedup, "HOT_SAMPLE", 1.0)
    monkeypatch.setattr(chain_dedup, "HOT_ROWS", 10)
    assert chain_dedup.hot_seeds(frame(spark, rows).selectExpr("doc_id AS doc", "text"))
    out = chain_dedup.passages(frame(spark, rows)).collect()
    assert {key(r) for r in out if r.first_doc_id == 0} == plain and {k[0] for k in plain} == set(range(1, 40))
    assert all(r.first_doc_id < r.doc_id for r in out) and any((r.doc_id, r.first_doc_id) == (30, 5) for r in out)


@pytest.mark.parametrize("parts", ["4", "7"])
def test_passages_do_not_depend_on_the_sample(spark, monkeypatch, parts):
    """All pairs are the same, whether seeds count as hot or not and over however many partitions they are dealt."""
    rng = random.Random(9)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    shared, rarer = words(70), words(60)
    rows = [(i, f"{words(rng.randrange(20))} {shared} {rarer if i % 13 == 5 else words(9)}", "a") for i in range(60)]
    plain = {tuple(r) for r in chain_dedup.passages(frame(spark, rows)).collect()}
    assert {(r[0], r[1]) for r in plain} >= {(i, j) for i in range(1, 60) for j in (0, i - 1)}
    monkeypatch.setattr(chain_dedup, "HOT_SAMPLE", 1.0)
    monkeypatch.setattr(chain_dedup, "HOT_ROWS", 5)
    monkeypatch.setattr(chain_dedup, "HOT_SHARE", 8)
    own = {"spark.sql.shuffle.partitions": parts, "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    usual = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        assert {tuple(r) for r in chain_dedup.passages(frame(spark, rows)).collect()} == plain
    finally:
        for k, v in usual.items():
            spark.conf.set(k, v)


def test_passages_apart_in_one_pair(spark):
    """Each passage that a pair of documents shares is found, however long the one before and whatever lies between."""
    rng = random.Random(21)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows, want = [], set()
    for i, (first, gap, second) in enumerate(((100, 100, 100), (100, 80, 100), (100, 300, 100), (300, 500, 300), (200, 80, 600), (60, 60, 60), (70, 30, 70))):
        a, b = words(first), words(second)
        rows += [(2 * i, " ".join(a + words(gap) + b), "a"), (2 * i + 1, " ".join(a + words(gap) + b), "a")]
        want |= {(2 * i + 1, 2 * i, 0, first), (2 * i + 1, 2 * i, first + gap, first + gap + second)}
    out = chain_dedup.passages(frame(spark, rows)).collect()
    met = {w for w in want for r in out if (r.doc_id, r.first_doc_id) == w[:2] and r.word_start <= w[2] and r.word_end >= w[3]}
    assert met == want


def test_passages_whose_parts_stand_singly(spark):
    """A run of lines is met as a whole, though each line stands alone in documents before its first holder and between."""
    rng = random.Random(31)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    rows, want = [], {}
    for trial, sizes in enumerate([(40, 40), (35, 30), (25, 25, 25), (20, 20, 21)] * 10):
        lines = [words(n) for n in sizes]
        alone = lambda: [f"{words(30)} {line} {words(30)}" for line in lines]
        texts = [*alone(), " ".join([words(30), *lines, words(30)]), *alone(), " ".join([words(9), *lines, words(40)])]
        rows += [(100 * trial + i, text, "a") for i, text in enumerate(texts)]
        want[100 * trial + len(texts) - 1] = (100 * trial + len(lines), 9, 9 + sum(sizes))
    out = chain_dedup.passages(frame(spark, rows)).collect()
    assert {(r.doc_id, (r.first_doc_id, r.word_start, r.word_end)) for r in out} == set(want.items())


def test_every_passage_of_changed_lines_that_stand_singly(spark):
    """A changed passage whose seeds all stand in documents before its first holder, and between, is met with every=True; all that the star finds is, too."""
    rng = random.Random(41)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows, want = [], set()
    for trial in range(12):
        lines = [words(12) for _ in range(6)]
        alone = lambda: [words(20) + line[:11] + words(20) for line in lines]
        changed = [w for line in lines for w in line[:11] + words(1)]
        texts = [*alone(), words(9) + [w for line in lines for w in line] + words(9), *alone(), words(7) + changed + words(30)]
        rows += [(100 * trial + i, " ".join(text), "a") for i, text in enumerate(texts)]
        want.add((100 * trial + 13, 100 * trial + 6))
    pairs = lambda **how: {(r.doc_id, r.first_doc_id) for r in chain_dedup.passages(frame(spark, rows), **how).collect()}
    star = pairs()
    assert star <= pairs(every=True) == want


def test_the_query_meets_all_earlier_documents(spark, tmp_path, monkeypatch):
    """Changed passages whose seeds all stand singly elsewhere are found by the query, hot seeds' pieces and all."""
    from tidemark.llm.queries import QUERIES

    rng = random.Random(43)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows, want = [], set()
    for trial in range(6):
        lines = [words(12) for _ in range(6)]
        alone = lambda: [words(20) + line[:11] + words(20) for line in lines]
        changed = [w for line in lines for w in line[:11] + words(1)]
        texts = [*alone(), words(9) + [w for line in lines for w in line] + words(9), *alone(), words(7) + changed + words(30)]
        rows += [(100 * trial + i, " ".join(text), "a") for i, text in enumerate(texts)]
        want.add((100 * trial + 13, 100 * trial + 6))
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    found = lambda: {(r.doc_id, r.first_doc_id) for r in QUERIES["op3_fuzzy_passages"](spark, str(tmp_path)).collect()}
    assert found() == want
    docs = frame(spark, rows).selectExpr("doc_id AS doc", "text")
    matches = lambda: Counter(tuple(r) for r in chain_dedup.all_matches(docs).collect())
    whole = matches()
    for name, value in (("HOT_SAMPLE", 1.0), ("HOT_ROWS", 2), ("PIECE_PAIRS", 1), ("PAIRS_AT_ONCE", 3)):
        monkeypatch.setattr(chain_dedup, name, value)
    assert max(chain_dedup.hot_pairs(docs).values()) > 1 and matches() == whole and found() == want
    plain, places = {}, Counter()
    for doc, text, _ in sorted(rows):
        _, seed, place = chain_dedup.seeds([text.encode().split()])
        for s, p in zip(seed.tolist(), place.tolist()):
            places.update((doc, other, p, q) for other, q in plain.get(s, ()) if other != doc)
            plain.setdefault(s, []).append((doc, p))
    assert whole == places


@pytest.mark.parametrize(("span", "many"), [(40, 12), (300, 25), (300, 120), (2000, 150)])
def test_chains_are_the_best(span, many):
    """Against all pairs of matches, gaps over the limit among them."""
    rng = random.Random(2)
    for _ in range(40):
        matches = sorted({(rng.randrange(span), rng.randrange(span)) for _ in range(many)})
        if many > 100:
            shift = rng.randrange(span)
            matches = sorted({*matches, *((p, p + shift) for p in range(0, span, 7))})
        best = [0.0] * len(matches)
        near = lambda x, y: 0 < x - y <= chain_dedup.MAX_GAP
        for i, (p, q) in enumerate(matches):
            best[i] = chain_dedup.SEED_WORDS + max([0.0, *(best[j] - chain_dedup.GAP_COST * (p - a + q - b) for j, (a, b) in enumerate(matches[:i]) if near(p, a) and near(q, b))])
        own = chain_dedup.chain(matches)
        assert sorted(m for c in own for m in c) == matches
        assert all(near(d, b) and near(c, a) for x in own for (a, b), (c, d) in zip(x, x[1:]))
        top = own[0]
        score = chain_dedup.SEED_WORDS * len(top) - chain_dedup.GAP_COST * (top[-1][0] - top[0][0] + top[-1][1] - top[0][1])
        assert score == pytest.approx(max(best))


def test_recall_of_changed_passages(spark):
    """Of passages with changed words, nine in ten are found and over, for each length and rate. By brute force only those
    count that lie from one equal word to another within both bounds, and all others must not be found."""
    rng = random.Random(41)
    words = lambda n: [f"w{rng.randrange(30_000)}" for _ in range(n)]
    rows, cases = [], {}
    for size in (50, 60, 80, 120):
        for rate in (0.03, 0.1, 0.17, 0.2):
            for _ in range(80):
                own = words(size)
                other = list(own)
                changed = set(rng.sample(range(size), int(size * rate)))
                for i in changed:
                    other[i] = f"x{rng.randrange(10**6)}"
                equal = [i for i in range(size) if i not in changed]
                within = any(b - a + 1 >= 50 and 5 * (j - i + 1) >= 4 * (b - a + 1) for i, a in enumerate(equal) for j, b in enumerate(equal[i:], i))
                cases.setdefault((size, rate), []).append((len(rows) + 1, within))
                rows += [(len(rows), " ".join(words(60) + own + words(40)), "a"), (len(rows) + 1, " ".join(words(30) + other + words(70)), "a")]
    found = {r.doc_id: r.first_doc_id for r in chain_dedup.passages(frame(spark, rows)).collect()}
    assert all(i - 1 == first for i, first in found.items()) and not any(i in found for own in cases.values() for i, within in own if not within)
    recall = {case: sum(i in found for i, within in own if within) / sum(within for _, within in own) for case, own in cases.items()}
    print(recall)
    assert min(recall.values()) >= 0.9


def test_token_counts(spark, mixed):
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    want = Counter()
    for i, t, _ in mixed:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want[(i, len((t or "").encode()), n, n > 2048)] += 1
    assert Counter(tuple(r) for r in token_counts.token_counts(frame(spark, mixed), path).collect()) == want


def test_token_counts_row_for_row(spark, monkeypatch):
    """Clashing and null ids give a row each, whatever the texts; pre-tokens dealt as hot count alike."""
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = [(1, "one text", "a"), (1, "another, longer text", "a"), (None, "x y", "a"), (None, "x y", "a"), (None, None, "b"), (2, "", "a"), (3, "same", "a"), (3, "same", "a"), (3, "other one", "a"), (4, "same", "a")]
    rows += [(10 + i, "the same words of all", "a") for i in range(200)]
    want = Counter((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids), False) for i, t, _ in rows)
    assert Counter(tuple(r) for r in token_counts.token_counts(frame(spark, rows), path).collect()) == want
    monkeypatch.setattr(token_counts, "BROADCAST_IDS", 0)
    assert Counter(tuple(r) for r in token_counts.token_counts(frame(spark, rows), path).collect()) == want


def test_line_dedup(spark, mixed):
    rows = mixed + [(500 + i, f"Home | About\nown line {i}\n\n  Home | About ", "a") for i in range(20)] + [(600, "Home | About", "q")]
    pages, total = defaultdict(set), Counter()
    for n, (_, t, s) in enumerate(rows):
        total[s] += 1
        for line in (t or "").split("\n") if t is not None else []:
            pages[(s, line.strip(" "))].add(n)
    gone = {k for k, v in pages.items() if k[1] and len(v) > 0.1 * total[k[0]] and len(v) >= 3}
    want = Counter((i, None if t is None else "\n".join(x for x in t.split("\n") if (s, x.strip(" ")) not in gone), s) for i, t, s in rows)
    got = Counter(tuple(r) for r in line_dedup.drop_boilerplate(frame(spark, rows), 0.1, 3).collect())
    assert got == want and ("a", "Home | About") in gone


def brute_fingerprint(text):
    words = [w.decode() for w in re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def test_suffix_dedup_sends_no_short_blobs(spark, docs, monkeypatch):
    import numpy as np

    # The blobs between chunks and buckets number by the text, not by the partitions squared, and texts travel compressed.
    asked = []
    monkeypatch.setattr(suffix_dedup, "send_runs", lambda n, real=suffix_dedup.send_runs: asked.append(n) or real(n))
    spark.conf.set("spark.sql.shuffle.partitions", "600")
    try:
        out = suffix_dedup.dedup_substrings(frame(spark, docs[:20]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert asked == [64] and "squeeze" in out._jdf.queryExecution().optimizedPlan().toString()
    keys = np.sort(np.frombuffer(random.Random(3).randbytes(500 * suffix_dedup.KEY), np.uint8).reshape(-1, suffix_dedup.KEY) % 3, axis=0)
    keys[:, -2:] = [[1 + i % 20, 21 + i % 10] for i in range(len(keys))]
    keys[:, :-2][~suffix_dedup.within(keys[:, -2:])] = 0
    keys = keys[suffix_dedup.distinct_keys(keys)[0]]
    shared, places, sent = (x.copy() for x in suffix_dedup.unpack(suffix_dedup.pack(*suffix_dedup.run_of(keys)), "u1", "u1", "u1"))
    for got, want in zip((shared, suffix_dedup.rests(shared, places, sent)), suffix_dedup.front_code(keys), strict=True):
        assert (got == want).all()
    numbers = np.sort(np.random.default_rng(2).integers(0, 1 << 32, 5000, dtype=np.uint32))
    assert (np.cumsum(suffix_dedup.unpack(suffix_dedup.pack(suffix_dedup.steps(numbers)), "<u4")[0], dtype=np.uint32) == numbers).all()
    assert len(suffix_dedup.pack(suffix_dedup.steps(numbers))) < 3.2 * len(numbers)


def test_simhash(spark, mixed):
    short = [(i, (t or "")[:3000] if t is not None else t, s) for i, t, s in mixed if i is not None]
    prints = {i: brute_fingerprint(t) for i, t, _ in short}
    want = brute_components(prints, [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3])
    got = Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.groups(frame(spark, short)).collect())
    assert got == Counter((i, prints[i], want[i]) for i, _, _ in short)
    kept = Counter(r.doc_id for r in simhash.keep_one(frame(spark, short)).collect())
    assert kept == Counter({i: 1 for i in prints if want[i] == i})


def test_simhash_rows_without_an_id(spark, monkeypatch):
    """Rows with a null id have the component of their links and never name one; alone they have none. Of unlike rows with
    one id, the same one stays however they are dealt. Fingerprints of many rows give what others give."""
    rows = [(5, "one two three four", "a"), (None, "one two three four", "b"), (None, "quite another text here", "a"), (7, None, "a"), (None, "", "b"), (9, "one two three four", "x"), (5, "one two three four", "y"), (5, "one two three four", "y")]
    for hot in (1, 1024):
        monkeypatch.setattr(simhash, "HOT_PRINTS", hot)
        got = Counter((r.doc_id, r.component_id) for r in simhash.groups(frame(spark, rows)).collect())
        assert got == Counter([(5, 5), (5, 5), (5, 5), (None, 5), (9, 5), (None, None), (7, 7), (None, 7)])
    kept = [Counter(tuple(r) for r in simhash.keep_one(frame(spark, x)).collect()) for x in (rows, rows[::-1])]
    assert kept[0] == kept[1] and Counter(r[0] for r in kept[0].elements()) == Counter({None: 3, 5: 1, 7: 1})


def test_simhash_variants_are_not_broadcast(spark):
    df = spark.createDataFrame([(i * 0x9E3779B97F4A7C15 % (1 << 63), i) for i in range(500)], "fp long, rep long").groupBy("fp").agg({"rep": "min"}).withColumnRenamed("min(rep)", "rep")
    found = simhash.links(df)
    found.collect()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_simhash_links_all_up_to_three_bits(spark):
    rng = random.Random(4)
    prints = {}
    for _ in range(20):
        base = rng.getrandbits(64)
        for _ in range(8):
            prints[len(prints)] = base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6)))
    distinct = {}
    for i, p in prints.items():
        distinct.setdefault(p, i)
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    df = prepare(spark).createDataFrame([(signed(p), i) for p, i in distinct.items()], "fp long, rep long")
    got = Counter(tuple(sorted(r)) for r in simhash.links(df).collect())
    assert got == Counter((a, b) for p, a in distinct.items() for q, b in distinct.items() if a < b and (p ^ q).bit_count() <= 3)


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(5001, 5050)]
    nodes = {n for e in edges for n in e if e[0] != e[1]}
    got = {r.node: r.component for r in connected_components(prepare(spark).createDataFrame(edges, "a long, b long")).collect()}
    want = brute_components(nodes, [e for e in edges if e[0] != e[1]])
    assert {n: got.get(n, n) for n in nodes} == want


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies, many.</div>
<div id="content"><article><h1>Title &amp; more</h1><p>First   paragraph, with <b>bold</b>&nbsp;text, and commas.<p>Second <a href="x">linked</a> one, longer than the first; it goes on.
<ul><li>An item</li><li>Another</ul><div class="ad">Buy now, really.</div></article></div><aside>Related, things</aside><!-- <p>hidden</p> -->
<section class="comments"><p>A reader says, well, this and that, at length.</p></section><form><p>Search, please</p><input></form><footer>&copy; 2024</footer></body></html>"""


def test_html(spark):
    rows = [(1, "u", PAGE), (2, "u", None), (3, "u", ""), (4, None, "plain text only"), (5, "u", "<p>" * 3000 + "deep"), (6, "u", "<div><p>cut off &am"), (7, "u", "<script>x"), (None, "u", "<article><p>A<br>b</p></article>")]
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract(prepare(spark).createDataFrame(rows, "page_id long, url string, html string")).collect()}
    text = "Title & more\nFirst paragraph, with bold text, and commas.\nSecond linked one, longer than the first; it goes on.\nAn item\nAnother"
    assert got == {1: (text, len(text)), 2: ("", 0), 3: ("", 0), 4: ("plain text only", 15), 5: ("deep", 4), 6: ("cut off &am", 11), 7: ("", 0), None: ("A b", 3)}


@pytest.mark.parametrize("name", ["site has-sidebar", "overflow-hidden", "no-comments", "with-nav", "widget"])
def test_html_in_a_wrapper(name):
    """A wrapper's name leaves out no page, short headings and paragraphs beside the body stay, and what has such names goes."""
    body = "".join(f"<p>Paragraph {i} of the story, with words, and commas, that go on for a while.</p>" for i in range(6))
    page = f"<body><div class='{name}'><div class='cookie-bar'>We use cookies.</div><h1>A title</h1><p>Short start.</p><div class=body>{body}</div><div id=site-sidebar>Other things</div></div></body>"
    text = html_text.main_text(page).split("\n")
    assert text[:2] == ["A title", "Short start."] and len(text) == 8


HTML_PROBES = [
    ('<a href="/hidden-gems">the guide</a>', "the guide"), ('<a href="/x?id=ad">x</a>', "x"), ('<p title="a hidden gem">t</p>', "t"), ('<p data-hidden="false">t</p>', "t"), ("<p data-x='class=ad'>t</p>", "t"),
    ("<p hidden>no</p><p>t</p>", "t"), ("<p aria-hidden=true>no</p><p>t</p>", "t"), ("<p style='display: none'>no</p><p>t</p>", "t"), ("<div class=ad>Buy, now, more words than the text has.</div><p>t</p>", "t"),
    ('<div class="layout has-sidebar"><article><p>T, and more</p></article></div>', "T, and more"), ('<div class="post no-comments"><p>T</p></div>', "T"), ('<p class="comment-on-policy">T</p>', "T"),
    ("<main><article><h1>A</h1><p>One, two, three.</p></article><article><h1>B</h1><p>One, two, four.</p></article></main>", "A\nOne, two, three.\nB\nOne, two, four."),
    ("<div class=post><div class=head><h1>Title</h1></div><div class=w><div class=body><p>Long, text.</p><p>Long, text.</p></div></div></div>", "Title\nLong, text.\nLong, text."),
    ("<article><section><h2>S</h2><p>Short.</p></section><section>" + "<p>Long, long text.</p>" * 9 + "</section></article>", "S\nShort." + "\nLong, long text." * 9),
    ("<div><section><h2>S</h2><p>Short.</p></section><section>" + "<p>Long, long text.</p>" * 9 + "</section><ul><li><a href=x>Related</a></li><li><a href=y>links</a></li></ul></div>", "S\nShort." + "\nLong, long text." * 9),
]


@pytest.mark.parametrize("name", ["reader-comments", "user_comments", "comment-thread", "disqus_thread", "comment-content", "related-articles", "shop-main-nav", "gdpr-cookie-bar", "story-sidebar", "weekly-newsletter", "ad-slot", "site-footer"])
@pytest.mark.parametrize("attribute", ["class", "id"])
@pytest.mark.parametrize("at", ["inside", "beside"])
def test_html_names_out(name, attribute, at):
    extra = f"<section {attribute}='{name}'><p>Said, and done, by others, at some length.</p></section>"
    body = "<h1>A title</h1><p>One, two, three.</p>" + "<p>A paragraph, with words.</p>" * 4
    page = f"<body><article>{body}{extra}</article></body>" if at == "inside" else f"<body><div><div>{body}</div>{extra}</div></body>"
    assert html_text.main_text(page) == "\n".join(["A title", "One, two, three."] + ["A paragraph, with words."] * 4)


@pytest.mark.parametrize("name", ["entry-header", "article-header", "post_header", "how-to-hide-comments", "no-sidebar", "page-with-sidebar", "commentary", "header-hidden-gems", "footnotes", "navy"])
def test_html_names_in(name):
    page = f"<body><article><div class='{name}'><h1>A title</h1></div><p>One, two, three.</p></article></body>"
    assert html_text.main_text(page) == "A title\nOne, two, three."


@pytest.mark.parametrize(("page", "want"), HTML_PROBES)
def test_html_probes(page, want):
    assert html_text.main_text(page) == want


@pytest.mark.parametrize("tag", ["article", "div", "section"])
def test_html_on_pages(spark, sf_dir, tag):
    """The scoring finds the text whatever the element around it is called."""
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    import html as h

    for r in rows:
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)
        want = [re.sub(r"\s+", " ", h.unescape(re.sub(r"<[^>]*>", " ", p))).strip() for p in re.split(r"</?(?:p|h1)>", body[1])]
        page = r.html.replace("<article", f"<{tag}").replace("</article", f"</{tag}")
        assert html_text.main_text(page) == "\n".join(filter(None, want))


def test_html_rows(spark):
    """Repeated rows get a result each, extra columns with clashing names do no harm, and an empty table gives none."""
    df = prepare(spark).createDataFrame([(1, "u", "<p>a</p>", 5, "x"), (1, "u", "<p>a</p>", 6, "y"), (None, None, None, None, None)], "page_id long, url string, html string, n_chars int, text string")
    assert Counter(tuple(r) for r in html_text.extract(df).collect()) == Counter({(1, "u", "a", 1): 2, (None, None, "", 0): 1})
    assert html_text.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1, 2, 3, 4, 10])
def test_windows_by_their_rarest_words(size):
    """Anchors and comparing find the words and items that trying each window at each place finds."""
    rng = random.Random(size)
    for _ in range(300):
        letters = [b"a", b"b", b"c", b"d", b"e", b"f"][: rng.choice([2, 3, 6])]
        items = [(rng.choice([None, f"x{i}"]), rng.choice([None, b"", b" ".join(rng.choice(letters) for _ in range(rng.randrange(15)))])) for i in range(rng.randrange(5))]
        doc = [rng.choice([*letters, b"zz"]) for _ in range(rng.randrange(40))]
        marks, ids, want, found = bytearray(len(doc)), set(), bytearray(len(doc)), set()
        decontam.Windows(items, size).hits(doc, marks, ids)
        for item, text in items:
            own = (text or b"").split()
            for a in range(max(1, len(own) - size + 1)) if own else []:
                window = own[a : a + size]
                for p in range(len(doc) - len(window) + 1):
                    if doc[p : p + len(window)] == window:
                        want[p : p + len(window)] = b"\1" * len(window)
                        found.add(item)
        assert (marks, ids) == (want, found)


def test_decontamination(spark, docs, sf_dir):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()] + [(900, "short Item here"), (901, None), (902, " ,. "), (None, "an item without id but with words"), (900, "short Item here")]
    rows = [(1, "This is a SHORT, item HERE and an item without id but with words.", "a"), (2, None, "a"), (3, "...", "a"), *((i + 100, t, s) for i, t, s in docs)]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for a in range(max(1, len(w) - 9)) if w else []:
            windows[tuple(w[a : a + 10])].add(i)
    want = {}
    for i, t, _ in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if own := windows.get(tuple(w[a : a + n])):
                    hit |= set(range(a, a + n))
                    found |= own
        want[i] = (len(w), len(hit), sorted(str(x) for x in found if x is not None))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limit in (decontam.AUTOMATON_BYTES, 3000):
        got = {r.doc_id: r for r in decontam.contamination(frame(spark, rows), bench, limit=limit).collect()}
        assert {i: (r.n_words, r.n_hit, r["items"]) for i, r in got.items()} == want
        assert Counter(r.doc_id for r in decontam.drop_contaminated(frame(spark, rows), bench, limit=limit).collect()) == Counter(i for i, t, _ in rows if not want[i][1])
    first = got[1]
    assert [rows[0][1][s.start : s.end] for s in first.spans] == ["SHORT, item HERE", "an item without id but with words"]
    assert {r.doc_id for r in decontam.drop_contaminated(frame(spark, rows), bench).collect()} == {i for i, (_, n, _) in want.items() if not n}
    empty = bench.limit(0)
    assert decontam.contamination(frame(spark, rows), empty).filter("n_hit > 0").count() == 0
    again = [(None, rows[0][1], "a"), (None, rows[0][1], "a"), (None, None, "a"), (7, rows[0][1], "a"), (7, "clean", "a")]
    for limit in (decontam.AUTOMATON_BYTES, 3000):
        got = decontam.contamination(frame(spark, again), bench, limit=limit)
        assert Counter((r.doc_id, r.n_words, r.n_hit) for r in got.collect()) == Counter({(None, *want[1][:2]): 2, (None, 0, 0): 1, (7, *want[1][:2]): 1, (7, 1, 0): 1})
        assert got.columns == ["doc_id", "n_words", "n_hit", "items", "spans"] and decontam.contamination(frame(spark, []), bench, limit=limit).count() == 0


def test_one_automaton_at_a_time():
    """A Python worker that serves several parts of a benchmark holds the last one's automaton."""
    from types import SimpleNamespace

    for part in range(4):
        decontam.automaton(SimpleNamespace(value=(f"part {part}", [("i", b"a b c")])), 10)
        assert len(decontam._BUILT) == 1


def brute_chunks(text):
    """Digest to length, byte by byte: a rolling gear hash, of which older bytes drop out at the top, and the cut rules."""
    data, out, start, h = text.encode(), {}, 0, 0
    for end in range(1, len(data) + 1):
        h = ((h << 1) + int(fingerprint.GEAR[data[end - 1]])) % (1 << 32)
        size = end - start
        zeros = 32 - h.bit_length()
        cut = size >= 32 and zeros >= 7 if size <= 64 else False
        cut = cut or size >= 64 and zeros >= 4 or size == 256 or end == len(data)
        if cut:
            out[xxhash.xxh64_intdigest(data[start:end])] = size
            start = end
    return out


def test_fingerprints(spark, mixed):
    """Against chunks cut byte by byte; null ids first, rows with one id by their text."""
    rows = [(i, (t or "")[:20_000] if t is not None else None, s) for i, t, s in mixed] + [(None, "again no id", "b"), (20, "b", "a"), (20, "a", "a")]
    ordered = sorted((-1 if i is None else i, t or "") for i, t, _ in rows)
    want = Counter()
    for n, (i, t) in enumerate(ordered):
        following = ordered[(n + 1) % len(ordered)][1]
        half = len(t) // 2
        changed = t[: len(t) - half] + following[:half]
        own, other, near = brute_chunks(t), brute_chunks(changed), brute_chunks(following)
        like = lambda a, b: sum(n for d, n in a.items() if d in b) / sum(a.values()) if a and b else float(a == b)
        written = lambda x: ",".join(f"{d:016x}:{n}" for d, n in sorted(x.items()))
        want[(None if i < 0 else i, len(t), hashlib.sha256(changed.encode()).hexdigest(), written(own), written(other), like(own, other), like(own, near))] += 1
    assert Counter(tuple(r) for r in fingerprint.neighbours(frame(spark, rows)).collect()) == want


def test_chunks_resist_shifts():
    data = LONG.encode()
    sizes = [b - a for a, b in zip([0, *fingerprint.cuts(data)], fingerprint.cuts(data))]
    assert sum(sizes) == len(data) and max(sizes) <= fingerprint.MOST and min(sizes[:-1]) >= fingerprint.LEAST
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefghij ") for _ in range(20_000))
    assert fingerprint.likeness(fingerprint.chunks(text), fingerprint.chunks("shifted " + text)) > 0.95
    assert fingerprint.likeness({}, {}) == 1.0 and fingerprint.likeness({}, {1: 2}) == 0.0


def test_language(spark, sf_dir):
    df = prepare(spark).read.parquet("/root/testdata/sf0.01/documents.parquet")
    network = langid.fit(df)
    rows = langid.predict(df, network).join(df.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) > 0.97 * len(held) and all(0 <= r.score <= 1 for r in rows)
    odd = {r.doc_id: r for r in langid.predict(frame(spark, AWKWARD), network).collect()}
    signs = frame(spark, [(i, t, "a") for i, t in enumerate(["½", "² ①", "Ⅷ 12", "_", "ª", "é", "字"])])
    assert [r.lang_pred == "und" for r in sorted(langid.predict(signs, network).collect())] == [True] * 4 + [False] * 3
    assert [odd[i].lang_pred for i in (1, 2, 4, 14)] == ["und"] * 4 and odd[9].lang_pred != "und" and odd[None].held_out
    assert langid.fit(df.filter("lang IS NULL")) is None
    assert langid.predict(df.limit(3), None).filter("lang_pred = 'und'").count() == 3
    assert langid.accepted(frame(spark, AWKWARD).withColumn("keys", langid.F.lit(1)), network).filter("doc_id in (1, 2, 4, 14)").count() == 0


def test_network_gradients():
    import numpy as np

    s = langid.Settings(hidden=3)
    network = langid.Network.fresh(["a", "b"], s)
    network.w = {k: v.astype(np.float64) for k, v in network.w.items()}
    rng = np.random.default_rng(1)
    x, truth = rng.integers(0, 5, (4, 6)), np.array([0, 1, 0, 1])

    def loss():
        states = []
        for d, order in (("f", range(6)), ("b", range(5, -1, -1))):
            h, own = np.zeros((4, 3)), [None] * 6
            for t in order:
                h = network.gate(network.w[f"x{d}"][x[:, t]], h, d)[0]
                own[t] = h
            states.append(np.array(own))
        p = langid.softmax(np.concatenate(states, axis=2) @ network.w["out"] + network.w["bias"])
        return -np.log(p[:, np.arange(4), truth]).mean()

    grads = network.gradients(x, truth, 3)
    for name, at in (("xf", (2, 1)), ("xb", (3, 7)), ("uf", (1, 4)), ("ub", (0, 8)), ("cf", (2,)), ("out", (4, 1)), ("bias", (0,))):
        old, e = network.w[name][at], 1e-5
        network.w[name][at] = old + e
        up = loss()
        network.w[name][at] = old - e
        down = loss()
        network.w[name][at] = old
        assert grads[name][at] == pytest.approx((up - down) / (2 * e), rel=2e-2, abs=1e-6)


def test_empty_tables(spark):
    empty = frame(spark, [])
    path, pattern = byte_bpe()
    for out in (bpe.round_trip(empty, path, pattern), suffix_dedup.dedup_substrings(empty), chain_dedup.passages(empty), token_counts.token_counts(empty, tokenizer_file("word_bpe_49k.json")), line_dedup.drop_boilerplate(empty), simhash.groups(empty), simhash.keep_one(empty), fingerprint.neighbours(empty), fingerprint.fingerprints(empty), langid.predict(empty, None)):
        assert out.count() == 0


def test_clashing_extra_columns(spark):
    rows = [(1, "the same words here", "a", 5, "x"), (2, "the same words here", "a", 6, "y")]
    df = prepare(spark).createDataFrame(rows, "doc_id long, text string, source string, id int, chunk string").withColumn("n_tokens", langid.F.lit(1)).withColumn("key", langid.F.lit("k")).withColumn("fp", langid.F.lit("f")).withColumn("component_id", langid.F.lit(0)).withColumn("drop", langid.F.lit(0)).withColumn("doc", langid.F.lit(0))
    path, pattern = byte_bpe()
    assert bpe.round_trip(df, path, pattern).count() == 2
    assert suffix_dedup.dedup_substrings(df).count() == 2
    assert chain_dedup.passages(df).count() == 0
    assert token_counts.token_counts(df, tokenizer_file("word_bpe_49k.json")).count() == 2
    assert line_dedup.drop_boilerplate(df).columns == df.columns
    assert simhash.keep_one(df).select(df.columns).collect()[0].id == 5
    assert fingerprint.neighbours(df).count() == 2
