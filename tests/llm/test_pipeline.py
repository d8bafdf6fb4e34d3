"""The pipeline against a plain version of its stages."""

import hashlib
from collections import Counter, defaultdict

import corpus_pipeline
from tidemark.llm import langid
from tidemark.llm.common import prepare
from tidemark.llm.queries import LINE_PAGES, LINE_RATIO, byte_bpe


def test_pipeline(spark):
    from test_operators import brute_components, brute_fingerprint

    sf_dir = "/root/testdata/sf0.01"
    df = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    network = langid.fit(df)
    rows = [r.asDict() for r in df.orderBy("doc_id").collect()]
    found = langid.labelled(network, langid.Settings(), [r["text"] for r in rows])
    rows = [r for r, (k, p) in zip(rows, found) if k != "und" and p >= 0.35]
    assert len(rows) > 0.98 * df.count()
    pages, total = defaultdict(set), Counter(r["source"] for r in rows)
    for r in rows:
        for line in r["text"].split("\n"):
            pages[(r["source"], line.strip(" "))].add(r["doc_id"])
    gone = {k for k, v in pages.items() if k[1] and len(v) > LINE_RATIO * total[k[0]] and len(v) >= LINE_PAGES}
    for r in rows:
        r["text"] = "\n".join(x for x in r["text"].split("\n") if (r["source"], x.strip(" ")) not in gone)
    prints = {r["doc_id"]: brute_fingerprint(r["text"]) for r in rows}
    names = brute_components(prints, [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3])
    rows = [r for r in rows if names[r["doc_id"]] == r["doc_id"]]
    from tidemark.llm.decontam import Windows, words

    items = [(str(r.item_id), r.text.encode()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    windows = {tuple(w[a : a + 10]) for w in (words(t) for _, t in items) for a in range(max(1, len(w) - 9)) if w}
    clean = []
    for r in rows:
        w = words(r["text"].encode())
        if not any(tuple(w[a : a + n]) in windows for n in {len(k) for k in windows} for a in range(len(w) - n + 1)):
            clean.append(r)
    assert Windows(items).automaton
    import base64

    import tiktoken

    path, pattern = byte_bpe()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}, special_tokens={})
    want = Counter()
    for r in clean:
        ids = library.encode_ordinary(r["text"])
        want[(r["doc_id"], len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()) == want


def test_stages_keep_columns(spark):
    docs = prepare(spark).read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("extra", langid.F.lit("x")).withColumn("key", langid.F.lit(1))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "/root/testdata/sf0.001").columns == docs.columns
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "/root/testdata/sf0.001").count() == 0


def test_stages_on_awkward_rows(spark):
    """Null texts and ids, repeated rows, empty texts and a null site pass all stages; what a stage drops is its own."""
    text = "These are some plain English words that stand in a sentence of their own, number {}, and go on for a while here.\n"
    rows = [(None, text.format(1) * 3, "a", "en", 1), (1, None, "a", "en", None), (2, "", None, None, 0), (3, text.format("three") * 2, None, "en", 2), (3, text.format("three") * 2, None, "en", 2), (4, text.format("three") * 2, "b", None, 2), (5, " \n ", "b", "en", 3)]
    rows += [(10 + i, f"{text.format(i)}Shared line of the site\nown words {i * 7919} follow as {i * 104729}", "c", "en", 9) for i in range(40)]
    docs = prepare(spark).createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars int")
    of = lambda df: Counter(r.doc_id for r in df.collect())
    everyone = of(docs)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        kept[name] = of(stage(spark, docs, "/root/testdata/sf0.001"))
    assert not {1, 2, 5} & set(kept["language_id"]) and kept["language_id"][3] == 2 and kept["language_id"][None] == 1
    assert kept["line_dedup"] == everyone and kept["byte_bpe"] == everyone
    assert kept["simhash_dedup"][3] == 1 and kept["simhash_dedup"][4] == 0 and kept["simhash_dedup"][None] == 1 and kept["simhash_dedup"][1] == 1
    assert kept["decontamination"] == everyone
    cut = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, "").collect()}
    assert "Shared line" not in cut[10] and "own words" in cut[10] and cut[1] is None
