"""One query for each operator over its whole table, with production parameters; the digests are derived here."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, chain_dedup, decontam, fingerprint, html_text, infill, langid, line_dedup, ngram_join, phrases, simhash, suffix_dedup, token_counts
from tidemark.llm.common import table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_bpe() -> tuple[str, str]:
    """The rank file and pattern of the queries."""
    import public_tokenizers

    return tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), *byte_bpe())


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup_substrings(table(spark, sf_dir, "documents"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return out.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_fuzzy_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain_dedup.passages(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


#: A line goes if over this share of a site's pages, and this many pages, hold it.
LINE_RATIO, LINE_PAGES = 0.05, 3


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_boilerplate(table(spark, sf_dir, "documents"), LINE_RATIO, LINE_PAGES, counts=True)
    return out.select("doc_id", "source", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP5_SQL = f"""
WITH lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents),
counts AS (SELECT source, trim(line, ' ') AS line, count(DISTINCT doc_id) AS pages FROM lines WHERE trim(line, ' ') <> '' GROUP BY 1, 2),
totals AS (SELECT source, count(*) AS total FROM documents GROUP BY 1),
gone AS (SELECT source, line FROM counts JOIN totals USING (source) WHERE pages > {LINE_RATIO} * total AND pages >= {LINE_PAGES}),
split AS (SELECT doc_id, source, string_split(text, chr(10)) AS own FROM documents),
numbered AS (SELECT doc_id, source, unnest(own) AS line, unnest(range(len(own))) AS place FROM split),
kept AS (SELECT n.doc_id, string_agg(n.line, chr(10) ORDER BY n.place) AS text, count(*) AS n FROM numbered n
  LEFT JOIN gone g ON g.source = n.source AND g.line = trim(n.line, ' ') WHERE g.line IS NULL GROUP BY 1)
SELECT s.doc_id, s.source, CAST(len(own) AS BIGINT) AS n_lines, CAST(len(own) - coalesce(k.n, 0) AS BIGINT) AS n_dropped,
  sha256(coalesce(k.text, '')) AS kept_sha256
FROM split s LEFT JOIN kept k ON k.doc_id = s.doc_id
"""


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP8_SQL = r"""
WITH doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[p + 1:p + n], ' ') AS win FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(greatest(1, len(w) - 9))) AS p FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, n, p, array_to_string(w[p + 1:p + n], ' ') AS win FROM (SELECT doc_id, n, w, unnest(range(len(w) - n + 1)) AS p FROM doc, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, p, p.n AS n, item_id FROM places p JOIN windows USING (n, win)),
covered AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, p + unnest(range(n)) AS spot FROM hits) GROUP BY 1),
listed AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN listed l ON l.doc_id = d.doc_id
"""


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.neighbours(table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return langid.predict(documents, langid.fit(documents))


#: Phrases of up to three words that occur ten times; those at least half of whose occurrences a longer one has go.
PHRASE_COUNT, PHRASE_WORDS, PHRASE_TOP, PHRASE_PERCENT = 10, 3, 2000, 50


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), PHRASE_COUNT, PHRASE_WORDS, PHRASE_TOP, PHRASE_PERCENT)


OP11_SQL = rf"""
WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
word AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece),
gram AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM word, (SELECT unnest(range(1, {PHRASE_WORDS + 1})) AS m) WHERE len(w) >= m),
f AS (SELECT lang, m, phrase, count(*) AS f FROM gram GROUP BY ALL),
size AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY 1),
cand AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= {PHRASE_COUNT}),
cut AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:], ' ') AS rp FROM (SELECT *, unnest(range(1, m)) AS k FROM cand)),
scored AS (SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r, CAST(1000000 AS HUGEINT) * c.a * c.a // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM cut c JOIN f x ON x.lang = c.lang AND x.phrase = lp JOIN f y ON y.lang = c.lang AND y.phrase = rp),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM cand WHERE m = 3),
gone AS (SELECT DISTINCT s.lang, s.phrase FROM lowest s JOIN inside i ON i.lang = s.lang AND i.phrase = s.phrase WHERE 100 * i.a >= {PHRASE_PERCENT} * s.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM lowest s WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.lang = s.lang AND g.phrase = s.phrase))
SELECT r.lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked r JOIN size z ON z.lang = r.lang WHERE rank <= {PHRASE_TOP}
"""


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH RECURSIVE word AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
gram AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 2, 2)), lambda i: array_to_string(w[i:i + 3], ' '))) AS g FROM word WHERE len(w) > 0),
size AS (SELECT doc_id, count(*) AS n FROM gram GROUP BY 1),
link AS (SELECT x.doc_id AS a, y.doc_id AS b FROM gram x JOIN gram y ON x.g = y.g AND x.doc_id <> y.doc_id JOIN size s ON s.doc_id = x.doc_id JOIN size t ON t.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, s.n, t.n HAVING 100 * count(*) >= 85 * (s.n + t.n - count(*))),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
SELECT w.doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(min(b), w.doc_id)) AS component_id
FROM word w LEFT JOIN size s ON s.doc_id = w.doc_id LEFT JOIN reach r ON r.a = w.doc_id GROUP BY w.doc_id
"""


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = infill.transform(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(infill.restored("output", "form"), 256).alias("restored_sha256"))


OP13_SQL = """
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || doc_id) AS d FROM documents),
u AS (SELECT *, CAST('0x' || d[1:8] AS BIGINT) % (n + 1) AS x, CAST('0x' || d[9:16] AS BIGINT) % (n + 1) AS y, CAST('0x' || d[17:24] AS BIGINT) % 100 AS h3, CAST('0x' || d[25:32] AS BIGINT) % 100 AS h4 FROM h),
c AS (SELECT *, least(x, y) AS lo, greatest(x, y) AS hi, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, substring(t, 1, lo) AS pre, substring(t, lo + 1, hi - lo) AS mid, substring(t, hi + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE t END) AS output_sha256,
  sha256(pre || mid || suf) AS restored_sha256
FROM p
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_byte_bpe, op2_suffix_dedup, op3_fuzzy_passages, op4_token_counts, op5_line_dedup, op6_simhash, op7_html_text, op8_decontamination, op9_fingerprints, op10_language, op11_phrases, op12_ngram_join, op13_infill)}
ORACLES: dict[str, str] = {"op5_line_dedup": OP5_SQL, "op8_decontamination": OP8_SQL, "op11_phrases": OP11_SQL, "op12_ngram_join": OP12_SQL, "op13_infill": OP13_SQL}
