"""The queries opN_<name>, and SQL for those that DuckDB can express. Each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import byte_bpe, collocations, embed_dedup, exact_dedup, license_scan, line_dedup, packing, periodic_runs, piece_transducer, simhash, token_counts, token_file, toxicity
from .common import documents

BYTE_BPE, WORD_BPE, PIECE_BPE, BYTE_RANKS = "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.digest_token_file(spark, token_file.write_token_file(documents(spark, sf_dir), tokenizer(BYTE_BPE), end_id=2))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.scores(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(documents(spark, sf_dir), tokenizer(WORD_BPE), end_id=0, capacity=2048), capacity=2048)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_transducer.round_trips(documents(spark, sf_dir), tokenizer(PIECE_BPE))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(documents(spark, sf_dir), shingle=4, seed=42, radius=4)
    return found.select("doc_id", simhash.hex_of("fp").alias("fingerprint"), "component_id")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), tokenizer(WORD_BPE), limit=2048)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"), F.col("_near").alias("n_near"), F.sha2("text", 256).alias("text_sha256"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.98)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(documents(spark, sf_dir))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir), least=100, longest=5, share=100, top=2000)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.with_planted_runs(documents(spark, sf_dir).select("doc_id", "text")))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.digests(documents(spark, sf_dir), tokenizer(BYTE_RANKS), public_tokenizers.PATTERN)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_file": op1_token_file,
    "op2_toxicity": op2_toxicity,
    "op3_packing": op3_packing,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_simhash": op5_simhash,
    "op6_token_counts": op6_token_counts,
    "op7_license_scan": op7_license_scan,
    "op8_line_dedup": op8_line_dedup,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_collocations": op11_collocations,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_byte_bpe": op13_byte_bpe,
}

def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_NOTICES = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in license_scan.TEMPLATES.items())
_CUT = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda w: w <> '')"
_BLANK = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

ORACLE_SQL: dict[str, str] = {
    # all windows that hold a shingle of a notice, without bands
    "op7_license_scan": f"""
WITH n AS (SELECT license, {_CUT.format("notice")} AS w FROM (VALUES {_NOTICES}) AS v(license, notice)),
s AS (SELECT DISTINCT license, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS shingle FROM n),
t AS (SELECT license, count(*) AS m, CAST(ceil(log2(count(*))) AS BIGINT) AS c FROM s GROUP BY license),
z AS (SELECT license, m, greatest(1, CAST(floor(pow(2, c - 1)) AS BIGINT)) AS step, greatest(1, CAST(floor(7 * pow(2, c) / 4) AS BIGINT)) AS size FROM t),
d AS (SELECT doc_id, {_CUT.format("coalesce(text, '')")} AS w FROM documents),
p AS (SELECT doc_id, unnest(range(0, len(w) - 4)) AS place, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS shingle FROM d WHERE len(w) > 4),
h AS (SELECT doc_id, place, license, shingle, m, step, size FROM p JOIN s USING (shingle) JOIN z USING (license)),
x AS (SELECT doc_id, license, m, shingle, unnest(range(CAST(greatest(ceil((place - size + 1) / step), 0) AS BIGINT), CAST(floor(place / step) AS BIGINT) + 1)) * step AS start FROM h),
k AS (SELECT doc_id, license, start, count(DISTINCT shingle) / any_value(m) AS containment FROM x GROUP BY ALL)
SELECT doc_id, license, round(max(containment), 6) AS containment, CAST(min(start) AS INTEGER) AS first_word FROM k WHERE containment >= 0.8 GROUP BY doc_id, license
""",
    "op8_line_dedup": f"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS own FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(own) + 1)) AS line, unnest(own) AS raw FROM s),
i AS (SELECT *, regexp_replace(raw, '^{_BLANK}|{_BLANK}$', '', 'g') AS t FROM l),
u AS (SELECT t, length(t) AS n, min(struct_pack(doc_id, line)) AS place FROM i WHERE t <> '' GROUP BY t),
h AS (SELECT DISTINCT t, n, place, unnest(['<' || left(t, n // 2), '<' || left(t, (n - 1) // 2), '>' || right(t, n - n // 2), '>' || right(t, (n - 1) - (n - 1) // 2)]) AS half FROM u WHERE n >= 20),
c AS (SELECT DISTINCT a.t AS a, a.n AS n, b.t AS b, b.n AS m FROM h a JOIN h b ON a.half = b.half AND b.place < a.place AND abs(a.n - b.n) <= 1),
near AS (SELECT DISTINCT a AS t FROM c WHERE len(list_filter(range(0, greatest(n, m)), lambda k: left(a, k) = left(b, k) AND substr(a, k + CASE WHEN n < m THEN 1 ELSE 2 END) = substr(b, k + CASE WHEN m < n THEN 1 ELSE 2 END))) > 0),
g AS (SELECT i.*, near.t IS NOT NULL AS near, i.t <> '' AND (near.t IS NOT NULL OR struct_pack(doc_id := i.doc_id, line := i.line) <> u.place) AS gone FROM i LEFT JOIN u ON u.t = i.t LEFT JOIN near ON near.t = i.t)
SELECT doc_id, CAST(count(*) AS INTEGER) AS n_lines, CAST(count(*) FILTER (gone) AS INTEGER) AS n_dropped, CAST(count(*) FILTER (gone AND near) AS INTEGER) AS n_near, sha256(coalesce(string_agg(raw, chr(10) ORDER BY line) FILTER (NOT gone), '')) AS text_sha256 FROM g GROUP BY doc_id
""",
    "op9_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN least ON least.a = vec_id
""",
    "op10_exact_dedup": """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
""",
    # all phrases, without a sketch
    "op11_collocations": r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
p AS (SELECT lang, list_filter(regexp_split_to_array(unnest(pieces), '[\x20\x09]+'), lambda w: w <> '') AS w FROM t),
g AS (SELECT lang, unnest(range(1, 6)) AS words, w FROM p WHERE len(w) > 0),
o AS (SELECT lang, words, unnest(list_transform(range(1, len(w) - words + 2), lambda i: array_to_string(w[i:i + words - 1], ' '))) AS phrase FROM g WHERE len(w) >= words),
f AS (SELECT lang, words, phrase, count(*) AS f FROM o GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE words = 1 GROUP BY lang),
c AS (SELECT lang, words, phrase, f, string_split(phrase, ' ') AS w FROM f WHERE f >= 100),
s AS (SELECT lang, unnest([array_to_string(w[1:words - 1], ' '), array_to_string(w[2:words], ' ')]) AS phrase, f FROM c WHERE words > 2),
k AS (SELECT c.* FROM c WHERE words > 1 AND NOT EXISTS (SELECT 1 FROM s WHERE s.lang = c.lang AND s.phrase = c.phrase AND 100 * s.f >= 100 * c.f)),
x AS (SELECT lang, phrase, w, words, f AS a, unnest(range(1, words)) AS cut FROM k),
y AS (SELECT x.lang, x.phrase, x.a, x.cut, i.f AS l, j.f AS r, n.n, CAST(CAST(1000 AS HUGEINT) * x.a * n.n // (CAST(i.f AS HUGEINT) * j.f) AS BIGINT) AS score FROM x
  JOIN f AS i ON i.lang = x.lang AND i.phrase = array_to_string(w[1:cut], ' ') JOIN f AS j ON j.lang = x.lang AND j.phrase = array_to_string(w[cut + 1:x.words], ' ') JOIN n ON n.lang = x.lang),
z AS (SELECT lang, phrase, a, n, min(struct_pack(score, cut, l, r)) AS least FROM y GROUP BY ALL),
q AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY least.score DESC, a DESC, phrase) AS rank, phrase, a, least.l AS l, least.r AS r, n, least.score AS score FROM z)
SELECT * FROM q WHERE rank <= 2000
""",
}
