"""The queries of this subpackage for the entry file, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.llm import fingerprints, html, lines, lm, minhash, mixing, negatives, packing, quality, substrings, toxicity, urls, whitening
from podium.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), cached=1_000_000)


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.dedup_substrings(table(spark, sf_dir, "documents"), width=13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op9_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten_embeddings(table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine_hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


def op13_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return lm.score_documents(table(spark, sf_dir, "documents"), lm.read_pieces(public_tokenizers.path("piece_bpe_32k.model")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_toxicity, op2_packing, op3_url_rules, op4_minhash, op5_html, op6_quality, op7_order_minhash, op8_substrings, op9_fuzzy_lines, op10_mixing, op11_whitening, op12_hard_negatives, op13_lattice_lm, pipeline)
    return {f.__name__: f for f in own}


#: Words of documents, one row each, k from 1.
_WORDS = r"""
words AS (
  SELECT doc_id, w, generate_subscripts(w, 1) AS k, unnest(w) AS word
  FROM (SELECT doc_id, regexp_extract_all({text}, '[^\x20\x09-\x0D]+') AS w FROM documents)
)"""

OP4 = (
    r"""
WITH RECURSIVE"""
    + _WORDS.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    + """,
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[k : k + 2], ' ') AS s FROM words WHERE k <= greatest(1, len(w) - 2)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
),
reach AS (SELECT doc_id, doc_id AS top FROM documents UNION SELECT l.b, r.top FROM reach r JOIN links l ON l.a = r.doc_id),
least AS (SELECT doc_id, min(top) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM least LEFT JOIN sizes USING (doc_id)
"""
)

OP8 = (
    "WITH"
    + _WORDS.format(text="text")
    + """,
windows AS (SELECT doc_id, k, array_to_string(w[k : k + 12], ' ') AS s FROM words WHERE k <= len(w) - 12),
first AS (SELECT s, min(doc_id) AS d FROM windows GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS k FROM windows JOIN first USING (s) WHERE d < doc_id),
judged AS (SELECT words.doc_id, words.k, word, gone.k IS NOT NULL AS g FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.k = words.k),
texts AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (g) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY k) FILTER (NOT g), '') AS kept
  FROM judged GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN texts USING (doc_id)
"""
)


OP12 = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
    CAST(list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS k FROM s WHERE same) WHERE k <= 5),
n AS (
  SELECT anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY anchor_id, p.id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


def oracle_sql() -> dict[str, str]:
    """The others have columns that SQL can't express (compression, tokens, models, signatures, seeded rings)."""
    return {"op4_minhash": OP4, "op8_substrings": OP8, "op12_hard_negatives": OP12}
