"""The queries opN_<name>: thin wrappers that apply each operator to its whole table. ORACLE has SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, exact_dedup, hard_negatives, html_extract, license_scan, line_dedup, media, near_dedup, packing, ranked_search, sharding, suffix_lm, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_min_cut_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(_table(spark, sf_dir, "pages"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"), keep="largest")


def op3_permutation_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(_table(spark, sf_dir, "documents"))


def op4_conv_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table names no paths: source/lang/bucket/id.txt stands for them, and every 50th document for a LICENSE file."""
    docs = _table(spark, sf_dir, "documents")
    bucket = F.pmod(F.floor(F.col("doc_id") / 50), F.lit(16)).cast("string")
    name = F.when(F.col("doc_id") % 50 == 0, F.concat(F.lit("LICENSE."), F.col("doc_id"))).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    docs = docs.withColumn("path", F.concat_ws("/", "source", "lang", bucket, name))
    return license_scan.licences(docs, id_col="doc_id")


def op6_template_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.without_recurring_lines(_table(spark, sf_dir, "documents"), counts=True).select("doc_id", "text", "n_lines", "n_dropped")


def op7_monoid_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), word_bpe_path())


def op9_min_max_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), shingle=2)
    return found.select("doc_id", F.col("n_shingles").cast("long"), "component_id", "kept")


def op10_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table has images: the embeddings drawn as pictures stand for them. Queries: cropped pictures of every 50th row."""
    vectors = _table(spark, sf_dir, "embeddings")
    asked = media.rendered(vectors.where(F.col("vec_id") % 50 == 0), cropped=True)
    return media.image_copies(media.rendered(vectors), asked)


def op11_summa_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op12_variable_block_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_lm.scored(_table(spark, sf_dir, "documents"))


_ALL = (op1_min_cut_html, op2_exact_dedup, op3_permutation_sharding, op4_conv_toxicity, op5_license_scan, op6_template_line_dedup, op7_monoid_byte_bpe, op8_lexical_packing, op9_min_max_near_dedup, op10_image_copies, op11_summa_hard_negatives, op12_variable_block_search, op13_suffix_tree_scores)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE: dict[str, str] = {
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op11_summa_hard_negatives": """
        WITH x AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                          [floor(256 * CAST(c AS DOUBLE)) FOR c IN embedding] AS v
                   FROM embeddings
                   WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0),
             s AS (SELECT a.vec_id AS anchor_id, r.vec_id AS vec_id, a.label = r.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
                   FROM x AS a JOIN x AS r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
             p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
                   QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
             n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
                          row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
                   FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""",
    "op12_variable_block_search": r"""
        WITH d AS (SELECT row_number() OVER () AS k, doc_id, text FROM documents),
             t AS (SELECT k, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
             c AS (SELECT k, term, count(*) AS tf FROM t GROUP BY k, term),
             l AS (SELECT k, CAST(sum(tf) AS BIGINT) AS n FROM c GROUP BY k),
             g AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens FROM l),
             w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM c, g GROUP BY term, docs),
             q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
             s AS (SELECT item_id, k, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // tokens)))) AS BIGINT) AS score
                   FROM q JOIN w USING (term) JOIN c USING (term) JOIN l USING (k), g GROUP BY item_id, k)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
        FROM s JOIN d USING (k) WHERE score > 0
        QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10""",
}
