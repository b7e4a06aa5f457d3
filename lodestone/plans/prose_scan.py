"""What leaves and what does not: refused prose, masks and class scores, over texts that parts and events stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prose, redact
from ..operators import classify, closed

#: Sentences around a part's name in lower case and number, with the reason that each must give and what its mask leaves.
_SENTENCES = [
    ("the {} check was skipped after {} runs.", None, "the {} check was skipped after {} runs."),
    ("see src/{}.txt for {}", "it holds a path separator", None),
    ("mail bob{}@example.org about {}", "it holds an address or a handle", None),
    ("the {} module_{} broke", "it holds a snake_case identifier", "the {} [identifier] broke"),
    ("what {} calls fooBar{} is gone", "it holds a camelCase identifier", None),
    ("it said \"{}\" and \"{}\"", "it holds a quoted string", None),
    ("the {} list [{}] is empty", "it holds code punctuation", None),
    ("commit abcdef0 of {} broke {}", "it holds an object hash", "commit [hash] of {} broke {}"),
    ("the HTTP part of {} and {}", "it holds an acronym or a constant name", None),
    ("we asked Acme about {} and {}", "it holds the capitalised name 'Acme'", None),
    ("Fine. Then {} uses Python and {} too", None, "Fine. Then {} uses Python and {} too"),
    ("the {} part (number {}) is late", "it holds code punctuation", "the {} part (number {}) is late"),
]


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, key = F.regexp_extract(F.lower("p_name"), "^([a-z]+)", 1), F.col("p_partkey") % 90 + 10
    text = lambda s: F.format_string(s.replace("{}", "%s"), name, key)
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.get(F.array(*(text(s) for s, _, _ in _SENTENCES)), (F.col("p_partkey") % len(_SENTENCES)).cast("int")).alias("text"))


def prose_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("p_partkey", F.coalesce(prose.rejection_reason(F.col("text")), F.lit("")).alias("reason"))


def refused_by_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules as the refusal of a declared prose field: the row stays, its text goes."""
    kept = closed.enforce(_parts(spark, sf_dir), {"p_partkey": closed.number(), "text": closed.prose(prose.rejection_reason)})
    return kept.select("p_partkey", (F.col("text") == "").alias("refused"), F.size("violations").cast("long").alias("violations"))


def masked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = [k for k, (_, _, masked) in enumerate(_SENTENCES) if masked]
    rows = _parts(spark, sf_dir).where((F.col("p_partkey") % len(_SENTENCES)).isin(some))
    masked = rows.select("p_partkey", redact.scrubbed(F.col("text")).alias("text"))
    return masked.withColumn("leak", F.coalesce(redact.leak(F.col("text")), F.lit("")))


def class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events of a type are the value of a signal; five signals speak for four classes."""
    signals = {"view": "frontend_frameworks", "click": "ui_component_files", "purchase": "orm_db", "signup": "notebooks", "error": "terraform_files"}
    name: Column = F.element_at(F.create_map(*(F.lit(x) for p in signals.items() for x in p)), F.col("event_type"))
    counts = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("user_id").alias("repo_id"), name.alias("signal")).agg(F.count("*").alias("value"))
    scores = classify.classified(counts)
    at = lambda c: F.round(F.element_at("raw_scores", F.lit(c)) * 1000).cast("long").alias(c)
    return scores.select("repo_id", *map(at, ("frontend", "backend", "ml", "ai_research", "infra")), "primary_class")


QUERIES = {q.__name__: q for q in (prose_rejections, refused_by_rules, masked_texts, class_scores)}
_LIST = ", ".join("'" + (r or "").replace("'", "''") + "'" for _, r, _ in _SENTENCES)
_MASKED = ", ".join("'" + (m or "").replace("'", "''") + "'" for _, _, m in _SENTENCES)
_NUMBERS = ", ".join(str(k) for k, (_, _, m) in enumerate(_SENTENCES) if m)
ORACLE = {
    "prose_rejections": f"SELECT p_partkey, [{_LIST}][p_partkey % {len(_SENTENCES)} + 1] AS reason FROM part",
    "refused_by_rules": f"SELECT p_partkey, [{_LIST}][p_partkey % {len(_SENTENCES)} + 1] <> '' AS refused, CAST(0 AS BIGINT) AS violations FROM part",
    "masked_texts": f"""
    WITH p AS (SELECT p_partkey, regexp_extract(lower(p_name), '^([a-z]+)', 1) AS name, p_partkey % 90 + 10 AS n, [{_MASKED}][p_partkey % {len(_SENTENCES)} + 1] AS s FROM part WHERE p_partkey % {len(_SENTENCES)} IN ({_NUMBERS}))
    SELECT p_partkey, format(s, name, n) AS text, '' AS leak FROM p""",
    "class_scores": """
    WITH s AS (SELECT user_id AS repo_id, count(*) FILTER (event_type = 'view') AS v, count(*) FILTER (event_type = 'click') AS c, count(*) FILTER (event_type = 'purchase') AS p,
                      count(*) FILTER (event_type = 'signup') AS s, count(*) FILTER (event_type = 'error') AS e FROM events GROUP BY 1),
    r AS (SELECT repo_id, CASE WHEN c > 0 THEN least(1.5 * v, 6) ELSE 0 END AS f1, least(0.1 * c, 5) AS f2, least(1.0 * p, 4) AS b, least(0.3 * s, 4) AS m, least(0.5 * s, 5) AS a, least(0.3 * e, 4) AS i FROM s),
    k AS (SELECT repo_id, unnest([{'c': 'frontend', 'o': 0, 'raw': f1 + f2, 'n': CAST(f1 >= 0.5 AS INTEGER) + CAST(f2 >= 0.5 AS INTEGER)}, {'c': 'backend', 'o': 1, 'raw': b, 'n': CAST(b >= 0.5 AS INTEGER)},
                 {'c': 'ml', 'o': 2, 'raw': m, 'n': 1}, {'c': 'ai_research', 'o': 3, 'raw': a, 'n': 1}, {'c': 'infra', 'o': 6, 'raw': i, 'n': 1}]) AS x FROM r),
    best AS (SELECT repo_id, x.c AS c, row_number() OVER (PARTITION BY repo_id ORDER BY CASE WHEN x.raw >= 1 AND (x.n >= 2 OR x.raw >= 4) THEN 0 ELSE 1 END, round(x.raw, 3) DESC, x.o) AS place, max(x.raw) OVER (PARTITION BY repo_id) AS top FROM k)
    SELECT r.repo_id, CAST(round((f1 + f2) * 1000) AS BIGINT) AS frontend, CAST(round(b * 1000) AS BIGINT) AS backend, CAST(round(m * 1000) AS BIGINT) AS ml, CAST(round(a * 1000) AS BIGINT) AS ai_research,
           CAST(round(i * 1000) AS BIGINT) AS infra, CASE WHEN top >= 1 THEN c ELSE 'backend' END AS primary_class
    FROM r JOIN best ON best.repo_id = r.repo_id AND place = 1""",
}
