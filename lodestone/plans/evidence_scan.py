"""Names, keywords, votes, classes, rules and verdicts."""

from __future__ import annotations

from ._sql import over_tables, same_sql

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _both(name: str, sql: str) -> None:
    QUERIES[name], ORACLE[name] = same_sql(sql)


def _pair(name: str, spark_sql: str, duck: str) -> None:
    QUERIES[name], ORACLE[name] = over_tables(spark_sql), duck


def _regex(name: str, sql: str, **parts: tuple[str, str]) -> None:
    """One text with the places where the engines' words differ filled in for each."""
    spark, duck = sql, sql
    for key, (a, b) in parts.items():
        spark, duck = spark.replace(f"<{key}>", a), duck.replace(f"<{key}>", b)
    QUERIES[name], ORACLE[name] = over_tables(spark), same_sql(duck)[1]


_regex(
    "primary_languages",
    """
    WITH g AS (SELECT source, lang, sum(n_chars) AS loc, count(*) AS files FROM {documents} GROUP BY source, lang),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY loc DESC, lang) AS place FROM g)
    SELECT source, max(CASE WHEN place = 1 THEN lang END) AS primary_language,
           <next> AS secondary_languages, CAST(sum(files) AS BIGINT) AS files
    FROM r GROUP BY source""",
    next=(
        "array_join(transform(array_sort(collect_list(CASE WHEN place BETWEEN 2 AND 4 THEN struct(place, lang) END)), x -> x.lang), ',')",
        "coalesce(string_agg(CASE WHEN place BETWEEN 2 AND 4 THEN lang END, ',' ORDER BY place), '')",
    ),
)
_both(
    "test_split",
    """
    SELECT source, count(*) AS files,
           CAST(sum(CASE WHEN doc_id % 7 = 0 AND n_chars <= 5000 THEN 1 ELSE 0 END) AS BIGINT) AS specs,
           CAST(sum(CASE WHEN doc_id % 7 = 0 AND n_chars > 5000 THEN 1 ELSE 0 END) AS BIGINT) AS fixtures
    FROM {documents} GROUP BY source""",
)
_regex(
    "extension_lookup",
    r"""
    WITH p AS (SELECT lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '/[^/]+(<dot>[A-Za-z0-9]+)$', 1)) AS ext FROM {pages}),
    dim AS (SELECT * FROM (VALUES ('.html', 'HTML'), ('.php', 'PHP'), ('.js', 'JavaScript')) AS t(ext, language))
    SELECT coalesce(p.ext, '') AS ext, coalesce(language, 'Other') AS language, count(*) AS files
    FROM p LEFT JOIN dim ON p.ext = dim.ext GROUP BY 1, 2""",
    dot=(r"\\.", r"\."),
)
_regex(
    "url_full_name",
    """
    SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host,
           regexp_extract(url, '^[a-z]+://[^/?#]+/([A-Za-z0-9][A-Za-z0-9._-]*/[A-Za-z0-9][A-Za-z0-9._-]*)', 1) AS full_name
    FROM {pages}""",
)
# One pass over the texts with a count for each group's pattern; a group without a hit has zeros.
_KEYWORDS = {"articles": "(^|[^a-z])(the|der|les|los)([^a-z]|$)", "licences": "(^|[^a-z])licensed([^a-z]|$)", "rights": "all rights reserved", "absent": "zzzzqqqq"}
_HITS = ", ".join(f"count(CASE WHEN <{g}> THEN 1 END) AS {g}" for g in _KEYWORDS)
_ROWS = " UNION ALL ".join(f"SELECT '{g}' AS keyword_group, count(CASE WHEN {g} > 0 THEN 1 END) AS sources, CAST(coalesce(sum({g}), 0) AS BIGINT) AS files FROM h" for g in _KEYWORDS)
_regex(
    "keyword_groups",
    f"WITH h AS (SELECT source, {_HITS} FROM (SELECT source, lower(text) AS text FROM {{documents}}) AS d GROUP BY source) {_ROWS}",
    **{g: (f"text rlike '{p}'", f"regexp_matches(text, '{p}')") for g, p in _KEYWORDS.items()},
)
_regex(
    "first_match_class",
    """
    WITH c AS (SELECT CASE WHEN text = '' THEN 'unknown_no_output' WHEN <a> THEN 'credentials' WHEN <b> THEN 'contact'
                           WHEN <c> THEN 'licence' ELSE 'unclassified' END AS error_class FROM {documents})
    SELECT error_class, count(*) AS logs FROM c GROUP BY error_class""",
    a=("text rlike '(AKIA|ghp_|sk-|password|token)'", "regexp_matches(text, '(AKIA|ghp_|sk-|password|token)')"),
    b=("text rlike '[A-Za-z0-9._-]+@[A-Za-z0-9-]+[.][a-z]+'", "regexp_matches(text, '[A-Za-z0-9._-]+@[A-Za-z0-9-]+[.][a-z]+')"),
    c=("text rlike 'Licensed|licensed|License'", "regexp_matches(text, 'Licensed|licensed|License')"),
)
# Intervals are counted by lane and start before they meet, so a run joins its lanes' days and not its rows.
_pair(
    "lane_overlaps",
    """
    WITH s AS (SELECT run, event_type, a, count(*) AS n
               FROM (SELECT event_type, user_id % 20 AS run, min(extract(day FROM ts)) AS a FROM {events} GROUP BY event_type, user_id) AS q
               WHERE a IS NOT NULL GROUP BY run, event_type, a),
    x AS (SELECT run, event_type, n, explode(array(a - 1, a, a + 1)) AS a FROM s)
    SELECT x.run, x.event_type AS lane, y.event_type AS other, sum(x.n * y.n) AS overlaps
    FROM x JOIN s AS y ON x.run = y.run AND x.a = y.a AND x.event_type <> y.event_type
    GROUP BY 1, 2, 3""",
    """
    WITH s AS (SELECT event_type, user_id % 20 AS run, epoch_day AS a, epoch_day + 2 AS b
               FROM (SELECT event_type, user_id, min(extract(day FROM ts)) AS epoch_day FROM events GROUP BY event_type, user_id) AS q)
    SELECT x.run, x.event_type AS lane, y.event_type AS other, count(*) AS overlaps
    FROM s AS x JOIN s AS y ON x.run = y.run AND x.event_type <> y.event_type AND x.a < y.b AND y.a < x.b
    GROUP BY 1, 2, 3""",
)
_both(
    "version_window_choice",
    """
    WITH want AS (SELECT n_nationkey AS lane, n_nationkey % 7 AS low, n_nationkey % 7 + 2 AS high FROM {nation}),
    have AS (SELECT DISTINCT p_partkey % 4 AS family, p_size % 6 AS version FROM {part}),
    r AS (SELECT want.lane, version, row_number() OVER (PARTITION BY want.lane ORDER BY version - low, version DESC) AS place
          FROM want JOIN have ON want.lane % 4 = have.family AND version >= low AND version < high)
    SELECT want.lane, coalesce(r.version, -1) AS version, r.version IS NOT NULL AS satisfied FROM want LEFT JOIN r ON want.lane = r.lane AND place = 1""",
)
_regex(
    "name_suffixing",
    """
    WITH r AS (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM {part})
    SELECT p_partkey, CASE WHEN k = 1 THEN p_name ELSE concat(p_name, '-', CAST(k AS <text>)) END AS output_name FROM r""",
    text=("STRING", "VARCHAR"),
)
_MASKS = (("[A-Za-z0-9._+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.]+", "[email]"), ("https?://[^ ]+", "[url]"), ("[0-9a-f]{16,40}", "[hash]"))


def _scrub(last: str) -> str:
    out = "text"
    for pattern, mask in _MASKS:
        out = f"regexp_replace({out}, '{pattern.replace('{', '{{').replace('}', '}}')}', '{mask}'{last})"
    return out


QUERIES["scrub_text"] = over_tables(f"SELECT doc_id, sha2({_scrub('')}, 256) AS scrubbed_sha256 FROM {{documents}}")
ORACLE["scrub_text"] = "SELECT doc_id, sha256(" + _scrub(", 'g'").replace("{{", "{").replace("}}", "}") + ") AS scrubbed_sha256 FROM documents"
_regex(
    "json_props",
    "SELECT event_type, count(*) AS n, CAST(sum(<k>) AS BIGINT) AS total_k, max(<k>) AS max_k FROM {events} GROUP BY event_type",
    k=("try_variant_get(try_parse_json(props), '$.k', 'bigint')", "TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)"),
)
_regex(
    "html_tag_counts",
    "SELECT page_id, CAST(<p> AS BIGINT) AS paragraphs, CAST(<a> AS BIGINT) AS links FROM {pages}",
    p=("regexp_count(lower(html), '<p[ />]')", "len(regexp_extract_all(lower(html), '<p[ />]'))"),
    a=("regexp_count(lower(html), '<a[ />]')", "len(regexp_extract_all(lower(html), '<a[ />]'))"),
)
_both(
    "tri_state_rollup",
    """
    WITH p AS (SELECT source, CASE WHEN quality = 1 THEN true WHEN quality = 0 THEN false END AS ok
               FROM {documents} LEFT JOIN {labels} USING (doc_id))
    SELECT source, CASE WHEN max(CASE WHEN ok = false THEN 1 ELSE 0 END) = 1 THEN false
                        WHEN max(CASE WHEN ok IS NULL THEN 1 ELSE 0 END) = 1 THEN NULL ELSE true END AS build_ok,
           count(ok) AS measured, count(*) AS projects
    FROM p GROUP BY source""",
)
_both(
    "row_status",
    """
    SELECT CASE WHEN o_orderstatus = 'F' THEN 'measured' ELSE 'partial' END AS status,
           CASE WHEN o_orderstatus = 'O' THEN 'budget_exhausted' WHEN o_orderstatus = 'P' THEN 'lanes_failed' END AS skip_reason,
           count(*) AS repositories
    FROM {orders} GROUP BY 1, 2""",
)
# Each text is hashed before a source's rows meet, so only 64 characters a text are gathered.
_regex(
    "tree_digest",
    """
    WITH h AS (SELECT source, doc_id, <one> AS hash FROM {documents})
    SELECT source, <hash>(<fold>) AS repo_digest FROM h GROUP BY source""",
    one=("sha2(text, 256)", "sha256(text)"),
    hash=("sha2", "sha256"),
    fold=(
        "array_join(transform(array_sort(collect_list(struct(doc_id, hash))), x -> concat(CAST(x.doc_id AS STRING), ':', x.hash, ';')), ''), 256",
        "string_agg(concat(CAST(doc_id AS VARCHAR), ':', hash, ';'), '' ORDER BY doc_id, hash)",
    ),
)
_both(
    "set_operations",
    """
    SELECT 'both' AS op, count(*) AS n FROM (SELECT c_nationkey FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}) AS a
    UNION ALL SELECT 'either', count(*) FROM (SELECT c_nationkey FROM {customer} UNION SELECT s_nationkey FROM {supplier}) AS b
    UNION ALL SELECT 'only_first', count(*) FROM (SELECT n_nationkey FROM {nation} EXCEPT SELECT s_nationkey FROM {supplier} WHERE s_acctbal > 5000) AS c""",
)
_both(
    "upsert_index",
    """
    WITH old AS (SELECT o_orderkey AS k, o_orderstatus AS v FROM {orders} WHERE o_orderkey % 3 <> 0),
    new AS (SELECT o_orderkey AS k, 'new' AS v FROM {orders} WHERE o_orderkey % 2 = 0)
    SELECT coalesce(old.k, new.k) AS k, coalesce(new.v, old.v) AS v, old.k IS NULL AS appended
    FROM old FULL OUTER JOIN new ON old.k = new.k""",
)
_both(
    "forecast",
    """
    SELECT source, count(*) AS files, least(3600000, 5000 + 3 * count(*)) AS reader_ms,
           least(3600000, 5000 + 3 * count(*)) + 90000 * count(DISTINCT lang) + 20 * count(*) AS full_ms
    FROM {documents} GROUP BY source""",
)
_both(
    "weight_suffix_sums",
    """
    SELECT s_suppkey, s_nationkey, CAST(sum(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey
                                            ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS weight_left
    FROM {supplier}""",
)
_regex(
    "copyright_consensus",
    r"""
    WITH f AS (SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS repo, regexp_extract(html, '&copy; ([^ &]+)', 1) AS entity FROM {pages}),
    c AS (SELECT repo, entity, count(*) AS files FROM f WHERE entity <> '' GROUP BY 1, 2),
    r AS (SELECT *, rank() OVER (PARTITION BY repo ORDER BY files DESC) AS place FROM c)
    SELECT repo, entity, files FROM r WHERE place = 1 AND files >= 2""",
)
_regex(
    "ancestor_counts",
    """
    WITH p AS (SELECT regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM {pages}),
    d AS (SELECT <split> AS parts FROM p)
    SELECT parts[<one>] AS host, parts[<two>] AS top_dir, count(*) AS files FROM d GROUP BY 1, 2""",
    split=("split(path, '/')", "string_split(path, '/')"),
    one=("0", "1"),
    two=("1", "2"),
)
