"""History analytics. Orders stand for commits, their lines for changed files, conversations for raw log lines."""

from __future__ import annotations

from ._sql import over_tables, same_sql

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _both(name: str, sql: str) -> None:
    QUERIES[name], ORACLE[name] = same_sql(sql)


def _pair(name: str, spark_sql: str, duck: str) -> None:
    QUERIES[name], ORACLE[name] = over_tables(spark_sql), duck


# A header line owns the detail lines after it, up to the next header.
_FILL = """
    SELECT conv_id, turn, role,
           {last} OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS header_turn
    FROM {table}"""
_pair(
    "commit_forward_fill",
    _FILL.format(last="last(CASE WHEN role = 'user' THEN turn END, true)", table="{conversations}"),
    _FILL.format(last="last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS)", table="conversations"),
)

# Twelve calendar months that end with the newest, empty ones included.
_pair(
    "commits_by_month",
    """
    WITH m AS (SELECT date_trunc('month', o_orderdate) AS month, count(*) AS n FROM {orders} GROUP BY 1),
    slots AS (SELECT explode(sequence(add_months(max(month), -11), CAST(max(month) AS DATE), interval 1 month)) AS slot FROM m)
    SELECT date_format(slot, 'yyyy-MM') AS month, coalesce(n, 0) AS commits
    FROM slots LEFT JOIN m ON CAST(m.month AS DATE) = slot""",
    """
    WITH m AS (SELECT date_trunc('month', o_orderdate) AS month, count(*) AS n FROM orders GROUP BY 1),
    slots AS (SELECT unnest(range(0, 12)) AS k, (SELECT max(month) FROM m) AS top)
    SELECT strftime(top - to_months(CAST(11 - k AS INTEGER)), '%Y-%m') AS month, coalesce(n, 0) AS commits
    FROM slots LEFT JOIN m ON m.month = top - to_months(CAST(11 - k AS INTEGER))""",
)

_both("active_days", "SELECT event_type, nullif(count(DISTINCT CAST(ts AS DATE)), 0) AS active_days FROM {events} GROUP BY event_type")

# Whole days between instants, not calendar days; "now" is the newest instant of the table.
_pair(
    "span_recency_days",
    """
    WITH top AS (SELECT max(ts) AS now FROM {events}),
    u AS (SELECT user_id, min(ts) AS a, max(ts) AS b, count(*) AS commits FROM {events} GROUP BY user_id)
    SELECT user_id, commits,
           CAST(floor(timestampdiff(MICROSECOND, a, b) / 86400000000) AS BIGINT) AS span_days,
           CAST(floor(timestampdiff(MICROSECOND, b, now) / 86400000000) AS BIGINT) AS recency_days
    FROM u CROSS JOIN top""",
    """
    WITH top AS (SELECT max(ts) AS now FROM events),
    u AS (SELECT user_id, min(ts) AS a, max(ts) AS b, count(*) AS commits FROM events GROUP BY user_id)
    SELECT user_id, commits, CAST(floor((epoch_us(b) - epoch_us(a)) / 86400000000) AS BIGINT) AS span_days,
           CAST(floor((epoch_us(now) - epoch_us(b)) / 86400000000) AS BIGINT) AS recency_days
    FROM u, top""",
)

# A few commits within two days by few authors.
_both(
    "burst_flag",
    """
    SELECT user_id, count(*) AS commits, count(DISTINCT event_type) AS authors,
           count(*) BETWEEN 2 AND 120 AND count(DISTINCT CAST(ts AS DATE)) <= 28 AND count(DISTINCT event_type) <= 5 AS burst
    FROM {events} GROUP BY user_id""",
)

_FLAGS = """
    f AS (SELECT l_orderkey,
                 sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS specs,
                 sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS impl,
                 sum(CASE WHEN l_tax > 0.06 THEN 1 ELSE 0 END) AS infra,
                 count(*) AS files
          FROM {lineitem} GROUP BY l_orderkey)"""
_both(
    "commit_classes",
    f"""
    WITH {_FLAGS},
    c AS (SELECT *, CASE WHEN specs >= 2 AND impl >= 2 THEN 'A' WHEN specs >= 1 AND impl >= 1 THEN 'B'
                         WHEN impl >= 2 THEN 'C' ELSE 'none' END AS class,
                 infra >= 1 AND specs = 0 AS d FROM f)
    SELECT class, count(*) AS commits, CAST(sum(CASE WHEN d THEN 1 ELSE 0 END) AS BIGINT) AS also_d,
           CAST(sum(CASE WHEN class = 'A' THEN specs WHEN class = 'B' THEN least(specs, 15) ELSE 0 END) AS BIGINT) AS candidates
    FROM c GROUP BY class""",
)
_both(
    "mineable_commits",
    """
    WITH c AS (SELECT l_orderkey, count(*) AS impl, sum(CAST(l_quantity AS BIGINT)) AS churn FROM {lineitem} GROUP BY l_orderkey)
    SELECT o_orderstatus AS status, count(*) AS real_commits,
           CAST(sum(CASE WHEN impl >= 2 AND churn BETWEEN 20 AND 10000 THEN 1 ELSE 0 END) AS BIGINT) AS mineable,
           count(DISTINCT o_custkey) AS authors
    FROM c JOIN {orders} ON o_orderkey = l_orderkey GROUP BY o_orderstatus""",
)
_both(
    "repair_complexity",
    """
    WITH c AS (SELECT l_orderkey, count(*) AS impl, count(DISTINCT l_suppkey) AS dirs, sum(CAST(l_quantity AS BIGINT)) AS churn
               FROM {lineitem} GROUP BY l_orderkey),
    s AS (SELECT l_orderkey, least(2000, 300 * impl + 200 * dirs + churn) AS points FROM c)
    SELECT l_orderkey, CAST(points AS BIGINT) AS points_of_2000,
           CASE WHEN points < 660 THEN 'Small' WHEN points < 1320 THEN 'Medium' ELSE 'Large' END AS band
    FROM s""",
)

_both(
    "conventional_rate_last_n",
    """
    WITH r AS (SELECT event_type, props, row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts DESC, event_id DESC) AS k,
                      user_id % 10 AS repo FROM {events})
    SELECT repo, count(*) AS looked_at, CAST(sum(CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END) AS BIGINT) AS conventional
    FROM r WHERE k <= 200 GROUP BY repo""",
)
_both(
    "bot_author_filter",
    """
    SELECT role, role IN ('system', 'assistant') AS is_bot, count(*) AS commits, count(DISTINCT conv_id) AS repos
    FROM {conversations} GROUP BY role""",
)
_both(
    "root_and_tip_commits",
    """
    SELECT o_custkey, min(o_orderdate) AS first_commit_at, max(o_orderdate) AS last_commit_at, count(*) AS commits
    FROM {orders} GROUP BY o_custkey""",
)
