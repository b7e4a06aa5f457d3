"""Digests, meeting intervals and JUnit reports against plain versions."""

import hashlib
import random

import duckdb
import pytest

from lodestone.functions import junit
from lodestone.operators import digest, intervals


def _digest(files, digits=6):
    sha = lambda b: hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()
    rows = [(sha(p), sha(f"{p}\0{sha(c) if c is not None else 'unreadable'}\0")) for p, c in files]
    for left in range(digits, -1, -2):
        groups = {}
        for at, h in sorted(rows):
            groups.setdefault(at[:left], []).append(h)
        rows = [(up, sha("".join(hs))) for up, hs in groups.items()]
    return rows[0][1]


def test_digest_hangs_on_paths_and_contents_alone(spark):
    rng = random.Random(3)
    files = [(f"d{k % 9}/f{k}", rng.randbytes(20)) for k in range(500)] + [("a", None), ("z", b""), ("z", b"")]
    table = lambda rows: spark.createDataFrame([("r", p, c) for p, c in rows], "repo_id string, path string, content binary")
    of = lambda rows, n: digest.tree_digest(table(rows).repartition(n)).collect()[0]
    want = of(files, 1)
    assert (want["repo_digest"], want["files"]) == (_digest(files), 503)
    assert of(rng.sample(files, len(files)), 7)["repo_digest"] == want["repo_digest"]
    assert of([*files, (".git/config", b"x"), (".git", b"y"), (None, b"q")], 3)["repo_digest"] == want["repo_digest"]
    for changed in (files[1:], [("d0/f0x", files[0][1]), *files[1:]], [(files[0][0], b"other"), *files[1:]], [("a", b""), *files[:500], *files[501:]]):
        assert of(changed, 2)["repo_digest"] != want["repo_digest"]
    assert digest.tree_digest(table(files).limit(0)).count() == 0


@pytest.mark.parametrize("unit", [1, 10, 5000])
def test_meeting_intervals_of_any_length(spark, unit):
    rng = random.Random(unit)
    rows = []
    for k in range(400):
        start = rng.choice([0, -50, 3000]) + rng.randint(-500, 2000)
        rows.append((rng.choice("ab"), k, start, start + rng.choice([0, 1, 3, 10, 64, 700, 20_000, -5])))
    rows += [("a", 900, 5, 6), ("a", 901, 6, 7), ("a", 902, 5, 6), (None, 903, 0, 9), ("a", None, 0, 9), ("a", 904, None, 9), ("a", 905, 0, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "run string, lane long, s long, e long, first string")
    got = sorted(map(tuple, intervals.overlaps(df, ["run"], "lane", "s", "e", unit).collect()))
    good = [r for r in rows if None not in r and r[2] < r[3]]
    assert got == sorted((x[0], x[1], y[1]) for x in good for y in good if x[0] == y[0] and x[1] < y[1] and x[2] < y[3] and y[2] < x[3])
    assert intervals.overlaps(df.limit(0), ["run"], "lane", "s", "e", unit).count() == 0


def test_reports_that_are_no_xml_are_not_measured(spark):
    reports = {
        "one": '<testsuite name="x > y" tests="5" failures="1" errors="1" skipped="1"><testsuite tests="90"/></testsuite>', "many": "<?xml version='1.0'?>\n<testsuites><testsuite tests='3'/><g><testsuite tests='2' failures='4'></testsuite></g></testsuites>",
        "broken": "<testsuite tests='7'>", "text": "5 passed", "none": None, "empty": "", "other": "<html/>", "hidden": "<testsuites><!-- <testsuite tests='8'/> --><![CDATA[<testsuite tests='8'/>]]></testsuites>",
    }
    df = spark.createDataFrame([(k, "f", v) for k, v in reports.items()], "repo_id string, path string, text string")
    got = {r["repo_id"]: tuple(r)[1:] for r in junit.junit_counts(df).collect()}
    assert got == {"one": (5, 1, 1, 1, 2), "many": (5, 4, 0, 0, 1)}


def test_lanes_start_at_the_nearest_second(spark, tmp_path):
    from lodestone.plans import tree_scan

    rows = "(0, '2024-01-01 00:00:00.6', 1), (1, '2024-01-01 00:10:00.4', 1), (2, '2024-01-01 00:09:59.7', 1), (3, '2024-01-01 00:19:59.6', 1)"
    spark.sql(f"SELECT CAST(i AS BIGINT) AS event_id, CAST(t AS TIMESTAMP_NTZ) AS ts, CAST(u AS BIGINT) AS user_id FROM VALUES {rows} AS v(i, t, u)").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    for name in ("lane_meetings", "lane_order"):
        got = tree_scan.QUERIES[name](spark, str(tmp_path)).collect()
        assert sorted(map(tuple, got)) == sorted(con.execute(tree_scan.ORACLE[name]).fetchall())
