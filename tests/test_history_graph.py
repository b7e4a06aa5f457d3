"""Depths, reachability and the tally behind the deepest ref."""

import random

from pyspark.sql import functions as F

from lodestone.operators import history

COMMIT = "repo_id string, sha string, parents array<string>, name string, address string, at string, subject string"
REF = "repo_id string, ref string, object_type string, sha string, peeled_sha string"


def _commits(spark, graph, **about):
    rows = [("r", sha, parents, *about.get(sha, ("Dev One", "dev1@example.com", f"2024-04-0{k % 9 + 1}T10:00:00+00:00", "feat: x"))) for k, (sha, parents) in enumerate(graph.items())]
    return spark.createDataFrame(rows, COMMIT)


def test_branches_tags_and_the_tip_of_a_pass(spark):
    graph = {"c1": [], "c2": ["c1"], "c3": ["c2"], "c4": ["c3"], "c5": ["c4"]}
    about = {
        "c1": ("Dev One", "dev1@example.com", "2024-04-01T10:00:00+00:00", "feat: first cut"), "c2": ("renovate[bot]", "renovate@example.com", "2024-04-02T10:00:00+00:00", "chore(deps): bump"),
        "c3": ("Dev One", "DEV1@example.com ", "2024-04-05T10:00:00+00:00", "feat: third"), "c4": ("Dev Two", "dev2@example.com", "2024-04-06T10:00:00+00:00", "feat: fourth"),
        "c5": ("anonymizer", "anonymizer@anonymizer.local", "2024-04-07T10:00:00+00:00", "anonymize repository identifiers"),
    }
    commits = _commits(spark, graph, **about)
    refs = spark.createDataFrame([("r", "refs/heads/main", "commit", "c2", None), ("r", "refs/heads/work", "commit", "c5", None), ("r", "refs/tags/v0", "commit", "c2", None), ("r", "refs/tags/v1.0", "tag", "t1", "c4")], REF)
    files = spark.createDataFrame([("r", "c1", "src/a.py", 30, 0), ("r", "c1", "src/b.py", 25, 0), ("r", "c1", "tests/test_a.py", 8, 0), ("r", "c2", "package-lock.json", 40, 0), ("r", "c3", "src/c.py", 40, 0), ("r", "c4", "src/d.py", 15, 0), ("r", "c5", "src/a.py", 1, 1)], "repo_id string, sha string, path string, added long, deleted long")
    depths = history.ref_depths(commits, refs)
    chosen = history.chosen_refs(depths).collect()[0]
    assert (chosen["ref"], chosen["commits"], chosen["candidates"]) == ("refs/heads/work", 5, 3)
    assert {r[0] for r in depths.select(history.ref_kind(F.col("ref"))).collect()} == {"local", "tag"}
    got = history.tallied(commits, files, refs).collect()[0].asDict()
    # Measured from the pass's parent: four commits, one of them a bot's; only the first touches two files of work.
    assert got == {"repo_id": "r", "ref_commits": 5, "ref_candidates_considered": 3, "anonymizer_tip_detected": True, "first_at": "2024-04-01T10:00:00+00:00", "last_at": "2024-04-06T10:00:00+00:00", "merges": 0, "real_commits": 3, "mineable_commits": 1, "human_authors": 2, "tag_count": 2, "semver_tags": 1}


def test_reachability_against_a_walk(spark):
    rng = random.Random(6)
    graph = {}
    for k in range(150):
        before = list(graph)[-12:]
        graph[f"n{k}"] = rng.sample(before, min(len(before), rng.choice([0, 1, 1, 1, 2, 3]))) + (["gone"] if k % 31 == 0 else [])
    tips = rng.sample(list(graph), 8)

    def walk(tip):
        found, todo = set(), [tip]
        while todo:
            sha = todo.pop()
            if sha in graph and sha not in found:
                found.add(sha)
                todo += graph[sha]
        return found

    got = history.reachable(_commits(spark, graph), spark.createDataFrame([("r", t) for t in [*tips, "gone", None]], "repo_id string, tip string")).collect()
    assert sorted((r["tip"], r["sha"]) for r in got) == sorted((t, s) for t in tips for s in walk(t))


def test_a_long_chain_takes_logarithmic_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(history, "cut", lambda df, real=history.cut: rounds.append(1) or real(df))
    n = 100_000
    chain = spark.range(n).select(F.lit("r").alias("repo_id"), F.col("id").cast("string").alias("sha"), F.when(F.col("id") > 0, F.array((F.col("id") - 1).cast("string"))).otherwise(F.array().cast("array<string>")).alias("parents"))
    got = history.first_parent_depths(chain)
    assert got.agg(F.sum((F.col("depth") == F.col("sha").cast("long")).cast("int")), F.count_distinct("root")).first() == (n, 1)
    assert len(rounds) <= 19
    assert history.first_parent_depths(chain.limit(0)).count() == 0


def test_rows_are_commits_however_many_refs_reach_them(spark, monkeypatch):
    sizes = []

    def counted(df, real=history.cut):
        out = real(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(history, "cut", counted)
    n = 1000
    chain = spark.range(n).select(F.lit("r").alias("repo_id"), F.format_string("%04d", "id").alias("sha"), F.when(F.col("id") > 0, F.array(F.format_string("%04d", F.col("id") - 1))).otherwise(F.array().cast("array<string>")).alias("parents"))
    refs = chain.where("sha % 5 = 4").select("repo_id", F.concat(F.lit("refs/heads/"), "sha").alias("ref"), F.lit("commit").alias("object_type"), "sha", F.lit(None).cast("string").alias("peeled_sha"))
    got = history.ref_depths(chain, refs).collect()
    assert len(got) == 200 and all((r["commits"], r["merges"], r["roots"]) == (int(r["sha"]) + 1, 0, 1) for r in got)
    # All pairs of a ref and a commit that it reaches are 100,500.
    assert max(sizes) <= n


def _reach(graph, tip):
    found, todo = set(), [tip]
    while todo:
        sha = todo.pop()
        if sha in graph and sha not in found:
            found.add(sha)
            todo += graph[sha]
    return found


def test_every_ref_is_counted_against_a_walk(spark, monkeypatch):
    # Parts of 16 tips, blocks of 8 depths, and chunks of 40 commits, in no order.
    monkeypatch.setattr(history, "CHUNK", 40)
    monkeypatch.setattr(history, "WORD", 16)
    monkeypatch.setattr(history, "WORDS", 1)
    monkeypatch.setattr(history, "BLOCK", 8)
    rng = random.Random(11)
    graphs = {}
    for repo, width in (("a", 12), ("b", 3), ("c", 60)):
        graph = graphs[repo] = {}
        for k in range(120):
            before = list(graph)[-width:]
            graph[f"{repo}{k:03d}"] = rng.sample(before, min(len(before), rng.choice([0, 1, 1, 1, 1, 2, 3]))) + (["gone"] if k % 31 == 0 else [])
    # No merges off the line, as in the queries: ends, and side lines that are merged again.
    line = graphs["d"] = {}
    for k in range(150):
        line[f"d{k:03d}"] = [f"d{k - (3 if k % 7 == 3 else 1):03d}"] * (k > 0) + ([f"d{k - 5:03d}"] if k % 7 == 6 else [])
    commits = spark.createDataFrame([(r, sha, p, "n", "a@x", "2024-04-01T10:00:00+00:00", "feat: x") for r, g in graphs.items() for sha, p in g.items()], COMMIT).repartition(3)
    rows = [(r, f"refs/tags/{sha}", "commit", sha, None) for r, g in graphs.items() for sha in g] + [("a", "refs/tags/none", "commit", "gone", None), ("a", "refs/tags/null", "commit", None, None), ("z", "refs/tags/z", "commit", "z", None)]
    got = {(r["repo_id"], r["ref"]): (r["commits"], r["merges"], r["roots"]) for r in history.ref_depths(commits, spark.createDataFrame(rows, REF)).collect()}
    want = {}
    for r, ref, _, sha, _ in rows:
        g = graphs.get(r, {})
        found = _reach(g, sha)
        want[r, ref] = (len(found), sum(len(g[s]) > 1 for s in found), sum(not g[s] for s in found))
    assert got == want


def test_no_ref_candidate_or_commit_is_cut(spark):
    n = 20_010
    at = F.format_string("2024-01-01T%02d:%02d:00+00:00", (F.col("id") % 24).cast("int"), (F.col("id") % 60).cast("int"))
    chain = spark.range(n).select(
        F.lit("r").alias("repo_id"), F.format_string("%05d", "id").alias("sha"), F.when(F.col("id") > 0, F.array(F.format_string("%05d", F.col("id") - 1))).otherwise(F.array().cast("array<string>")).alias("parents"),
        F.lit("Dev").alias("name"), F.concat(F.lit("d"), "id", F.lit("@x.org")).alias("address"), at.alias("at"), F.lit("feat: x").alias("subject"),
    )
    refs = chain.where("sha % 40 = 9").select("repo_id", F.concat(F.lit("refs/tags/v1."), "sha").alias("ref"), F.lit("commit").alias("object_type"), "sha", F.lit(None).cast("string").alias("peeled_sha"))
    depths = history.ref_depths(chain, refs).collect()
    assert len(depths) == 501 and all(r["commits"] == int(r["sha"]) + 1 for r in depths)
    files = chain.select("repo_id", "sha", F.explode(F.array(F.lit("src/a.py"), F.lit("src/b.py"))).alias("path"), F.lit(20).cast("long").alias("added"), F.lit(0).cast("long").alias("deleted"))
    got = history.tallied(chain, files, refs).collect()[0].asDict()
    assert {k: got[k] for k in ("ref_commits", "ref_candidates_considered", "real_commits", "mineable_commits", "human_authors", "tag_count")} == {"ref_commits": n, "ref_candidates_considered": 501, "real_commits": n, "mineable_commits": n, "human_authors": n, "tag_count": 501}


def test_lines_in_stored_order_are_followed_within_chunks(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(history, "cut", lambda df, real=history.cut: rounds.append(1) or real(df))
    sha = lambda id_: F.format_string("%05d", id_)
    line = spark.range(0, 5000, 1, 4).select(F.lit("r").alias("repo_id"), sha(F.col("id")).alias("sha"), F.when(F.col("id") > 0, F.array(sha(F.col("id") - 1))).otherwise(F.array().cast("array<string>")).alias("parents"))
    got = history._spines(line, spark.createDataFrame([("r", "04999"), ("r", "00100")], "repo_id string, tip string"))
    assert got.agg(F.count_if(F.col("depth") == F.col("sha").cast("long")), F.count("*")).first() == (5000, 5000)
    # By pointers from mark to mark: more than 20.
    assert len(rounds) <= 12
