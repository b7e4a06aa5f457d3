"""Classes, names, versions and cells on small cases with known results."""

from pyspark.sql import functions as F

from lodestone.functions import versions
from lodestone.operators import classify, identity
from lodestone.sources import sinks

SIGNALS = {
    "full": {"frontend_frameworks": 2, "ui_component_files": 20, "backend_frameworks": 2, "orm_db": 2},
    "paper": {"frontend_frameworks": 3, "backend_frameworks": 1, "orm_db": 1},
    "infra": {"terraform_present": 1, "terraform_files": 40, "iac_share": 0.9},
    "weak": {"security_libs": 1, "orm_db": 1, "service_frameworks": 1},
    "none": {"css_loc_ratio": 0.0},
}


def test_classes(spark):
    rows = [(r, s, float(v)) for r, all_ in SIGNALS.items() for s, v in all_.items()]
    got = {r["repo_id"]: r for r in classify.classified(spark.createDataFrame(rows, "repo_id string, signal string, value double")).collect()}
    assert {k: (r["primary_class"], r["suggested_classes"], r["is_monorepo"], r["undecided"]) for k, r in got.items()} == {
        "full": ("frontend", ["fullstack"], False, False),
        "paper": ("backend", ["backend"], False, False),
        "infra": ("infra", ["infra"], False, False),
        "weak": ("backend", ["backend"], False, False),
        "none": ("backend", ["backend"], False, True),
    }
    assert got["infra"]["raw_scores"]["infra"] == 14.0 and got["paper"]["raw_scores"]["frontend"] == 0.0
    assert got["full"]["class_confidence"]["backend"] == 0.5


def test_company(spark):
    names = {"Acme Systems, Inc.": "acmesystems", "acme-systems": "acmesystems", "Inc": "", "Foo Co Ltd": "foo", "Incline": "incline"}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r[0]: r[1] for r in df.select("n", identity.company_key(F.col("n"))).collect()} == names
    rows = [("a", "git_remote", "acme-systems", 0), ("a", "licence_file", "Acme Systems, Inc.", 1), ("a", "package_manifest", "other", 2), ("b", "git_remote", "foo", 0), ("b", "git_remote", "nobody", 1)]
    found = identity.candidates(spark.createDataFrame(rows, "repo_id string, family string, name string, seen int"), spark.createDataFrame([("nobody",)], "key string"))
    got = {r["repo_id"]: (r["outcome"], [tuple(c) for c in r["company_candidates"]]) for r in identity.company(found).collect()}
    assert got == {"a": ("confident", [("Acme Systems, Inc.", ["licence_file", "git_remote"]), ("other", ["package_manifest"])]), "b": ("uncertain", [("foo", ["git_remote"])])}


def test_industry(spark):
    rows = [("a", "health", "readme", "x"), ("a", "health", "dependencies", "y"), ("a", "law", "readme", "z"), ("b", "law", "readme", "z"), ("c", "law", "readme", "p"), ("c", "law", "readme", "q"), ("c", "art", "readme", "p"), ("c", "art", "readme", "q")]
    got = identity.industry(spark.createDataFrame(rows, "repo_id string, industry string, source string, word string")).collect()
    assert [tuple(r) for r in got] == [("a", "health", ["dependencies", "readme"])]


SPECS = [
    ("18", "node", False, [([18], [19])]), ("3.9.7", "python", False, [([3, 9], [3, 10])]), ("1.21", "go", True, [([1, 21], None)]), ("0.4", "node", False, [([0, 4], [0, 5])]),
    ("^18.2.0", "node", False, [([18, 2, 0], [19])]), ("^0.3.1", "node", False, [([0, 3, 1], [0, 4])]), ("~3.9", "python", False, [([3, 9], [3, 10])]), (">=14 <21", "node", False, [([14], [21])]),
    ("16 || 18", "node", False, [([16], [17]), ([18], [19])]), ("18.x", "node", False, [([18], [19])]), (">=3.8,<3.13", "python", False, [([3, 8], [3, 13])]), (">3.8,!=3.9", "python", False, [([3, 9], None)]),
    ("1.8", "java", False, [([8], [25])]), ("1.6", "java", False, [([6], [20])]), ("17", "java", False, [([17], None)]), ("lts/hydrogen", "node", False, [([18], [19])]), ("lts/*", "node", False, []),
    ("*", "node", False, []), ("latest", "ruby", False, []), ("'3.3'", "ruby", False, [([3, 3], [3, 4])]), ("none", "python", False, []), (None, "python", False, []),
]


def test_chosen_versions(spark):
    df = spark.createDataFrame([(str(k), *s[:3]) for k, s in enumerate(SPECS)], "repo_id string, spec string, lane string, floor boolean")
    declared = df.select("repo_id", "lane", versions.windows("spec", "lane", "floor").alias("windows"))
    assert {int(r["repo_id"]): [tuple(w) for w in r["windows"]] for r in declared.collect()} == {k: s[3] for k, s in enumerate(SPECS)}
    have = [("node", "v18.17.0", False), ("node", "20.1", True), ("node", "18.3.1", False), ("python", "Python 3.12.1", True), ("python", "3.9", False), ("java", "openjdk 21.0.2", True)]
    installed = spark.createDataFrame(have, "lane string, t string, is_default boolean").select("lane", versions.version(F.col("t")).alias("version"), "is_default")
    got = {int(r["repo_id"]): r["version"] for r in versions.chosen(declared, installed).collect()}
    assert (got[0], got[1], got[4], got[7], got[10], got[12], got[14], got[2], got[17]) == ([18, 17, 0], [3, 9], [18, 3, 1], [20, 1], [3, 12, 1], [21, 0, 2], [21, 0, 2], None, [20, 1])
    java = spark.createDataFrame([("1.8.0_292",), ("17",), ("none",)], "t string").select(versions.modern_java(versions.version(F.col("t")))).collect()
    assert [r[0] for r in java] == [[8, 0], [17], None]


def test_cells_and_upsert(spark, tmp_path):
    df = spark.createDataFrame([("a,\"b", True, {"z": 1, "a": 2}, ["x"], None), (None, False, None, [], 3)], "s string, b boolean, m map<string,bigint>, l array<string>, n bigint")
    assert [tuple(r) for r in sinks.cells(df).collect()] == [("a,\"b", "true", '{"a":2,"z":1}', '["x"]', ""), ("", "false", "", "[]", "3")]
    sinks.write_csv(df.coalesce(1), str(tmp_path / "c"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c"))
    assert sorted((r["s"] or "", r["m"] or "") for r in back.collect()) == [("", ""), ('a,"b', '{"a":2,"z":1}')]
    old, new = (spark.createDataFrame(x, "k string, v int, at long") for x in ([("a", 1, 0), ("b", 2, 1)], [("c", 9, 0), ("b", 8, 1)]))
    got = sinks.upserted(old, new, "k", "at").orderBy("at").collect()
    assert [tuple(r[c] for c in ("k", "v")) for r in got] == [("a", 1), ("b", 8), ("c", 9)]
