from pyspark.sql import functions as F

from lodestone.operators import dependencies as d


def test_names(spark):
    raw = [(' "My_Lib/" ',), ("@scope/Pkg",), ("a b",), ("",), (None,), ("'x'",)]
    assert [r[0] for r in spark.createDataFrame(raw, "t string").select(d.dep_name(F.col("t"))).collect()] == ["my-lib", "@scope/pkg", None, None, None, "x"]
    lines = [("Flask_Login>=1 ; x",), ("-r base.txt",), ("# no",), ("git+ssh://x",), ("./local",), ("  ",), (None,), ("a.b[extra]==2",)]
    assert [r[0] for r in spark.createDataFrame(lines, "t string").select(d.requirement_name(F.col("t"))).collect()] == ["flask-login", None, None, None, None, None, None, "a.b"]


def test_keyword_hits_give_every_group(spark):
    table = [("db", "any", "redis"), ("db", "npm", "pg"), ("ml", "pip", "torch*"), ("ml", "pip", "jax"), ("none", "any", "zz")]
    rows = [(1, "npm", "@x/redis"), (1, "npm", "pg"), (1, "npm", "redis"), (1, "pip", "torch-vision"), (2, "pip", "pg"), (2, "pip", "jaxlib"), (2, "npm", "torch"), (3, None, None)]
    got = d.keyword_hits(spark.createDataFrame(rows, "repo_id int, ecosystem string, name string"), table).collect()
    assert {(r[0], r[1]): r[2] for r in got} == {
        (1, "db"): ["pg", "redis"], (1, "ml"): ["torch"], (1, "none"): [], (2, "db"): [], (2, "ml"): [], (2, "none"): [], (3, "db"): [], (3, "ml"): [], (3, "none"): []
    }


def test_direct_counts_and_lockfiles(spark):
    go = "module m\n\nrequire example.org/a v1\nrequire (\n\t// comment\n\texample.org/b v2 // indirect\n\n\texample.org/c v3\n)\nreplace x => y\nrequire (\n d v1\n)\n"
    rows = [
        (1, "package.json", '{"dependencies": {"a": "1", "b": "2"}, "devDependencies": {"c": "3"}}'), (1, "go.mod", go), (1, "sub/package.json", '{"dependencies": {"z": "1"}}'),
        (2, "package.json", "not json"), (2, "go.mod", None), (3, "package.json", '{"dependencies": ["x"]}'), (4, "go.mod", "require (\n a v1"),
    ]
    got = d.direct_counts(spark.createDataFrame(rows, "repo_id int, path string, content string")).orderBy("repo_id").collect()
    assert [tuple(r) for r in got] == [(1, 6, 1), (2, 0, 0), (3, 0, 0), (4, 1, 0)]
    files = [(1, "b/yarn.lock"), (1, "a/yarn.lock"), (1, "node_modules/a/go.sum"), (1, "go.sum"), (1, "x.lock"), (2, None)]
    got = d.lockfiles(spark.createDataFrame(files, "repo_id int, path string")).orderBy("format").collect()
    assert [tuple(r) for r in got] == [(1, "go.sum", "go.sum"), (1, "yarn.lock", "a/yarn.lock")]
