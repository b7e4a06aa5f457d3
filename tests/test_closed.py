import pytest
from pyspark.sql import Row

from lodestone.operators import closed as k


def test_enforce_rebuilds_and_names_what_is_refused(spark):
    fields = {
        "n": k.number(0, 10), "lang": k.choice(["en", "de"]), "kind": k.choice(["a"], fold=True), "name": k.token("[a-z]+", 4),
        "notes": k.list_of(k.choice(["x", "y"])), "by": k.tally(["py", "go"]), "secret": k.uncollected(), "in": k.nested({"a": k.number(0), "b": k.choice(["u"], fold=True)}),
    }
    schema = "n double, lang string, kind string, name string, notes array<string>, by map<string,int>, secret string, `in` struct<a:int,b:string,c:string>"
    rows = [
        (1.0, "en", "zz", "abc", ["x", "q", None, "y"], {"py": 1, "c": 2, "d": 3, "other": None}, "s", (1, "v", "gone")),
        (11.0, "fr", "a", "abcde", None, {"go": -1}, None, (-1, "u", None)),
        (float("nan"), None, None, "ab\n", [], None, None, None),
        (None,) * 8,
    ]
    got = k.enforce(spark.createDataFrame(rows, schema), fields).collect()
    first = got[0]
    assert (first["kind"], first["notes"], first["by"], first["secret"], first["in"]) == ("other", ["x", "y"], {"other": 5, "py": 1}, None, Row(a=1, b="other"))
    assert [[tuple(v) for v in r["violations"]] for r in got] == [
        [], [("n", "number"), ("lang", "enum"), ("name", "token"), ("by", "count"), ("in", "a.number")], [("n", "number"), ("name", "token")], []
    ]
    assert tuple(got[3])[:-1] == (None,) * 8


def test_enforce_refuses_undeclared_missing_and_clashing_columns(spark):
    df = spark.createDataFrame([], "a int, b int")
    for fields in ({"a": k.number()}, {"a": k.number(), "b": k.number(), "c": k.number()}):
        with pytest.raises(ValueError):
            k.enforce(df, fields)
    with pytest.raises(ValueError):
        k.enforce(df, {"a": k.number(), "b": k.number()}, "a")
    assert k.enforce(df, {"a": k.number(), "b": k.number()}).count() == 0


def test_redacted_trees_pass_the_audit(spark):
    schema = "id long, author string, note string, items array<struct<who:string,text:string>>, by map<string,string>, raw string"
    row = (1, "Ann", "mail a@b.org now", [("x", "see src/app/main.py"), None], {"keep": "ok", "a@b.org": "one", "c@d.org": "two", "author": "z"}, "a@b.org")
    df = spark.createDataFrame([row, (2, None, None, None, None, None)], schema)
    found = k.leaks(df, exempt=["raw"]).select("id", "leak_field", "leak_kind").collect()
    assert [tuple(r) for r in found] == [(1, "author", "a proper name")]
    with pytest.raises(ValueError, match="author shows a proper name"):
        k.audit_no_leak(df, exempt=["raw"])
    out = k.redact_tree(df, identity=["author", "who"], exempt=["raw"], declared=["keep"])
    assert out.columns == ["id", "note", "items", "by", "raw"]
    got = out.orderBy("id").collect()
    assert got[0]["note"] == "mail [email] now" and got[0]["raw"] == "a@b.org"
    assert got[0]["items"] == [Row(text="see [path]"), None]
    assert got[0]["by"] == {"keep": "ok", "[email]": "one"}
    assert tuple(got[1]) == (2, None, None, None, None)
    assert k.audit_no_leak(out, exempt=["raw"]) is out
    assert k.leaks(df.select("id")).count() == 0
