"""Functions, the decisions that fall to them, and lines of error handling."""

import ast
import random

import pytest

from lodestone.operators import structure

FILES = "repo_id string, path string, content string"


def _functions(spark, files):
    df = spark.createDataFrame([("r", k, v) for k, v in files.items()], FILES)
    got = {}
    for r in structure.functions(df).collect():
        got.setdefault(r["path"], []).append((r["at"], r["decisions"]))
    return {k: [d for _, d in sorted(v, key=lambda x: (x[0] < 0, x[0]))] for k, v in got.items()}


def test_decisions_fall_to_the_innermost_function(spark):
    files = {
        "a.py": "def load(p):\n    try:\n        with open(p) as f:\n            return f\n    except OSError:\n        return None\n\n\ndef pick(rows, limit):\n    for row in rows:\n        if row.get('if for'):  # if\n            pass\n        elif len(rows) >= limit and row:\n            break\n    else:\n        x = [\n  1 if y else 2\n  for y in rows]\n    return rows\n",
        "b.py": "def outer():\n    def inner(a,\n  b):\n        if a:\n            return b\n    return inner\n\nif True:\n    for x in y: pass\n\nclass C:\n    def one(self): return 1 if self else 2\n    \"\"\"\n    def not_this(): if\n    \"\"\"\n    async def two(self):\n        while self:\n            pass\n    f = lambda v: v\n",
        "c.ts": "export function f(n: number): string {\n  if (n < 0) {\n    return 'if {';\n  } else if (n === 0) {\n    return `for ${n}`;\n  }\n  return n ? 'a' : 'b';\n}\nexport const g = (xs: number[]): number => {\n  for (const x of xs) {\n    // while\n  }\n  return xs.map(x => x + 1);\n};\nclass K { get(a?: string) { switch (a) { case 'x': break; default: try { } catch (e) { } } } }\n",
        "d.go": "func Divide(a, b int) (int, error) {\n\tif b == 0 {\n\t\treturn 0, errors.New(\"{if\")\n\t}\n\treturn a / b, nil\n}\n\nfunc Sum(xs []int) int {\n\tf := func(x int) { for { } }\n\treturn 0\n}\n",
        "e.rs": "pub fn largest<'a>(xs: &'a [i32]) -> Option<i32> {\n    for x in xs {\n        match x { Some(b) => {} _ => y = '{', }\n    }\n}\nfn one() { s.map_err(|e| e.to_string()); }\n",
    }
    got = _functions(spark, files)
    # One: try 2, except 1. Two: for 2, if 2, elif 2, and 1, else 1, then if 2 and for 2 in the brackets.
    assert got["a.py"] == [3, 12]
    # outer only wraps; inner has its if; the loop at the margin belongs to none; the lambda comes last.
    assert got["b.py"] == [2, 2, 2, 0]
    # f: two ifs, one else, one question mark. g: a loop, its arrow has none. get: switch 2, case 2, default 1, try 2, catch 2.
    assert got["c.ts"] == [6, 2, 9, 0]
    assert got["d.go"] == [2, 2] and got["e.rs"] == [2 + 3 + 4, 0]


def _plain_decisions(source):
    """Decisions of each function by Python's own syntax tree, with the weights of the patterns."""
    out = []

    def walk(node, owner):
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                rec = [0, False]
                if owner is not None:
                    owner[1] = True
                out.append(rec)
                walk(child, rec)
                continue
            if owner is not None:
                owner[0] += 2 * isinstance(child, (ast.If, ast.For, ast.While, ast.Try, ast.IfExp)) + (len(child.values) - 1 if isinstance(child, ast.BoolOp) else 0) + isinstance(child, ast.ExceptHandler)
                if isinstance(child, (ast.For, ast.While, ast.Try)) and child.orelse or isinstance(child, ast.If) and child.orelse and not (len(child.orelse) == 1 and isinstance(child.orelse[0], ast.If)):
                    owner[0] += 1
                owner[0] += isinstance(child, ast.Try) and bool(child.finalbody)
            walk(child, owner)

    walk(ast.parse(source), None)
    return sorted(n for n, wraps in out if n or not wraps)


def test_python_against_its_own_syntax_tree(spark):
    rng = random.Random(2)

    def block(depth, inside):
        pad, out = "    " * depth, []
        for _ in range(rng.randint(1, 3)):
            kind = rng.choice(["def", "if", "for", "while", "try", "x", "x", "x"]) if depth < 5 else "x"
            if kind == "x":
                out.append(pad + rng.choice(["y = a and b or c", "z = 1 if y else 2", "pass", "call(\n1,\n  2 if a else 3,\n)", "s = 'if: for'", "# else:", ""]) if rng.random() < 0.9 else pad + "t = '''\nif x:\n'''")
                out.append(pad + "pass")
                continue
            head = {"def": "def f(a,\n b=(1, 2)):", "if": "if a:", "for": "for i in (\n a, b):", "while": "while a:", "try": "try:"}[kind]
            out += [pad + head, *block(depth + 1, True)]
            if kind == "try":
                out += [pad + "except (A, B):", *block(depth + 1, True)] + ([pad + "finally:", pad + "    pass"] if rng.random() < 0.5 else [])
            elif kind in ("if", "for", "while") and rng.random() < 0.5:
                if kind == "if" and rng.random() < 0.5:
                    out += [pad + "elif b:", *block(depth + 1, True)]
                out += [pad + "else:", pad + "    pass", *block(depth + 1, True)]
        return out

    files = {f"m{k}.py": "\n".join(block(0, False)) + "\n" for k in range(25)}
    got = _functions(spark, files)
    for path, text in files.items():
        assert sorted(got.get(path, [])) == _plain_decisions(text), text


@pytest.mark.parametrize("extra", [{}, {"x.py": None, "lib/vendor/q.py": "def a(): pass\n", "z.min.js": "function a() { }"}])
def test_totals_of_a_repository(spark, extra):
    files = {
        "src/ok.py": "def ok(n):\n    if n:\n        return n\n    raise ValueError", "gen.py": "# Code generated by x. DO NOT EDIT.\ndef a(): pass\n", "huge.py": "row = 1\n" * 200_000, "tests/test_ok.py": "def test(): assert 1\n",
        "n.ipynb": '{"cells": [{"cell_type": "markdown", "source": ["prose\\n"]}, {"cell_type": "code", "source": ["def m(x):\\n", "    return x\\n"]}, {"cell_type": "code", "source": "t = 0\\nassert t\\n"}]}', "bad.ipynb": "{", "README.md": "x",
    } | extra
    got = structure.structure(spark.createDataFrame([("r", k, v) for k, v in files.items()], FILES)).collect()[0]
    assert (got["prod_loc"], got["source_files"], got["test_files"], got["n_functions_seen"]) == (4 + 5, 2, 1, 2)
    assert got["decisions_gini_top1pct"] == 1.0 and got["error_handling_per_kloc"] == round(2 / 0.009, 3)


def test_share_of_the_top(spark):
    share = lambda values: structure.top_share(spark.createDataFrame([("r", v) for v in values], "k string, v long"), ["k"], "v").collect()[0]
    assert share([100] + [1] * 99)[1:] == (100, 199, 100) and share([10])[1:] == (1, 10, 10) and share([0, 0])[1:] == (2, 0, 0)
    assert share([5, 5, 5, *[1] * 247])[1:] == (250, 262, 15)


def test_files_are_shuffled_once_into_parts_that_grow_with_them(spark, monkeypatch):
    from lodestone.operators import scans

    df = spark.createDataFrame([("r", f"m{k}.py", "def a():\n    if x: pass\n" * 20) for k in range(50)], FILES)
    assert scans.by_file(df).rdd.getNumPartitions() == 4
    monkeypatch.setattr(scans, "TASK_BYTES", 1000)
    assert scans.by_file(df).rdd.getNumPartitions() == 24
    assert structure.functions(df)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2
