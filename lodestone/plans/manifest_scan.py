"""Lockfiles and manifests that are derived from documents, parts and suppliers, through the library's readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import manifests

# A document stands for one of seven lockfiles; its words are broken into the lines of that format.
_FORMATS = {
    "yarn.lock": "replace(replace(text, 'e ', 'e\n\n'), 'n ', '\n')",
    "pnpm-lock.yaml": "replace(replace(text, 'a ', '\n  /'), 'd ', '\n  ')",
    "poetry.lock": "replace(text, 't ', '[[package]]')",
    "go.sum": "replace(text, 's ', '\n')",
    "Gemfile.lock": "concat(replace(text, 'a ', '\n  '), '\n  specs:\n', replace(replace(text, 'e ', '\n  '), 'n ', '\n    '))",
    "package-lock.json": "concat('{\"packages\": {\"a', doc_id, '\": {\"x\": [1, {\"y\": 2}]}, \"b\": \"c\"}, \"dependencies\": {}}')",
    "uv.lock": "text",
}


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("text", F.regexp_replace("text", "\r", ""))
    sql = "CASE doc_id % 7 " + " ".join(f"WHEN {k} THEN {e}" for k, e in enumerate(_FORMATS.values())).replace("\n", "\\n") + " END"
    names = F.get(F.array(*(F.lit(n) for n in _FORMATS)), (F.col("doc_id") % 7).cast("int"))
    return docs.select(F.col("source").alias("repo_id"), F.concat(F.lit("d"), "doc_id", F.lit("/"), names).alias("path"), F.expr(sql).alias("content"), "doc_id")


def lock_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.locked_entries(_documents(spark, sf_dir))


def transitive_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.transitive_counts(_documents(spark, sf_dir))


def manifest_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier declares itself and its neighbours by number in the manifests of nine ecosystems."""
    k = F.col("s_suppkey")
    texts = {
        "package.json": ('{{"dependencies": {{"@s/n{0}": "1"}}, "peerDependencies": {{"peer-{0}": "*"}}, "scripts": {{"x": "y"}}}}'),
        "requirements.txt": "boto{0}==1.0\n# no\nSQL_{0}>=2  # why\n-e .\nhttps://x/y\n",
        "pyproject.toml": '[project]\nname = "svc"\ndependencies = [\n  "Req{0}[x]>=1",  # c\n  "two{0} ; extra == \'y\'",\n]\n[project.optional-dependencies]\ndev = ["opt{0}"]\n[tool.poetry.dependencies]\npo-{0} = "^1"\n'
        '[tool.poetry.group.test.dependencies]\n"gr{0}" = {{version = "1"}}\n[tool.black]\nline-length = 1\n[build-system]\nrequires = ["build{0}"]\n',
        "setup.cfg": "[options]\ninstall_requires =\n    cfg{0}>1\n    two_{0}\npython_requires = >=3\n[flake8]\n  not{0} = 1\n",
        "environment.yml": "name: e{0}\ndependencies:\n  - conda{0}=1.0\n  - pip:\n    - inner{0}>2\nchannels:\n  - c{0}\n",
        "Cargo.toml": '[package]\nname = "p{0}"\n[dependencies]\nserde{0} = "1"\n[dev-dependencies.tok{0}]\nversion = "1"\n[workspace.dependencies]\nws{0} = "1"\n',
        "Gemfile": "source 'https://x'\n  gem \"rails{0}\", '1'\n# gem\n",
        "pom.xml": "<dependency><groupId>org.x{0}</groupId>\n<artifactId> art{0} </artifactId><version>1</version></dependency>",
        "go.mod": "module example.com/m{0}\nrequire (\n\tgithub.com/a/b{0} v1.2.3\n)\nrequire go.x.org/y{0} v0.1.0\n",
    }
    entries = F.array(*(F.struct(F.lit(n).alias("path"), F.regexp_replace(F.lit(t.replace("{0}", "@@").replace("{{", "{").replace("}}", "}")), "@@", k.cast("string")).alias("content")) for n, t in texts.items()))
    files = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(k.alias("repo_id"), F.inline(entries))
    return manifests.declared_names(files)


QUERIES = {q.__name__: q for q in (lock_entries, transitive_counts, manifest_names)}
_ENTRIES = """
    f AS (SELECT source, doc_id, replace(text, chr(13), '') AS text, doc_id % 7 AS kind FROM documents),
    c AS (SELECT source, doc_id, kind, CASE kind
            WHEN 0 THEN replace(replace(text, 'e ', 'e' || chr(10) || chr(10)), 'n ', chr(10)) WHEN 1 THEN replace(replace(text, 'a ', chr(10) || '  /'), 'd ', chr(10) || '  ')
            WHEN 2 THEN replace(text, 't ', '[[package]]') WHEN 3 THEN replace(text, 's ', chr(10))
            WHEN 4 THEN replace(replace(text, 'e ', chr(10) || '  '), 'n ', chr(10) || '    ') ELSE '' END AS t FROM f),
    e AS (SELECT source, doc_id, kind, CASE kind
            WHEN 0 THEN (length(t) - length(replace(t, chr(10) || chr(10), ''))) // 2 WHEN 1 THEN (length(t) - length(replace(t, chr(10) || '  /', ''))) // 4
            WHEN 2 THEN (length(t) - length(replace(t, '[[package]]', ''))) // 11 WHEN 3 THEN (length(t) - length(replace(t, chr(10), ''))) // 2
            WHEN 4 THEN len(list_filter(string_split(t, chr(10)), lambda l: starts_with(l, '  ') AND NOT starts_with(l, '    '))) WHEN 5 THEN 2 ELSE 0 END AS entries,
            'd' || doc_id || '/' || ['yarn.lock', 'pnpm-lock.yaml', 'poetry.lock', 'go.sum', 'Gemfile.lock', 'package-lock.json', 'uv.lock'][kind + 1] AS path FROM c)"""
ORACLE = {
    "lock_entries": f"WITH {_ENTRIES} SELECT source AS repo_id, path, entries FROM e",
    "transitive_counts": f"""
    WITH {_ENTRIES}, p AS (SELECT source, entries, row_number() OVER (PARTITION BY source, kind ORDER BY path) AS place FROM e)
    SELECT source AS repo_id, CAST(sum(entries) AS BIGINT) AS total_transitive_deps FROM p WHERE place = 1 GROUP BY source""",
    "manifest_names": """
    WITH n AS (SELECT s_suppkey AS k, unnest([
        {'e': 'npm', 'n': '@s/n' || s_suppkey}, {'e': 'npm', 'n': 'peer-' || s_suppkey}, {'e': 'pypi', 'n': 'boto' || s_suppkey}, {'e': 'pypi', 'n': 'sql-' || s_suppkey},
        {'e': 'pypi', 'n': 'req' || s_suppkey}, {'e': 'pypi', 'n': 'two' || s_suppkey}, {'e': 'pypi', 'n': 'opt' || s_suppkey}, {'e': 'pypi', 'n': 'po-' || s_suppkey},
        {'e': 'pypi', 'n': 'gr' || s_suppkey}, {'e': 'pypi', 'n': 'build' || s_suppkey}, {'e': 'pypi', 'n': 'cfg' || s_suppkey}, {'e': 'pypi', 'n': 'two-' || s_suppkey},
        {'e': 'pypi', 'n': 'conda' || s_suppkey}, {'e': 'pypi', 'n': 'pip'}, {'e': 'pypi', 'n': 'inner' || s_suppkey}, {'e': 'cargo', 'n': 'serde' || s_suppkey}, {'e': 'cargo', 'n': 'tok' || s_suppkey},
        {'e': 'cargo', 'n': 'ws' || s_suppkey}, {'e': 'gem', 'n': 'rails' || s_suppkey}, {'e': 'maven', 'n': 'org.x' || s_suppkey}, {'e': 'maven', 'n': 'art' || s_suppkey},
        {'e': 'go', 'n': 'github.com/a/b' || s_suppkey}, {'e': 'go', 'n': 'go.x.org/y' || s_suppkey}]) AS r FROM supplier)
    SELECT k AS repo_id, r.e AS ecosystem, r.n AS name FROM n""",
}
