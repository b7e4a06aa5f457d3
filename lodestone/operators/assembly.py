"""Blocks of measurements that meet in one row for each repository.

A block is a table with one row for each repository. It is told as facts, a row for each number, text, flag, list member and map
entry, so blocks with different columns are one table, which is grouped by repository once however many blocks there are. The
nested type is generated from what is declared: {block: {field: kind}} with the kinds below. A field without a fact was not
measured and is null; a list or map that was measured and is empty leaves a fact that says so.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER, TEXT, FLAG, LIST, MAP = "number", "text", "flag", "list", "map"
_FACT = "array<struct<field:string,key:string,number:double,text:string>>"


def facts(table: DataFrame, block: str, fields: dict[str, str]) -> DataFrame:
    """(repo_id, block, field, key, number, text) of the declared fields of table; its other columns are not told."""
    empty = F.array().cast(_FACT)
    fact = lambda name, key=F.lit(None), number=F.lit(None), text=F.lit(None): F.struct(F.lit(name).alias("field"), key.cast("string").alias("key"), number.cast("double").alias("number"), text.cast("string").alias("text"))

    def told(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind == LIST:
            some = F.concat(F.array(fact(name)), F.transform(c, lambda x, i: fact(name, key=F.format_string("%09d", i), text=x)))
        elif kind == MAP:
            some = F.concat(F.array(fact(name)), F.transform(F.map_entries(c), lambda e: fact(name, key=e["key"], number=e["value"])))
        else:
            some = F.array(fact(name, text=c) if kind == TEXT else fact(name, number=c.cast("int") if kind == FLAG else c))
        return F.when(c.isNotNull(), some).otherwise(empty).cast(_FACT)

    return table.select("repo_id", F.lit(block).alias("block"), F.inline(F.concat(*(told(n, k) for n, k in fields.items()))))


def assembled(told: Iterable[DataFrame], declared: dict[str, dict[str, str]]) -> DataFrame:
    """(repo_id, a struct for each block): all facts of a repository in one row. Facts that are not declared are refused."""
    rows = None
    for part in told:
        rows = part if rows is None else rows.unionByName(part)
    names = [f"{b}.{f}" for b, fields in declared.items() for f in fields]
    name = F.concat_ws(".", "block", "field")
    rows = rows.withColumn("name", F.when(name.isin(names), name).otherwise(F.raise_error(F.concat(F.lit("not declared: "), name))))
    whole = rows.groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct("name", "key", "number", "text"))).alias("facts"))

    def field(block: str, name: str, kind: str) -> Column:
        own = F.filter("facts", lambda x: x["name"] == f"{block}.{name}")
        members = F.filter(own, lambda x: x["key"].isNotNull())
        first = F.get(own, F.lit(0))
        value = {
            NUMBER: first["number"], TEXT: first["text"], FLAG: first["number"] == 1, LIST: F.transform(members, lambda x: x["text"]),
            MAP: F.map_from_entries(F.transform(members, lambda x: F.struct(x["key"], x["number"]))),
        }[kind]
        return F.when(F.size(own) > 0, value).alias(name)

    return whole.select("repo_id", *(F.struct(*(field(b, n, k) for n, k in fields.items())).alias(b) for b, fields in declared.items()))


#: The blocks of a repository that the flat row reads.
DECLARED = {
    "tree": {"total_loc": NUMBER, "loc_by_language": MAP, "primary_language": TEXT, "source_files": NUMBER, "spec_files": NUMBER},
    "structure": {"test_files": NUMBER, "n_functions_seen": NUMBER, "decisions_gini_top1pct": NUMBER},
    "ci": {"ci_systems": LIST, "ci_present": FLAG, "runs_tests": FLAG},
    "git": {"commits": NUMBER, "human_authors": NUMBER, "active_days": NUMBER, "span_days": NUMBER},
    "history": {"mineable_commits": NUMBER},
}


def flat_row(measured: DataFrame) -> DataFrame:
    """The flat columns of a repository's row out of its blocks; what is never collected is left to the sink's declaration."""
    whole = lambda c: F.col(c).cast("long")
    specs, files = F.col("tree.spec_files"), F.col("tree.source_files")
    ratio = F.when(specs > 0, F.concat(F.lit("1:"), F.round((files - specs) / specs).cast("long"))).when(specs == 0, "0 tests")
    return measured.select(
        "repo_id", whole("tree.total_loc").alias("loc"), F.transform_values("tree.loc_by_language", lambda _, v: v.cast("long")).alias("languages"), F.col("tree.primary_language").alias("primary_language"),
        whole("structure.test_files").alias("test_code_files"), whole("tree.spec_files").alias("test_spec_files"), F.round(F.try_divide(specs, F.nullif(files, F.lit(0.0))), 4).alias("test_ratio"), ratio.alias("test_source_ratio"),
        F.col("ci.ci_present").alias("ci_present"), F.col("ci.runs_tests").alias("ci_runs_tests"), whole("git.commits").alias("commit_count"), whole("git.human_authors").alias("author_count"),
        whole("git.active_days").alias("active_days"), whole("git.span_days").alias("span_days"), whole("history.mineable_commits").alias("capacity"),
    )
