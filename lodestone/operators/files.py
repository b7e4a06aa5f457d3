"""Tree analytics over files (repo_id, path, text): languages, sizes, tests, infrastructure, largest files.

Sizes are at most LINE_CAP lines, so order statistics come from a histogram of bounded size for each repository; no group of
files is ever collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.text import nonblank_lines

FIXTURE_LINES = 5000


def file_stats(files: DataFrame) -> DataFrame:
    """One row for each walked file: ext, lang, loc, is_code, is_generated, is_test, is_fixture, iac_kind (null: none).

    Null texts count as empty. Files below skipped directories go.
    """
    p, t = F.col("path"), F.col("text")
    charts = files.where(paths.is_walked(p) & F.lower(paths.basename(p)).isin("chart.yaml", "chart.yml")).select("repo_id", paths.parent(p).alias("chart")).distinct()
    name, slashed = F.lower(paths.basename(p)), F.concat(F.lit("/"), p)
    home = F.when(slashed.contains("/templates/"), F.regexp_replace(F.split_part(slashed, F.lit("/templates/"), F.lit(1)), "^/+", ""))
    rows = files.where(paths.is_walked(p)).withColumns({"beside": F.when(name.startswith("values"), paths.parent(p)), "home": home})
    beside, above = charts.select("repo_id", F.col("chart").alias("beside"), F.lit(True).alias("is_beside")), charts.select("repo_id", F.col("chart").alias("home"), F.lit(True).alias("is_below"))
    rows = rows.join(beside, ["repo_id", "beside"], "left").join(above, ["repo_id", "home"], "left")
    in_chart = F.coalesce("is_beside", "is_below", F.lit(False))
    test, fixture, generated = paths.is_test(p), paths.is_fixture(p), paths.is_generated(t)
    kind = F.when(~(test | fixture | generated), paths.infrastructure_kind(p, t, in_chart))
    return rows.select("repo_id", "path", paths.extension(p).alias("ext"), paths.language(p).alias("lang"), nonblank_lines(t).alias("loc"), paths.is_code(p).alias("is_code"), generated.alias("is_generated"), test.alias("is_test"), fixture.alias("is_fixture"), kind.alias("iac_kind"))


def languages(stats: DataFrame) -> DataFrame:
    """For each repository: total_loc, loc_by_language, files_by_language, primary_language, secondary_languages (next three).

    Source that is not generated counts; ties go by name; a repository without any has Unknown and empty maps.
    """
    by = stats.where("is_code AND NOT is_generated").groupBy("repo_id", "lang").agg(F.sum("loc").alias("loc"), F.count("*").alias("files"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("loc")).alias("less"), "lang", "loc", "files")))
    got = by.groupBy("repo_id").agg(F.sum("loc").alias("total_loc"), ranked.alias("r"))
    got = got.select(
        "repo_id",
        "total_loc",
        F.map_from_entries(F.transform("r", lambda x: F.struct(x.lang, x.loc))).alias("loc_by_language"),
        F.map_from_entries(F.transform("r", lambda x: F.struct(x.lang, x.files))).alias("files_by_language"),
        F.col("r")[0]["lang"].alias("primary_language"),
        F.transform(F.slice("r", 2, 3), lambda x: x.lang).alias("secondary_languages"),
    )
    none = F.create_map().cast("map<string,bigint>")
    return stats.select("repo_id").distinct().join(got, "repo_id", "left").select(
        "repo_id",
        F.coalesce("total_loc", F.lit(0)).alias("total_loc"),
        F.coalesce("loc_by_language", none).alias("loc_by_language"),
        F.coalesce("files_by_language", none).alias("files_by_language"),
        F.coalesce("primary_language", F.lit("Unknown")).alias("primary_language"),
        F.coalesce("secondary_languages", F.array().cast("array<string>")).alias("secondary_languages"),
    )


def sizes(stats: DataFrame) -> DataFrame:
    """For each repository with sized files: files, median_loc, p90_loc (elements n div 2 and 0.9 n of the sorted sizes),
    over_500, over_1000, non_test. Source that is not generated and infrastructure count, where they have lines."""
    sized = stats.where("loc > 0 AND ((is_code AND NOT is_generated) OR iac_kind IS NOT NULL)")
    each = sized.groupBy("repo_id", "loc").agg(F.count("*").alias("n"), F.count_if(~F.col("is_test")).alias("non_test"))
    upto, whole = Window.partitionBy("repo_id").orderBy("loc"), Window.partitionBy("repo_id")
    each = each.withColumns({"upto": F.sum("n").over(upto), "files": F.sum("n").over(whole)})
    reached = lambda at: F.min(F.when(F.col("upto") > at, F.col("loc")))
    more = lambda than: F.coalesce(F.sum(F.when(F.col("loc") > than, F.col("n"))), F.lit(0))
    return each.groupBy("repo_id").agg(F.max("files").alias("files"), reached(F.expr("files div 2")).alias("median_loc"), reached(F.expr("cast(files * 0.9D as bigint)")).alias("p90_loc"), more(500).alias("over_500"), more(1000).alias("over_1000"), F.sum("non_test").alias("non_test"))


def largest(stats: DataFrame, n: int = 10) -> DataFrame:
    """(repo_id, path, loc, place) of the n largest sized files of each repository; ties go by path."""
    place = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("loc"), "path"))
    return stats.where("loc > 0 AND ((is_code AND NOT is_generated) OR iac_kind IS NOT NULL)").select("repo_id", "path", "loc", place.alias("place")).where(F.col("place") <= n)


def tests(stats: DataFrame) -> DataFrame:
    """For each repository: spec_files, fixture_files (by path or beyond FIXTURE_LINES), test_files."""
    data = F.col("is_fixture") | (F.col("loc") > FIXTURE_LINES)
    return stats.groupBy("repo_id").agg(F.count_if(F.col("is_test") & ~data).alias("spec_files"), F.count_if(F.col("is_test") & data).alias("fixture_files"), F.count_if("is_test").alias("test_files"))


KINDS = ("Ansible", "CloudFormation", "Docker Compose", "Dockerfile", "Helm", "Kubernetes", "Terraform")


def infrastructure(stats: DataFrame) -> DataFrame:
    """For each repository: iac_files, iac_loc, and files and lines of each kind, zero where there are none."""
    own = F.col("iac_kind").isNotNull() & (F.col("loc") > 0)
    out = [F.count_if(own).alias("iac_files"), F.coalesce(F.sum(F.when(own, F.col("loc"))), F.lit(0)).alias("iac_loc")]
    for kind in KINDS:
        is_kind, label = own & (F.col("iac_kind") == kind), kind.lower().replace(" ", "_")
        out += [F.count_if(is_kind).alias(f"{label}_files"), F.coalesce(F.sum(F.when(is_kind, F.col("loc"))), F.lit(0)).alias(f"{label}_loc")]
    return stats.groupBy("repo_id").agg(*out)


def language_share(by_language, total, chosen: tuple[str, ...] = ("Java", "Kotlin", "Scala", "C#")):
    """Share of the chosen languages in total lines, four digits; null where there are no lines."""
    own = F.map_filter(by_language, lambda k, _: k.isin(*chosen))
    return F.round(F.try_divide(F.aggregate(F.map_values(own), F.lit(0).cast("bigint"), lambda a, b: a + b), F.nullif(total, F.lit(0))), 4)
