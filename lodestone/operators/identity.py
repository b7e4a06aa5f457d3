"""Whose a repository is: names found by independent families of evidence, grouped by what they are spelled like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Families by strength and by how well they spell, and words that end a company's name.
BY_STRENGTH = ["licence_file", "copyright_header", "git_remote", "package_manifest"]
BY_SPELLING = ["licence_file", "copyright_header", "package_manifest", "git_remote"]
LEGAL = [
    "inc", "incorporated", "llc", "lllp", "llp", "lp", "ltd", "ltda", "limited", "plc", "corp", "corporation", "co", "company",
    "gmbh", "mbh", "ag", "kg", "sa", "sas", "sarl", "srl", "spa", "bv", "nv", "ab", "as", "asa", "oy", "oyj", "aps", "pty", "pte",
    "kk", "kft", "zoo", "doo", "ou", "sro", "ug",
]
MOST_SHOWN, LEAST_VOTES = 3, 2
# End of the fixed values.


def company_key(name: Column) -> Column:
    """Letters and digits of the name in lower case, without legal words at its end; empty if nothing is left."""
    words = F.array_join(F.filter(F.split(F.lower(name), r"[^a-z0-9ß-öø-ÿ]+"), lambda w: w != ""), " ")
    return F.regexp_replace(F.regexp_replace(words, rf"(?:(?:^| )(?:{'|'.join(LEGAL)}))+$", ""), " ", "")


def candidates(evidence: DataFrame, nobody: DataFrame | None = None) -> DataFrame:
    """evidence (repo_id, family, name, seen: order of the finds) to (repo_id, key, name, families, place), all places.

    Names whose key is empty or in nobody (key) go. The name shown is the first of the family that spells best.
    """
    rows = evidence.where(F.col("family").isin(BY_STRENGTH)).withColumn("key", company_key(F.col("name"))).where("key <> ''")
    rows = rows if nobody is None else rows.join(nobody, "key", "left_anti")
    at = lambda order: F.array_position(F.lit(order), F.col("family"))
    each = rows.groupBy("repo_id", "key").agg(F.min_by("name", F.struct(at(BY_SPELLING), "seen")).alias("name"), F.collect_set(F.struct(at(BY_STRENGTH).alias("p"), F.col("family").alias("f"))).alias("f"))
    each = each.withColumn("f", F.array_sort("f"))
    order = Window.partitionBy("repo_id").orderBy(F.desc(F.size("f")), F.col("f")[0]["p"], "key")
    return each.select("repo_id", "key", "name", F.transform("f", lambda x: x["f"]).alias("families"), F.row_number().over(order).alias("place"))


def company(found: DataFrame) -> DataFrame:
    """(repo_id, outcome, company_candidates): confident if exactly one name of all has two families; the first three names."""
    sure = F.count_if(F.size("families") >= 2)
    shown = F.array_sort(F.collect_list(F.when(F.col("place") <= MOST_SHOWN, F.struct("place", "name", "families"))))
    return found.groupBy("repo_id").agg(F.when(sure == 1, "confident").otherwise("uncertain").alias("outcome"), F.transform(shown, lambda x: F.struct(x["name"].alias("company_name"), x["families"].alias("signal_families"))).alias("company_candidates"))


def industry(votes: DataFrame) -> DataFrame:
    """votes (repo_id, industry, source, word) to (repo_id, industry): the one with the most distinct votes, if at least two
    and alone at the top; repositories without an answer have no row."""
    each = votes.groupBy("repo_id", "industry").agg(F.count_distinct("source", "word").alias("votes"), F.array_sort(F.collect_set("source")).alias("sources"))
    most = each.groupBy("repo_id").agg(F.max("votes").alias("most"))
    top = each.join(most, "repo_id").where((F.col("votes") == F.col("most")) & (F.col("votes") >= LEAST_VOTES))
    return top.groupBy("repo_id").agg(F.count("*").alias("n"), F.first("industry").alias("industry"), F.first("sources").alias("industry_signals")).where("n = 1").drop("n")
