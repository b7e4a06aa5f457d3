"""Counts out of JUnit reports. Spark's XML reader says whether a text is a document; its suites' attributes are then columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Attributes of a suite, and the names their sums have.
COUNTS = {"tests": "collected", "failures": "failed", "errors": "errored", "skipped": "skipped"}


def is_xml(text: Column) -> Column:
    """The XML reader finds a document whose elements are all closed."""
    parsed = F.from_xml(text, "_corrupt_record string, _any string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return F.coalesce(text.rlike(r"(?s)^\s*<.*>\s*$") & parsed.isNotNull() & parsed["_corrupt_record"].isNull(), F.lit(False))


def suites(text: Column) -> Column:
    """The start tags of a report's suites: of a document that is itself a suite that one, else all, however deep."""
    bare = F.regexp_replace(text, r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<!DOCTYPE[^>]*>", "")
    tags = F.regexp_extract_all(bare, F.lit(r"""(?s)<testsuite(?:\s(?:[^>"']|"[^"]*"|'[^']*')*)?/?>"""), 0)
    return F.when(bare.rlike(r"^\s*<testsuite[\s/>]"), F.slice(tags, 1, 1)).otherwise(tags)


def junit_counts(reports: DataFrame) -> DataFrame:
    """(repo_id, path, text) -> (repo_id, collected, failed, errored, skipped, passed): sums over the suites of reports that are XML.

    Reports that are none, null ones included, are left out. A repository without a suite has no row: it was not measured.
    """
    tags = reports.where(is_xml(F.col("text"))).select("repo_id", F.explode(suites(F.col("text"))).alias("tag"))
    count = lambda name: F.coalesce(F.regexp_extract("tag", rf"""\s{name}\s*=\s*["']\s*(\d+)\s*["']""", 1).try_cast("long"), F.lit(0).cast("long"))
    sums = tags.groupBy("repo_id").agg(*(F.sum(count(a)).alias(n) for a, n in COUNTS.items()))
    return sums.withColumn("passed", F.greatest(F.lit(0).cast("long"), F.col("collected") - F.col("failed") - F.col("errored") - F.col("skipped")))
