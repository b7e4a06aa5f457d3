"""A fingerprint of a tree's contents as a Merkle tree whose blocks are tasks.

A file is a leaf: the SHA-256 of its path and of its content's SHA-256. Leaves are dealt by the first hexadecimal digits of the
hash of their path; a node hashes its children in the order of their digits, two digits a level. So a block has about as many
members as leaves are left over 16^DIGITS, or at most 256, whatever folders the files stand in, and the digest hangs on paths
and contents alone: not on the order of rows, their partitions or where the tree is checked out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGITS = 6
UNREADABLE = "unreadable"


def leaf(path: Column, content: Column) -> Column:
    """Null content: the file could not be read."""
    return F.sha2(F.concat(path.cast("string"), F.lit("\0"), F.coalesce(F.sha2(content.cast("binary"), 256), F.lit(UNREADABLE)), F.lit("\0")), 256)


def tree_digest(files: DataFrame, repo: str = "repo_id", path: str = "path", content: str = "content", digits: int = DIGITS) -> DataFrame:
    """(repo, repo_digest, files): one row for each repository with a file. Files of .git and null paths are left out; a path that
    comes twice counts twice."""
    p = F.col(path).cast("string")
    rows = files.where(p.isNotNull() & ~p.startswith(".git/") & (p != ".git"))
    rows = rows.select(F.col(repo).alias("repo"), F.sha2(p, 256).alias("at"), leaf(p, F.col(content)).alias("hash"), F.lit(1).cast("long").alias("files"))
    for left in range(digits, -1, -2):
        children = F.transform(F.array_sort(F.collect_list(F.struct("at", "hash"))), lambda c: c["hash"])
        rows = rows.groupBy("repo", F.substring("at", 1, left).alias("up")).agg(F.sha2(F.array_join(children, ""), 256).alias("hash"), F.sum("files").alias("files")).withColumnRenamed("up", "at")
    return rows.select(F.col("repo").alias(repo), F.col("hash").alias("repo_digest"), "files")
