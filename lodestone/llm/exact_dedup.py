"""Exact duplicates by a 128-bit content hash, with a comparison of bytes inside each hash group.

Scale: copies collapse in each task before the shuffle, since the grouping key is the hash and the text itself; that grouping
compares bytes, so two texts under one hash make two groups. What comes back to the documents is joined on the hash alone,
16 bytes a row, as long as no hash holds two texts; only the documents under such a hash are joined by their text as well.
Large hash groups are split by the skew handling of the join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import text_or_empty, written


def _hash128(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", content_hash: Callable[[Column], Column] = _hash128) -> DataFrame:
    """One row for each row of df: id_col, keep_id, group_size, kept, text_sha256.

    keep: which id of a group stays, 'smallest' or 'largest'. Null counts as the empty text. A null id stays only where its
    whole group has null ids (keep_id null). Repeated rows count in group_size and share a fate. Other columns of df,
    whatever their names, are not looked at. An empty df gives no rows.
    """
    pick = {"smallest": F.min, "largest": F.max}[keep]
    docs = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).withColumn("h", content_hash(F.col("text")))
    texts = docs.groupBy("h", "text").agg(pick("id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = written(texts.select("h", "keep_id", "group_size"), "groups")
    clash = groups.groupBy("h").count().where("count > 1").select("h")
    narrow = docs.select("id", "h", F.sha2("text", 256).alias("text_sha256"))
    if clash.isEmpty():
        out = narrow.join(groups, "h")
    else:
        clash = written(clash, "clash")
        within = docs.join(clash, "h", "left_semi").join(texts.join(clash, "h", "left_semi"), ["h", "text"])
        out = narrow.join(groups.join(clash, "h", "left_anti"), "h").unionByName(within.select("h", "id", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size"))
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
