"""Scans along ordered rows that are cut into blocks: what a block does is composed, and only a row a block is put in order.

A long sequence is never one task: blocks of BLOCK rows are worked on apart, a second look goes over one row for each block, and
its results are given back to the blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1024
#: Content of files that one task works on, where a file is not cut.
TASK_BYTES = 4 << 20
#: Rows that one task works on, where each brings a handful of others.
TASK_ROWS = 1 << 16


def parts(df: DataFrame, size: int, each: int) -> int:
    """Partitions that hold `each` of `size`, but no fewer than shuffles have."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


def file_parts(files: DataFrame) -> int:
    return parts(files, files.select(F.sum(F.octet_length("content"))).first()[0] or 0, TASK_BYTES)


def by_file(files: DataFrame) -> DataFrame:
    """files (repo_id, path, content, ...) in partitions by file whose number grows with the bytes of content, so that a task's
    memory does not. What is then done by repo_id and path, or by more, needs no other shuffle."""
    return files.repartition(file_parts(files), "repo_id", "path")


def lines(files: DataFrame, content: str = "content") -> DataFrame:
    """(repo_id, path, content) -> (repo_id, path, line, text), from line 0; no content, no lines. Lines end in \\n or \\r\\n."""
    parts = F.split(F.regexp_replace(content, "\r\n", "\n"), "\n")
    return files.where(F.col(content).isNotNull()).select("repo_id", "path", F.posexplode(parts).alias("line", "text"))


def filled(rows: DataFrame, by: list[str], order: str, value: Column, name: str, block: int = BLOCK, parts: int | None = None) -> DataFrame:
    """rows with `name`: the last value that is not null at the row or before it. order counts rows from 0, without large gaps.
    parts, if given, is the number of partitions that rows are dealt to, by the first of `by` and their block."""
    rows = rows.withColumns({"_own": value, "_block": F.floor(F.col(order) / block)})
    rows = rows.repartition(parts, by[0], "_block") if parts else rows
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    last = rows.groupBy(*by, "_block").agg(F.max_by("_own", F.when(F.col("_own").isNotNull(), F.col(order))).alias("_last"))
    carried = last.select(*by, "_block", F.last("_last", True).over(before).alias("_carried"))
    within = Window.partitionBy(*by, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    # Rows stay where they were dealt to; neither side is small for sure.
    rows = rows.withColumn("_within", F.last("_own", True).over(within)).join(carried.hint("merge") if parts else carried, [*by, "_block"])
    return rows.withColumn(name, F.coalesce("_within", "_carried")).drop("_own", "_block", "_within", "_carried")


def states(rows: DataFrame, by: list[str], order: str, step: Column, count: int, name: str = "state", start: int = 0, block: int = BLOCK) -> DataFrame:
    """rows with `name`: the state of an automaton of `count` states before it reads the row.

    step is what the row does: an array that gives the next state for each state; null leaves it. Steps compose, so each block
    is folded to one step, the blocks of a sequence are gone through in order, and each block is then gone through from the
    state it is entered in. order is unique within by.
    """
    identity = F.array(*(F.lit(k) for k in range(count)))
    rows = rows.withColumns({"_step": F.coalesce(step.cast("array<int>"), identity), "_block": F.floor(F.col(order) / block)})
    blocks = rows.groupBy(*by, "_block").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col("_step").alias("step")))).alias("steps"))
    whole = F.aggregate("steps", identity, lambda acc, s: F.transform(acc, lambda k: F.get(s["step"], k)))
    blocks = blocks.withColumn("whole", whole)
    first = F.array(F.lit(start))
    # One row a block: the states in which the blocks of a sequence are entered.
    chain = blocks.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_block", "whole"))).alias("chain"))
    along = lambda steps, field, begin: F.aggregate(steps, begin, lambda acc, s: F.concat(acc, F.array(F.get(s[field], F.element_at(acc, -1)))))
    entered = chain.select(*by, F.inline(F.arrays_zip(F.transform("chain", lambda c: c["_block"]).alias("_block"), F.slice(along(F.col("chain"), "whole", first), 1, F.size("chain")).alias("enters"))))
    inside = blocks.join(entered, [*by, "_block"]).select(*by, F.inline(F.arrays_zip(F.transform("steps", lambda s: s["at"]).alias(order), F.slice(along(F.col("steps"), "step", F.array("enters")), 1, F.size("steps")).alias(name))))
    return rows.drop("_step", "_block").join(inside, [*by, order])


def running(rows: DataFrame, by: list[str], order: str, value: Column, name: str, block: int = BLOCK) -> DataFrame:
    """rows with `name`: the sum of value over the rows before it. order counts rows from 0, without large gaps."""
    rows = rows.withColumns({"_own": F.coalesce(value, F.lit(0)).cast("long"), "_block": F.floor(F.col(order) / block)})
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*by, "_block").agg(F.sum("_own").alias("_sum")).select(*by, "_block", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*by, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum("_own").over(inside), F.lit(0))).join(sums, [*by, "_block"])
    return rows.withColumn(name, F.col("_before") + F.col("_inside")).drop("_own", "_block", "_before", "_inside")


def enclosing(rows: DataFrame, by: list[str], order: str, depth: str, opens: Column, wanted: Column, name: str) -> DataFrame:
    """rows with `name`: the order of the innermost row that encloses it and is `wanted`, null for none.

    A row that opens encloses what follows until a row that opens stands no deeper than it. Each row looks, for every depth
    that occurs and is not above its own, at the last opening row that is less deep: windows by depth in place of a stack.
    """
    whole = Window.partitionBy(*by)
    wide = rows.withColumns({"_opens": opens, "_wanted": wanted, "_levels": F.collect_set(depth).over(whole)}).withColumn("_level", F.explode("_levels"))
    before = Window.partitionBy(*by, "_level").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.when(F.col("_opens") & (F.col(depth) < F.col("_level")), F.struct(F.col(order).alias("at"), F.col("_wanted").alias("wanted")))
    found = wide.withColumn("_above", F.last(seen, True).over(before)).where(F.col("_level") <= F.col(depth))
    # What a row holds comes along, so that no join reads the rows a second time.
    held = [F.first(c).alias(c) for c in rows.columns if c not in (*by, order)]
    return found.groupBy(*by, order).agg(*held, F.max(F.when(F.col("_above.wanted"), F.col("_above.at"))).alias(name))
