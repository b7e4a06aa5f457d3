"""Which half-open intervals of a key meet, by bins of time.

An interval is sent to every bin it touches, so only intervals of one bin of one key are compared; a pair that shares several
bins counts in the one where the later of the two starts, so none counts twice. Intervals much longer than a bin would be sent
to many: each length has bins of its own size, a power of WIDER, and a pair is looked for in the bins of the longer one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDER = 4


def _class(length: Column, unit: int) -> Column:
    """The size of bin, as a power of WIDER of the unit, that is not shorter than the interval."""
    return F.greatest(F.lit(0), F.ceil(F.log(float(WIDER), F.greatest(length, F.lit(1)) / unit)).cast("int"))


def overlaps(spans: DataFrame, keys: list[str], id_col: str, start: str, end: str, unit: int) -> DataFrame:
    """Pairs (keys..., first, second) of different intervals of a key that meet; first is the smaller id.

    start and end are whole numbers; [start, end) is empty where end <= start and meets nothing, and so does one with a null key,
    id or bound. Ids are unique within a key; `unit` is about the length of a short interval. Every interval is in at most two
    bins of each size that occurs in its key, so the work is the rows times the sizes, plus the pairs that share a bin.
    """
    s, e = F.col(start).cast("long"), F.col(end).cast("long")
    rows = spans.select(*keys, F.col(id_col).alias("id"), s.alias("s"), e.alias("e")).where("s < e AND id IS NOT NULL")
    rows = rows.withColumn("size", _class(F.col("e") - F.col("s"), unit))
    width = lambda c: (F.lit(unit) * F.pow(F.lit(WIDER), c)).cast("long")
    bins = lambda c: F.sequence(F.floor(F.col("s") / width(c)), F.floor((F.col("e") - 1) / width(c)))
    # The longer interval of a pair lies in at most two bins of its own size; the shorter one, in bins of that size, too.
    own = rows.withColumn("bin", F.explode(bins(F.col("size"))))
    sizes = rows.select(*keys, "size").distinct().withColumnRenamed("size", "at")
    shorter = rows.join(sizes, keys).where("size <= at").withColumn("bin", F.explode(bins(F.col("at"))))
    a = own.select(*keys, F.col("size").alias("at"), "bin", F.col("id").alias("a"), F.col("s").alias("as"), F.col("e").alias("ae"))
    b = shorter.select(*keys, "at", "bin", F.col("id").alias("b"), F.col("s").alias("bs"), F.col("e").alias("be"), "size")
    # Of one size, each pair would come twice: the smaller id is then the first.
    met = a.join(b, [*keys, "at", "bin"]).where("a <> b AND (size < at OR a < b) AND as < be AND bs < ae")
    once = met.where(F.floor(F.greatest("as", "bs") / width(F.col("at"))) == F.col("bin"))
    return once.select(*keys, F.least("a", "b").alias("first"), F.greatest("a", "b").alias("second"))


def start_order(spans: DataFrame, keys: list[str], id_col: str, start: str) -> DataFrame:
    """spans with `place`: their order of starting within a key, equal starts by id."""
    return spans.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(start, id_col)))
