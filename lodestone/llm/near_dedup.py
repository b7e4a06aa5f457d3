"""Near-duplicate documents by min-max hashing.

Every permutation of the shingle hashes yields two signature values, its minimum and its maximum, so half the hash
evaluations give a signature of the same length. Bands of the signature make buckets; links between documents of a bucket
are confirmed on the full shingle sets, and documents fall into the connected components of the confirmed links.

Scale: equal shingle sets collapse to one representative before banding. A bucket offers only pairs with its few pivots, so
a bucket of m documents costs a multiple of m pairs and not m squared. Where the confirmed links leave several components
in a bucket, an exact prefix-filter join over the rarest shingles of just those documents finds every link that is left
between components, without a cap. Shuffles carry 16 bytes for each document and band; texts travel only for documents
that have a candidate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import as_long, mix64, shingle_set, text_or_empty, written
from .components import components

PERMUTATIONS = 120
BAND_ROWS = 6


def _coefficients(permutations: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        seeds = mix64(np.arange(1, 2 * permutations + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (seeds[:permutations] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[permutations:] >> np.uint64(32)).astype(np.uint32)


def min_max_signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray, block: int = 2048) -> np.ndarray:
    """Minima, then maxima, of the permutations x -> a x + b modulo 2^32 over a non-empty set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low, high = np.full(len(a), 0xFFFFFFFF, np.uint32), np.zeros(len(a), np.uint32)
    for at in range(0, len(x), block):
        y = a[:, None] * x[None, at : at + block] + b[:, None]
        np.minimum(low, y.min(axis=1), out=low)
        np.maximum(high, y.max(axis=1), out=high)
    return np.concatenate([low, high])


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of `rows` signature values; the band's number is part of the key."""
    bands = signature.reshape(-1, rows).astype(np.uint64)
    with np.errstate(over="ignore"):
        out = np.arange(1, len(bands) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for k in range(rows):
            out = mix64(out * np.uint64(31) + bands[:, k])
    return out


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def sketches(docs: DataFrame, shingle: int, permutations: int, rows: int) -> DataFrame:
    """(id, text) -> id, n_shingles, set_key (128 bits of the set), bands. Empty sets have null set_key and bands."""
    import xxhash

    a, b = _coefficients(permutations)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n, keys, bands = [], [], []
            for text in batch["text"]:
                s = shingle_set(text, shingle)
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                bands.append(as_long(band_keys(min_max_signature(s, a, b), rows)) if len(s) else None)
            yield pd.DataFrame({"id": batch["id"], "n_shingles": n, "set_key": keys, "bands": bands})

    return docs.mapInPandas(run, T.StructType([docs.schema["id"], T.StructField("n_shingles", T.LongType()), T.StructField("set_key", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))]))


def confirmed(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Those of the pairs (u, v) whose full shingle sets are similar enough. docs: a row for each text of an id."""
    rows = pairs.join(docs.select(F.col("id").alias("v"), F.col("text").alias("text_v")), "v").join(docs.select(F.col("id").alias("u"), F.col("text").alias("text_u")), "u")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, of_last = None, None
        for batch in batches:
            keep = []
            for text_u, text_v in zip(batch["text_u"], batch["text_v"], strict=True):
                if text_u is not last:
                    if text_u != last:
                        of_last = shingle_set(text_u, shingle)
                    last = text_u
                keep.append(similar(of_last, shingle_set(text_v, shingle), percent))
            yield batch.loc[keep, ["u", "v"]]

    return rows.select("u", "v", "text_u", "text_v").mapInPandas(run, pairs.select("u", "v").schema)


#: Pivots that each bucket offers to its other members.
PIVOTS = 3


def _pivot_pairs(member: DataFrame) -> DataFrame:
    """Pairs (u, v) of each bucket's pivots with its other members. Pivots go by one random order, so that buckets agree."""
    picks = [F.min(F.struct(F.xxhash64("rep", F.lit(k)), "rep")) for k in range(PIVOTS)]
    pivots = member.groupBy("bucket").agg(F.array_distinct(F.array(*picks)).alias("p")).select("bucket", F.explode("p.rep").alias("pivot"))
    return member.join(pivots, "bucket").where("rep <> pivot").select(F.least("rep", "pivot").alias("u"), F.greatest("rep", "pivot").alias("v")).distinct()


def _prefix_pairs(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """All pairs (u, v) of docs (id, c, text) with c unequal that can be similar enough, by exact prefix filtering.

    Sets that similar share one of their rarest n - ceil(percent * n / 100) + 1 shingles, so only these are joined on. At the
    first shingle that two sets share, no more can be shared than that one and the fewer of the rest of either set; a pair
    stays only if at some shared shingle this bound reaches the intersection that it needs.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [as_long(shingle_set(text, shingle)) for text in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "k": batch["k"], "c": batch["c"], "n": [len(s) for s in sets], "s": sets})

    kinds = [docs.schema["id"], T.StructField("k", T.LongType()), docs.schema["c"], T.StructField("n", T.LongType()), T.StructField("s", T.ArrayType(T.LongType()))]
    sets = written(docs.select("id", F.xxhash64("text").alias("k"), "c", "text").mapInPandas(run, T.StructType(kinds)).select("id", "k", "c", "n", F.explode("s").alias("s")), "shingles")
    shared = sets.groupBy("s").agg(F.count("*").alias("df"))
    order = Window.partitionBy("id", "k").orderBy("df", "s")
    rare = sets.join(shared, "s").withColumn("at", F.row_number().over(order)).where(f"df > 1 AND at <= n - ({percent} * n + 99) div 100 + 1")
    u = rare.select("s", F.col("id").alias("u"), F.col("c").alias("cu"), F.col("n").alias("nu"), F.col("at").alias("au"))
    v = rare.select("s", F.col("id").alias("v"), F.col("c").alias("cv"), F.col("n").alias("nv"), F.col("at").alias("av"))
    near = f"u < v AND cu <> cv AND 100 * least(nu, nv) >= {percent} * greatest(nu, nv) AND ({percent} + 100) * (1 + least(nu - au, nv - av)) >= {percent} * (nu + nv)"
    return u.join(v, "s").where(near).select("u", "v").distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, permutations: int = PERMUTATIONS, rows: int = BAND_ROWS) -> DataFrame:
    """One row for each row of df: id_col, n_shingles, component_id (smallest id reachable), kept (id is component_id).

    Words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z. Sets with 100 * intersection >= percent * union are linked. A pair
    at a similarity of 0.8 shares no band with probability 5e-6 at the default 40 bands of 6 values; above, less.
    Null, empty and wordless texts have no shingles and link with nothing. A null id links with nothing: its component_id is
    null and it is kept. Repeated rows link as copies do; rows of one id with different texts are linked through the id. Other columns of df, whatever their names, are not looked at.
    An empty df gives no rows.
    """
    docs = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    table = written(sketches(docs, shingle, permutations, rows), "sketches")
    sets = written(table.where("id IS NOT NULL AND n_shingles > 0").groupBy("set_key").agg(F.min("id").alias("rep"), F.first("bands").alias("bands")), "sets")
    member = sets.select("rep", F.explode("bands").alias("bucket"))
    shared = member.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1").select("bucket")
    member = written(member.join(shared, "bucket"), "buckets")
    wanted = member.select(F.col("rep").alias("id")).distinct()
    texts = written(docs.join(wanted, "id", "left_semi").dropDuplicates(["id", "text"]), "texts")
    links = written(confirmed(written(_pivot_pairs(member), "pairs"), texts, shingle, percent), "links")
    label = components(links).withColumnRenamed("node", "id").withColumnRenamed("component", "c")
    found = member.select("bucket", F.col("rep").alias("id")).join(label, "id", "left").select("bucket", "id", F.coalesce("c", "id").alias("c"))
    mixed = found.groupBy("bucket").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("bucket")
    left = texts.join(found.join(mixed, "bucket").select("id", "c").distinct(), "id")
    across = confirmed(written(_prefix_pairs(left, shingle, percent), "across"), texts, shingle, percent)
    label = components(links.unionByName(across))
    group = sets.select("set_key", "rep").join(label.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component_id"))
    out = table.select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.col("set_key")).alias("set_key")).join(group, "set_key", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def without_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of df whose id is its component's smallest, with all their columns. Null ids stay; rows of an id go alike."""
    found = near_duplicates(df, id_col, text_col, **options).where(~F.col("kept")).select(F.col(id_col).alias("__gone")).distinct()
    return df.join(found, df[id_col] == found["__gone"], "left_anti")
