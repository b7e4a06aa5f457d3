"""Hard negatives by a two-dimensional block matrix multiply over integer vectors.

Rows and anchors are cut into blocks, and each block into chunks of dimensions. A row block, an anchor block and a chunk meet in
one task, which multiplies them to a partial tile of int64 scores; a shuffle adds the partial tiles of all chunks. The finished
tile keeps, for each of its anchors, the best rows of the anchor's label and every row of another label that can still lie in
a window: as the tile's own fifth positive is at most the anchor's fifth, scores below its window lie in none. The tiles'
positives are reduced to the anchor's, each tile then gives its best rows of every window, and these are reduced.

Scale: a partial tile is anchor_rows x block_rows int64, sent as one strip an anchor; a task holds one tile's sums at a time.
Rows are replicated once for 16 anchor blocks, anchors once for a row block: both are small beside the tiles they make, which
are rows x anchors by nature. No side is broadcast by hint, and no key of the tables (id, label) decides where a row goes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import spread, written

BLOCK_ROWS = 4096
ANCHOR_ROWS = 128
CHUNK_DIMS = 32
#: Anchor blocks that share a copy of a row block, and the largest number of partitions that products are dealt to.
SHARED = 16
MOST_PARTITIONS = 4096

_BLOCK = "block long, chunk int, n int, ids binary, labels binary, x binary"
_STRIP = "block long, ablock long, a int, chunk int, anchor_id long, anchor_label long, ids binary, labels binary, scores binary"
_FOUND = "ablock long, a int, anchor_id long, pos_ids array<long>, pos_scores array<long>, neg_ids array<long>, neg_scores array<long>"


def _matrix(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    """floor(scale * x) of each component as int64; shorter vectors end in zeros. Saturated so that no score leaves 64 bits."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False)
    most = float(int((2**62 / max(dims, 1)) ** 0.5))
    flat = np.clip(np.floor(values * scale), -most, most).astype(np.int64)
    if len(lengths) and (lengths == dims).all():
        return flat.reshape(len(lengths), dims)
    out = np.zeros((len(lengths), dims), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _packed(size: int, dims: int, width: int, scale: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of at most `size` rows in the order of their ids, each cut into chunks of dimensions; chunk 0 has ids and labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        made = 0

        def out(ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            order = np.argsort(ids, kind="stable")
            ids, labels, x = ids[order], labels[order], x[order]
            chunks = list(range(0, max(dims, 1), width))
            meta = [None] * (len(chunks) - 1)
            columns = [pa.array([first + made] * len(chunks), pa.int64()), pa.array(range(len(chunks)), pa.int32()), pa.array([len(ids)] * len(chunks), pa.int32()), pa.array([ids.tobytes(), *meta], pa.binary()), pa.array([labels.tobytes(), *meta], pa.binary())]
            return pa.RecordBatch.from_arrays([*columns, pa.array([np.ascontiguousarray(x[:, c : c + width]).tobytes() for c in chunks], pa.binary())], ["block", "chunk", "n", "ids", "labels", "x"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), _matrix(batch.column(2), dims, scale)))
            while sum(len(h[0]) for h in held) >= size:
                ids, labels, x = (np.concatenate(part) for part in zip(*held, strict=True))
                yield out(ids[:size], labels[:size], x[:size])
                made += 1
                held = [(ids[size:], labels[size:], x[size:])]
        if sum(len(h[0]) for h in held):
            yield out(*(np.concatenate(part) for part in zip(*held, strict=True)))

    return run


def _product(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """a @ x.T in int64. Doubles are as exact while no sum can reach 2^53, and much faster."""
    if not a.size or not x.size:
        return np.zeros((len(a), len(x)), np.int64)
    if int(np.abs(a).max()) * int(np.abs(x).max()) * a.shape[1] < 1 << 53:
        return (a.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return a @ x.T


def _multiplied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A strip of partial scores for each anchor of each meeting of a row block, an anchor block and a chunk."""
    for batch in batches:
        for r in batch.itertuples(index=False):
            m = r.an
            x, a = np.frombuffer(r.x, np.int64).reshape(r.n, -1), np.frombuffer(r.ax, np.int64).reshape(m, -1)
            lead = r.chunk == 0
            who = (np.frombuffer(r.aids, np.int64), np.frombuffer(r.alabels, np.int64)) if lead else (np.zeros(m, np.int64),) * 2
            meta = [None] * (m - 1)
            yield pd.DataFrame(
                {
                    "block": r.block, "ablock": r.ablock, "a": np.arange(m, dtype=np.int32), "chunk": np.int32(r.chunk), "anchor_id": who[0], "anchor_label": who[1],
                    "ids": [r.ids if lead else None, *meta], "labels": [r.labels if lead else None, *meta], "scores": [s.tobytes() for s in _product(a, x)],
                }
            )


def _added(positives: int, low: int, high: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Strips in the order of tile, anchor and chunk -> sums, of which positives and possible negatives stay."""

    def finished(tile: tuple, key: tuple, who: tuple, total: np.ndarray) -> tuple:
        ids, labels = tile
        own = np.flatnonzero((labels == who[1]) & (ids != who[0]))
        best = own[np.argsort(-total[own], kind="stable")[:positives]]
        least = max(0, -(-low * int(total[best[-1]]) // high)) if len(best) == positives else 0
        other = np.flatnonzero((labels != who[1]) & (ids != who[0]) & (total >= least))
        other = other[np.argsort(-total[other], kind="stable")]
        return key[1], key[2], who[0], ids[best], total[best], ids[other], total[other]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _FOUND.split(", ")]
        key, tile, who, total, out, size = None, None, None, None, [], 0
        for batch in batches:
            for r in batch.itertuples(index=False):
                scores = np.frombuffer(r.scores, np.int64)
                if (r.block, r.ablock, r.a) == key:
                    total = total + scores
                    continue
                if key is not None:
                    out.append(finished(tile, key, who, total))
                    size += len(out[-1][5])
                if size > 1 << 20:
                    yield pd.DataFrame(out, columns=names)
                    out, size = [], 0
                if r.ids is not None:
                    tile = np.frombuffer(r.ids, np.int64), np.frombuffer(r.labels, np.int64)
                key, who, total = (r.block, r.ablock, r.a), (r.anchor_id, r.anchor_label), scores
        if key is not None:
            out.append(finished(tile, key, who, total))
        if out:
            yield pd.DataFrame(out, columns=names)

    return run


def hard_negatives(
    rows: DataFrame, is_anchor: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding", positives: int = 5, negatives: int = 5,
    low: int = 80, high: int = 100, scale: int = 256, block_rows: int = BLOCK_ROWS, anchor_rows: int = ANCHOR_ROWS, chunk_dims: int = CHUNK_DIMS,
) -> DataFrame:
    """For each anchor and each of its first `positives` other rows of its label: the first `negatives` rows of other labels with
    low * positive_score <= high * negative_score <= high * positive_score.

    is_anchor and label are columns over rows; label is a whole number. Returns anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score. A score is the inner product of the floors of scale * x; higher come first, then smaller ids.
    Rows with a null id, label or vector, or a null or non-finite component, take no part. Shorter vectors count as ending in
    zeros, an empty one as zeros. Components beyond 2^31 / sqrt(dimensions) saturate. Rows that repeat an id are rows of their
    own, and anchors of their own, but a row of the anchor's own id is neither its positive nor its negative. Other columns of rows, whatever their names,
    are not looked at. An empty table gives no rows; so does an anchor without a positive of at least 0.
    """
    spark = rows.sparkSession
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    table = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    table = table.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").where(F.forall("v", finite))
    dims = table.agg(F.max(F.size("v"))).first()[0] or 0
    pack = lambda df, size: df.select("id", "label", "v").mapInArrow(_packed(size, dims, chunk_dims, scale), _BLOCK)
    x = written(pack(table, block_rows), "rows")
    a = written(pack(table.where("is_anchor"), anchor_rows), "anchors")
    many, few = (df.where("chunk = 0").count() for df in (x, a))
    copies = max(1, -(-few // SHARED))
    chunks = max(1, -(-dims // chunk_dims))
    n = min(MOST_PARTITIONS, max(spread(spark), many * copies * chunks // 4))
    left = x.withColumns({"salt": F.pmod(F.xxhash64("block"), F.lit(max(1, many))), "q": F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))})
    right = a.select(F.col("block").alias("ablock"), "chunk", F.col("n").alias("an"), F.col("ids").alias("aids"), F.col("labels").alias("alabels"), F.col("x").alias("ax"))
    right = right.withColumns({"q": F.pmod(F.xxhash64("ablock"), F.lit(copies)).cast("int"), "salt": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(1, many) - 1).cast("long")))})
    deal = lambda df: df.repartition(n, "chunk", "salt", "q")
    met = deal(left).hint("merge").join(deal(right), ["chunk", "salt", "q"])
    strips = met.mapInPandas(_multiplied, _STRIP).repartition(n, "block", "ablock").sortWithinPartitions("block", "ablock", "a", "chunk")
    found = written(strips.mapInPandas(_added(positives, low, high), _FOUND), "tiles")

    anchor = ["ablock", "a"]
    own = found.select(*anchor, F.inline(F.arrays_zip(F.col("pos_scores").alias("positive_score"), F.col("pos_ids").alias("positive_id"))))
    place = F.row_number().over(Window.partitionBy(*anchor).orderBy(F.desc("positive_score"), "positive_id"))
    own = own.withColumn("place", place).where(F.col("place") <= positives).where("positive_score >= 0")
    p = F.col("positive_score")
    pairs = F.arrays_zip(F.col("neg_scores").alias("negative_score"), F.col("neg_ids").alias("negative_id"))
    fits = F.filter(pairs, lambda c: (F.lit(high) * c["negative_score"] >= F.lit(low) * p) & (c["negative_score"] <= p))
    each = found.join(own, anchor).select(*anchor, "place", "anchor_id", "positive_id", "positive_score", F.inline(F.slice(fits, 1, negatives)))
    rank = F.row_number().over(Window.partitionBy(*anchor, "place").orderBy(F.desc("negative_score"), "negative_id"))
    each = each.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return each.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
