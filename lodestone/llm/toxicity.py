"""Toxicity of texts by a small convolutional network, trained in numpy.

Words are embedded by hashing (the word and its first bytes share out buckets), filters of several widths slide over the
whole text, each keeps its maximum, and a dense layer gives a logit. Gradients only reach the words that won a maximum. A
threshold is calibrated for each language that the text itself shows by its function words, and the score is shifted so
that 0.5 is the calibrated threshold.

Scale: the fit sees the whole text of every labelled row that is not held out. Counts of buckets by class are sums over all of
them; shards of rows, by a hash of the id, then train from the same start, each through its blocks of bounded size, and what
they learned is averaged; the thresholds come from counts of scores. Only those counts and at most SHARDS models reach the
driver. Scoring is one pass without a shuffle, and the model that tasks receive has a fixed size (under 4 MB).
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import text_or_empty, word_hashes, written

#: Rows that make one more shard worth while, and the most shards; a shard of any size is gone through in blocks.
SHARD_ROWS = 4_096
SHARDS = 32
BLOCK_ROWS = 6_000
BLOCK_WORDS = 4_000_000
#: Scores are counted by grains of this part of a logit for the thresholds.
GRAIN = 256
BUCKETS = 1 << 14
DIM = 8
FILTERS = 6
WIDTHS = (1, 2, 3)
PREFIXES = (4, 6)
CHUNK = 1 << 16
#: Frequent function words; only to tell languages apart for the calibration.
FUNCTION_WORDS = {
    "en": "the of and to in is that for was on it with as are be this",
    "de": "der die und das den von zu mit ist nicht ein eine für auf als dem",
    "fr": "le les et des une du que est pour dans qui sur pas au par avec",
    "es": "el los y del las por con una su para como más lo al se ha",
}
LEARNED = ("embedding", "filters", "bias", "dense", "constant")
_KNOWN = [np.sort(word_hashes(words)[0]) for words in FUNCTION_WORDS.values()]


def features(text: str | None) -> tuple[np.ndarray, int]:
    """Buckets (words x (1 + prefixes)) of a whole text, and the number of its language (the last: none shown)."""
    hashes = word_hashes(text, PREFIXES)
    language = [int(np.isin(hashes[0], known).sum()) for known in _KNOWN] if len(hashes[0]) else [0]
    buckets = np.stack([(h % np.uint64(BUCKETS)).astype(np.int32) + k * BUCKETS for k, h in enumerate(hashes)], axis=1)
    return buckets, int(np.argmax(language)) if max(language) else len(_KNOWN)


class ToxicityModel:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.embedding = rng.normal(0, 0.05, (BUCKETS * (1 + len(PREFIXES)), DIM)).astype(np.float32)
        self.filters = rng.normal(0, 0.1, (sum(WIDTHS), DIM, FILTERS)).astype(np.float32)
        self.bias = np.zeros((len(WIDTHS), FILTERS), np.float32)
        self.dense = np.full(len(WIDTHS) * FILTERS, 0.3, np.float32)
        self.constant = np.float32(-1.0)
        self.shift = np.zeros(len(_KNOWN) + 1, np.float32)

    def pooled(self, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maxima after the rectifier, and the first word of each winner (-1: none); chunks overlap by a filter's width."""
        best = np.zeros((len(WIDTHS), FILTERS), np.float32)
        where = np.full((len(WIDTHS), FILTERS), -1)
        flat = self.filters.transpose(1, 0, 2).reshape(DIM, -1)
        for at in range(0, len(buckets), CHUNK):
            words = buckets[at : at + CHUNK + max(WIDTHS) - 1]
            vectors = self.embedding[words[:, 0]]
            for k in range(1, words.shape[1]):
                vectors = vectors + self.embedding[words[:, k]]
            parts = (vectors @ flat).reshape(len(words), -1, FILTERS)
            first = 0
            for w, width in enumerate(WIDTHS):
                n = len(words) - width + 1
                if n > 0:
                    z = parts[:n, first]
                    for k in range(1, width):
                        z = z + parts[k : n + k, first + k]
                    z = z + self.bias[w]
                    top = z.argmax(axis=0)
                    value = z[top, np.arange(FILTERS)]
                    better = value > best[w]
                    best[w] = np.where(better, value, best[w])
                    where[w] = np.where(better, top + at, where[w])
                first += width
        return best, where

    def logit(self, buckets: np.ndarray) -> float:
        return float(self.pooled(buckets)[0].ravel() @ self.dense + self.constant)

    def score(self, text: str | None) -> float:
        buckets, language = features(text)
        return float(1 / (1 + np.exp(np.clip(self.shift[language] - self.logit(buckets), -30, 30))))

    def fit(self, texts: list[str], labels: list[int], epochs: int = 2, rate: float = 0.02, seed: int = 7) -> ToxicityModel:
        """Adagrad on single rows, classes weighted alike; a fifth of the rows is kept for the calibration."""
        if len(set(labels)) < 2:
            self.constant = np.float32(6.0 if labels and labels[0] else -6.0)
            return self
        seen = [features(t) for t in texts]
        y = np.array(labels, np.float32)
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(y))
        held, train = order[: len(y) // 5], order[len(y) // 5 :]
        train = train if len(set(y[train].tolist())) == 2 else order
        counts = np.zeros((2, len(self.embedding)))
        for i in train:
            counts[int(y[i]), np.unique(seen[i][0])] += 1
        n1, n0 = int(y[train].sum()), int((1 - y[train]).sum())
        self.plant(counts, n1, n0)
        self.learn([seen[i][0] for i in train], y[train], (n1, n0), self.fresh(), rng, epochs, rate)
        self._calibrate(Counter((self.logit(seen[i][0]), seen[i][1], int(y[i])) for i in (held if len(held) else order)))
        return self

    def plant(self, counts: np.ndarray, n1: int, n0: int) -> None:
        """The log-odds of each bucket as a first column. counts: rows of class 0 and of class 1 that hold it."""
        odds = np.log((counts[1] + 0.5) / (n1 + 1)) - np.log((counts[0] + 0.5) / (n0 + 1))
        self.embedding[:, 0] = np.clip(odds, -3, 3) * np.minimum(1, counts.sum(axis=0) / 5) / 3
        for first in (0, 1, 3):
            self.filters[first, 0] = np.abs(self.filters[first, 0]) + 0.8

    def fresh(self) -> dict[str, np.ndarray]:
        """Sums of squared steps before the first one."""
        return {k: np.full_like(getattr(self, k), 1e-2) for k in LEARNED}

    def learn(self, seen: list[np.ndarray], y: np.ndarray, of: tuple[int, int], past: dict[str, np.ndarray], rng: np.random.Generator, epochs: int = 2, rate: float = 0.02) -> None:
        """Steps through the rows. of: rows of class 1 and 0 in the whole training set, so that classes weigh alike there."""
        weight = np.where(y > 0, sum(of) / (2 * of[0]), sum(of) / (2 * of[1]))
        starts = np.concatenate([[0], np.cumsum(WIDTHS)])
        for _ in range(epochs):
            for i in rng.permutation(len(y)):
                buckets = seen[i]
                pool, where = self.pooled(buckets)
                h = pool.ravel()
                p = 1 / (1 + np.exp(-np.clip(float(h @ self.dense + self.constant), -30, 30)))
                g = float(weight[i] * (p - y[i]))
                if abs(g) < 1e-3:
                    continue
                back = (g * self.dense).reshape(pool.shape)
                step = g * h
                past["dense"] += step * step
                self.dense -= rate * step / np.sqrt(past["dense"])
                past["constant"] += g * g
                self.constant = np.float32(self.constant - rate * g / np.sqrt(past["constant"]))
                for w, width in enumerate(WIDTHS):
                    live = np.flatnonzero(where[w] >= 0)
                    if not len(live):
                        continue
                    d = back[w, live]
                    past["bias"][w, live] += d * d
                    self.bias[w, live] -= rate * d / np.sqrt(past["bias"][w, live])
                    for k in range(width):
                        rows = buckets[where[w, live] + k]
                        f = starts[w] + k
                        vectors = self.embedding[rows].sum(axis=1)
                        old = self.filters[f][:, live].copy()
                        step = vectors.T * d
                        past["filters"][f][:, live] += step * step
                        self.filters[f][:, live] -= rate * step / np.sqrt(past["filters"][f][:, live])
                        step = (old * d).T
                        for c in range(rows.shape[1]):
                            np.add.at(past["embedding"], rows[:, c], step * step)
                            np.add.at(self.embedding, rows[:, c], -rate * step / np.sqrt(past["embedding"][rows[:, c]]))

    def average(self, parts: list[tuple[int, dict[str, np.ndarray], np.ndarray]]) -> None:
        """What shards learned from this model, weighed by their rows; a bucket by those that moved it. parts: (rows, learned,
        the buckets moved)."""
        rows = np.array([n for n, _, _ in parts], np.float64)
        for k in LEARNED:
            if k != "embedding":
                setattr(self, k, np.float32(sum(n * p[k].astype(np.float64) for n, p, _ in parts) / rows.sum()))
        by = sum(n * moved for n, _, moved in parts)
        total = sum(n * moved[:, None] * p["embedding"].astype(np.float64) for n, p, moved in parts)
        self.embedding = np.where(by[:, None] > 0, total / np.maximum(by, 1)[:, None], self.embedding).astype(np.float32)

    def _calibrate(self, counts: dict[tuple[float, int, int], int]) -> None:
        """For each language, the logit with the fewest mistakes; where a class is missing, that of all languages. counts: rows by
        logit, language and class."""

        def best(of) -> float | None:
            table: dict[float, list[int]] = {}
            for (z, language, y), n in counts.items():
                if of is None or of == language:
                    table.setdefault(z, [0, 0])[y] += n
            z = np.array(sorted(table))
            n = np.array([table[x] for x in z]).reshape(-1, 2)
            if not n.sum(axis=0).all():
                return None
            wrong = np.concatenate([[0], np.cumsum(n[:, 1])]) + np.concatenate([np.cumsum(n[::-1, 0])[::-1], [0]])
            edges = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
            ties = np.flatnonzero(wrong == wrong.min())
            return float(edges[ties[len(ties) // 2]])

        overall = best(None) or 0.0
        for language in range(len(self.shift)):
            own = best(language)
            self.shift[language] = overall if own is None else own


def is_held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(y, text) -> (bucket, y, n): rows that hold a bucket."""
    counts = np.zeros((2, BUCKETS * (1 + len(PREFIXES))), np.int64)
    for batch in batches:
        for y, text in zip(*(batch.column(k) for k in (0, 1)), strict=True):
            counts[y.as_py(), np.unique(features(text.as_py())[0])] += 1
    y, bucket = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(y, pa.int32()), pa.array(counts[y, bucket], pa.int64())], ["bucket", "y", "n"])


def _learned(base: ToxicityModel, of: tuple[int, int], block_rows: int, block_words: int):
    """(shard, y, text), rows of a shard in order and together -> (shard, n, learned): what each shard learned from base."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, model = None, None
        seen: list[np.ndarray] = []
        ys: list[int] = []
        rows = words = 0

        def block() -> None:
            model.learn(seen, np.array(ys, np.float32), of, past, rng)
            seen.clear()
            ys.clear()

        def done() -> pa.RecordBatch:
            block()
            what = {k: getattr(model, k) for k in LEARNED}, (past["embedding"] > np.float32(1e-2)).any(axis=1)
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([rows], pa.int64()), pa.array([pickle.dumps(what)], pa.binary())], ["shard", "n", "learned"])

        for batch in batches:
            for shard, y, text in zip(*(batch.column(k) for k in range(3)), strict=True):
                if shard.as_py() != at:
                    if model is not None:
                        yield done()
                    at, rows, words = shard.as_py(), 0, 0
                    model = pickle.loads(pickle.dumps(base))
                    past, rng = model.fresh(), np.random.default_rng(7 + at)
                seen.append(features(text.as_py())[0])
                ys.append(y.as_py())
                rows += 1
                words += len(seen[-1])
                if len(ys) >= block_rows or words >= block_words:
                    block()
                    words = 0
        if model is not None:
            yield done()

    return run


def _logits(model: ToxicityModel):
    """(y, text) -> (z, language, y, n): rows by the grain of their logit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for y, text in zip(*(batch.column(k) for k in (0, 1)), strict=True):
                buckets, language = features(text.as_py())
                counts[round(float(np.clip(model.logit(buckets), -40, 40)) * GRAIN), language, y.as_py()] += 1
        columns = [*zip(*((*k, n) for k, n in counts.items()), strict=True)] or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["z", "language", "y", "n"])

    return run


def _perhaps(rows: DataFrame, known: DataFrame, bits: int = 16, page: int = 1 << 15) -> DataFrame:
    """rows without most of those whose id is not in known, so that few texts travel for nothing: known ids set bits (so many for
    each) of a bitmap, which is joined in pages."""
    n = known.count()
    if not n:
        return rows.limit(0)
    place = F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(bits * n))
    at = lambda df: df.withColumns({"_page": F.floor(place / page), "_bit": place % page})
    pages = at(known).groupBy("_page").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    is_set = F.expr("(shiftright(cast(conv(hex(substring(_bits, cast(_bit div 8 as int) + 1, 1)), 16, 10) as int), cast(_bit % 8 as int)) & 1) = 1")
    return at(rows).join(F.broadcast(pages), "_page").where(is_set).select(*rows.columns)


def train(
    documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int | None = None,
    shard_rows: int = SHARD_ROWS, shards: int = SHARDS, block_rows: int = BLOCK_ROWS, block_words: int = BLOCK_WORDS,
) -> ToxicityModel:
    """A model of the labelled ids that are not held out, one whole text an id (of several, the one that sorts first).

    A fifth of them, by a hash of the id, sets the thresholds and the rest is learned from. No or one-sided labels: a constant
    model. With max_rows, a fit on the driver to so many rows (a third positive at most), chosen by a hash; no query asks for it.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)").where(~is_held_out("id")).distinct()
    texts = documents.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).where("id IS NOT NULL").where(~is_held_out("id"))
    one_each = lambda some, chosen: some.join(chosen, "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    if max_rows is not None:
        some = [known.where(f"y = {y}").orderBy(F.xxhash64("id"), "id").limit(n) for y, n in ((1, max_rows // 3), (0, max_rows - max_rows // 3))]
        rows = sorted(one_each(texts, some[0].unionByName(some[1])).collect(), key=lambda r: (r["id"], r["y"], r["text"]))
        return ToxicityModel().fit([r["text"] for r in rows], [r["y"] for r in rows])
    rows = written(one_each(_perhaps(texts, known), known).select("id", "y", "text", (F.pmod(F.xxhash64("id"), F.lit(5)) == 0).alias("sets")), "training")
    n = {(r["sets"], r["y"]): r["n"] for r in rows.groupBy("sets", "y").agg(F.count("*").alias("n")).collect()}
    total = [n.get((False, y), 0) + n.get((True, y), 0) for y in (0, 1)]
    model = ToxicityModel()
    if not all(total):
        model.constant = np.float32(6.0 if total[1] else -6.0)
        return model
    apart = all((False, y) in n for y in (0, 1))
    learning = rows.where("NOT sets") if apart else rows
    n0, n1 = (n[False, 0], n[False, 1]) if apart else total
    counts = np.zeros((2, len(model.embedding)))
    found = learning.select("y", "text").mapInArrow(_bucket_counts, "bucket int, y int, n long")
    for bucket, y, k in found.groupBy("bucket", "y").agg(F.sum("n")).collect():
        counts[y, bucket] = k
    model.plant(counts, n1, n0)
    parts = min(shards, -(-(n0 + n1) // shard_rows))
    dealt = learning.withColumns({"place": F.xxhash64(F.lit(1), "id")}).withColumn("shard", F.pmod("place", F.lit(parts)).cast("int"))
    dealt = dealt.repartitionById(parts, F.col("shard")).sortWithinPartitions("shard", "place", "id", "y").select("shard", "y", "text")
    learned = dealt.mapInArrow(_learned(model, (n1, n0), block_rows, block_words), "shard int, n long, learned binary")
    model.average([(r["n"], *pickle.loads(r["learned"])) for r in sorted(learned.collect(), key=lambda r: r["shard"])])
    sets = rows.where("sets") if any(k for k, _ in n) else rows
    z = sets.select("y", "text").mapInArrow(_logits(model), "z int, language int, y int, n long").groupBy("z", "language", "y").agg(F.sum("n").alias("n"))
    model._calibrate({(r["z"] / GRAIN, r["language"], r["y"]): r["n"] for r in z.collect()})
    return model


def score_column(spark, model: ToxicityModel, text: Column) -> Column:
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return texts.map(shared.value.score)

    return score(F.coalesce(text.cast("string"), F.lit("")))


def toxicity(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id_col, held_out, score (0 to 1), predicted (1 if score >= 0.5, else 0).

    Null and empty texts score as texts without words. Null ids are not held out and never trained on. Repeated rows score
    alike. Other columns of documents, whatever their names, are not looked at. An empty table gives no rows.
    """
    model = train(documents, labels, id_col, text_col)
    scored = documents.select(F.col(id_col), is_held_out(id_col).alias("held_out"), score_column(documents.sparkSession, model, F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents whose score is below 0.5, with all their columns."""
    model = train(documents, labels, id_col, text_col)
    return documents.where(score_column(documents.sparkSession, model, F.col(text_col)) < 0.5)
