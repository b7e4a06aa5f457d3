"""Packing of documents into training sequences by lexical retrieval.

Every document is tokenised and ends with one more id. Its full windows are sequences by themselves; what remains is packed
with lexically near remainders: within a shard of an inverted index, a seed document is scored against all others by BM25
over token ids with all its terms, and unused neighbours greedily fill the seed's window, best first, until none shares a term;
the last one is cut where the window ends, and its rest is the next seed. The end of a shard is cut into sequences of power-of-two lengths, which need no
padding.

Scale: document frequencies and lengths are counted over all documents, with one row a token id after the aggregation; the
vocabulary bounds what the driver and the tasks hold of them (12 bytes an id). Remainders go to shards by a range partition
on a locality key, the id and the row's place, so near documents meet and a key that many share is split; a shard holds about
SHARD_TOKENS ids. Full windows never move: they have no room for a neighbour, so they neither retrieve nor are retrieved.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import mix64, text_or_empty, written
from .word_bpe import word_bpe

SHARD_TOKENS = 1 << 22
K1, B = 1.2, 0.75
#: Neighbours fetched at a time; a window that they do not fill fetches the seed's next best, so this limits nothing.
NEIGHBOURS = 48
#: Terms in one of so many remainders of the index are kept as a row of weights, the others as lists.
DENSE = 32


def _signs(size: int) -> np.ndarray:
    """Sixteen random bits for each id, in the 16-bit lanes of four words, so that sums count the ids that have each bit."""
    bits = mix64(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    lanes = (bits[:, None] >> np.arange(16, dtype=np.uint64)) & np.uint64(1)
    return np.ascontiguousarray(lanes.astype("<u2")).view("<u8")


def locality_key(terms: np.ndarray, ids: np.ndarray, signs: np.ndarray) -> int:
    """High bits: SimHash of the distinct ids; low bits: minimum hash of 4-id runs. Like texts have like keys."""
    counts = signs.take(terms, axis=0).sum(axis=0).view("<u2")
    high = int.from_bytes(np.packbits(counts > len(terms) // 2, bitorder="little").tobytes(), "little")
    run = np.ndarray(len(ids) - 3, "<u8", np.ascontiguousarray(ids, "<u2"), strides=(2,)).copy() if len(ids) > 3 else ids.astype("<u8")
    return high << 32 | int(mix64(run).min() >> np.uint64(32))


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def tokenised(docs: DataFrame, path: str, window: int, end_id: int) -> DataFrame:
    """(id, text) -> rows of three kinds: 'full' window pieces, the 'rest' of each document, 'count's of one task's documents."""
    kinds = [T.StructField("kind", T.StringType()), docs.schema["id"], *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "key")), T.StructField("ids", T.BinaryType())]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = word_bpe(path)
        signs, end = _signs(bpe.size), np.array([end_id], np.uint16)
        seen = np.zeros(bpe.size, np.int64)
        for batch in batches:
            rows = []
            for doc, text in zip(batch["id"], batch["text"], strict=True):
                ids = np.concatenate([bpe.ids(text), end])
                terms = np.unique(ids)
                seen[terms] += 1
                at = len(ids) // window * window
                rows += [("full", doc, s, window, crc(ids[s : s + window]), len(ids), None, None) for s in range(0, at, window)]
                if at < len(ids):
                    rows.append(("rest", doc, at, len(ids) - at, None, len(ids), locality_key(terms, ids[at:], signs), ids[at:].tobytes()))
            yield _frame(rows, kinds, batch["id"].dtype)
        if seen.any():
            yield _frame([("count", None, None, None, None, None, None, seen.tobytes())], kinds, object)

    return docs.mapInPandas(run, T.StructType(kinds))


def _frame(rows: list[tuple], kinds: list[T.StructField], id_type) -> pd.DataFrame:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
    out = {k.name: pd.array(c, "Int64") if isinstance(k.dataType, T.LongType) else pd.Series(c, dtype=object) for k, c in zip(kinds, columns, strict=True)}
    return pd.DataFrame(out)


def document_frequencies(rows: DataFrame) -> DataFrame:
    """(term, df) over all documents; sums in each task first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = 0
        for batch in batches:
            for raw in batch["ids"]:
                total = total + np.frombuffer(raw, np.int64)
        if isinstance(total, np.ndarray):
            (term,) = np.nonzero(total)
            yield pd.DataFrame({"term": term, "df": total[term]})

    return rows.where("kind = 'count'").select("ids").mapInPandas(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


class Shard:
    """An inverted index with BM25 weights over the remainders of a shard.

    A seed is scored with all its terms. The index is built anew over the unused remainders once a fourth of it is used.
    """

    def __init__(self, tails: list[np.ndarray], idf: np.ndarray, average: float):
        n = len(tails)
        length = np.array([len(t) for t in tails])
        code, tf = np.unique(np.repeat(np.arange(n, dtype=np.int64), length) * len(idf) + np.concatenate(tails).astype(np.int64), return_counts=True)
        doc, self.terms = code // len(idf), code % len(idf)
        self.weight = (idf[self.terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / average))).astype(np.float32)
        self.doc, self.of_doc = doc, np.searchsorted(doc, np.arange(n + 1))
        self.n, self.size = n, len(idf)
        self._index(np.ones(n, bool))

    def _index(self, live: np.ndarray) -> None:
        self.members = np.flatnonzero(live)
        place = np.cumsum(live) - 1
        keep = live[self.doc]
        term, doc, weight = self.terms[keep], place[self.doc[keep]], self.weight[keep]
        count = np.bincount(term, minlength=self.size)
        common = count * DENSE > len(self.members)
        self.row = np.where(common, np.cumsum(common) - 1, -1)
        self.dense = np.zeros((int(common.sum()), len(self.members)), np.float32)
        often = common[term]
        self.dense[self.row[term[often]], doc[often]] = weight[often]
        term, doc, weight = term[~often], doc[~often], weight[~often]
        by_term = np.argsort(term.astype(np.uint16), kind="stable")
        self.docs, self.weights = doc[by_term], weight[by_term].astype(np.float64)
        self.of_term = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=self.size))]).tolist()

    def scores(self, doc: int) -> np.ndarray:
        """BM25 of the index's members for all terms of doc."""
        terms = self.terms[self.of_doc[doc] : self.of_doc[doc + 1]]
        rows, at, dense = self.row[terms], self.of_term, self.dense
        spans = [slice(at[t], at[t + 1]) for t in terms[rows < 0].tolist()]
        out = np.zeros(len(self.members), np.float32)
        for r in rows[rows >= 0].tolist():
            out += dense[r]
        out = out.astype(np.float64)
        if spans:
            out += np.bincount(np.concatenate([self.docs[s] for s in spans]), np.concatenate([self.weights[s] for s in spans]), len(out))
        return out

    def neighbours(self, doc: int, unused: np.ndarray) -> np.ndarray:
        """The NEIGHBOURS best unused documents that share a term with doc, best first; of equals, the first."""
        live = unused[self.members]
        if 4 * np.count_nonzero(live) < 3 * len(live):
            self._index(unused)
            live = unused[self.members]
        score = self.scores(doc)
        score[~live] = 0
        least = np.partition(score, -NEIGHBOURS)[-NEIGHBOURS] if len(score) > NEIGHBOURS else 0.0
        best = np.flatnonzero(score > least)
        if least > 0:
            best = np.concatenate([best, np.flatnonzero(score == least)[: NEIGHBOURS - len(best)]])
        return self.members[best[np.lexsort((best, -score[best]))]]


def fill(tails: list[np.ndarray], idf: np.ndarray, average: float, window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences as lists of (tail, from, to). All are `window` long but the last, of a smaller power of two each."""
    shard = Shard(tails, idf, average)
    unused = np.ones(len(tails), bool)
    at = 0
    sequence: list[tuple[int, int, int]] = []
    room = window
    rest: tuple[int, int] | None = None
    while True:
        if rest is None:
            while at < len(tails) and not unused[at]:
                at += 1
            if at == len(tails):
                break
            rest = at, 0
            unused[at] = False
        queue, query = [rest], rest[0]
        rest = None
        while queue:
            doc, start = queue.pop(0)
            if not start:
                unused[doc] = False
            take = min(room, len(tails[doc]) - start)
            sequence.append((doc, start, start + take))
            room -= take
            if not room:
                yield sequence
                sequence, room = [], window
                if start + take < len(tails[doc]):
                    rest = doc, start + take
                break
            if not queue:
                queue = [(d, 0) for d in shard.neighbours(query, unused).tolist()]
    size = window
    while sequence:
        size //= 2
        if window - room < size:
            continue
        out, left = [], size
        while left:
            doc, start, stop = sequence.pop(0)
            take = min(left, stop - start)
            out.append((doc, start, start + take))
            left -= take
            if start + take < stop:
                sequence.insert(0, (doc, start + take, stop))
        room += size
        yield out


def pack(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, end_id: int = 1, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row a piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    window is a power of two. Each id of each document lies in exactly one piece; pieces of a sequence follow without a gap.
    Null and empty texts are one end id. Null ids pass through; repeated rows are documents each. Other columns of df,
    whatever their names, are not looked at. An empty df gives no rows.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    docs = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    table = written(tokenised(docs, tokenizer_path, window, end_id), "tokens")
    n, total, average = table.where("kind = 'rest'").agg(F.count("*"), F.sum("length"), F.avg("length")).first()
    counts = document_frequencies(table).collect()
    df_of = np.zeros(max((r["term"] for r in counts), default=0) + 1, np.float64)
    for r in counts:
        df_of[r["term"]] = r["df"]
    documents = df_of[end_id] if end_id < len(df_of) else 0
    idf = np.log1p((documents - df_of + 0.5) / (df_of + 0.5)).astype(np.float32)
    columns = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    kinds = T.StructType([table.schema["id"], *(T.StructField(c, T.LongType()) for c in columns[1:])])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [b for b in batches if len(b)]
        if not got:
            return
        rest = pd.concat(got, ignore_index=True)
        rest["crc"] = rest["ids"].map(zlib.crc32)
        rest = rest.sort_values(["key", "id", "crc"], kind="stable", ignore_index=True)
        tails = [np.frombuffer(raw, np.uint16) for raw in rest["ids"]]
        first = (1 << 62) + (TaskContext.get().partitionId() << 32)
        ids, starts, tokens = rest["id"].tolist(), rest["start"].tolist(), rest["doc_tokens"].tolist()
        rows = []
        for k, sequence in enumerate(fill(tails, idf, average, window)):
            offset = 0
            for doc, a, b in sequence:
                rows.append((ids[doc], starts[doc] + a, b - a, crc(tails[doc][a:b]), tokens[doc], first + k, offset))
                offset += b - a
            if len(rows) >= 20_000:
                yield _frame(rows, kinds.fields, None)
                rows = []
        yield _frame(rows, kinds.fields, None)

    shards = max(1, -(-(total or 0) // shard_tokens))
    rest = table.where("kind = 'rest'").select("id", "start", "doc_tokens", "key", "ids").withColumn("place", F.monotonically_increasing_id()).repartitionByRange(shards, "key", "id", "place").drop("place").mapInPandas(run, kinds)
    full = table.where("kind = 'full'").select("id", "start", "length", "ids_crc32", "doc_tokens", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return full.unionByName(rest).withColumnRenamed("id", id_col)
