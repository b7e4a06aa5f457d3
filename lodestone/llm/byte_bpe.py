"""Byte-level BPE as a monoid of token sequences.

The elements are encodings of byte strings, the identity is the empty one, and joining two encodings gives the encoding of
the joined strings: the tokens around the seam are decoded and encoded again, in a window that grows to either side until
its outer tokens are stable. A sequence is the encoding of its bytes exactly if each two neighbours are the encoding of
theirs, so two checks at the window's edges prove that no token outside changes. A match of the splitting pattern is encoded
by halves, recursively; the tokens of a text are those of its matches, one after the other. Decoding concatenates the tokens'
bytes up a tree whose nodes have a thousand children.

Scale: one pass without a shuffle; halves that recur are remembered up to a bound, so memory does not grow with the data,
and a match of any length costs a number of joins proportional to it.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import text_or_empty


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class ByteBpe:
    REMEMBERED = 200_000

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.matches = regex.compile(pattern).findall
        self.token = {rank: token for token, rank in ranks.items()}
        self.decimal = {rank: str(rank).encode() for rank in self.token}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.halves: dict[bytes, tuple[int, ...]] = {}
        self.texts: dict[str, tuple[int, ...]] = {}

    def merged(self, raw: bytes) -> tuple[int, ...]:
        """Merge by lowest rank, leftmost first; for windows, which are short."""
        ranks = self.ranks
        whole = ranks.get(raw)
        if whole is not None:
            return (whole,)
        if len(raw) > 48:
            return self._merged_long(raw)
        parts = [raw[k : k + 1] for k in range(len(raw))]
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                rank = ranks.get(parts[k] + parts[k + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(ranks[p] for p in parts)

    def _merged_long(self, raw: bytes) -> tuple[int, ...]:
        """The same with a heap of pairs, for windows that periodic texts make long."""
        ranks, n = self.ranks, len(raw)
        end, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        live = [True] * n

        def offer(k: int) -> None:
            after = end[k]
            if after < n and (rank := ranks.get(raw[k : end[after]])) is not None:
                heapq.heappush(heap, (rank, k, end[after]))

        heap: list[tuple[int, int, int]] = []
        for k in range(n):
            offer(k)
        while heap:
            _, k, stop = heapq.heappop(heap)
            after = end[k]
            if not live[k] or after >= n or end[after] != stop:
                continue
            live[after], end[k] = False, stop
            if stop < n:
                before[stop] = k
            offer(k)
            if before[k] >= 0:
                offer(before[k])
        return tuple(ranks[raw[k : end[k]]] for k in range(n) if live[k])

    def stable(self, a: int, b: int) -> bool:
        """Whether (a, b) is the encoding of its bytes."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= self.REMEMBERED:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged(self.token[a] + self.token[b]) == (a, b)
        return known

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The monoid's operation."""
        if not left or not right:
            return left or right
        if self.stable(left[-1], right[0]):
            return left + right
        a, b, grow = len(left) - 1, 1, 1
        while True:
            window = self.merged(b"".join(map(self.token.__getitem__, left[a:] + right[:b])))
            ok_left = a == 0 or self.stable(left[a - 1], window[0])
            ok_right = b == len(right) or self.stable(window[-1], right[b])
            if ok_left and ok_right:
                return left[:a] + window + right[b:]
            grow *= 2
            if not ok_left:
                a = max(0, a - grow)
            if not ok_right:
                b = min(len(right), b + grow)

    def piece(self, raw: bytes) -> tuple[int, ...]:
        """The encoding of one match, by halves."""
        if len(raw) < 2:
            return (self.ranks[raw],) if raw else ()
        got = self.halves.get(raw)
        if got is None:
            middle = len(raw) // 2
            got = self.join(self.piece(raw[:middle]), self.piece(raw[middle:]))
            if len(raw) <= 32:
                if len(self.halves) >= self.REMEMBERED:
                    self.halves.clear()
                self.halves[raw] = got
        return got

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        texts, add = self.texts, out.extend
        for match in self.matches(text):
            got = texts.get(match)
            if got is None:
                got = self.piece(match.encode("utf-8"))
                if len(match) <= 32:
                    if len(texts) >= self.REMEMBERED:
                        texts.clear()
                    texts[match] = got
            add(got)
        return out

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the tokens, joined up a tree of a thousand children a node."""
        parts = list(map(self.token.__getitem__, ids))
        while len(parts) > 1:
            parts = [b"".join(parts[k : k + 1000]) for k in range(0, len(parts), 1000)]
        return parts[0] if parts else b""


@cache
def _byte_bpe(path: str, pattern: str) -> ByteBpe:
    """One for each process: the tasks of a Python worker share the ranks and what is remembered, which is bounded."""
    return ByteBpe(load_ranks(path), pattern)


def _mapped(df: DataFrame, id_col: str, text_col: str, path: str, pattern: str, row, kinds: list[T.StructField]) -> DataFrame:
    docs = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = _byte_bpe(path, pattern)
        for batch in batches:
            rows = [row(bpe, text) for text in batch["text"]]
            out = {k.name: [r[i] for r in rows] for i, k in enumerate(kinds)}
            yield pd.DataFrame({"id": batch["id"], **out})

    return docs.mapInPandas(run, T.StructType([docs.schema["id"], *kinds])).withColumnRenamed("id", id_col)


def encoded(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and ids (array of int) of each row; null counts as the empty text, which has no ids."""
    return _mapped(df, id_col, text_col, path, pattern, lambda bpe, text: (bpe.encode(text),), [T.StructField("ids", T.ArrayType(T.IntegerType()))])


def digests(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: id_col, n_tokens, ids_sha256 (of the decimal ids), decoded_sha256 (of the ids decoded).

    Null and empty texts have no ids. Null ids and repeated rows pass through. Other columns of df, whatever their names,
    are not looked at. An empty df gives no rows.
    """

    def row(bpe: ByteBpe, text: str) -> tuple:
        ids = bpe.encode(text)
        return len(ids), hashlib.sha256(b" ".join(map(bpe.decimal.__getitem__, ids))).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()

    return _mapped(df, id_col, text_col, path, pattern, row, [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
