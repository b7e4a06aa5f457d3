"""A probabilistic suffix tree over words, learned from and applied to a table of documents.

A context is a run of up to `depth` words. Its next-word distribution is smoothed with that of the context one word shorter, down
to the distribution of single words, which keeps a share for one unknown word. A context becomes a state of the tree if it
occurs often enough and the test of its divergence finds that, over the training tokens that follow it, its distribution gains
more than a margin over the shorter one's; each token is left out of its own counts there, so that what it has seen once
gains nothing. A token is scored by the longest suffix of the words before it that is a state. A context whose own test
fails is no state even where a longer one is; the longer one's distribution is still smoothed through it.

Scale: the documents are written once as parts of a bounded number of tokens. Level by level, a part sends the distinct runs of
words that it holds, as hashes with its counts, to the owners of the hashes; owners add up and answer with the totals. Only
runs whose context is frequent enough go on to the next level. So counts cover the whole corpus while nothing is held whole
anywhere: a task holds a part, or an owner's share of the hashes. A frequent word is one hash a part, whoever owns it.
The divergence of a context is a sum over training tokens, so parts send partial sums and owners answer with the decision.
Parts are a table bucketed by part, so they do not move; the messages do.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import mix64, spread, word_hashes, written

DEPTH = 2
#: Tokens of a part and of one piece of a document; training tokens for each owner of hashes.
PART_TOKENS = 3 << 19
PIECE_TOKENS = 1 << 20
OWNED_TOKENS = 1 << 22
#: Least occurrences of a context that can be a state, as a number and as a share of the training tokens, and the gain (natural
#: log, over all its occurrences) that its test asks for. Each token's gain is rounded to GRAIN, so that sums do not hang on
#: their order and partial sums are short.
LEAST_COUNT = 4
LEAST_SHARE = 1e-7
MARGIN = 2.0
GRAIN = 1 / 64
#: Weight of the shorter context's distribution, in tokens, by the length of the context; longer contexts take the last.
WEIGHTS = (1000.0, 8.0)
DECISION = 100

_END = mix64(np.array([0xE0D], np.uint64))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MESSAGE = "part long, level int, bucket int, keys binary, sums binary"
_ANSWER = "part long, level int, bucket int, totals binary, distinct long"


def _planes(x: np.ndarray) -> bytes:
    """The bytes of x by significance: those that hardly change stand together and compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _from_planes(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and the place of each key among them."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    place = np.empty(len(keys), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return ordered[new], place


def _owner(keys: np.ndarray, owners: int) -> np.ndarray:
    """Owners take ranges of hashes, so sorted keys fall into slices."""
    return ((keys >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int64)


def is_held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 1, F.lit(False))


def _parted(depth: int, part_tokens: int, piece_tokens: int, id_type: pa.DataType):
    """(id, held_out, text) -> parts. A document longer than a piece is cut; a piece begins with the `depth` tokens before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        pieces: list[tuple] = []
        held = made = rows = 0

        def part() -> pa.RecordBatch:
            tokens = np.concatenate([p[4] for p in pieces])
            words, place = _distinct(tokens)
            by_count = np.argsort(-np.bincount(place), kind="stable")
            rank = np.empty(len(words), np.uint32)
            rank[by_count] = np.arange(len(words), dtype=np.uint32)
            trained = sum(len(p[4]) - p[3] for p in pieces if not p[2])
            cells = [first + made, trained, words[by_count].tobytes(), _planes(rank[place]), [p[0] for p in pieces], [p[1] for p in pieces], [p[2] for p in pieces], [p[3] for p in pieces], [len(p[4]) for p in pieces]]
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(id_type), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], ["part", "trained", "words", "tokens", "rows", "ids", "held", "leads", "sizes"])

        for batch in batches:
            for doc, out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                tokens = np.concatenate([word_hashes(text.as_py())[0], _END])
                for at in range(0, len(tokens), piece_tokens):
                    lead = min(at, depth)
                    pieces.append((first + rows, doc, out, lead, tokens[at - lead : at + piece_tokens]))
                    held += len(pieces[-1][4])
                    if held >= part_tokens:
                        yield part()
                        made, held, pieces = made + 1, 0, []
                rows += 1
        if pieces:
            yield part()

    return run


class Level:
    """Runs of words of one length in a part: sorted distinct hashes, the positions they end at, and which stands where."""

    def __init__(self, keys: np.ndarray, at: np.ndarray, place: np.ndarray):
        self.keys, self.at, self.place = keys, at, place
        self.counts: np.ndarray | None = None


class Part:
    def __init__(self, words: bytes, tokens: bytes, held: np.ndarray, leads: np.ndarray, sizes: np.ndarray):
        self.words, self.tokens = np.frombuffer(words, np.uint64), _from_planes(tokens, np.uint32).astype(np.int32)
        sizes, leads = np.asarray(sizes, np.int64), np.asarray(leads, np.int64)
        self.starts = np.cumsum(sizes) - sizes
        self.depth = (np.arange(len(self.tokens)) - np.repeat(self.starts, sizes)).astype(np.int32)
        self.counted = self.depth >= np.repeat(leads, sizes)
        self.trained = self.counted & ~np.repeat(np.asarray(held, bool), sizes)

    def levels(self, totals: dict[int, np.ndarray], last: int, least: int) -> list[Level]:
        """Levels 0 to last, with total counts as far as totals has them. Those before the last must be there."""
        order = np.argsort(self.words)
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        hashes = self.words[self.tokens]
        out = [Level(self.words[order], np.arange(len(self.tokens)), rank[self.tokens])]
        run = hashes
        for k in range(last + 1):
            if k:
                frequent = np.zeros(len(self.tokens), bool)
                before = out[-1]
                frequent[before.at] = before.counts[before.place] >= least
                at = np.flatnonzero(frequent[:-1] & (self.depth[1:] >= k)) + 1
                longer = np.zeros(len(self.tokens), np.uint64)
                with np.errstate(over="ignore"):
                    longer[at] = mix64(run[at - 1] * _STEP + hashes[at] + np.uint64(k))
                run = longer
                out.append(Level(*(lambda keys, place, at=at: (keys, at, place))(*_distinct(run[at]))))
            # A part without a run of this length has asked for nothing and got no answer.
            out[k].counts = totals.get(k) if len(out[k].keys) else np.empty(0, np.int64)
        return out

    def local(self, level: Level) -> np.ndarray:
        """Training occurrences in this part of each run."""
        return np.bincount(level.place, self.trained[level.at], len(level.keys)).astype(np.int64)

    def chances(self, levels: list[Level], trained: int, distinct: int, weights: tuple[float, ...], left_out: bool) -> list[np.ndarray]:
        """For each level, every token's probability after the context of that length; where it has none, that of the level below.
        left_out: as if the token itself had not been counted."""
        one = 1 if left_out else 0
        p = (np.maximum(levels[0].counts[levels[0].place] - one, 0) + 0.5) / max(trained - one + 0.5 * (distinct + 1), 0.5)
        out = [p]
        for k, level in enumerate(levels[1:], 1):
            w = weights[min(k, len(weights)) - 1]
            p = p.copy()
            before = np.zeros(len(self.tokens), np.int64)
            before[levels[k - 1].at] = levels[k - 1].counts[levels[k - 1].place]
            count, context = level.counts[level.place], before[level.at - 1]
            p[level.at] = (np.maximum(count - one, 0) + w * p[level.at]) / (context - one + w)
            out.append(p)
        return out

    def contexts(self, levels: list[Level], k: int) -> np.ndarray:
        """For each position of level k, the place of its context among the runs of level k - 1."""
        where = np.full(len(self.tokens), -1, np.int32)
        where[levels[k - 1].at] = levels[k - 1].place
        return where[levels[k].at - 1]

    def gains(self, levels: list[Level], chances: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Contexts in the part (places among the runs of level k - 1), and the sums of what training tokens gain, in grains."""
        at, context = levels[k].at, self.contexts(levels, k)
        gain = np.where(self.trained[at], np.rint(np.log(chances[k][at] / chances[k - 1][at]) / GRAIN), 0)
        total = np.bincount(context, gain, len(levels[k - 1].keys)).astype(np.int64)
        seen = self.seen(levels, k)
        return seen, total[seen]

    def seen(self, levels: list[Level], k: int) -> np.ndarray:
        return np.flatnonzero(np.bincount(self.contexts(levels, k), minlength=len(levels[k - 1].keys)))

    def scores(self, levels: list[Level], chances: list[np.ndarray], states: dict[int, np.ndarray]) -> np.ndarray:
        """log10 of each token's probability in the longest state."""
        p = chances[0].copy()
        for k in range(1, len(levels)):
            at = levels[k].at[states[k][self.contexts(levels, k)]]
            p[at] = chances[k][at]
        return np.log10(p)


def _messages(part: int, level: int, keys: np.ndarray, sums: np.ndarray, owners: int) -> pd.DataFrame:
    cuts = np.searchsorted(_owner(keys, owners), np.arange(owners + 1))
    full = np.flatnonzero(np.diff(cuts))
    slices = [slice(cuts[b], cuts[b + 1]) for b in full]
    return pd.DataFrame({"part": part, "level": level, "bucket": full.astype(np.int32), "keys": [_planes(keys[s]) for s in slices], "sums": [_planes(sums[s]) for s in slices]})


def _answers(margin: float):
    """What an owner makes of all messages about its hashes: the total of each, or whether it is above the margin."""

    def run(got: pd.DataFrame) -> pd.DataFrame:
        parts = [_from_planes(x, np.uint64) for x in got["keys"]]
        decide = int(got["level"].iloc[0]) >= DECISION
        keys, place = _distinct(np.concatenate(parts))
        total = np.bincount(place, np.concatenate([_from_planes(x, np.int64) for x in got["sums"]]), len(keys))
        answer = (total * GRAIN > margin).astype(np.int8) if decide else total.astype(np.int64)
        at = np.cumsum([0, *map(len, parts)])
        distinct = np.zeros(len(got), np.int64)
        distinct[0] = np.count_nonzero(total)
        return pd.DataFrame({"part": got["part"], "level": got["level"], "bucket": got["bucket"], "totals": [_planes(answer[place[at[i] : at[i + 1]]]) for i in range(len(parts))], "distinct": distinct})

    return run


def _opened(part: pd.DataFrame, answers: pd.DataFrame) -> tuple[Part, dict[int, np.ndarray]]:
    r = part.iloc[0]
    got = {}
    for level, rows in answers.sort_values(["level", "bucket"]).groupby("level"):
        got[int(level)] = np.concatenate([_from_planes(x, np.int8 if level >= DECISION else np.int64) for x in rows["totals"]])
    return Part(r["words"], r["tokens"], r["held"], r["leads"], r["sizes"]), got


def _context_key(keys: np.ndarray, k: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(keys + np.uint64(DECISION + k))


def _bucketed(parts: DataFrame, buckets: int) -> DataFrame:
    """parts as a table of the shared folder whose files are dealt by part, so that nothing that goes by part moves them."""
    from ._shared import _tables

    spark = parts.sparkSession
    name = f"lodestone_parts_{uuid.uuid4().hex}"
    parts.write.bucketBy(buckets, "part").format("parquet").option("path", f"{_tables(spark)}/{name}").option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def scored(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None, depth: int = DEPTH, least_count: int = LEAST_COUNT, least_share: float = LEAST_SHARE, margin: float = MARGIN,
    weights: tuple[float, ...] = WEIGHTS, part_tokens: int = PART_TOKENS, piece_tokens: int = PIECE_TOKENS,
) -> DataFrame:
    """One row for each document: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10).

    The model learns from the documents that are not held out (by default those whose crc32 of the id as text is 1 modulo 5);
    all are scored. Tokens are words, lower-cased in A-Z only, and one end. Null and empty texts are one end. Null ids are not
    held out. Repeated rows are documents of their own. Other columns of documents, whatever their names, are not looked at.
    An empty table gives no rows. Without training documents every token has the unknown word's probability, which is 1.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = documents.sparkSession
    kind = documents.schema[id_col].dataType
    docs = documents.select(F.col(id_col).alias("id"), (is_held_out(id_col) if held_out is None else F.coalesce(held_out, F.lit(False))).alias("held"), F.col(text_col).cast("string").alias("text"))
    lists = {"rows": T.LongType(), "ids": kind, "held": T.BooleanType(), "leads": T.IntegerType(), "sizes": T.IntegerType()}
    schema = T.StructType([T.StructField("part", T.LongType()), T.StructField("trained", T.LongType()), T.StructField("words", T.BinaryType()), T.StructField("tokens", T.BinaryType()), *(T.StructField(n, T.ArrayType(t)) for n, t in lists.items())])
    parts = _bucketed(docs.mapInArrow(_parted(depth, part_tokens, piece_tokens, to_arrow_type(kind)), schema), 2 * spread(spark))
    trained = parts.agg(F.sum("trained")).first()[0] or 0
    owners = max(spread(spark), -(-trained // OWNED_TOKENS))
    least = max(least_count, math.ceil(least_share * trained))
    light = parts.select("part", "words", "tokens", "held", "leads", "sizes")
    answers = spark.createDataFrame([], _ANSWER)

    def asked(run, result: str | T.StructType, table: DataFrame = light) -> DataFrame:
        return table.groupBy("part").cogroup(answers.groupBy("part")).applyInPandas(run, result)

    def counts(k: int):
        def run(part: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
            own, totals = _opened(part, answers)
            level = own.levels(totals, k, least)[k]
            return _messages(part["part"].iloc[0], k, level.keys, own.local(level), owners)

        return run

    def answered(messages: DataFrame, name: str) -> DataFrame:
        return answers.unionByName(written(messages.groupBy("bucket").applyInPandas(_answers(margin), _ANSWER), name))

    for k in range(depth + 1):
        answers = answered(asked(counts(k), _MESSAGE), f"counts{k}")
        if not k:
            distinct = answers.agg(F.sum("distinct")).first()[0] or 0

    def tests(part: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        own, totals = _opened(part, answers)
        levels = own.levels(totals, depth, least)
        chances = own.chances(levels, trained, distinct, weights, left_out=True)
        out = []
        for k in range(1, depth + 1):
            seen, gain = own.gains(levels, chances, k)
            keys, place = _distinct(_context_key(levels[k - 1].keys[seen], k))
            sums = np.bincount(place, gain, len(keys)).astype(np.int64)
            out.append(_messages(part["part"].iloc[0], DECISION + k, keys, sums, owners))
        return pd.concat(out, ignore_index=True)

    # Decisions about contexts of different lengths have different hashes, so one owner may hear of all of them at once.
    answers = answered(asked(tests, _MESSAGE), "tests")

    result = T.StructType([T.StructField("row", T.LongType()), T.StructField("id", kind), T.StructField("held_out", T.BooleanType()), *(T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known")), *(T.StructField(n, T.DoubleType()) for n in ("base_score", "score"))])

    def scores(part: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        own, totals = _opened(part, answers)
        levels = own.levels(totals, depth, least)
        states = {}
        for k in range(1, depth + 1):
            # The decisions stand in the order in which the tests asked for them.
            seen = own.seen(levels, k)
            asked_for = _distinct(_context_key(levels[k - 1].keys[seen], k))[1]
            states[k] = np.zeros(len(levels[k - 1].keys), bool)
            if len(seen):
                states[k][seen] = totals[DECISION + k][asked_for] > 0
        chances = own.chances(levels, trained, distinct, weights, left_out=False)
        base, score = np.log10(chances[0]), own.scores(levels, chances, states)
        known = levels[0].counts[levels[0].place] > 0
        r = part.iloc[0]
        add = lambda x: np.add.reduceat(np.where(own.counted, x, 0), own.starts)
        return pd.DataFrame({"row": r["rows"], "id": pd.Series(list(r["ids"]), dtype=object), "held_out": r["held"], "n_tokens": add(1), "n_known": add(known.astype(np.int64)), "base_score": add(base), "score": add(score)})

    each = asked(scores, result, parts).groupBy("row").agg(F.first("id").alias(id_col), F.first("held_out").alias("held_out"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")))
    return each.select(id_col, "held_out", "n_tokens", "n_known", F.lit(trained).cast("long").alias("train_tokens"), "base_score", "score")
