"""What the operators of this subpackage share: the cluster's shared folder and word hashing."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where that is unset, as in tests, one of our own, but only
    if driver and executors are one machine: elsewhere each would write a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, _OWN_DIR[app], ignore_errors=True)
    return _OWN_DIR[app]


def _tables(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lodestone/{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it again.

    Every executor reads the table from there, so the loss of an executor costs no recomputation of what came before.
    """
    spark = df.sparkSession
    path = f"{_tables(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession) -> None:
    """Delete all tables that written() made for this application. Results that were not yet read or saved need them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_tables(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread(spark: SparkSession, least: int = 8) -> int:
    """Partitions for work that is heavy on the CPU per row: what shuffles use, and a task for each core at least."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, elementwise on uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


#: A word's hash is the sum of BYTE[c] * BASE^i over its bytes modulo 2^64, then mixed. BASE is odd, so it has an inverse.
BASE = 0x5851F42D4C957F2D
BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
PART = 1 << 18
_UP = _powers(BASE, PART + 1)
_DOWN = _powers(pow(BASE, -1, 1 << 64), PART + 1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _parts(raw: bytes) -> list[bytes]:
    """Pieces that end at white space, of PART bytes where words allow it: memory is bounded however long the text is."""
    if len(raw) <= PART:
        return [raw]
    out, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + PART)
        if end < len(raw):
            cut = max(raw.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f"))
            if cut < 0:
                cut = min((x for c in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f") if (x := raw.find(c, end)) >= 0), default=len(raw) - 1)
            end = cut + 1
        out.append(raw[at:end])
        at = end
    return out


def word_hashes(text: str | None, prefixes: tuple[int, ...] = ()) -> list[np.ndarray]:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+ in order, after lower-casing A-Z only; null has none.

    With prefixes, also one array for each length k: hashes of the words' first k bytes (of the word, if shorter).
    """
    global _UP, _DOWN
    got: list[list[np.ndarray]] = [[] for _ in range(1 + len(prefixes))]
    for raw in _parts(text.encode("utf-8", "surrogatepass").lower()) if text else ():
        c = np.frombuffer(raw, np.uint8)
        if len(c) >= len(_UP):
            _UP, _DOWN = _powers(BASE, len(c) + 1), _powers(pow(BASE, -1, 1 << 64), len(c) + 1)
        space = _SPACE[c]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).view(np.int8)))
        start, end = edge[::2], edge[1::2]
        total = np.zeros(len(c) + 1, np.uint64)
        np.cumsum(BYTE[c] * _UP[: len(c)], out=total[1:])
        for k, out in zip((None, *prefixes), got, strict=True):
            stop = end if k is None else np.minimum(end, start + k)
            out.append(mix64((total[stop] - total[start]) * _DOWN[start] + (stop - start).astype(np.uint64)))
    return [np.concatenate(x) if x else np.empty(0, np.uint64) for x in got]


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the size-word shingles; fewer words make one shingle of all; no words, none."""
    (h,) = word_hashes(text)
    if not len(h):
        return h
    width = min(size, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - width + 1 + k])
    return np.unique(out)


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def text_or_empty(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
