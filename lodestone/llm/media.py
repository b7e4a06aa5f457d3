"""Copies of images in a media column, found by local descriptors.

Images (binary PGM or PNG, 8 bits) are made grey. Corners are found over a pyramid of scales, the strongest of each tile, so
their number grows with the picture; around each, the intensity centroid gives an orientation and comparisons of point pairs,
turned by it, give 256 binary tests. Descriptors meet in Hamming tables: runs of the bits are join keys of a fixed width.
Matches of two images must agree on one scale, turn and shift; the pairs with enough agreeing matches are copies, cropped or
edited.

Images that differ little form a look: an image meets the leaders of its strongest corners' keys, links that half of the
corners confirm are kept, and connected images are one look, led by the smallest id. Queries probe looks. A look offers each
key once, however many of its images hold it, and is confirmed on its leader; only where that fails are the images of the look
that met the query compared one by one.

Scale: equal images are one class, described once; near copies are one look, probed once, so the work grows with the images
and the looks that a query meets, not with the square of a group. Keys have one width at every size of the table. The tables
only choose what is compared: SEEDS corners that meet are enough, and then all descriptors of the two are compared.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import mix64, written
from .components import components

#: Ratio of a scale of the pyramid to the one above it.
STEP = 0.5**0.5
RADIUS = 9
#: Corners kept of each tile of TILE x TILE points, at each scale.
CORNERS, TILE = 48, 96
BITS = 256
#: Runs of the bits that are keys, evenly spaced, and their width in bytes.
CHUNKS, KEY_BYTES = 10, 5
DISTANCE = 40
LEAST = 6
#: Corners of a query that must meet a look in the tables before the two are compared whole.
SEEDS = 2
#: Strongest corners of an image whose keys name its leaders, and the share of the corners that confirms a near copy.
LEADING, SHARE = 6, 0.5


def decode_image(raw: bytes | None) -> np.ndarray | None:
    """Grey values of a binary PGM or an 8-bit PNG (grey or RGB, not interlaced); None for anything else."""
    try:
        if raw[:2] == b"P5":
            head = raw[:64].split(maxsplit=4)
            w, h = int(head[1]), int(head[2])
            return np.frombuffer(raw[len(raw) - w * h :], np.uint8).reshape(h, w).astype(np.float32)
        if raw[:8] != b"\x89PNG\r\n\x1a\n":
            return None
        at, data, w = 8, b"", 0
        while at < len(raw):
            size, kind = struct.unpack(">I4s", raw[at : at + 8])
            body = raw[at + 8 : at + 8 + size]
            at += size + 12
            if kind == b"IHDR":
                w, h, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
                channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
                if depth != 8 or channels is None or interlaced:
                    return None
            elif kind == b"IDAT":
                data += body
        rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(h, 1 + w * channels)
        out, above = np.zeros((h, w * channels), np.uint8), np.zeros(w * channels, np.uint8)
        for y in range(h):
            kind, line = rows[y, 0], rows[y, 1:].copy()
            if kind == 2:
                line += above
            elif kind:
                for x in range(len(line)):
                    a = int(line[x - channels]) if x >= channels else 0
                    b, c = int(above[x]), int(above[x - channels]) if x >= channels else 0
                    p = a + b - c
                    near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                    line[x] = (int(line[x]) + {1: a, 3: (a + b) // 2, 4: near}[int(kind)]) & 255
            out[y] = above = line
        grey = out.reshape(h, w, channels).astype(np.float32)
        return grey[..., :3].mean(axis=2) if channels >= 3 else grey[..., 0]
    except (ValueError, TypeError, IndexError, KeyError, struct.error, zlib.error, UnboundLocalError):
        return None


def encode_image(grey: np.ndarray) -> bytes:
    h, w = grey.shape
    return b"P5 %d %d 255\n" % (w, h) + np.clip(np.rint(grey), 0, 255).astype(np.uint8).tobytes()


def _box(image: np.ndarray, r: int) -> np.ndarray:
    total = np.cumsum(np.cumsum(np.pad(image, ((r + 1, r), (r + 1, r)), mode="edge"), axis=0), axis=1)
    k = 2 * r + 1
    return (total[k:, k:] - total[:-k, k:] - total[k:, :-k] + total[:-k, :-k]) / (k * k)


def _points() -> np.ndarray:
    """The point pairs of the binary tests, within RADIUS."""
    numbers = mix64(np.arange(1, BITS * 4 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    units = (numbers >> np.uint64(40)).astype(np.float64) / (1 << 24)
    radius, angle = (RADIUS - 2) * np.sqrt(units[::2]), 2 * np.pi * units[1::2]
    return np.stack([radius * np.cos(angle), radius * np.sin(angle)], axis=1).reshape(BITS, 2, 2)


_POINTS = _points()
_Y, _X = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
_DISC = _X**2 + _Y**2 <= RADIUS**2


def _shrunk(image: np.ndarray, scale: float) -> np.ndarray:
    if scale == 1.0:
        return image
    smooth = _box(image, 1 if scale > 0.4 else int(round(0.5 / scale)))
    y = np.arange(0, image.shape[0] - 1e-6, 1 / scale).astype(int)
    x = np.arange(0, image.shape[1] - 1e-6, 1 / scale).astype(int)
    return smooth[np.ix_(y, x)]


def _strongest(ys: np.ndarray, xs: np.ndarray, strength: np.ndarray) -> np.ndarray:
    """The places of the CORNERS strongest of each tile, strongest first."""
    order = np.argsort(-strength, kind="stable")
    tile = (ys[order] // TILE) * (1 << 20) + xs[order] // TILE
    by_tile = np.argsort(tile, kind="stable")
    at = tile[by_tile]
    rank = np.arange(len(at)) - np.searchsorted(at, at)
    return order[np.sort(by_tile[rank < CORNERS])]


def descriptors(grey: np.ndarray | None) -> list[tuple[float, float, float, float, bytes]]:
    """(x, y, scale, angle, bits) of the strongest corners of each tile and scale, scale 1 first, strongest first.

    No image, none; flat or tiny images, none.
    """
    out = []
    scale = 1.0
    while grey is not None:
        image = _shrunk(grey, scale)
        h, w = image.shape
        if min(h, w) <= 2 * RADIUS + 2:
            break
        smooth = _box(image, 1)
        gy, gx = np.gradient(smooth)
        a, b, c = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        corner = a * b - c * c - 0.05 * (a + b) ** 2
        inner = corner[RADIUS:-RADIUS, RADIUS:-RADIUS]
        peak = np.ones_like(inner, bool)
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                if dy or dx:
                    peak &= inner >= corner[RADIUS + dy : h - RADIUS + dy, RADIUS + dx : w - RADIUS + dx]
        ys, xs = np.nonzero(peak & (inner > 1.0))
        best = _strongest(ys, xs, inner[ys, xs])
        for part in np.array_split(best, max(1, -(-len(best) // 4096))):
            y, x = ys[part] + RADIUS, xs[part] + RADIUS
            patch = smooth[y[:, None, None] + _Y, x[:, None, None] + _X] * _DISC
            angle = np.arctan2((patch * _Y).sum(axis=(1, 2)), (patch * _X).sum(axis=(1, 2))).astype(np.float64)
            co, si = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
            px = np.rint(_POINTS[..., 0] * co - _POINTS[..., 1] * si).astype(int) + x[:, None, None]
            py = np.rint(_POINTS[..., 0] * si + _POINTS[..., 1] * co).astype(int) + y[:, None, None]
            value = smooth[py, px]
            bits = np.packbits(value[..., 0] < value[..., 1], axis=1)
            out += [(float(u) / scale, float(v) / scale, scale, float(t), d.tobytes()) for u, v, t, d in zip(x, y, angle, bits, strict=True)]
        scale *= STEP
    return out


def _described(classes: DataFrame) -> DataFrame:
    """(cls, image) -> cls, n (number within the image), x, y, scale, angle, bits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.iloc[at : at + 200]
                rows = [(c, n, *d) for c, raw in zip(part["cls"], part["image"], strict=True) for n, d in enumerate(descriptors(decode_image(raw)))]
                yield pd.DataFrame(rows, columns=["cls", "n", "x", "y", "scale", "angle", "bits"])

    kind = classes.schema["cls"].dataType.simpleString()
    return classes.select("cls", "image").mapInPandas(run, f"cls {kind}, n int, x double, y double, scale double, angle double, bits binary")


def _keyed(described: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and a key for each of CHUNKS runs of KEY_BYTES, evenly spaced around the bits."""
    step = BITS // 8 // CHUNKS
    around = F.concat("bits", "bits")
    keys = F.array(*(F.xxhash64(F.lit(k), F.substring(around, k * step + 1, KEY_BYTES)) for k in range(CHUNKS)))
    return described.select(*keep, F.explode(keys).alias("key"))


def _whole(described: DataFrame, cls: str, mark: str) -> DataFrame:
    """One row for each image with the arrays of its descriptors, as many as its corners."""
    rows = described.groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("n", "x", "y", "scale", "angle", "bits"))).alias("d"))
    return rows.select(F.col("cls").alias(cls), *(F.col(f"d.{k}").alias(mark + k) for k in ("x", "y", "scale", "angle", "bits")))


def _agreeing(rows: pd.DataFrame) -> int:
    """Most matches of two images that agree on one scale, turn and shift, each corner counted once."""
    s = (rows["scale"] / rows["qscale"]).to_numpy()
    turn = (rows["qangle"] - rows["angle"]).to_numpy()
    qx, qy, x, y = (rows[c].to_numpy() for c in ("qx", "qy", "x", "y"))
    most = 0
    for k in range(len(rows)):
        ok = (np.abs(np.log2(s / s[k])) < 0.6) & (np.abs((turn - turn[k] + np.pi) % (2 * np.pi) - np.pi) < 0.35)
        if ok.sum() <= most:
            continue
        co, si = s[k] * np.cos(turn[k]), s[k] * np.sin(turn[k])
        dx, dy = x - x[k], y - y[k]
        ok &= np.hypot(qx - qx[k] - (co * dx - si * dy), qy - qy[k] - (si * dx + co * dy)) < 4 * max(1.0, s[k])
        if ok.sum() > most:
            most = max(most, min(len(set(zip(qx[ok], qy[ok], strict=True))), len(set(zip(x[ok], y[ok], strict=True)))))
    return most


def _compared(pair) -> int:
    """Agreement of two images: each corner of the query with its nearest descriptors, if within DISTANCE, ties and all."""
    mine, theirs = (np.unpackbits(np.frombuffer(b"".join(map(bytes, bits)), np.uint8).reshape(-1, BITS // 8), axis=1).astype(np.float32) * 2 - 1 for bits in (pair.bits, pair.qbits))
    apart = (BITS - mine @ theirs.T) / 2
    i, k = np.nonzero(apart <= np.minimum(apart.min(axis=0), DISTANCE))
    own = {c: np.asarray(getattr(pair, c), float)[i] for c in ("x", "y", "scale", "angle")}
    return _agreeing(pd.DataFrame(own | {c: np.asarray(getattr(pair, c), float)[k] for c in ("qx", "qy", "qscale", "qangle")}))


def _agreement(pairs: DataFrame, asked: DataFrame, table: DataFrame) -> DataFrame:
    """(q, cls) pairs -> q, cls, agreeing, corners (of the image with fewer); descriptors of the named images only are read."""
    mine = _whole(table.join(pairs.select("cls").distinct(), "cls", "left_semi"), "cls", "")
    theirs = _whole(asked.join(pairs.select(F.col("q").alias("cls")).distinct(), "cls", "left_semi"), "q", "q")
    kinds = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in ("q", "cls"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(_compared(r), min(len(r.bits), len(r.qbits))) for r in batch.itertuples(index=False)]
            yield pd.DataFrame({"q": batch["q"], "cls": batch["cls"], "agreeing": [f[0] for f in found], "corners": [f[1] for f in found]})

    return pairs.select("q", "cls").join(mine, "cls").join(theirs, "q").mapInPandas(run, f"{kinds}, agreeing long, corners long")


def looks(table: DataFrame, least: int = LEAST) -> DataFrame:
    """(cls, look) of the images that are near copies of others; look is the smallest id of the connected images.

    For each key of its LEADING strongest corners an image meets one leader, the first of all images that hold the key, by
    one random order so that keys agree; so an image has a bounded number of links to confirm, whatever the group's size.
    """
    strong = _keyed(table.where(F.col("n") < LEADING), "cls", "n")
    first = strong.groupBy("key").agg(F.min(F.struct(F.xxhash64("cls").alias("h"), "cls")).alias("f"), F.count("*").alias("m")).where("m > 1").select("key", F.col("f.cls").alias("q"))
    near = strong.join(first, "key").where("cls <> q").groupBy("q", "cls").agg(F.count_distinct("n").alias("m"))
    near = written(near.where(F.col("m") >= SEEDS).select("q", "cls"), "leaders")
    links = _agreement(near, table, table).where((F.col("agreeing") >= least) & (F.col("agreeing") >= SHARE * F.col("corners")))
    found = components(links.select(F.col("q").alias("u"), F.col("cls").alias("v")))
    return found.select(F.col("node").alias("cls"), F.col("component").alias("look"))


def image_copies(images: DataFrame, queries: DataFrame, id_col: str = "id", image_col: str = "image", least: int = LEAST) -> DataFrame:
    """Rows of two kinds: 'member' (id, its look) for each row of images, 'pair' (query id, look, agreeing matches).

    A look is the smallest id of connected near copies, equal images among them. A pair says that the query agrees with the
    look's leader, or else with an image of it; it stands for all images of the look. Queries are rows of id_col and
    image_col; a pair names the smallest query id of equal query images. Null, empty and undecodable images are looks of
    their own bytes and match nothing. Null ids are members of their look and name none, unless all of it is null. Repeated
    rows are equal images. Other columns, whatever their names, are not looked at. No rows: none.
    """
    rows = images.select(F.col(id_col).alias("id"), F.coalesce(F.col(image_col), F.lit(b"")).alias("image"))
    rows = rows.withColumn("h", F.sha2("image", 256))
    classes = rows.groupBy("h").agg(F.min("id").alias("cls"), F.max("image").alias("image"))
    table = written(_described(classes.where("cls IS NOT NULL")), "descriptors")
    asked = queries.select(F.col(id_col).alias("id"), F.coalesce(F.col(image_col), F.lit(b"")).alias("image")).groupBy(F.sha2("image", 256).alias("h")).agg(F.min("id").alias("cls"), F.max("image").alias("image"))
    asked = written(_described(asked.where("cls IS NOT NULL")), "asked")
    look = written(looks(table, least), "looks")
    probes = _keyed(asked.select(F.col("cls").alias("q"), F.col("n").alias("qn"), "bits"), "q", "qn")
    lone = _keyed(table.join(look, "cls", "left_anti"), F.col("cls").alias("look"))
    held = _keyed(table.join(look, "cls"), "cls", "look")
    met = lone.unionByName(held.select("look", "key").distinct()).join(probes, "key").groupBy("q", "look").agg(F.count_distinct("qn").alias("m"))
    met = written(met.where(F.col("m") >= min(SEEDS, least)).select("q", F.col("look").alias("cls")), "met")
    led = written(_agreement(met, asked, table), "led")
    failed = led.where(F.col("agreeing") < least).select("q", F.col("cls").alias("look")).join(look.select("look").distinct(), "look", "left_semi")
    others = held.where("cls <> look").join(probes.join(failed, "q"), ["key", "look"]).groupBy("q", "cls", "look").agg(F.count_distinct("qn").alias("m"))
    others = written(others.where(F.col("m") >= min(SEEDS, least)).select("q", "cls", "look"), "others")
    second = _agreement(others, asked, table).where(F.col("agreeing") >= least).join(look, "cls").groupBy("q", "look").agg(F.max("agreeing").alias("agreeing"))
    pairs = led.where(F.col("agreeing") >= least).select("q", F.col("cls").alias("look"), "agreeing").unionByName(second)
    named = classes.select("h", "cls").join(look, "cls", "left").select("h", F.coalesce("look", "cls").alias("class_id"))
    members = rows.select("id", "h").join(named, "h").select(F.lit("member").alias("kind"), F.col("id").alias("query_id"), "class_id", F.lit(None).cast("long").alias("agreeing"))
    return members.unionByName(pairs.select(F.lit("pair").alias("kind"), F.col("q").alias("query_id"), F.col("look").alias("class_id"), "agreeing"))


SIDE = 72


def rendered(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cropped: bool = False) -> DataFrame:
    """(id, image): each vector drawn as a picture of blocks, for tables without a media column; null vectors, null images.

    Each component tints one of the fixed block patterns, so near vectors make edited copies. With cropped, the picture
    loses a seventh of each side and is brightened.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        patterns: dict[int, np.ndarray] = {}
        for batch in batches:
            images = []
            for v in batch["v"]:
                if v is None or not len(v):
                    images.append(None)
                    continue
                if len(v) not in patterns:
                    noise = np.random.default_rng(5).integers(0, 2, (len(v), SIDE // 4, SIDE // 4)) * 2 - 1
                    patterns[len(v)] = np.kron(noise, np.ones((1, 4, 4))).reshape(len(v), -1).astype(np.float32)
                value = np.asarray(v, np.float32)
                value = value / (np.linalg.norm(value) + 1e-9)
                image = 127 + 45 * (value @ patterns[len(v)]).reshape(SIDE, SIDE)
                images.append(encode_image(image[8:-8, 8:-8] * 1.05 + 5 if cropped else image))
            yield pd.DataFrame({"id": batch["id"], "image": images})

    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(run, f"id {kind}, image binary")
