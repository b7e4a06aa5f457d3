"""Pairs of images against a comparison of every query with every image."""

import numpy as np
import pandas as pd
from lodestone.llm import media


def test_recall_against_brute_force(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    images, asked = media.rendered(vectors), media.rendered(vectors.where("vec_id % 50 = 0"), cropped=True)
    rows, look = media.image_copies(images, asked).collect(), {}
    for r in rows:
        if r["kind"] == "member":
            look.setdefault(r["class_id"], []).append(r["query_id"])
    got = {(r["query_id"], m) for r in rows if r["kind"] == "pair" for m in look[r["class_id"]]}

    def described(rows):
        return {r["id"]: media.descriptors(media.decode_image(bytes(r["image"]))) for r in rows.collect()}

    def signs(d):
        return np.unpackbits(np.frombuffer(b"".join(x[4] for x in d), np.uint8).reshape(len(d), -1), axis=1) * 2.0 - 1

    all_images, want = described(images), set()
    for q, theirs in described(asked).items():
        for c, mine in all_images.items():
            i, k = np.nonzero((media.BITS - signs(mine) @ signs(theirs).T) / 2 <= media.DISTANCE)
            if len(i) >= media.LEAST:
                rows = [(*mine[a][:4], *theirs[b][:4]) for a, b in zip(i, k, strict=True)]
                if media._agreeing(pd.DataFrame(rows, columns=["x", "y", "scale", "angle", "qx", "qy", "qscale", "qangle"])) >= media.LEAST:
                    want.add((q, c))
    assert want and got <= want and len(got) >= 0.9 * len(want)
