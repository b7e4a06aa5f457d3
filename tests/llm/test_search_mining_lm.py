"""Hard negatives, ranked search and suffix-tree scores against brute force, with nulls, ties, repeats, long and empty input."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import hard_negatives, ranked_search, suffix_lm

VECTORS = "vec_id long, embedding array<float>, label int, id int, x string"


def _mined(rows, positives=5, negatives=5):
    """rows: (id, vector, label), each a row of its own."""
    dims = max((len(v) for _, v, _ in rows), default=0)
    full = [(i, [math.floor(256 * float(np.float32(c))) for c in v] + [0] * (dims - len(v)), y) for i, v, y in rows]
    out = []
    for i, v, y in full:
        if i % 10:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, z) for j, w, z in full if j != i]
        best = sorted((s for s in scored if s[2] == y), key=lambda s: (-s[0], s[1]))[:positives]
        for p, j, _ in best:
            fits = sorted((s for s in scored if s[2] != y and 80 * p <= 100 * s[0] <= 100 * p), key=lambda s: (-s[0], s[1]))[:negatives]
            out += [(i, j, k, n, p, s) for k, (s, n, _) in enumerate(fits, 1)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(4096, 128, 32), (7, 2, 3)])
def test_hard_negatives(spark, sizes):
    rng = random.Random(5)
    base = [[rng.uniform(-1, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i, [c + rng.uniform(-0.2, 0.2) for c in rng.choice(base)], rng.randint(0, 2)) for i in range(150)]
    rows += [(200 + i, base[0], i % 2) for i in range(30)] + [(10, base[0], 1), (33, base[0], 1), (33, base[0], 1), (50, [], 0), (61, [0.5], 0)]
    odd = [(None, base[0], 1), (300, None, 1), (310, base[0], None), (320, [1.0, None], 0), (330, [float("nan")] * 8, 0), (340, [float("inf")] + [0.0] * 7, 1)]
    df = spark.createDataFrame([(i, v, y, 3, None) for i, v, y in rows + odd], VECTORS).repartition(3)
    run = lambda d: hard_negatives.hard_negatives(d, F.col("vec_id") % 10 == 0, F.col("label"), block_rows=sizes[0], anchor_rows=sizes[1], chunk_dims=sizes[2])
    got = sorted(map(tuple, run(df).collect()))
    assert got == _mined(rows) and len(got) > 100
    assert run(df.limit(0)).collect() == []


def test_products_beyond_doubles_are_exact():
    a = np.array([[2**30, 1], [-(2**30), 3]], np.int64)
    assert hard_negatives._product(a, a).tolist() == [[2**60 + 1, 3 - 2**60], [3 - 2**60, 2**60 + 9]]


def _ranked(docs, items, most=10):
    split = lambda t: re.findall("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    counts = [(d, Counter(split(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n, tokens = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        words = split(text)
        scores = []
        for d, c in counts:
            m = 25 + (75 * sum(c.values()) * n) // tokens
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w in words if w in c)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, k, d, -s) for k, (s, _, _, d) in enumerate(sorted(scores)[:most], 1)]
    return out


@pytest.mark.parametrize("sizes", [(4_000_000, 2_000_000), (40, 60)])
def test_ranked_search(spark, sizes):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(60)] + ["Ünï", "x_y", "A9", "the", "THE"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", "-", "\n", "\x00", "\x7f", "; "]) for _ in range(n))
    docs = [(k, text(rng.choice([0, 1, 5, 40, 300]))) for k in range(400)]
    docs += [(1000 + k, "same words here the w1 w2") for k in range(30)] + [(None, "same words here the w1 w2"), (7, None), (8, " \n"), (1001, "same words here the w1 w2"), (2000, "w1 " * 20_000)]
    items = [(k, text(rng.choice([1, 3, 12]))) for k in range(25)] + [(90, None), (91, ""), (92, "nowhere"), (93, "same the the THE w1"), (94, "same"), (95, "w1 " * 50)]
    ddf = spark.createDataFrame([(d, t, "k", 1) for d, t in docs], "doc_id long, text string, item_id string, score int").repartition(3)
    idf = spark.createDataFrame([(i, t, 4) for i, t in items], "item_id long, text string, doc_id int")
    run = lambda a, b: ranked_search.ranked(a, b, block_chars=sizes[0], shard_postings=sizes[1])
    got = sorted(map(tuple, run(ddf, idf).collect()), key=lambda r: r[:2])
    assert got == sorted(_ranked(docs, items), key=lambda r: r[:2]) and len(got) > 200
    assert run(ddf.limit(0), idf).count() == 0 == run(ddf, idf.limit(0)).count()


def test_search_reads_lists_behind_the_pivot_for_few_documents(monkeypatch):
    n = 4000
    holds = [[0] if k % 50 else [0, 1] for k in range(n)]
    terms, sizes = np.array([t for h in holds for t in h], np.int32), np.array([len(h) for h in holds])
    shard = ranked_search.Shard(list(range(n)), np.full(n, 9), sizes, terms, np.ones(len(terms), np.int32), np.array([5, 9000]), n, 9 * n)
    asked, scores = [], shard.scores
    monkeypatch.setattr(shard, "scores", lambda query, docs: asked.append(len(docs)) or scores(query, docs))
    gain = 10**9 // 1800
    assert shard.search({0: 1, 1: 1}, 10, 9000 * gain) == [(9005 * gain, k * 50) for k in range(10)]
    assert sum(asked) <= n // 50


def test_items_of_one_text_are_one_search(spark):
    items = spark.createDataFrame([(k, f"a b{k % 3}") for k in range(60)] + [(60, None)], "item_id long, text string").repartition(4)
    texts = ranked_search._texts(items, "text")
    assert sorted(len(b) for b in ranked_search._blocks(texts, 1)) == [1, 1, 1]
    docs = spark.createDataFrame([(k, f"a b{k}") for k in range(5)], "doc_id long, text string")
    got = ranked_search.ranked(docs, items).collect()
    assert sorted(r["item_id"] for r in got if r["rank"] == 1 and r["doc_id"] == r["item_id"] % 3) == list(range(60))


def test_block_boundaries_are_the_best(spark):
    rng = random.Random(1)
    for n in (0, 1, 2, 9, 10):
        scores = np.array([rng.randint(1, 9) for _ in range(n)], float)
        (ends,) = ranked_search.block_ends([scores], longest=4, price=0.7)
        price = 0.7 * (scores.mean() if n else 0)
        cost = lambda cut: sum((b - a) * scores[a:b].max() + price for a, b in itertools.pairwise(cut))
        ways = [[0, *c, n] for k in range(n) for c in itertools.combinations(range(1, n), k)] if n else [[0]]
        ways = [w for w in ways if all(b - a <= 4 for a, b in itertools.pairwise(w))]
        assert math.isclose(cost([0, *ends.tolist()]), min(map(cost, ways)), abs_tol=1e-9)
    lists = [np.array([rng.randint(1, 99) for _ in range(rng.randint(1, 300))], float) for _ in range(20)]
    together = ranked_search.block_ends(lists)
    assert all(np.array_equal(a, ranked_search.block_ends([b])[0]) for a, b in zip(together, lists))


def _suffix_scores(docs, depth, least, margin, weights):
    words = lambda t: [w for w in re.split("[\\x20\\x09-\\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) if w] + [0]
    held = [zlib.crc32(str(d).encode()) % 5 == 1 if d is not None else False for d, _ in docs]
    texts = [words(t) for _, t in docs]
    count = Counter(tuple(t[i - k : i + 1]) for t, h in zip(texts, held) if not h for i in range(len(t)) for k in range(depth + 1) if i >= k)
    n, v = sum(c for g, c in count.items() if len(g) == 1), sum(len(g) == 1 for g in count)

    def chance(t, i, out):
        p = [(max(count[(t[i],)] - out, 0) + 0.5) / max(n - out + 0.5 * (v + 1), 0.5)]
        for k in range(1, depth + 1):
            context = tuple(t[i - k : i]) if i >= k else None
            if context is None or count[context] < least:
                break
            w = weights[min(k, len(weights)) - 1]
            p.append((max(count[(*context, t[i])] - out, 0) + w * p[-1]) / (count[context] - out + w))
        return p

    gain = defaultdict(float)
    for t, h in zip(texts, held):
        for i in range(len(t) if not h else 0):
            p = chance(t, i, 1)
            for k in range(1, len(p)):
                gain[tuple(t[i - k : i])] += np.rint(math.log(p[k] / p[k - 1]) / suffix_lm.GRAIN) * suffix_lm.GRAIN
    states = {c for c, g in gain.items() if g > margin}
    out = []
    for (d, _), h, t in zip(docs, held, texts):
        ps = [chance(t, i, 0) for i in range(len(t))]
        best = [max((k for k in range(len(p)) if not k or tuple(t[i - k : i]) in states)) for i, p in enumerate(ps)]
        out.append((d, h, len(t), sum(count[(w,)] > 0 for w in t), n, sum(math.log10(p[0]) for p in ps), sum(math.log10(p[k]) for p, k in zip(ps, best))))
    return out, states, chance


@pytest.mark.parametrize("sizes", [(1 << 21, 1 << 20), (50, 9)])
@pytest.mark.parametrize("depth", [1, 2, 3])
def test_suffix_tree_scores(spark, sizes, depth):
    rng = random.Random(4)
    phrase = "the cat sat on the mat and then it ran".split()
    text = lambda n: " ".join(" ".join(phrase[: rng.randint(2, 10)]) if rng.random() < 0.4 else rng.choice(["A", "b", "ü", "C", "dog"]) for _ in range(n))
    docs = [(k, text(rng.randint(0, 12))) for k in range(60)] + [(70, None), (71, ""), (72, " \t\n"), (None, "the cat"), (5, "the cat sat"), (80, "b " * 300), (81, "never seen words 9 8 7")]
    df = spark.createDataFrame([(d, t, 1, "q") for d, t in docs], "doc_id long, text string, row int, score string").repartition(3)
    run = lambda d: suffix_lm.scored(d, depth=depth, least_count=3, margin=1.0, weights=(5.0, 2.0), part_tokens=sizes[0], piece_tokens=sizes[1])
    got = sorted(map(tuple, run(df).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[2], r[6]))
    want, states, _ = _suffix_scores(docs, depth, 3, 1.0, (5.0, 2.0))
    want.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2], r[6]))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], atol=1e-9)
    assert max(map(len, states)) == depth
    if depth == 1:
        assert run(df.limit(0)).count() == 0
        alone = run(df.where("doc_id = 81")).collect()[0]
        assert zlib.crc32(b"81") % 5 == 1 or alone["train_tokens"] == 7


def test_chances_of_a_context_add_up_to_one():
    docs = [(k, t) for k, t in enumerate(["a b a b a c", "a b b a", "c a b a b"] * 4)]
    out, states, chance = _suffix_scores(docs, 2, 2, 0.0, (5.0, 2.0))
    for context in (["a"], ["b", "a"], []):
        vocabulary = ["a", "b", "c", 0, "unknown"]
        assert math.isclose(sum(chance([*context, w], len(context), 0)[-1] for w in vocabulary), 1)


def test_held_out_text_is_more_likely_than_by_single_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    total = suffix_lm.scored(docs).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.avg((F.col("score") >= F.col("base_score")).cast("int"))).first()
    assert total[0] > 0.96 * total[1] and total[2] > 0.9
