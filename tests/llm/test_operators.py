"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeated rows and empty tables."""

import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from lodestone.llm import byte_bpe, exact_dedup, html_extract, license_scan, line_dedup, media, near_dedup, packing, sharding, toxicity
from lodestone.llm._shared import shingle_set, word_hashes
from lodestone.llm.word_bpe import WordBpe

SCHEMA = "doc_id long, text string, kept string, id int, c int"
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def _docs(spark, texts, first=0):
    return spark.createDataFrame([(first + k, t, "x", 7, None) for k, t in enumerate(texts)], SCHEMA).repartition(3)


def _words(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta of the to it runs far 12 ü Été".split()) + str(rng.randint(0, 40)) for _ in range(n))


ODD = [None, "", " \n\t", "one", "The END", "the end", "x " * 5000, None, "", "same\nsame", "same\nsame"]


def test_word_hashes_follow_the_words():
    text = "Ab  ab\tÉa\x0bb\x1cc " + "z" * 300_000 + " end " + "q " * 200_000
    words = text.encode().lower().split()
    hashes, prefix = word_hashes(text, (2,))
    assert len(hashes) == len(words) and len(set(zip(words, hashes.tolist()))) == len(set(words)) == len(set(hashes.tolist()))
    assert len(set(prefix.tolist())) == len({w[:2] for w in words})
    assert len(word_hashes(None)[0]) == 0 == len(shingle_set(" ", 2)) and len(shingle_set("one", 2)) == 1


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("weak", [False, True])
def test_exact_duplicates(spark, keep, weak):
    options = {"content_hash": F.length} if weak else {}
    docs = _docs(spark, ODD).unionByName(_docs(spark, ["one", "eno"], 3))
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    groups = defaultdict(list)
    for d, t in rows:
        groups[t].append(d)
    pick = {"smallest": min, "largest": max}[keep]
    want = sorted((d, pick(groups[t]), len(groups[t]), d == pick(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for d, t in rows)
    assert sorted(map(tuple, exact_dedup.exact_duplicates(docs, keep=keep, **options).collect())) == want
    assert exact_dedup.exact_duplicates(docs.limit(0), **options).count() == 0


def test_lookup_table_is_even_and_stable():
    names = [f"shard-{k}" for k in range(13)]
    table = sharding.lookup_table(names, 1009)
    counts = np.bincount(table)
    assert counts.max() - counts.min() <= 1 and len(table) == 1009
    rest = sharding.lookup_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, rest) if a != 12)
    assert moved < 0.1 * 1009
    ranks = {k: [(int.from_bytes(hashlib.sha256(n.encode()).digest()[:8], "little") + i * (int.from_bytes(hashlib.sha256(n.encode()).digest()[8:16], "little") % 1008 + 1)) % 1009 for i in range(1009)] for k, n in enumerate(names)}
    want, left = {}, 0
    while len(want) < 1009:
        want[next(s for s in ranks[left] if s not in want)] = left
        left = (left + 1) % 13
    assert [want[s] for s in range(1009)] == table
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad)


def test_sharded(spark):
    docs = _docs(spark, ODD).unionByName(spark.createDataFrame([(None, "n", "", 1, 1)], SCHEMA))
    table = sharding.lookup_table([f"shard-{k}" for k in range(64)])
    for r in sharding.sharded(docs).collect():
        text = "" if r["doc_id"] is None else str(r["doc_id"])
        assert r["slot"] == int(hashlib.md5(text.encode()).hexdigest()[:8], 16) % 65537 and r["shard"] == table[r["slot"]]
    assert sharding.sharded(docs).count() == 12 and sharding.sharded(docs.limit(0)).count() == 0


def test_write_shards_with_clashing_names(spark, tmp_path):
    rows = [(k, f"t{k}", 9, "own") for k in range(200)] + [(None, None, None, None), (3, "again", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot int, shard string")
    name = sharding.write_shards(docs, str(tmp_path / "a"), shards=8, files=2)
    back = spark.read.parquet(str(tmp_path / "a"))
    want = {r["doc_id"]: r["shard"] for r in sharding.sharded(docs, shards=8).collect()}
    assert name == "_shard" and sorted(map(str, (tuple(r)[:4] for r in back.select("doc_id", "text", "slot", "shard").collect()))) == sorted(map(str, rows))
    assert all(r["_shard"] == want[r["doc_id"]] for r in back.collect())


def test_training_rows_are_bounded(spark):
    docs = spark.createDataFrame([(k, f"text {k} {j % 3}") for k in range(1, 30) for j in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 30)] * 3, "doc_id long, toxic int")
    seen = []
    fit = toxicity.ToxicityModel.fit
    try:
        toxicity.ToxicityModel.fit = lambda self, texts, y: seen.append(len(texts)) or self
        toxicity.train(docs, labels, max_rows=6)
    finally:
        toxicity.ToxicityModel.fit = fit
    assert seen == [6]


def test_toxicity(spark):
    rng = random.Random(5)
    texts = [_words(rng, 60) + (" badword" + rng.choice("xyz") if k % 4 == 0 else "") for k in range(400)]
    docs = _docs(spark, texts)
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    rows = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [k for k in rows if rows[k]["held_out"]]
    assert held == [k for k in rows if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([rows[k]["predicted"] == (k % 4 == 0) for k in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows.values())
    odd = toxicity.toxicity(_docs(spark, ODD), labels).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd)
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(not r["predicted"] for r in rows.values())
    assert toxicity.toxicity(docs.limit(0), labels.limit(0)).count() == 0


def test_toxicity_learns_from_every_labelled_row_and_its_whole_text(spark):
    """Counts hold more rows than a sample had, and words beyond its 20,000 characters; more shards and smaller blocks see them too."""
    rng = random.Random(8)
    late = lambda k: _words(rng, 20) + (" " + "pad " * 6000 if k % 50 == 0 else " ") + ("badword" if k % 3 == 0 else "good")
    docs = _docs(spark, [late(k) for k in range(9000)])
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(9000)], "doc_id long, toxic int")
    seen = []
    plant, learned = toxicity.ToxicityModel.plant, toxicity.ToxicityModel.average
    try:
        toxicity.ToxicityModel.plant = lambda self, counts, n1, n0: seen.append((int(counts.sum(axis=0).max()), n1 + n0)) or plant(self, counts, n1, n0)
        toxicity.ToxicityModel.average = lambda self, parts: seen.append((len(parts), sum(n for n, _, _ in parts))) or learned(self, parts)
        model = toxicity.train(docs, labels, shard_rows=1000, block_rows=300)
    finally:
        toxicity.ToxicityModel.plant, toxicity.ToxicityModel.average = plant, learned
    train = [k for k in range(9000) if zlib.crc32(str(k).encode()) % 5]
    (_, counted), (shards, stepped) = seen
    assert counted == stepped and 0.75 * len(train) < counted < 0.85 * len(train) and counted < len(train) and shards == -(-counted // 1000)
    # The mark at the end of texts of 24,000 characters is found as well.
    assert all((model.score(late(k)) >= 0.5) == (k % 3 == 0) for k in range(0, 600, 50))
    again = toxicity.train(docs.repartition(5), labels, shard_rows=1000, block_rows=300)
    assert (again.embedding == model.embedding).all() and (again.shift == model.shift).all()


def test_bitmap_of_labelled_ids_loses_none(spark):
    rows = spark.range(-20_000, 20_000).withColumnRenamed("id", "n").selectExpr("cast(n * 7919 as string) AS id", "n")
    known = rows.where("n % 3 = 0").select("id")
    left = {r["n"] for r in toxicity._perhaps(rows, known, page=64).collect()}
    wanted = {n for n in range(-20_000, 20_000) if n % 3 == 0}
    assert wanted <= left and len(left - wanted) < 4000 and toxicity._perhaps(rows, known.limit(0)).count() == 0


def test_chunks_of_a_long_text_make_one_pool(monkeypatch):
    model = toxicity.ToxicityModel()
    buckets, _ = toxicity.features(_words(random.Random(1), 3000))
    whole = model.pooled(buckets)
    monkeypatch.setattr(toxicity, "CHUNK", 100)
    part = model.pooled(buckets)
    assert np.allclose(whole[0], part[0], atol=1e-6) and (whole[1] == part[1]).all()


def _cosine(line, df, n):
    terms = license_scan.terms_of(line)
    idf = lambda t: np.log((1 + n) / (1 + df.get(t, 0))) + 1
    known, top, best = set(license_scan.vocabulary()), np.log(1 + n) + 1, (0.0, None)
    norm = np.sqrt(sum(idf(t) ** 2 if t in known else top**2 for t in terms))
    for name, sentences in license_scan.TEMPLATES.items():
        for s in map(license_scan.terms_of, sentences):
            cos = sum(idf(t) ** 2 for t in s & terms) / (norm * np.sqrt(sum(idf(t) ** 2 for t in s))) if terms else 0
            if round(cos, 9) > best[0]:
                best = round(cos, 9), name
    return best


def test_licences(spark):
    rng = random.Random(3)
    texts = [_words(rng, 30) + rng.choice(["", "\nReleased under the MIT License.", "\nAll rights reserved", "\nLicensed under the Apache License, Version 2.0"]) for _ in range(60)]
    paths = [f"r{k % 2}/d{k % 3}/{'LICENSE' if k in (4, 11) else k}" for k in range(60)] + [None, "LICENSE", "r9/x/y"]
    texts += [None, "Licensed under CC BY-NC 4.0.", ""]
    docs = spark.createDataFrame([(k, p, t, "own") for k, (p, t) in enumerate(zip(paths, texts))], "doc_id long, path string, text string, how string").repartition(4)
    df = defaultdict(int)
    for t in texts:
        for w in license_scan.terms_of(t or ""):
            df[w] += 1
    own = {k: max((_cosine(line, df, len(texts)) for line in (t or "").split("\n")), key=lambda b: b[0]) for k, t in enumerate(texts)}
    own = {k: b if b[0] >= license_scan.THRESHOLD else (None, None) for k, b in own.items()}
    files = {(paths[k] or "").rpartition("/")[0]: own[k][1] for k in (4, 11, 61) if own[k][1]}
    rows = {r["doc_id"]: r for r in license_scan.licences(docs, id_col="doc_id").collect()}
    assert len(rows) == 63
    for k, r in rows.items():
        if own[k][1]:
            assert (r["how"], r["licence"]) == ("own", own[k][1]) and abs(r["cosine"] - own[k][0]) < 1e-6
            continue
        at = (paths[k] or "").rpartition("/")[0]
        while at not in files and at:
            at = at.rpartition("/")[0]
        assert (r["how"], r["licence"], r["licence_dir"]) == ("inherited", files[at], at)
    assert license_scan.licences(docs.limit(0), id_col="doc_id").count() == 0


def test_licences_do_not_depend_on_the_number_of_rows(spark):
    lines = ["This file is released under the MIT License", "Released under the MIT License. See file.", "Copyright 2020 Acme. All rights reserved.", "the file is here and this is all", "nothing at all"]
    texts = [f"this file is here, see the end of 2020\n{lines[k % 10] if k % 10 < 5 else 'copyright of acme, see file'}" for k in range(40)]
    docs = spark.createDataFrame([(k, f"d{k}/x", t) for k, t in enumerate(texts)], "k long, path string, text string")
    n, got = len(texts), {}
    for times in (1, 100):
        many = docs.crossJoin(spark.range(times)).select((F.col("k") + 40 * F.col("id")).alias("doc_id"), F.concat_ws("/", "path", "id").alias("path"), "text")
        got[times] = defaultdict(set)
        for r in license_scan.licences(many, id_col="doc_id").collect():
            got[times][r["doc_id"] % 40].add((r["licence"], r["cosine"] and round(r["cosine"], 6)))
        df = defaultdict(int)
        for t in texts:
            for w in license_scan.terms_of(t):
                df[w] += times
        weight = lambda t: (np.log((1 + n * times) / (1 + df[t])) + 1) ** 2  # noqa: E731, B023
        for k, t in enumerate(texts):
            best = 0.0
            for terms in map(license_scan.terms_of, t.split("\n")):
                for s in map(license_scan.terms_of, (x for y in license_scan.TEMPLATES.values() for x in y)):
                    best = max(best, sum(map(weight, s & terms)) / np.sqrt(sum(map(weight, s)) * sum(map(weight, terms))))
            assert {c for _, c in got[times][k]} == {round(best, 6) if best >= license_scan.THRESHOLD else None}
    names = {times: [{a for a, _ in got[times][k]} for k in range(40)] for times in got}
    assert names[1] == names[100] and names[1][:5] == [{"MIT"}, {"MIT"}, {"Proprietary"}, {None}, {None}]


def _prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_lines(spark):
    rng = random.Random(9)
    shared = [_prose(rng, 55), "Posted on day 12 by user 44", "short one"]
    texts = [f"{_prose(rng, 20)}\n" + "\n".join(shared if k % 2 else shared[2:]).replace("12", str(k)) + f"\n{_prose(rng, 12)}" for k in range(12)] + ODD
    docs = _docs(spark, texts)
    rows = {r["doc_id"]: r for r in line_dedup.without_recurring_lines(docs, counts=True).collect()}
    assert len(rows) == len(texts)
    for k in range(12):
        lines = rows[k]["text"].split("\n")
        assert lines[0] == texts[k].split("\n")[0] and lines[-1] == texts[k].split("\n")[-1] and "short one" in lines
        assert rows[k]["n_dropped"] == (2 if k % 2 and k > 1 else 0)
    for k, t in enumerate(ODD, 12):
        assert rows[k]["text"] == t
    out = line_dedup.without_recurring_lines(docs)
    assert out.columns == docs.columns and out.count() == len(texts)
    copies = _docs(spark, ["a b c d\ne f g h"] * 4)
    assert [r["doc_id"] for r in line_dedup.without_recurring_lines(copies, drop_emptied=True).collect()] == [0]
    assert line_dedup.without_recurring_lines(docs.limit(0)).count() == 0


def test_lines_of_interleaved_families(spark):
    names = "ann bob cid dot eve fay gus hal ida joe kim lee mia ned ola pia".split()
    family = ["Welcome to our forum dear friend {} read all rules here", "Welcome to our shop where the {} is always on sale"]
    texts = ["Welcome to our shop for all items that cost less today"] + [family[k % 2].format(name) for k, name in enumerate(names)]
    rows = {r["doc_id"]: r for r in line_dedup.without_recurring_lines(_docs(spark, texts), counts=True).collect()}
    assert [rows[k]["n_dropped"] for k in range(len(texts))] == [0, 0, 0] + [1] * 14


def test_lines_alike_in_a_few_places_are_not_one_template(spark):
    rng = random.Random(21)
    line = lambda: " ".join(["see", "the", "list", *(t if k % 5 == 1 else _prose(rng, 1) + "x" * (k % 3) for k, t in enumerate(["same"] * 37))])
    texts = [line() for _ in range(5)]
    assert all(r["n_dropped"] == 0 for r in line_dedup.without_recurring_lines(_docs(spark, texts), counts=True).collect())


@pytest.mark.parametrize("at", [4, 9])
def test_five_families_of_one_leaf(spark, at):
    rng, texts = random.Random(22), []
    families = [["one", "of", "our", *_prose(rng, 7).split()] for _ in range(5)]
    for k in range(40):
        line = list(families[k % 5])
        line[at] = f"name{'abcdefgh'[k // 5]}"
        texts.append(" ".join(line))
    rows = {r["doc_id"]: r["n_dropped"] for r in line_dedup.without_recurring_lines(_docs(spark, texts), counts=True).collect()}
    assert [rows[k] for k in range(40)] == [0] * 5 + [1] * 35


def test_a_document_counts_once_for_a_template(spark):
    texts = ["welcome to this nice place ann\nwelcome to this nice place bob", "welcome to this nice place cid"]
    assert all(r["n_dropped"] == 0 for r in line_dedup.without_recurring_lines(_docs(spark, texts), counts=True).collect())
    rows = {r["doc_id"]: r["n_dropped"] for r in line_dedup.without_recurring_lines(_docs(spark, [*texts, "welcome to this nice place dee"]), counts=True).collect()}
    assert rows == {0: 0, 1: 1, 2: 1}


def _parts(tokens):
    n = len(tokens)
    if n < 8:
        return [tokens[int(n * (2 * k + 1) / 16)] for k in range(8)]
    return [tuple(tokens[n * k // 8 : n * (k + 1) // 8]) for k in range(8)]


def test_templates_against_going_through_the_lines_in_order(spark):
    rng, lines = random.Random(23), []
    for _ in range(12):
        base = ["a", "b", "c", *(rng.choice("pqrstu") for _ in range(rng.choice([1, 2, 4, 7, 12, 20])))]
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randint(0, len(copy) // 3)):
                copy[rng.randrange(3, len(copy))] = rng.choice("pqrstuvwxyz")
            lines.append(" ".join(copy))
    lines = list(dict.fromkeys(lines))
    docs = spark.createDataFrame(list(enumerate(lines)), "id long, text string").withColumn("doc", F.xxhash64("text"))
    known = line_dedup._lines(docs, 3, 3).withColumnRenamed("id", "owner").drop("doc").cache()
    number = {bytes(r["key"]): r["owner"] for r in known.collect()}
    got = {number[bytes(r["key"])]: number[bytes(r["template"])] for r in line_dedup._variants(known, 6).collect()}
    want, seeds = {}, []
    for k, tokens in enumerate(x.split() for x in lines):
        fits = [s for s in seeds if len(tokens) == len(lines[s].split()) and sum(x == y for x, y in zip(_parts(tokens), _parts(lines[s].split()))) >= 6]
        if fits:
            want[k] = fits[0]
        else:
            seeds.append(k)
    assert len(want) > 30 and got == want


RANKS = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_byte_bpe(spark):
    rng = random.Random(2)
    bpe = byte_bpe.ByteBpe(RANKS, public_tokenizers.PATTERN)
    parts = ["a", "the", "ing", " ", "  ", "\n", "é", "中", "😀", "0", "'s", "!", "aaaa", "=="]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))
        assert bpe.encode(text) == TIKTOKEN.encode_ordinary(text) and bpe.decode(bpe.encode(text)) == text.encode()
    for text in ("a" * 3000, "=" * 3000, "ab" * 2000):
        assert bpe.encode(text) == TIKTOKEN.encode_ordinary(text)
        a, b = bpe.piece(text[:999].encode()), bpe.piece(text[999:].encode())
        assert bpe.join(a, b) == bpe.piece(text.encode()) and bpe.join((), a) == a == bpe.join(a, ())
    docs = _docs(spark, ODD)
    for r in byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect():
        text = ODD[r["doc_id"]] or ""
        ids = TIKTOKEN.encode_ordinary(text)
        assert (r["n_tokens"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(text.encode()).hexdigest())
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_word_bpe_reads_added_tokens_as_the_library():
    bpe = WordBpe(WORD_BPE)
    for text in ("see <|endoftext|> here", "<|startoftext|>", "a<|EndOfText|>b", "<|endoftext", "é <|endoftext|> ü"):
        assert bpe.ids(text).tolist() == bpe.whole.encode(text, add_special_tokens=False).ids
    assert 49407 in bpe.ids("see <|endoftext|> here")


def test_word_bpe_is_the_library():
    rng = random.Random(4)
    bpe = WordBpe(WORD_BPE)
    letters = "abcdefghijklmnopqrstuvwxyzABCÀÉßÿ'’0123456789²½ªµ.,!?-_()$€\n\t  ĀžſƏŊ\xa0\x85\x01İΣς中"
    for _ in range(4000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        assert bpe.ids(text).tolist() == bpe.whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("shard_tokens", [600, 1 << 22])
def test_packing(spark, shard_tokens):
    rng = random.Random(6)
    texts = [_words(rng, rng.choice([3, 40, 200, 1500])) for _ in range(40)] + ODD
    bpe = WordBpe(WORD_BPE)
    rows = packing.pack(_docs(spark, texts), WORD_BPE, window=256, shard_tokens=shard_tokens).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for k, t in enumerate(texts):
        ids, at = [*bpe.ids(t or "").tolist(), 1], 0
        for r in sorted(pieces[k], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == packing.crc(np.array(ids[at : at + r["length"]]))
            at += r["length"]
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256 and at & (at - 1) == 0
    assert packing.pack(_docs(spark, []), WORD_BPE).count() == 0


def test_index_scores_are_bm25():
    rng = np.random.default_rng(1)
    tails = [rng.integers(0, 30, rng.integers(3, 40)).astype(np.uint16) for _ in range(20)]
    idf = rng.random(30).astype(np.float32) + 0.1
    shard = packing.Shard(tails, idf, 20.0)
    want = np.zeros(20)
    for d, tail in enumerate(tails):
        for t in set(tails[0].tolist()):
            tf = int((tail == t).sum())
            want[d] += idf[t] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(tail) / 20.0))
    unused = np.ones(20, bool)
    unused[0] = False
    got = shard.neighbours(0, unused)
    best = [d for d in np.lexsort((np.arange(20), -want)).tolist() if d and want[d] > 0]
    assert got.tolist() == best and np.allclose(shard.scores(0), want, rtol=1e-5)


def _filled(tails, idf, average, window):
    """packing.fill by sorting all scores anew for each seed."""

    def score(a, b):
        tf = np.bincount(tails[b], minlength=len(idf))
        return sum(float(idf[t]) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(tails[b]) / average)) for t in set(tails[a].tolist()))

    left, out, room, seed = list(range(len(tails))), [], 0, None
    while left or seed:
        if seed is None:
            seed = (left.pop(0), 0)
        line = [seed] + [(d, 0) for d in sorted((d for d in left if score(seed[0], d) > 1e-9), key=lambda d: -score(seed[0], d))]
        seed = None
        for doc, at in line:
            if doc in left:
                left.remove(doc)
            if not room:
                out.append([])
                room = window
            take = min(room, len(tails[doc]) - at)
            out[-1].append((doc, at, at + take))
            room -= take
            if not room:
                seed = (doc, at + take) if at + take < len(tails[doc]) else None
                break
    return out


def test_windows_are_filled_as_by_brute_force():
    rng = np.random.default_rng(7)
    tails = [rng.zipf(1.3, rng.integers(2, 90)).clip(1, 199).astype(np.uint16) for _ in range(150)]
    idf = (rng.random(200) + 0.1).astype(np.float32)
    want = _filled(tails, idf, 40.0, 256)
    got = list(packing.fill(tails, idf, 40.0, 256))
    full = [s for s in want if sum(b - a for _, a, b in s) == 256]
    assert len(full) > 10 and got[: len(full)] == full


@pytest.mark.parametrize("used", [0, 60])
def test_neighbours_of_long_tails_are_those_of_full_bm25(used):
    rng = np.random.default_rng(2)
    tails = [rng.zipf(1.2, rng.integers(100, 600)).clip(1, 899).astype(np.uint16) for _ in range(90)]
    df = np.bincount(np.concatenate([np.unique(t) for t in tails]), minlength=900)
    idf = np.log1p((90 - df + 0.5) / (df + 0.5)).astype(np.float32)
    shard = packing.Shard(tails, idf, 300.0)
    unused = np.arange(90) >= used
    for seed in (0, 70, 89):
        terms = set(tails[seed].tolist())
        assert len(terms) > 40
        unused[seed] = False
        want = {}
        for d in np.flatnonzero(unused).tolist():
            tf = np.bincount(tails[d], minlength=900)
            want[d] = sum(float(idf[t]) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(tails[d]) / 300.0)) for t in terms)
        got = shard.neighbours(seed, unused).tolist()
        best = sorted(want, key=lambda d: -want[d])[: packing.NEIGHBOURS]
        assert len(got) == len(best) and np.allclose([want[d] for d in got], [want[d] for d in best], rtol=1e-5)


def _brute_components(texts, shingle, percent=80):
    sets = {k: set(shingle_set(t, shingle).tolist()) for k, t in texts.items()}
    parent = {k: k for k in texts}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in texts:
        for b in texts:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and 100 * both >= percent * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {k: root(k) for k in texts}, {k: len(s) for k, s in sets.items()}


@pytest.mark.parametrize("shingle", [2, 5])
def test_near_duplicates(spark, shingle):
    rng = random.Random(8)
    texts = list(ODD)
    for _ in range(8):
        base = _words(rng, 150).split()
        for _ in range(rng.randint(1, 14)):
            copy = list(base)
            for _ in range(rng.randint(0, 14)):
                copy[rng.randrange(len(copy))] = f"edit{rng.randint(0, 99)}"
            texts.append(" ".join(copy))
    docs = _docs(spark, texts).unionByName(spark.createDataFrame([(None, texts[-1], "", 1, 1)], SCHEMA))
    want, sizes = _brute_components(dict(enumerate(texts)), shingle)
    rows = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs, shingle=shingle).collect()}
    assert len(rows) == len(texts) + 1 and rows[None]["component_id"] is None or rows[None]["kept"]
    for k in want:
        assert (rows[k]["component_id"], rows[k]["n_shingles"], rows[k]["kept"]) == (want[k], sizes[k], want[k] == k)
    stay = near_dedup.without_near_duplicates(docs, shingle=shingle)
    assert stay.columns == docs.columns and {r["doc_id"] for r in stay.collect()} - {None} == {k for k in want if want[k] == k}
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_texts_that_share_an_id_lose_no_link(spark):
    rng = random.Random(31)
    a, b = _words(rng, 80), _words(rng, 80)
    docs = spark.createDataFrame([(1, a), (1, b), (2, a + " end"), (3, b + " end"), (4, _words(rng, 80))], "doc_id long, text string")
    rows = [(r["doc_id"], r["component_id"]) for r in near_dedup.near_duplicates(docs).collect()]
    assert sorted(rows) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


def test_prefix_join_loses_no_pair(spark):
    rng = random.Random(12)
    base = _words(rng, 120).split()
    texts = {}
    for k in range(40):
        copy = list(base)
        for _ in range(rng.randint(0, 25)):
            copy[rng.randrange(len(copy))] = f"edit{rng.randint(0, 30)}"
        texts[k] = " ".join(copy)
    docs = spark.createDataFrame([(k, k % 7, t) for k, t in texts.items()], "id long, c long, text string")
    got = {(r["u"], r["v"]) for r in near_dedup._prefix_pairs(docs, 2, 80).collect()}
    sets = {k: shingle_set(t, 2) for k, t in texts.items()}
    want = {(a, b) for a in texts for b in texts if a < b and a % 7 != b % 7 and near_dedup.similar(sets[a], sets[b], 80)}
    assert want and want <= got


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><header><a href=/>Site</a></header><nav><ul><li><a>Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><main><article><h1>A &amp; B</h1><p>First&nbsp; paragraph<br>goes <b>on</b>.<p>Le.
<script>var x = "</p>";</script></p><div class="share"><a>Share</a></div><ul><li>Point one here</li></ul></article>
<section id="comments"><p>I liked this a lot, thank you very much for it.</p></section></main><aside><p>More things to read</p></aside>
<form><label>Mail</label><input><button>Go</button></form><footer>&copy; us</footer></body></html>"""


def test_html(spark):
    want = "A & B\nFirst paragraph goes on.\nLe.\nPoint one here"
    assert html_extract.main_text(PAGE) == want
    pages = spark.createDataFrame([(1, "u", PAGE, "a"), (2, None, None, "b"), (3, "w", "", "c"), (None, "x", "<p>unclosed <b", "d"), (1, "u", PAGE, "a"), (5, "y", "<article>" + "<p>word word.</p>" * 3000, "e")], "page_id long, url string, html string, text string")
    rows = {r["url"]: r for r in html_extract.extracted(pages).collect()}
    assert rows["u"]["text"] == want and rows["u"]["n_chars"] == len(want) and rows[None]["text"] == "" == rows["w"]["text"]
    assert rows["y"]["text"] == "\n".join(["word word."] * 3000)
    assert html_extract.extracted(pages.limit(0)).count() == 0


TITLE, FIRST, SECOND = "Title here", "First paragraph of some length, with words.", "Second paragraph of some length too."
ARTICLE = f"<h1>{TITLE}</h1><p>{FIRST}</p><p>{SECOND}</p>"
NAV = "<nav><ul><li><a href=/>Home</a></li><li><a>About us</a></li></ul></nav>"
FOOT = "<footer><p>&copy; 2020 Site. All rights reserved.</p></footer>"
SIDE = "<div class='sidebar'><h3>More</h3><p>Some more long text here in the sidebar, which says things.</p></div>"
LABELLED = {
    "a class that denies": f"{NAV}<article class='post no-sidebar'>{ARTICLE}</article>{FOOT}",
    "a class that tells a state": f"{NAV}<article class='post comments-open'>{ARTICLE}</article>{FOOT}",
    "a wrapper with a sidebar": f"{NAV}<div class='has-sidebar'><main>{ARTICLE}</main>{SIDE}</div>{FOOT}",
    "a form around the page": f"<form id='aspnetForm'>{NAV}<div>{ARTICLE}</div>{SIDE}{FOOT}</form>",
    "a header in an article": f"{NAV}<article><div class='article-header'><h1>{TITLE}</h1></div><p>{FIRST}</p><p>{SECOND}</p></article>{FOOT}",
    "nested objects": f"{NAV}<article>{ARTICLE}<object>a<object>b</object>fallback</object></article>{FOOT}",
    "a stray quote": f'{NAV}<article><h1>{TITLE}</h1><p class="a>{FIRST}</p><p class="b">{SECOND}</p></article>{FOOT}',
    "a quote that never closes": f'{NAV}<article><h1>{TITLE}</h1><p class="a>{FIRST}</p><p>{SECOND}</p></article><footer><p>x</p></footer>',
    "a tag end in a value": f'{NAV}<article><h1 title="a > b">{TITLE}</h1><p>{FIRST}</p><p>{SECOND}</p></article>{FOOT}',
    "comments that are articles": f"{NAV}<div id='content'><article>{ARTICLE}</article><section class='comments-area'><article class='comment'><p>I liked this very much, it was great reading.</p></article></section></div>{FOOT}",
    "articles in an aside": f"{NAV}<main>{ARTICLE}</main><aside><article><h3>Rel</h3><p>Related thing with a longer text here to read.</p></article></aside>{FOOT}",
    "no names at all": f"{NAV}<div><div>{ARTICLE}</div></div>{SIDE}{FOOT}",
    "open elements": f"{NAV}<article><h1>{TITLE}</h1><p><b>{FIRST}<br><p>{SECOND}</article>{FOOT}",
}


@pytest.mark.parametrize("name", LABELLED)
def test_html_of_labelled_pages(name):
    assert html_extract.main_text(f"<html><body>{LABELLED[name]}</body></html>") == f"{TITLE}\n{FIRST}\n{SECOND}"


def test_the_cut_decides_beyond_each_blocks_own_cost():
    short = "<article><h1>A</h1>" + "<p>Le.</p>" * 300 + "<p>It.</p></article>"
    assert len(html_extract.content_blocks(short)) == 302
    blocks = html_extract.read(PAGE).blocks
    own = [b.text for b, c in zip(blocks, html_extract.own_costs(blocks)) if c > 0]
    assert own != [b.text for b in html_extract.content_blocks(PAGE)]
    assert html_extract.main_text("<article><p>Let <math><mi>x</mi></math> be given.</p></article>") == "Let x be given."


def test_reading_is_linear():
    import time

    for part in ('<p class="a>x ', "<p class='a>x \"y ", "<div>x", "<div><p>x</b></i></p>", "<nav><article>x"):
        began = time.time()
        html_extract.main_text(part * 20_000)
        assert time.time() - began < 20


def test_minimum_cut_is_minimal():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(1, 8)
        excess = [rng.randint(-5, 5) for _ in range(n)]
        edges = [(a, b, rng.randint(1, 3)) for a in range(n) for b in range(a) if rng.random() < 0.4]
        cost = lambda side: sum(e for k, e in enumerate(excess) if e > 0 and not side[k]) + sum(-e for k, e in enumerate(excess) if e < 0 and side[k]) + sum(c for a, b, c in edges if side[a] != side[b])  # noqa: E731, B023
        best = min(cost([bool(m >> k & 1) for k in range(n)]) for m in range(1 << n))
        assert cost(html_extract.minimum_cut(excess, edges)) == best


def test_image_copies(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(30, 64))
    vectors[7] = vectors[3]
    vectors[9] = vectors[4] + rng.normal(scale=0.02, size=64)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)] + [(30, None)], "vec_id long, embedding array<float>")
    images = media.rendered(df).unionByName(spark.createDataFrame([(31, bytearray(b"junk")), (None, None)], "id long, image binary"))
    asked = media.rendered(df.where("vec_id IN (3, 4, 7, 12, 30)"), cropped=True)
    rows = media.image_copies(images, asked).collect()
    pairs = {(r["query_id"], r["class_id"]) for r in rows if r["kind"] == "pair"}
    members = {r["query_id"]: r["class_id"] for r in rows if r["kind"] == "member"}
    assert members[7] == 3 and members[9] == 4 and members[12] == 12
    assert pairs == {(3, 3), (4, 4), (12, 12)}
    assert media.image_copies(images.limit(0), asked.limit(0)).count() == 0


def test_corners_grow_with_the_picture_and_resized_crops_agree():
    rng = np.random.default_rng(4)

    def picture(side):
        return sum(media._box(np.kron(rng.integers(0, 256, (side // n, side // n)), np.ones((n, n))), n // 2) for n in (4, 8, 16, 32)).astype(np.float32) / 4

    large = picture(512)
    many = media.descriptors(large)
    assert len(many) > 5 * media.CORNERS

    def agreement(a, b):
        row = lambda d, q: {f"{q}{k}": [x[n] for x in d] for n, k in enumerate(("x", "y", "scale", "angle", "bits"))}
        return media._compared(type("Pair", (), row(a, "") | row(b, "q"))())

    crop = large[200:330, 300:430]
    half = large.reshape(256, 2, 256, 2).mean(axis=(1, 3))
    assert agreement(many, media.descriptors(crop)) >= media.LEAST
    assert agreement(many, media.descriptors(half[100:200, 100:200])) >= media.LEAST
    assert agreement(many, media.descriptors(picture(160))) < media.LEAST


def test_png_and_pgm_decode():
    import struct

    grey = np.arange(35, dtype=np.uint8).reshape(5, 7)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    raw = b"".join(bytes([1]) + np.diff(line, prepend=0).astype(np.uint8).tobytes() for line in grey)
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 5, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    assert (media.decode_image(png) == grey).all() and (media.decode_image(media.encode_image(grey)) == grey).all()
    assert media.decode_image(None) is None and media.decode_image(png[:30]) is None and media.descriptors(None) == []


def test_base64_ranks_cover_all_bytes():
    assert all(bytes([b]) in RANKS for b in range(256)) and base64.b64encode(b"a")
