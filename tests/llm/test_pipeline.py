"""The pipeline's stages on small tables, each against a brute-force version or the operator's own verdicts."""

import random
from collections import defaultdict

import corpus_pipeline
from lodestone.llm import queries, toxicity
from lodestone.llm._shared import shingle_set
from lodestone.llm.word_bpe import WordBpe

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def _tables(spark, folder):
    rng, texts = random.Random(3), []
    passage = _prose(rng, 60)
    for k in range(60):
        text = _prose(rng, 40) + (" badword" if k % 5 == 0 else "")
        texts.append(text + (f"\n{passage}" if k % 3 == 0 else ""))
    texts += [texts[1], texts[2] + " end", None, "", passage]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)] + [(None, _prose(rng, 30), None, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, k % 2, int(k % 5 == 0)) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows, passage


def test_stages_on_small_tables(spark, tmp_path):
    rows, passage = _tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    seen = {None: docs}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen[list(seen)[-1]], str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
            out = spark.createDataFrame(out.collect(), docs.schema)
        seen[name] = out
    key = lambda r: (r["doc_id"], r["text"])
    bad = {r["doc_id"] for r in toxicity.toxicity(docs, labels).collect() if r["predicted"]}
    assert {key(r) for r in seen["toxicity"].collect()} == {r[:2] for r in rows if r[0] not in bad} and bad
    held = sorted(r["doc_id"] for r in seen["toxicity"].collect() if passage in (r["text"] or ""))
    lines = {r["doc_id"]: r["text"] for r in seen["line_dedup"].collect()}
    assert [d for d, t in lines.items() if passage in (t or "")] == held[:1] and 64 not in lines and lines[62] is None and lines[63] == ""
    sets = {d: set(shingle_set(t, 5).tolist()) for d, t in lines.items() if d is not None}
    gone = {b for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    kept = {r["doc_id"]: r["text"] for r in seen["near_dedup"].collect()}
    assert gone and set(kept) == set(lines) - gone
    bpe, pieces = WordBpe(queries.word_bpe_path()), defaultdict(int)
    for r in seen["packing"].collect():
        pieces[r["doc_id"]] += r["length"]
    assert pieces == {d: len(bpe.ids(t or "")) + 1 for d, t in kept.items()}
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or -1, r["start"], r["length"]) for r in again)[0][1] == 0 and sum(r["length"] for r in again) == sum(pieces.values())


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
