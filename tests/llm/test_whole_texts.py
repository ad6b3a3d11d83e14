"""The classifier sees whole texts, and computes what plain loops compute."""

import math
import random

import numpy as np
from llm_rows import prose
from pyspark.sql import functions as F

from accesslens.llm import quality


def plain_probability(text, model, config):
    tables, chunks = model["tables"], quality.chunk_rows(text, config)
    responses = [
        [max(0.0, max(sum(float(tables[k][c[p + k]][f]) for k in range(config.width)) for p in range(config.chunk)) + float(model["bias"][f])) for f in range(config.filters)]
        for c in chunks
    ]
    total = float(model["base"][0])
    for f in range(config.filters):
        own = [r[f] for r in responses]
        total += sum(own) / len(own) * float(model["mean"][f]) + max(own) * float(model["max"][f])
    return 1 / (1 + math.exp(-total))


def test_scores_match_plain_loops():
    rng = np.random.default_rng(4)
    config = quality.ConvConfig(filters=3, width=3, chunk=20, overlap=5)
    model = {
        "tables": rng.normal(0, 0.5, (3, 256, 3)).astype(np.float32), "bias": rng.normal(0, 0.3, 3).astype(np.float32),
        "mean": rng.normal(0, 1, 3).astype(np.float32), "max": rng.normal(0, 1, 3).astype(np.float32), "base": np.array([0.1], np.float32),
    }
    texts = [b"", b"a", b"some words of a text", "zwölf Wörter, ñ".encode() * 9, bytes(range(256)) * 2]
    assert np.allclose(quality.probabilities(texts, model, config), [plain_probability(t, model, config) for t in texts], atol=1e-5)


def test_what_makes_a_long_text_bad_may_lie_anywhere(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(700):
        words = prose(rng, 700).split()
        bad = i % 2
        if bad:
            at = rng.randrange(len(words))
            words[at:at] = ["#@~%"] * 12
        rows.append((i, " ".join(words)))
        labels.append((i, 1 - bad))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    config = quality.ConvConfig(filters=8, width=4, chunk=256, overlap=32, sample=200, steps=300)
    out = quality.held_out_column()
    model = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"), out, config)
    scored = quality.score(docs.filter(out), model, config).select("row.doc_id", "score").collect()
    assert min(len(t) for _, t in rows) > 10 * 256
    assert sum((r.score >= 0.5) == (r.doc_id % 2 == 0) for r in scored) / len(scored) > 0.95


def test_the_sample_is_bounded_in_bytes(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.repeat(F.lit("good "), 40)).otherwise(F.repeat(F.lit("bad# "), 40)).alias("text"))
    labels = docs.select("doc_id", (1 - F.col("doc_id") % 2).cast("int").alias("quality"))
    config = quality.ConvConfig(filters=8, width=4, chunk=64, overlap=16, sample=500, sample_bytes=10_000, steps=100)
    model = quality.train(docs, labels, quality.held_out_column(), config)
    scored = quality.score(docs, model, config).select("row.doc_id", "score").collect()
    assert sum((r.score >= 0.5) == (r.doc_id % 2 == 0) for r in scored) / len(scored) > 0.95
