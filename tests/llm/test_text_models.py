import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_rows import prose, row, words
from pyspark.sql import functions as F

from accesslens.llm import maxent, pii, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _tag string, row int, kept string, score double, `a.b` string, _text int, shard string"
SMALL = quality.ConvConfig(filters=8, width=4, chunk=256, overlap=32, sample=200, steps=300)


def held(i, n, k):
    return zlib.crc32(("" if i is None else str(i)).encode()) % n == k


@pytest.fixture(scope="module")
def marked(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        text, good = prose(rng, rng.randint(20, 120)), i % 3 > 0
        if not good:
            text = prose(rng, rng.randint(20, 400)) + " " + " ".join(w + "$%&" for w in text.split())
        rows.append(row(i, text))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifier_learns_what_it_never_saw(marked):
    docs, labels = marked
    out = quality.held_out_column()
    model = quality.train(docs, labels, out, SMALL)
    scored = quality.score(docs, model, SMALL).select("row.doc_id", "row.kept", "score").filter(out).collect()
    right = [(r.score >= 0.5) == (r.doc_id % 3 > 0) for r in scored]
    assert len(right) > 80 and sum(right) / len(right) > 0.95
    assert quality.keep_good(docs, model, SMALL).columns == docs.columns


def test_scores_of_awkward_texts(marked, hostile, empty):
    docs, labels = marked
    model = quality.train(docs, labels.union(labels.limit(1)).union(labels.selectExpr("cast(null as long)", "cast(null as int)", "0").limit(1)), quality.held_out_column(), SMALL)
    scores = [r.score for r in quality.score(hostile, model, SMALL).collect()]
    assert len(scores) == hostile.count() and all(0 <= s <= 1 for s in scores)
    assert quality.score(empty, model, SMALL).count() == 0
    none = quality.train(hostile, labels.limit(0), quality.held_out_column(), SMALL)
    assert none == 0.5 and {r.score for r in quality.score(hostile, none, SMALL).collect()} == {0.5}
    assert quality.train(docs, labels.filter("quality = 1"), quality.held_out_column(), SMALL) == 1.0


def test_chunks_cover_every_byte():
    config = quality.ConvConfig(chunk=10, overlap=3)
    for n in range(0, 60):
        starts = list(quality.chunk_starts(n, config))
        assert set(range(n)) <= {s + k for s in starts for k in range(10)}


def test_base_scores_match_counting(hostile, hostile_rows):
    out = quality.held_out_column(7, 2)
    model, rest = maxent.train(hostile, out, maxent.MaxentConfig(head=64))
    rows = maxent.score(hostile, model, rest, out).collect()
    tokens = [(r[0], words(r[1]) + [None]) for r in hostile_rows]
    count = Counter(t for i, own in tokens if not held(i, 7, 2) for t in own)
    n, v = sum(count.values()), len(count)
    wanted = sorted((repr(i), held(i, 7, 2), len(own), sum(count[t] > 0 for t in own), n, round(sum(math.log10((count[t] + 1) / (n + v + 1)) for t in own), 6)) for i, own in tokens)
    assert sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == wanted
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)


def test_model_beats_the_base_on_unseen_texts(spark):
    rng = random.Random(3)
    # which words follow depends on the topic, so the last word tells much
    topics = [[f"{c}{k}{c}" for k in range(30)] for c in "abcdefgh"]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(topics[i % 8]) for _ in range(300))) for i in range(240)], "doc_id long, text string")
    out = quality.held_out_column(7, 2)
    model, rest = maxent.train(docs, out)
    total = maxent.score(docs, model, rest, out).filter("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert total[0] / total[2] > total[1] / total[2] + 0.15


def test_model_probabilities_add_up():
    config = maxent.MaxentConfig(classes=4, bits=4)
    rng = np.random.default_rng(1)
    weights = rng.normal(size=(3, 16, 4)).astype(np.float32)
    odds = maxent.class_odds(np.zeros(4, np.float32), weights, rng.integers(0, 16, (3, 50)).astype(np.uint16))
    assert np.allclose(np.exp(odds).sum(axis=1), 1, atol=1e-5)
    tokens, kinds, counts = maxent.tokens_of([b"", b"One two  ONE", b"\xc3\xa9 x"], config)
    assert counts.tolist() == [1, 4, 3] and tokens[1] == tokens[3] and kinds[0] == 0 and kinds[4] == 0


def test_maxent_without_rows(empty, spark):
    out = quality.held_out_column(7, 2)
    model, rest = maxent.train(empty, out)
    assert maxent.score(empty, model, rest, out).count() == 0
    one = spark.createDataFrame([(1, "never seen")], "doc_id long, text string")
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in maxent.score(one, model, rest, out).collect()] == [(3, 0, 0)]


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in doubled) % 10 == 0


def brute(text):
    found = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")) or kind == "card" and 16 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 8 <= len(digits) <= 15:
                found.append((kind, *m.span()))
    return found


def test_base_spans_equal_plain_scanning():
    rng = random.Random(5)
    for _ in range(20000):
        text = "".join(rng.choice(["a", "@", ".", "-", "1", "255", "256", " ", "+", "(", "é", "_", "4111111111111111", "b.c"]) for _ in range(rng.randint(0, 25)))
        assert pii.base_spans(text)[0] == brute(text), text


def test_long_texts_take_linear_time():
    for unit in ("1", "a", "1.", "+1 ", "a@", "1-", " at ", "ab:"):
        text = unit * (400_000 // len(unit))
        base, runs = pii.base_spans(text)
        pii.loose_spans(text, base, runs)


def test_spans_keep_the_base_and_add_likely_ones(spark, hostile, hostile_rows, empty):
    rng = random.Random(6)
    rows = [row(i, f"{prose(rng, 5)} tel +1 (389) 555-{rng.randint(1000, 9999)} {prose(rng, 5)}") for i in range(60)]
    rows += [row(1000 + i, f"{prose(rng, 5)} phone (389) 555-{rng.randint(1000, 9999)} x") for i in range(20)]
    docs = spark.createDataFrame(rows + hostile_rows, SCHEMA)
    out = pii.personal_data(docs).collect()
    texts = Counter((r[0], str(sorted(brute(r[1])))) for r in rows + hostile_rows)
    assert Counter((r.doc_id, str(sorted((s.kind, s.start, s.end) for s in r.spans if s.base))) for r in out) == texts
    added = [r.doc_id for r in out if any(not s.base for s in r.spans)]
    assert sum(i is not None and i >= 1000 for i in added) == 20
    assert pii.personal_data(empty).count() == 0
    assert {len(r.spans) for r in pii.personal_data(docs.filter("doc_id = 16 AND n_chars = 1 AND text LIKE 'xxx%'")).collect()} == {0}
