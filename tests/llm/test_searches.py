"""Phrases, vector search and lexical search against plain versions."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_rows import UP

from accesslens.llm import lexical, phrases, vectors
from accesslens.llm.lexical import LexicalConfig
from accesslens.llm.phrases import PhraseConfig, collocations
from accesslens.llm.vectors import SearchConfig, top_k

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_phrases(rows, longest, least, top):
    counts = defaultdict(Counter)
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UP)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                counts["und" if lang is None else lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        candidates = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        inside = Counter()
        for p, c in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], c)
        found = []
        for p, a in candidates.items():
            score, _, l, r = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            if 100 * inside[p] < 50 * a:
                found.append((-score, -a, " ".join(p).encode(), l, r))
        found.sort()
        out += [(lang, i, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(found[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def chatter():
    rng = random.Random(8)
    words = ["alpha", "Beta", "gämma", "delta.", "of", "the", "THE,", "x", "New", "York", "City", "中文", "a b", "z" * 70]
    rows = [(" ".join(rng.choice(words) + rng.choice(["", "", "", "\t", "  ", "\n", "!"]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None, "und", ""])) for _ in range(200)]
    return rows + [(None, "en"), ("", None), (" \t ", "en"), ("the the the the the the", "de"), ("new york city " * 400, "en"), rows[0], rows[0]]


@pytest.mark.parametrize("config", [PhraseConfig(), PhraseConfig(longest=4, least=3, top=40, budget=50, held=200), PhraseConfig(longest=2, least=1, budget=5)])
def test_phrases_match_plain_counts(spark, chatter, config):
    docs = spark.createDataFrame([(i, t, lang, "x") for i, (t, lang) in enumerate(chatter)], "doc_id long, text string, lang string, word string").repartition(3)
    out = collocations(docs, config).collect()
    assert sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in out) == plain_phrases(chatter, config.longest, config.least, config.top)


def test_phrases_run_on_across_the_parts_of_a_long_text(monkeypatch):
    text = b"one two\tthree four.  five \n" + b" " * 50 + b"six seven eight nine, ten " * 5
    langs = np.array([7], np.uint64)

    def found(size):
        monkeypatch.setattr(phrases, "PIECE", size)
        out = Counter()
        for _, _, _, key, opens, seen in phrases.scanned([text], langs, 1, 3):
            for k in (1, 2, 3):
                at = phrases.suffixes(key, opens, k)
                at = at[seen[at + k - 1] >= 0]
                out.update(tuple(key[at[i] : at[i] + k].tolist()) for i in range(len(at)))
        return out

    assert found(10) == found(33) == found(10_000)


def test_phrases_of_a_heavy_prefix_take_several_groups(spark):
    rows = [(f"hot {i % 97} {i % 13}. hot hot hot {i % 7}", "en") for i in range(3000)]
    config = PhraseConfig(least=5, budget=400, held=500)
    docs = spark.createDataFrame(rows, "text string, lang string")
    words, _ = phrases.count_words(docs, config)
    groups = phrases.vertical_groups(words, config)
    assert len(groups.heavy[0]) >= 1 and groups.extra > 10
    out = collocations(docs, config).collect()
    assert sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in out) == plain_phrases(rows, 3, 5, 2000)


def plain_top(rows, k=5, every=50):
    own = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, x) in enumerate(own):
        if q is None or q % every:
            continue
        ranked = sorted((-sum(s * t for s, t in zip(x, y, strict=True)), i is None, i or 0) for b, (i, y) in enumerate(own) if a != b and len(x) == len(y))
        out += [(q, r, None if null else i, -s) for r, (s, null, i) in enumerate(ranked[:k], 1)]
    return sorted(out, key=repr)


def vector_rows():
    rng = random.Random(2)
    rows = [(i, [round(rng.gauss(0, 0.3), 3) for _ in range(12)]) for i in range(400)]
    ties = [(1000 + i, [0.5] * 12) for i in range(30)]
    odd = [(50, None), (100, [0.1, None]), (150, [float("nan")] * 12), (200, [float("inf")] + [0.0] * 11), (None, [0.9] * 12), (2000, [1.0, 2.0]), (2001, [3.0, -1.0]), (2050, []), (3000, [1000.0] * 12), (250, [0.2] * 12)]
    return rows + ties + odd + [rows[7], rows[100]]


@pytest.mark.parametrize("config", [SearchConfig(), SearchConfig(tile=16, block_bytes=500, dense=1.0), SearchConfig(levels=(), tile=64), SearchConfig(levels=(1, 5, 100), dense=0.0)])
def test_vector_search_is_exact(spark, config):
    table = spark.createDataFrame(vector_rows(), "vec_id long, embedding array<double>").selectExpr("*", "1 AS rank", "'x' AS _v").repartition(3)
    out = top_k(table, "vec_id % 50 = 0", config).collect()
    assert sorted(((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out), key=repr) == plain_top(vector_rows())


def test_vector_search_bounds_hold_and_sharpen():
    rng = np.random.default_rng(1)
    x = np.cumsum(rng.integers(-9, 10, (300, 32)), axis=1).astype(float)
    exact = x[:20] @ x.T
    before = None
    for n in (1, 2, 4, 16, 32):
        bound = vectors.statistics(x[:20], n) @ vectors.statistics(x, n).T
        assert (bound >= exact - 1e-6).all()
        assert before is None or (bound <= before + 1e-6).all()
        before = bound
    assert np.allclose(before, exact)


def test_vector_search_prunes_smooth_vectors():
    rng = np.random.default_rng(3)
    x = np.cumsum(rng.integers(-9, 10, (2000, 64)), axis=1)
    config = SearchConfig(levels=(2, 8))
    block, best = vectors.Block.of(x[:10], np.arange(10), config), vectors.Best.none(10, 5)
    left = [vectors.search_tile(block, best, vectors.Block.of(x[lo : lo + 500], np.arange(lo, lo + 500), config), np.arange(lo, lo + 500), config) for lo in range(0, 2000, 500)]
    assert left[-1][0] > 4 * left[-1][1] > 4 * left[-1][2]


def test_vector_search_of_wide_and_of_too_wide_components(spark):
    rows = [(0, [2.0**20, 1.0]), (1, [2.0**21, 3.0]), (2, [2.0**21, 4.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in top_k(table, "vec_id = 0").collect()) == [(0, 1, 2, (2**57) + 4 * 2**16), (0, 2, 1, (2**57) + 3 * 2**16)]
    assert top_k(table.limit(0), "vec_id = 0").count() == 0
    with pytest.raises(Exception, match="too large"):
        top_k(spark.createDataFrame([(0, [1e300]), (1, [1e300])], "vec_id long, embedding array<double>"), "vec_id = 0").collect()


def plain_search(docs, items, top):
    low = [(i, TERM.findall((t or "").translate(UP))) for i, t in docs]
    low = [(i, Counter(t), len(t)) for i, t in low if t]
    N, L = len(low), sum(n for _, _, n in low)
    df = Counter(t for _, c, _ in low for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, n in low:
            m = 75 + 25 * n * N // L
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t in TERM.findall((text or "").translate(UP)) if c[t])
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("config", [LexicalConfig(), LexicalConfig(top=3, chunk=7, postings=40, step=1, block_bytes=300), LexicalConfig(top=1000, step=2)])
def test_lexical_search_matches_brute_force(spark, hostile, hostile_rows, config):
    own = [(r[0], r[1]) for r in hostile_rows]
    items = [(0, own[0][1]), (1, own[2][1]), (2, None), (3, "  "), (4, "one one ONE"), (4, "one"), (None, "der rest"), (5, "absent"), (6, own[14][1]), (7, "ñoséÖ x mail"), (8, "ca " * 50 + "x-y_z 10.20")]
    asked = spark.createDataFrame([(*i, "z") for i in items], "item_id long, text string, doc_id string")
    out = lexical.search(hostile, asked, config).collect()
    assert sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in out), key=repr) == plain_search(own, items, config.top)


def test_lexical_search_stops_early_and_settles_ties():
    rng = np.random.default_rng(5)
    docs = 20_000
    lists = []
    for j in range(6):
        doc = rng.permutation(docs)[: docs // (j + 1)]
        impact = np.sort(rng.integers(1, 50 if j < 5 else 3, len(doc)))[::-1] * (1000 if j == 0 else 1)
        lists.append((doc, impact))
    every = np.zeros(docs, np.int64)
    for doc, impact in lists:
        every[doc] += impact
    found, scores, read = lexical.settle(lists, docs, 1, LexicalConfig(top=5, step=16))
    least = np.sort(every)[-5]
    assert sorted(found) == np.flatnonzero(every >= least).tolist() and (scores == every[found]).all()
    rare = (np.arange(30), np.arange(3000, 2970, -1) * 1000)
    _, _, few = lexical.settle([rare, (rng.permutation(docs), np.full(docs, 1))], docs, 1, LexicalConfig(top=5, step=16))
    assert few < read and few <= docs + 30
    found, scores, _ = lexical.settle([(np.arange(100), np.full(100, 7))], 100, 7, LexicalConfig(top=5, step=4))
    assert len(found) == 100 and (scores == 7).all()


def test_searches_of_empty_tables(spark, empty):
    assert collocations(empty).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert lexical.search(empty, one).count() == 0 == lexical.search(one.withColumnRenamed("item_id", "doc_id"), none).count()
    assert lexical.search(empty, one).columns == ["item_id", "rank", "doc_id", "score"]
