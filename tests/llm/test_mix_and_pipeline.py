from collections import Counter, defaultdict

import pytest
from llm_rows import words
from pyspark.sql import functions as F

import corpus_pipeline
from accesslens.llm.mixing import MixConfig, mix, mixed, targets, sizes
from accesslens.llm.queries import QUERIES, SQL


def water(sizes, weights, total, most):
    """Targets by raising the shares until none is above its cap."""
    target, open_ = {}, dict(weights)
    while open_:
        left = total - sum(target.values())
        share = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        over = [s for s in open_ if share[s] >= most * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = most * sizes[s]
            del open_[s]
    return target


def expected(rows):
    size = defaultdict(int)
    for text, source in rows:
        size[source] += len(words(text))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    return size, water(size, weights, 1.5 * sum(size.values()), 2)


def check_mix(docs, rows):
    out = mix(docs).collect()
    size, target = expected(rows)
    taken, largest = defaultdict(int), defaultdict(int)
    by_size = {round(v): None for v in size.values()}
    assert len(out) == len(rows)
    sources = {(size[s], round(target[s], 3)): s for s in size}
    for r in out:
        key = (r.source_size, round(r.target, 3))
        assert key in sources, (key, sources)
        assert r.taken == r.copies * r.size and r.taken <= 2 * r.size
        taken[key] += r.taken
        largest[key] = max(largest[key], r.size)
    for key, words_taken in taken.items():
        assert abs(words_taken - key[1]) <= largest[key] / 2 + 1
    return by_size


def test_mix_comes_near_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check_mix(docs, [(r.text, r.source) for r in docs.collect()])


def test_mix_of_awkward_rows(hostile, hostile_rows):
    check_mix(hostile, [(r[1], r[3]) for r in hostile_rows])
    again = [sorted(map(repr, mix(hostile).collect())) for _ in range(2)]
    assert again[0] == again[1]


def test_mixed_repeats_whole_rows(hostile, hostile_rows):
    out = mixed(hostile)
    assert out.columns == hostile.columns
    counted = Counter(tuple(r) for r in out.collect())
    assert set(counted) <= set(hostile_rows)
    times = Counter(hostile_rows)
    assert all(n <= 2 * times[r] for r, n in counted.items())
    wanted = mix(hostile).agg(F.sum("copies")).first()[0]
    assert sum(counted.values()) == wanted


def test_rates_tilt_with_size(spark):
    rows = [(i, "w " * (1 + i % 50), "a") for i in range(400)] + [(1000 + i, "w " * 30, "b") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    config = MixConfig(weights=(1.0, 9.0), budget=0.9)
    out = mix(docs, config).join(docs.select("doc_id", "source"), "doc_id").collect()
    small = [r for r in out if r.source == "a"]
    # a source cut below its size loses long documents first, by exponential tilt
    assert sum(r.copies for r in small if r.size < 10) / sum(1 for r in small if r.size < 10) > sum(r.copies for r in small if r.size > 40) / sum(1 for r in small if r.size > 40)
    assert abs(sum(r.taken for r in small) - small[0].target) <= 25


def test_empty_and_wordless(spark, empty):
    assert mix(empty).count() == 0 and mixed(empty).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "", "a"), (2, " ", "a")], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mix(blank).collect()] == [(0, 0.0, 0)] * 3
    assert targets(sizes(blank)).count() == 2


@pytest.fixture(scope="module")
def folder(spark, hostile, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    hostile.write.parquet(f"{path}/documents.parquet")
    text = hostile.filter("doc_id = 14").first().text
    spark.createDataFrame([(1, text)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_pipeline_on_awkward_rows(spark, folder, hostile_rows):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, before, folder)
        if k < 4:
            assert after.columns == docs.columns, name
        rows = Counter(tuple(r)[: len(docs.columns) - 1] for r in after.select(*[f"`{c}`" for c in docs.columns if c != "shard"], "shard").collect())
        assert set(rows) <= {r[:-1] for r in hostile_rows}, name
        if name == "quality":  # no labels: nothing is rejected
            assert sum(rows.values()) == len(hostile_rows)
        if name == "decontamination":
            assert not any(r[0] == 14 for r in rows)
        before = after
    # The input has a column of that name, which stays as it is.
    assert after.columns == [*docs.columns, "shard_", "slot"]
    assert {r.shard for r in after.select("shard").collect()} == {"sh"}


def test_many_copies_of_one_row_are_made_in_parts(spark):
    rows = [(1, "hot words here", "a")] * 300 + [(2 + i, f"w{i} " * (1 + i % 9), "a") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    config = MixConfig(spread=7)
    out, want = (sorted(map(tuple, mixed(docs, c).collect())) for c in (config, MixConfig()))
    assert out == want and out.count((1, "hot words here", "a")) > 300


def test_pipeline_of_an_empty_table(spark, empty, folder, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    assert [k.split("_")[0] for k in QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert set(SQL) <= set(QUERIES)
