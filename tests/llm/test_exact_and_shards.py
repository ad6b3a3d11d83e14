import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from accesslens.llm.exact_dedup import HeavyHitters, exact_dedup, frequent_digests, digests, survivors
from accesslens.llm.hilbert import HilbertConfig, hilbert_index, hilbert_shards, write_shards

UP = {i: i + 32 for i in range(65, 91)}


def norm(text):
    return (text or "").translate(UP)


@pytest.mark.parametrize("copies", [2, 10_000])
def test_exact_dedup_matches_brute_force(hostile, hostile_rows, copies):
    out = exact_dedup(hostile, config=HeavyHitters(copies=copies)).collect()
    groups = defaultdict(list)
    for r in hostile_rows:
        groups[norm(r[1])].append(r[0])
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in hostile_rows)
    for r in out:
        ids = by_sha[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
        assert r.doc_id in ids and (not r.kept or r.doc_id == r.keep_id)
    assert Counter(r.text_sha256 for r in out if r.kept) == Counter(by_sha.keys())


def test_survivors_keep_whole_rows(hostile, hostile_rows):
    left = survivors(hostile, exact_dedup(hostile))
    assert left.columns == hostile.columns
    assert Counter(norm(r.text) for r in left.collect()) == Counter({norm(r[1]) for r in hostile_rows})


def test_frequent_digests_are_verified_counts(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'hot', concat('t', id)) AS text")
    found = frequent_digests(digests(docs), HeavyHitters(candidates=8, counters=64, copies=50)).collect()
    assert [(r.group_size, r._win.doc_id) for r in found] == [(1000, 2997)]


def test_empty_tables(empty):
    assert exact_dedup(empty).count() == 0
    assert survivors(empty, exact_dedup(empty)).count() == 0
    assert hilbert_shards(empty).count() == 0


def test_hilbert_curve_visits_neighbours():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    index = hilbert_index(cells, 3)
    assert sorted(index) == list(range(512))
    path = cells[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_shards_differ_by_one_row_and_have_no_gaps(hostile, hostile_rows):
    out = hilbert_shards(hostile, HilbertConfig(shards=7)).collect()
    assert Counter(tuple(r.row) for r in out) == Counter(hostile_rows)
    held = defaultdict(list)
    for r in out:
        held[r.shard].append(r.slot)
        assert r.size == len((r.row.text or "").encode()) + 1
    assert sorted(held) == list(range(7))
    assert all(sorted(s) == list(range(len(s))) for s in held.values())
    sizes = [len(s) for s in held.values()]
    assert max(sizes) - min(sizes) <= 1
    order = sorted(out, key=lambda r: (r.shard, r.slot))
    assert [r.hilbert for r in order] == sorted(r.hilbert for r in order)


def test_sources_with_a_common_beginning_have_bins_of_their_own(spark):
    rows = [(i, "w", ["dataset_a", "dataset_b", "dataset_c", None][i % 4], "en") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    out = hilbert_shards(docs, HilbertConfig(shards=4), {"source": F.col("source")}).collect()
    held = defaultdict(set)
    for r in out:
        held[r.shard].add(r.row.source)
    assert [held[k] for k in range(4)] == [{None}, {"dataset_a"}, {"dataset_b"}, {"dataset_c"}]


def test_fewer_rows_than_shards(hostile):
    out = hilbert_shards(hostile.limit(3), HilbertConfig(shards=16), whole_rows=False).collect()
    assert len({r.shard for r in out}) == 3 and all(r.slot == 0 for r in out)


def test_files_follow_the_slots(spark, hostile, tmp_path):
    write_shards(hilbert_shards(hostile, HilbertConfig(shards=3)), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == hostile.count() and back.select("shard").distinct().count() == 3
