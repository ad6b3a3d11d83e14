"""Near duplicates inside crowds: documents that share much of their text without being near duplicates."""

import random

import pytest
from pyspark.sql import functions as F

from accesslens.llm.chosen_path import PathConfig, children, near_duplicates, survival, trees_of


def crowd_rows(documents, share, percent, every):
    """Documents of 100 shingles that share ``share`` of what two of them hold together; each ``every``-th has a partner at ``percent``."""
    rng = random.Random(documents)
    word = lambda: f"w{rng.getrandbits(48):x}"
    common = [word() for _ in range(round(100 * 2 * share / (1 + share)) + 4)]
    alike = -(-200 * percent // (100 + percent)) + 4
    rows, pairs = [], []
    for i in range(documents):
        own = common + [word() for _ in range(104 - len(common))]
        rows.append((2 * i, " ".join(own)))
        if i % every == 0:
            rows.append((2 * i + 1, " ".join(own[:alike] + [word() for _ in range(104 - alike)])))
            pairs.append(2 * i)
    return rows, pairs


def recall(spark, documents, share, percent, every=10):
    rows, pairs = crowd_rows(documents, share, percent, every)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    found = {r.doc_id: r.component_id for r in near_duplicates(docs, PathConfig(percent=percent)).collect()}
    assert all(c in (i, i - i % 2) for i, c in found.items())  # nothing else is linked
    return sum(found[p + 1] == p for p in pairs) / len(pairs)


@pytest.mark.parametrize("share, percent", [(0.4, 80), (0.6, 85), (0.7, 80)])
def test_pairs_in_crowds_are_found(spark, share, percent):
    assert recall(spark, 2000, share, percent) >= 0.99


@pytest.mark.parametrize("percent", [80, 85])
def test_a_class_has_one_child_in_similarity(spark, percent):
    config = PathConfig(percent=percent)
    nodes = spark.range(50_000).select(F.xxhash64("id").alias("_node"), F.lit(bytes(4 * config.tokens)).alias("_tokens"))
    mean = nodes.select(F.avg(F.size(children(F.col("_node"), config)))).first()[0]
    assert mean == pytest.approx(100 / percent, abs=0.01)


def test_survival_of_a_pair_and_number_of_trees():
    assert survival(80, 0) == 1 and survival(80, 1) == pytest.approx(1 - 0.75 * 0.2 - 0.25 * 0.04)
    rng, alive = random.Random(3), 0
    for _ in range(4000):
        together = 1
        for _ in range(8):
            together = sum(rng.random() < 0.8 for _ in range(together) for _ in range(1 + (rng.random() < 0.25)))
        alive += together > 0
    assert alive / 4000 == pytest.approx(survival(80, 8), abs=0.03)
    for percent in (80, 85):
        config = PathConfig(percent=percent)
        assert (1 - survival(percent, config.depth)) ** trees_of(config) <= config.miss
