"""Near duplicates: small levels and finished components take no tables of their own."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_rows import SCHEMA, row

from accesslens.llm import chosen_path
from accesslens.llm import components as component_steps
from accesslens.llm.chosen_path import PathConfig, classes, exact_links, gathered, sketches


@pytest.fixture
def names(monkeypatch):
    """The names of the tables that are written."""
    found = []
    for module in (chosen_path, component_steps):
        monkeypatch.setattr(module, "written", lambda df, name, write=module.written: (found.append(name), write(df, name))[1])
    return found


@pytest.mark.parametrize("edges, tables", [([], 0), ([(2, 1), (1, 3), (5, 4), (6, 6)], 0), ([(1, 2), (2, 3)], 2)])
def test_stars_around_their_smallest_nodes_need_no_step(spark, names, edges, tables):
    found = {r.node: r.root for r in component_steps.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert names == ["edges"] * tables
    assert found == ({} if not edges else {1: 1, 2: 1, 3: 1} | ({4: 4, 5: 4} if len(edges) > 2 else {}))


def test_exact_links_point_at_the_smallest_class():
    sets = {b"d": [1, 2, 3, 4], b"b": [1, 2, 3, 4, 5], b"z": [9], b"c": [2, 3, 4, 5], b"\xff": [9, 10, 11, 12], b"a": [9, 10, 11, 12, 13]}
    given = [(7 if k in (b"a", b"\xff") else 3, k, np.array(v, np.uint64).tobytes()) for k, v in sets.items()]
    given.sort(key=lambda g: g[0])
    given.insert(1, given[0])
    part = pa.RecordBatch.from_arrays([pa.array([g[i] for g in given]) for i in range(3)], names=["_group", "_set", "_shingles"])
    found = [(r["a"], r["b"]) for out in exact_links(PathConfig(percent=80))(iter([part])) for r in out.to_pylist()]
    assert sorted(found) == [(b"c", b"b"), (b"d", b"b"), (b"\xff", b"a")]


def test_levels_with_few_rows_write_no_nodes(spark, names):
    rng = random.Random(21)
    common = [f"c{i}" for i in range(94)]
    rows = [row(i, " ".join(common + [f"w{rng.randrange(10**9)}" for _ in range(66)])) for i in range(400)]
    config = PathConfig(small=32, depth=4)
    assert gathered(classes(sketches(spark.createDataFrame(rows, SCHEMA).repartition(4), config)), config).columns == ["a", "b"]
    written = Counter(names)
    assert written["crowded"] > 1 and written["nodes"] == 1 and written["met"] - written["crowded"] in (0, 1)
