import random

import pytest
from llm_rows import SCHEMA, row, shingles

from accesslens.llm.chosen_path import PathConfig, near_duplicates


@pytest.mark.parametrize("config", [PathConfig(small=4, depth=3, block=256), PathConfig(small=4)])
def test_near_copies_among_documents_with_common_boilerplate_are_found(spark, config):
    rng = random.Random(17)
    common = [f"c{i}" for i in range(94)]
    rows, pairs = [], 100
    for i in range(4000):
        own = [f"w{rng.randrange(10**9)}" for _ in range(66)]
        rows.append(row(i, " ".join(common + own)))
        if i < pairs:
            own[40] = "changed"
            own[50] = "too"
            rows.append(row(10_000 + i, " ".join(common + own)))
    a, b, c = shingles(rows[0][1]), shingles(rows[1][1]), shingles(rows[-1][1])
    assert 0.85 <= len(a & b) / len(a | b) < 0.9 and 0.38 < len(a & c) / len(a | c) < 0.42
    found = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(8), config).collect()}
    assert sum(found[10_000 + i] == i for i in range(pairs)) == pairs
    assert len(set(found.values())) == 4000
