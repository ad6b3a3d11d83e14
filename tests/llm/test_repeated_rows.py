import random
from collections import Counter

import pytest
from llm_rows import SCHEMA, prose, row
from test_pairs import brute_removed

from accesslens.llm.suffix_dedup import RepeatConfig, without_repeats


@pytest.mark.parametrize("config", [RepeatConfig(), RepeatConfig(crowd=1)])
def test_the_first_of_repeated_rows_keeps_its_text(spark, config):
    rng = random.Random(31)
    own, nameless, twice = prose(rng, 80), prose(rng, 80), prose(rng, 60)
    rows = [row(1, own), row(1, own), row(None, nameless), row(None, nameless), row(2, f"{twice} and {twice}"), row(2, f"{twice} and {twice}"), row(3, prose(rng, 50))]
    assert min(len(own), len(nameless), len(twice)) > 100
    found = without_repeats(spark.createDataFrame(rows, SCHEMA).coalesce(1), config).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == brute_removed(rows, 100)
