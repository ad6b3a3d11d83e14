import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from accesslens.llm.chat import WindowConfig, escape, format_chat, read_back, unescape

SCHEMA = "conv_id long, turn long, role string, text string, window string, loss int, _turns string"


def talk():
    rng = random.Random(1)
    marks = ["</s>", "<s>", "[INST]", "[/INST]", "<|im_end|>\n", "<\\/s>", "<<SYS>>", "\\", "<", "[", "ü", " ", "\n", "word"]
    rows = []
    for conv in range(12):
        if conv % 3 == 0:
            rows.append((conv, 0, "system", "Be " * rng.randint(1, 30)))
        for turn in range(1, rng.randint(2, 30)):
            text = "".join(rng.choice(marks) for _ in range(rng.randint(0, 60)))
            rows.append((conv, turn, rng.choice(["user", "assistant", "a b\n%"]), text))
    rows += [(50, 1, "user", None), (50, 2, None, "x"), (50, None, "assistant", "first"), (None, 1, "assistant", "no id"), (51, 1, "assistant", "same"), (51, 1, "assistant", "same"), (52, 1, "assistant", "long " * 5000), (52, 2, "user", "y")]
    return [(*r, "w", 1, "t") for r in rows]


def test_round_trip_and_loss(spark):
    rows = talk()
    expected = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        expected[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    for config in (WindowConfig(), WindowConfig(budget=64, history=16, block=2)):
        windows = format_chat(spark.createDataFrame(rows, SCHEMA).repartition(3), config)
        found = defaultdict(list)
        for r in read_back(windows).collect():
            found[r.conv_id].append((r.window, [(t.role, t.text) for t in r.turns], list(r.learned)))
        assert set(found) == set(expected)
        for conv, parts in found.items():
            parts.sort(key=lambda p: p[0])
            turns = [t for p in parts for t in p[1]]
            wanted = sorted(expected[conv], key=lambda t: t[0])
            assert sorted(turns) == sorted((r, t) for _, r, t in wanted)
            if len({t[0] for t in wanted}) == len(wanted):
                assert turns == [(r, t) for _, r, t in wanted]
            assert [x for p in parts for x in p[2]] == [t for r, t in turns if r == "assistant"]


@pytest.mark.parametrize("block", [2, 50])
def test_windows_keep_to_the_budget_and_repeat_history(spark, block):
    config = WindowConfig(budget=64, history=16, block=block)
    rows = [(1, 0, "system", "be kind")] + [(1, i, "user" if i % 2 else "assistant", f"turn {i}") for i in range(1, 400)]
    out = sorted(format_chat(spark.createDataFrame([(*r, "w", 1, "t") for r in rows], SCHEMA), config).collect(), key=lambda r: r.window)
    assert sum(r.new for r in out) == 400
    assert all(r.tokens <= config.budget and not r.over_budget for r in out)
    for before, r in zip(out, out[1:]):
        assert r.formatted.startswith("<s><|im_start|>system\nbe kind<|im_end|>\n")
        assert r.window == before.window + before.new
        # the system turn, and the two turns of six tokens that sixteen leave room for
        assert r.repeated == 3 and f"turn {r.window - 1}<" in r.formatted
    if block == 50:  # greedy within a block: the next turn would not have fitted into what history and system turn leave
        assert min(r.new for r in out[1:-1]) >= 5


def test_long_turns_stay_whole(spark):
    out = format_chat(spark.createDataFrame([(*r, "w", 1, "t") for r in [(1, 1, "user", "a " * 500), (1, 2, "assistant", "b")]], SCHEMA), WindowConfig(budget=64, history=16)).collect()
    assert sorted((r.new, r.over_budget) for r in out) == [(1, False), (1, True)]


def test_escape_is_reversible(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["<", "[", "/", "s>", "INST]", "\\", "|im_start|>", "|im_end|>", "<SYS>>", "</SYS>>", "$1", "x"]) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", escape(F.col("t"))).withColumn("u", unescape(F.col("e")))
    for r in df.collect():
        assert r.u == r.t
        assert not any(m in r.e for m in ("<s>", "</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<<SYS>>"))


def test_empty(spark):
    assert read_back(format_chat(spark.createDataFrame([], SCHEMA))).count() == 0
