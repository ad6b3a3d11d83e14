import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_rows import prose, row, shingles

from accesslens.llm import induced
from accesslens.llm.chosen_path import PathConfig, linked_sets, near_duplicates, one_of_each
from accesslens.llm.components import components, is_star_forest
from accesslens.llm.decontam import contained, decontaminate
from accesslens.llm.suffix_dedup import RepeatConfig, without_repeats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _tag string, row int, kept string, score double, `a.b` string, _text int, shard string"


def brute_components(rows, percent):
    ids = defaultdict(list)
    for r in rows:
        ids[shingles(r[1])].append(r[0])
    keys = [k for k in ids if k]
    root = list(range(len(keys)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(keys):
        for j in range(i):
            both = len(a & keys[j])
            if 100 * both >= percent * (len(a) + len(keys[j]) - both):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, k in enumerate(keys):
        least[find(i)] += [x for x in ids[k] if x is not None]
    return {k: min(least[find(i)], default=None) for i, k in enumerate(keys)}


def check_near(docs, rows, config):
    comp = brute_components(rows, config.percent)
    wanted = Counter()
    for r in rows:
        own = shingles(r[1])
        c = comp[own] if own else r[0]
        wanted[(r[0], len(own), c, r[0] == c)] += 1
    found = near_duplicates(docs, config).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found) == wanted


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_match_brute_force(hostile, hostile_rows, percent):
    check_near(hostile, hostile_rows, PathConfig(percent=percent))


def test_crowds_are_compared_in_blocks(spark):
    rng = random.Random(9)
    base, rows = prose(rng, 200).split(), []
    for i in range(300):
        own = list(base)
        for _ in range(rng.randint(1, 5)):
            own[rng.randrange(len(own))] = f"w{rng.randrange(10**6)}"
        rows.append(row(i, " ".join(own)))
    rows += [row(1000 + i, prose(rng, 60)) for i in range(50)]
    check_near(spark.createDataFrame(rows, SCHEMA).repartition(4), rows, PathConfig(small=8, depth=2, block=32))


def test_one_document_of_each_component_stays(hostile, hostile_rows):
    left = one_of_each(hostile, PathConfig(percent=80))
    assert left.columns == hostile.columns
    comp = brute_components(hostile_rows, 80)
    kept = [r for r in left.collect() if shingles(r.text)]
    # two different texts have the id 15, and each is a component of that name
    assert Counter(comp[shingles(r.text)] for r in kept) == Counter({c: 1 + (c == 15) for c in comp.values()})
    assert sum(not shingles(r.text) for r in left.collect()) == sum(not shingles(r[1]) for r in hostile_rows)


def test_linked_sets_counts_every_pair():
    sets = [np.array(s, np.uint64) for s in ([1, 2, 3, 4], [1, 2, 3, 4, 5], [2, 3, 4, 5, 6], [9], [9, 10])]
    assert linked_sets(sets, 80).tolist() == [0, 0, 2, 3, 4]
    assert linked_sets(sets, 60).tolist() == [0, 0, 0, 3, 4]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(200, 200), (301, 300), (300, 301)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(61)) and all(found[i] == 100 for i in range(100, 150)) and found[301] == found[300] == 300
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_containment_matches_brute_force(spark, hostile, hostile_rows, empty):
    by_id = {r[0]: r[1] for r in hostile_rows}
    own = by_id[14].split()
    items = [(1, " ".join(own[3:25])), (2, by_id[1][:200]), (3, "no such words in any of the texts here"), (4, None), (5, " "), (6, "a b c d"), (6, "a b c d"), (None, by_id[15]), (7, " ".join(own[:20] + ["z", "z"]))]
    bench = spark.createDataFrame([(*i, "x", "y") for i in items], "item_id long, text string, doc_id string, n string")
    wanted = set()
    for item, text in set(items):
        a = shingles(text)
        for r in hostile_rows:
            both = len(a & shingles(r[1]))
            if a and 10 * both >= 8 * len(a):
                wanted.add((r[0], r[1], item, both, len(a)))
    found = contained(hostile, bench).collect()
    assert Counter((r.doc_id, r.item_id, r.shared, r.total) for r in found) == Counter((d, i, b, n) for d, _, i, b, n in wanted)
    bad = {(d, t) for d, t, *_ in wanted}
    left = decontaminate(hostile, bench)
    assert left.columns == hostile.columns
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter((r[0], r[1]) for r in hostile_rows if (r[0], r[1]) not in bad)
    assert contained(empty, bench).count() == 0 and contained(hostile, bench.limit(0)).count() == 0
    assert decontaminate(hostile, bench.limit(0)).count() == len(hostile_rows)


def test_suffix_arrays(monkeypatch):
    rng = np.random.default_rng(1)
    for t in range(200):
        monkeypatch.setattr(induced, "MANY_NAMES", 2 if t % 5 == 0 else 2048)
        text = bytes(np.tile(rng.integers(0, rng.integers(1, 5), rng.integers(1, 120)), 1 + 3 * (t % 3 == 0)).astype(np.uint8))
        data = np.frombuffer(text, np.uint8)
        order = induced.suffix_array(data, 256)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        shared = induced.common_prefixes(data, order, 10)
        for a, b in zip(order, order[1:]):
            n = 0
            while n < 10 and max(a, b) + n < len(text) and text[a + n] == text[b + n]:
                n += 1
            assert shared[b] == n


def brute_removed(rows, length):
    seen, out = set(), []
    placed = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))  # texts with one id share nothing here
    for r in placed:
        data = (r[1] or "").encode()
        gone = np.zeros(len(data) + 1, int)
        for i in range(len(data) - length + 1):
            w = data[i : i + length]
            if w in seen:
                gone[i] += 1
                gone[i + length] -= 1
            seen.add(w)
        mask = np.cumsum(gone[:-1]) > 0
        kept = bytes(np.frombuffer(data, np.uint8)[~mask])
        out.append((r[0], len(data), int(mask.sum()), int((np.diff(np.concatenate(([0], mask.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("config", [RepeatConfig(), RepeatConfig(crowd=1), RepeatConfig(shard=500)])
def test_repeats_match_brute_force(hostile, hostile_rows, empty, config):
    found = without_repeats(hostile, config, texts=True).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == brute_removed(hostile_rows, 100)
    assert all(r.kept is None or hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in found)
    if config == RepeatConfig():
        assert without_repeats(empty).count() == 0


@pytest.mark.parametrize("edges, stars", [([], True), ([(2, 1), (3, 1), (5, 4)], True), ([(2, 1), (3, 2)], False), ([(3, 1), (3, 2)], False), ([(2, 1), (2, 1)], False)])
def test_components_end_at_stars(spark, edges, stars):
    assert is_star_forest(spark.createDataFrame(edges, "a long, b long")) is stars
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    least = {n: n for e in edges for n in e}
    for _ in least:
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    assert found == least
