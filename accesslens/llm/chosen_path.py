"""Near-duplicate detection by chosen-path set similarity join.

A document is the set of its word shingles; documents with the same set are
one class. A class has ``tokens`` minwise tokens. In each of several
independent trees a node picks one of them, by hash of the path so far, and
classes with different values go to different children, until a node has at
most ``small`` classes, which are compared with each other exhaustively on
one-byte tokens. A share 1/s - 1 of the nodes picks two tokens, so that a class
has 1/s children on average, where s is the similarity of a link: a crowd
that shares a fraction f < s of its tokens then has (f/s)^d as many rows at
depth d, and nodes that shrink by f a level. What is still large at depth
``depth`` is compared in pairs of blocks, so that all its pairs meet.

In a large node all classes are also compared with some ``leaders`` of it: what
is ``loose`` or more like one is gathered with it, and what is ``close`` leaves
the tree, as what is like it is gathered too.

Comparisons on tokens only gather classes that may belong together: pairs at
``loose`` or more, kept as a spanning forest, not as all pairs. Inside each
gathered group links are then decided by the exact intersection of the full
sets. A group too large for one task is compared in pairs of blocks, so that
every pair meets. Classes linked in a chain are one component.

A pair of similarity s survives in a tree to depth d with the probability of
``survival``: a branching process with one child on average that is together.
``trees_of`` takes as many trees as bring the chance that all of them part a
pair at s to ``miss`` at the deepest level; nodes that are small earlier miss
less (at 0.80: 0.41 survive to depth 8, 0.27 to depth 16, so 20 trees miss 3e-5
and 2e-3). Two things come on top. Trees share the tokens, so a pair whose
tokens differ more than its sets is missed more often. And a pair is lost in a
tree where one of it is ``close`` to a leader and the other not even
``loose``; at 0.80 13 of 64 tokens of a pair differ on average, as many as lie
between the two bounds, so this needs a pair whose differing tokens are all
the leader's on one side. What both cost together is measured on crowds in
tests/llm/test_crowds.py.

Defined results: null and blank texts have no shingles, are linked with
nothing and stay; fewer words than ``width`` make one shingle; the smallest
id of a component is its name (null ids lose); repeated rows of one id get the
same result; an empty table gives no rows; extra columns do not matter.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accesslens.llm.common import BROADCAST_ROWS, sized, text_of, written
from accesslens.llm.components import components
from accesslens.llm.wordhash import batches, shingles, words_of

#: Crowds whose leaders may be broadcast.
LEADING = 10_000


@dataclass(frozen=True)
class PathConfig:
    """percent: similarity of a link, in hundredths; width: words of a shingle; small: classes of a node that are compared exhaustively;
    leaders: classes of a larger node that all its classes are compared with; miss: chance that all trees part a pair at ``percent``
    before ``depth``; block: classes compared in one task at most."""

    percent: int = 85
    width: int = 5
    tokens: int = 64
    small: int = 512
    leaders: int = 4
    depth: int = 16
    miss: float = 0.002
    loose: float = 0.50
    close: float = 0.70
    block: int = 2048
    seed: int = 11


def survival(percent: int, depth: int) -> float:
    """The chance that a pair at ``percent`` is together in some node of a tree at ``depth``."""
    s, lost = percent / 100, 0.0
    second = 1 / s - 1
    for _ in range(depth):
        apart = 1 - s + s * lost
        lost = (1 - second) * apart + second * apart * apart
    return 1 - lost


def trees_of(config: PathConfig) -> int:
    return math.ceil(math.log(config.miss) / math.log(1 - survival(config.percent, config.depth)))


def minwise(sets: list[np.ndarray], config: PathConfig) -> np.ndarray:
    """The minwise tokens (rows: sets, columns: hash functions) of sets that are not empty."""
    factors = np.random.default_rng(config.seed).integers(0, 2**63, config.tokens, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    first = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    every = np.concatenate(sets)
    out = np.empty((len(sets), config.tokens), np.uint32)
    for j, f in enumerate(factors):
        out[:, j] = np.minimum.reduceat(((every * f) >> np.uint64(32)).astype(np.uint32), first)
    return out


def digest(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame, config: PathConfig) -> DataFrame:
    """Per row: _id, _text_key, n_shingles, _set (digest of the set) and _tokens; the last two null without shingles. Written."""

    def sketch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column("_text").to_pylist()
            for lo, hi in batches(texts):
                words, counts = words_of(texts[lo:hi])
                sets = [shingles(w, config.width) for w in np.split(words, np.cumsum(counts)[:-1])]
                full = [s for s in sets if len(s)]
                rows = iter(minwise(full, config)) if full else iter(())
                rest = part.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        rest.column("_id"), rest.column("_text_key"), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array([next(rows).astype(">u4").tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    names=["_id", "_text_key", "n_shingles", "_set", "_tokens"],
                )

    rows = docs.select(F.col("doc_id").alias("_id"), F.xxhash64(text_of()).alias("_text_key"), text_of().cast("binary").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return written(rows.mapInArrow(sketch, f"_id {kind}, _text_key long, n_shingles long, _set binary, _tokens binary"), "sketches")


def classes(rows: DataFrame) -> DataFrame:
    """One row per distinct set: _set, its smallest id, the text of one document with it, size and tokens. Written."""
    named = rows.filter("n_shingles > 0").groupBy("_set").agg(
        F.min("_id").alias("_least"), F.min(F.struct(F.col("_id").isNull().alias("null"), "_id", "_text_key")).alias("_one"), F.first("_tokens").alias("_tokens"), F.first("n_shingles").alias("_n")
    )
    return written(named, "classes")


def pick(node: Column, config: PathConfig, nth: int = 0) -> Column:
    """The token that a node chooses; ``nth`` 1: another one."""
    first = F.pmod(F.xxhash64(node, F.lit(config.seed)), F.lit(config.tokens)).cast("int")
    if not nth:
        return first
    step = 1 + F.pmod(F.xxhash64(node, F.lit(config.seed + 1)), F.lit(config.tokens - 1)).cast("int")
    return F.pmod(first + step, F.lit(config.tokens)).cast("int")


def children(node: Column, config: PathConfig) -> Column:
    """The children of a node that a class goes to, one for each token that the node chooses: two in a share 1/s - 1 of the nodes, else one."""

    def child(token: Column) -> Column:
        return F.xxhash64(node, token, F.substring("_tokens", token * 4 + 1, F.lit(4)))

    million = 1_000_000
    two = F.pmod(F.xxhash64(node, F.lit(config.seed + 2)), F.lit(million)) < int(million * (100 / config.percent - 1))
    return F.when(two, F.array(child(pick(node, config)), child(pick(node, config, 1)))).otherwise(F.array(child(pick(node, config))))


def meetings(key: Column, rows: Column, block: int) -> Column:
    """The pairs of blocks that a class of a crowd of ``rows`` is in: every two blocks, of half ``block`` each, meet once."""
    blocks = F.ceil(rows / max(1, block // 2)).cast("int")
    mine = F.pmod(key, blocks).cast("int")
    return F.array_distinct(F.transform(F.sequence(F.lit(0), blocks - 1), lambda other: F.struct(F.least(mine, other).alias("i"), F.greatest(mine, other).alias("j"))))


def similar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of rows of one-byte tokens."""
    return ((a == b).mean(axis=1) - 1 / 256) / (1 - 1 / 256)


def labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index each of n items is connected with by edges a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def grouped(parts: Iterator[pa.RecordBatch], key: str, enough: int) -> Iterator[pa.Table]:
    """Batches of a sorted partition, put together so that no group of ``key`` is cut; some ``enough`` rows each."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for part in parts:
        if not part.num_rows:
            continue
        held.append(part)
        rows += part.num_rows
        if rows < enough:
            continue
        whole = pa.Table.from_batches(held)
        keys = whole.column(key).to_numpy()
        last = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if (keys != keys[-1]).any() else 0
        if last:
            yield whole.slice(0, last)
            held = whole.slice(last).to_batches()
            rows = whole.num_rows - last
    if held:
        yield pa.Table.from_batches(held)


def node_edges(config: PathConfig):
    """Compare all rows of a node with each other; one edge to a leader per gathered row."""

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in grouped(parts, "_node", 4_000):
            node = part.column("_node").to_numpy()
            tokens = np.frombuffer(b"".join(part.column("_bytes").to_pylist()), np.uint8).reshape(len(node), -1)
            a, b = [], []
            for k in range(1, len(node)):
                i = np.flatnonzero(node[:-k] == node[k:])
                if not len(i):
                    break
                near = i[similar(tokens[i], tokens[i + k]) >= config.loose]
                a.append(near)
                b.append(near + k)
            if not a:
                continue
            root = labels(len(node), np.concatenate(a), np.concatenate(b))
            out = np.flatnonzero(root != np.arange(len(node)))
            sets = part.column("_set").combine_chunks()
            yield pa.RecordBatch.from_arrays([pa.array(sets.take(pa.array(out)), pa.binary()), pa.array(sets.take(pa.array(root[out])), pa.binary())], names=["a", "b"])

    return compare


def nearest_leaders(config: PathConfig):
    """Adds to the classes of crowded nodes how near the nearest leader is, and the leaders to be gathered with.

    Of leaders that belong together anyway one is enough; a leader names all others that it belongs with.
    """

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if not part.num_rows:
                continue
            own = np.frombuffer(b"".join(part.column("_bytes").to_pylist()), np.uint8).reshape(part.num_rows, -1)
            leads = part.column("_leads")
            count = leads.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            names, tokens = leads.flatten().flatten()
            names = names.to_pylist()
            tokens = np.frombuffer(b"".join(tokens.to_pylist()), np.uint8).reshape(len(names), -1)
            first = np.cumsum(count) - count
            most = int(count.max())
            # A row's leaders in columns; those that a node lacks repeat its first and are never chosen.
            at = first[:, None] + np.where(np.arange(most) < count[:, None], np.arange(most), 0)
            there = np.arange(most) < count[:, None]
            near = np.stack([similar(own, tokens[at[:, k]]) for k in range(most)], axis=1)
            sets = part.column("_set").to_pylist()
            self_ = np.array([[names[j] == s for j in row] for row, s in zip(at.tolist(), sets, strict=True)], bool) & there
            together = np.tile(np.arange(most), (part.num_rows, 1))
            for _ in range(most):
                for a in range(most):
                    for b in range(a):
                        joined = there[:, a] & (similar(tokens[at[:, a]], tokens[at[:, b]]) >= config.loose)
                        low = np.minimum(together[:, a], together[:, b])
                        together[joined, a] = low[joined]
                        together[joined, b] = low[joined]
            leader = self_.any(axis=1)
            good = there & ~self_ & (near >= config.loose)
            chosen = good.copy()
            for a in range(most):
                for b in range(a):
                    chosen[:, a] &= leader | ~(good[:, b] & (together[:, a] == together[:, b]))
            gathered_with = [[names[j] for j in row[pick]] for row, pick in zip(at, chosen, strict=True)]
            near[~there] = -1
            yield pa.RecordBatch.from_arrays(
                [part.column("_node"), part.column("_set"), part.column("_tokens"), part.column("_bytes"), pa.array(near.max(axis=1)), pa.array(gathered_with, pa.list_(pa.binary()))],
                names=["_node", "_set", "_tokens", "_bytes", "_near", "_with"],
            )

    return compare


def gathered(sets: DataFrame, config: PathConfig) -> DataFrame:
    """Edges (a, b) between classes that may be linked, from all trees. Written."""
    low = F.array(*[F.substring("_tokens", 4 * j + 4, 1) for j in range(config.tokens)])
    rows = written(sets.select("_set", "_tokens", F.aggregate(low, F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x)).alias("_bytes")), "tokens")
    trees = F.explode(F.sequence(F.lit(0), F.lit(trees_of(config) - 1))).alias("_tree")
    level = rows.select("_set", "_tokens", trees).select("_set", F.explode(children(F.xxhash64("_tree"), config)).alias("_node"))
    # The leaders of a node are the classes with the least value of one of some hashes.
    own = {f"_h{k}": F.xxhash64("_node", "_set", F.lit(k)) for k in range(config.leaders)}
    leaves, stars, few = [], [], False
    for depth in range(1, config.depth + 1):
        # Narrow rows find the nodes with several classes; most classes are alone in theirs.
        busy = level.groupBy("_node").agg(F.count("*").alias("_m"), *[F.min(h).alias(name) for name, h in own.items()]).filter("_m > 1")
        met = level.join(F.broadcast(busy) if few else written(busy, "nodes"), "_node")
        if depth == 1:
            met = met.join(rows, "_set")
        met = written(met.select("_node", "_m", *own, "_set", "_tokens", "_bytes"), "met")
        leaves.append(met.filter(F.col("_m") <= config.small).select("_node", "_set", "_bytes"))
        crowd = met.filter(F.col("_m") > config.small)
        large = crowd.count()
        if not large:
            break
        if depth == config.depth:
            dealt = crowd.withColumn("_pair", F.explode(meetings(F.xxhash64("_set", "_node"), F.col("_m"), config.block)))
            leaves.append(dealt.select(F.xxhash64("_node", "_pair").alias("_node"), "_set", "_bytes"))
        is_lead = reduce(lambda a, b: a | b, [h == F.col(name) for name, h in own.items()])
        lead = crowd.filter(is_lead).groupBy("_node").agg(F.collect_list(F.struct("_set", "_bytes")).alias("_leads"))
        # There are fewer than large / small crowds, and the next level has at most ``large`` nodes with several classes.
        few = large <= BROADCAST_ROWS
        facing = crowd.join(F.broadcast(lead) if large <= LEADING * config.small else lead, "_node").select("_node", "_set", "_tokens", "_bytes", "_leads")
        crowded = written(facing.mapInArrow(nearest_leaders(config), "_node long, _set binary, _tokens binary, _bytes binary, _near double, _with array<binary>"), "crowded")
        stars.append(crowded.select(F.col("_set").alias("a"), F.explode("_with").alias("b")))
        # What is close to a leader is gathered with it and leaves the tree; the rest branches on.
        rest = crowded.filter(F.col("_near") < config.close)
        level = rest.select("_set", "_tokens", "_bytes", F.explode(children(F.col("_node"), config)).alias("_node"))
    # A node's name is a hash of its path, so the small nodes of all levels are compared in one go.
    leaf = reduce(DataFrame.unionByName, leaves)
    found = leaf.repartition("_node").sortWithinPartitions("_node").mapInArrow(node_edges(config), "a binary, b binary")
    return written(reduce(DataFrame.unionByName, stars, found).distinct(), "near")


def exact_links(config: PathConfig):
    """Within each group, the components of the pairs whose full sets are similar enough: one edge per class to the smallest of its component."""

    def link(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in grouped(parts, "_group", 256):
            group = part.column("_group").to_numpy()
            names, members = part.column("_set").to_pylist(), part.column("_shingles").to_pylist()
            starts = np.concatenate(([0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]))
            a, b = [], []
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                own = dict(zip(names[lo:hi], members[lo:hi], strict=True))  # a class given twice counts once
                keys = sorted(own)  # so that the first of a component is the smallest
                root = linked_sets([np.frombuffer(own[k], np.uint64) for k in keys], config.percent)
                for i in np.flatnonzero(root != np.arange(len(keys))):
                    a.append(keys[i])
                    b.append(keys[root[i]])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return link


def linked_sets(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """The smallest index each set is connected with, by exact similarity of all pairs."""
    n = len(sets)
    if n < 2:
        return np.arange(n)
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), size)
    value, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    owner, column = owner[shared], (np.cumsum(count > 1) - 1)[column[shared]]
    both = np.zeros((n, n), np.float32)
    width = max(1, min(8192, 16_000_000 // n))
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for lo in range(0, int((count > 1).sum()), width):
        i, j = np.searchsorted(column, (lo, lo + width))
        block = np.zeros((n, width), np.float32)
        block[owner[i:j], column[i:j] - lo] = 1
        both += block @ block.T
    close = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    a, b = np.nonzero(np.triu(close, 1))
    return labels(n, a, b)


def near_duplicates(docs: DataFrame, config: PathConfig = PathConfig()) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept, and text_key, a hash of the text."""
    rows = sketches(docs, config)
    sets = classes(rows)
    groups = components(gathered(sets, config))
    wanted = written(sets.join(groups, sets["_set"] == groups["node"]).select(F.col("_one._id").alias("_want"), F.col("_one._text_key").alias("_want_key"), F.col("root").alias("_root")), "wanted")
    counts = written(wanted.groupBy("_root").agg(F.count("*").alias("_m")).filter(F.col("_m") > config.block), "crowds")
    texts = docs.select(F.col("doc_id").alias("_id"), F.xxhash64(text_of()).alias("_text_key"), text_of().cast("binary").alias("_text"))
    member = texts.join(sized(wanted), F.col("_id").eqNullSafe(F.col("_want")) & (F.col("_text_key") == F.col("_want_key"))).select("_root", "_text")

    def sets_again(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            given = part.column("_text").to_pylist()
            for lo, hi in batches(given):
                words, n = words_of(given[lo:hi])
                own = [shingles(w, config.width) for w in np.split(words, np.cumsum(n)[:-1])]
                yield pa.RecordBatch.from_arrays(
                    [part.column("_root").slice(lo, hi - lo), pa.array([digest(s) for s in own], pa.binary()), pa.array([s.tobytes() for s in own], pa.binary())], names=["_root", "_set", "_shingles"]
                )

    full = member.mapInArrow(sets_again, "_root binary, _set binary, _shingles binary")
    # A crowd is dealt out in blocks, and every two blocks meet in one group.
    tall = full.join(F.broadcast(counts) if counts.limit(10_001).count() <= 10_000 else counts, "_root", "left")
    half = max(1, config.block // 2)
    blocks = F.when(F.col("_m").isNull(), 1).otherwise(F.ceil(F.col("_m") / half)).cast("int")
    mine = F.pmod(F.xxhash64("_set"), blocks).cast("int")
    meets = F.transform(F.sequence(F.lit(0), blocks - 1), lambda other: F.struct(F.least(mine, other).alias("i"), F.greatest(mine, other).alias("j")))
    dealt = tall.withColumn("_pair", F.explode(F.array_distinct(meets))).select(F.xxhash64("_root", "_pair").alias("_group"), "_set", "_shingles")
    links = written(dealt.repartition("_group").sortWithinPartitions("_group").mapInArrow(exact_links(config), "a binary, b binary"), "links")
    joined = components(links)
    named = sets.join(joined, sets["_set"] == joined["node"], "left").select("_set", "_least", F.coalesce("root", "_set").alias("_root"))
    least = named.groupBy("_root").agg(F.min("_least").alias("component_id"))
    by_set = written(named.join(least, "_root").select(F.col("_set").alias("_name"), "component_id"), "components")
    out = rows.drop("_tokens").join(by_set, F.col("_set") == F.col("_name"), "left")
    component = F.when(F.col("n_shingles") == 0, F.col("_id")).otherwise(F.col("component_id"))
    return out.select(F.col("_id").alias("doc_id"), "n_shingles", component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"), F.col("_text_key").alias("text_key"))


def one_of_each(docs: DataFrame, config: PathConfig = PathConfig()) -> DataFrame:
    """``docs`` with one document of each component, with the columns they came with; blank ones all stay."""
    found = written(near_duplicates(docs, config), "decisions")
    keep = found.filter("kept").groupBy(F.col("doc_id").alias("_keep"), F.col("text_key").alias("_keep_key")).agg(F.count("*").alias("_times"), F.max("n_shingles").alias("_full"))
    keep = written(keep, "kept")
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64(text_of()).alias("_text_key"))
    stay = rows.join(sized(keep), F.col("_id").eqNullSafe(F.col("_keep")) & (F.col("_text_key") == F.col("_keep_key")))
    again = (F.col("_times") > 1) & (F.col("_full") > 0)
    if not keep.filter(again).isEmpty():
        stay = stay.filter(~again).unionByName(stay.filter(again).dropDuplicates(["_id", "_text_key"]))
    return stay.select("_row.*")
