"""Exact top-k search by inner product, pruned by segment statistics of growing resolution.

Components are turned into whole numbers floor(256 x), so scores are exact.
Cut into segments of n components with means m and deviations s, two vectors
have a squared distance of at least sum n ((m - m')^2 + (s - s')^2), and so, as
|q|^2 = sum n (m^2 + s^2), a score of at most (|q|^2 + |x|^2 - bound) / 2 =
sum n (m m' + s s'). Finer segments give better bounds.

Queries are cut into blocks of bounded bytes, which are sent to all tasks one
after the other; the vectors stay where they are. A task takes its vectors in
tiles. For each tile the bound is formed for all pairs on the coarsest
segments, then on finer ones for pairs that are left, and the score itself
for the survivors. A pair is left while its bound reaches the k-th best score
that the task has met for the query so far. Tasks give back k rows a query,
which are ranked once more together.

Scores are summed in doubles while they are whole numbers below 2^53, else in
64-bit integers; what does not fit these raises OverflowError.

Defined results: vectors that are null or hold null or non-finite components
take no part; vectors of different dimension do not meet; equal scores go to
the smaller id, null ids last (they are no queries); rows with the same id are
different vectors, and each is a query; queries without candidates give no
rows; extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from accesslens.llm.common import written
from accesslens.operators.scan import running_totals

NO_ID = 2**63 - 1


@dataclass(frozen=True)
class SearchConfig:
    """k: neighbours per query; scale: of a component; levels: segments, coarse to fine; block_bytes: queries of a block as 8-byte
    components; tile: vectors compared at once; dense: share of a tile's pairs from which on all of them are computed."""

    k: int = 5
    scale: int = 256
    levels: tuple[int, ...] = (2, 8, 32)
    block_bytes: int = 32 << 20
    tile: int = 1024
    dense: float = 0.05


def quantised(vectors: DataFrame, config: SearchConfig) -> DataFrame:
    """vec_id, _row (a number of the row) and _v (whole components) of the vectors that take part. Written."""
    wide = F.transform("embedding", lambda x: x.cast("double"))
    sound = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    # A component beyond 2^52 stops the run below, whatever it is cast to.
    whole = F.transform(wide, lambda x: F.floor(F.lit(float(config.scale)) * x).cast("long"))
    rows = vectors.filter(sound).select(F.col("vec_id").cast("long").alias("vec_id"), F.monotonically_increasing_id().alias("_row"), whole.alias("_v"))
    return written(rows, "vectors")


def matrix(column: pa.Array | pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Vectors by dimension: their places in the column and their components as rows."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = whole.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = whole.flatten().to_numpy()
    first = np.cumsum(lengths) - lengths
    found = {}
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        found[n] = at, flat[first[at][:, None] + np.arange(n)]
    return found


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments, times the root of their length: the inner product of two such rows is the bound on the score."""
    n = x.shape[1]
    parts = min(segments, n)
    if not parts:
        return np.zeros((len(x), 0))
    start = np.arange(parts) * n // parts
    length = np.diff(np.append(start, n))
    total = np.add.reduceat(x, start, axis=1)
    squares = np.add.reduceat(x * x, start, axis=1)
    mean = total / length
    deviation = np.sqrt(np.maximum(0.0, squares / length - mean * mean))
    return np.concatenate((mean, deviation), axis=1) * np.sqrt(np.concatenate((length, length)))


@dataclass
class Best:
    """The k best scores of each query so far, best first; places without one have the lowest score there is."""

    score: np.ndarray
    id: np.ndarray
    row: np.ndarray

    @classmethod
    def none(cls, queries: int, k: int) -> Best:
        return cls(np.full((queries, k), np.iinfo(np.int64).min), np.full((queries, k), NO_ID), np.full((queries, k), -1))

    def part(self, at: slice) -> Best:
        """Some of the queries; what is added to them is added here."""
        return Best(self.score[at], self.id[at], self.row[at])

    def least(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Pairs to be ranked with what is held of their queries."""
        touched = np.unique(query)
        if not len(touched):
            return
        k = self.score.shape[1]
        q = np.concatenate((np.repeat(touched, k), query))
        s, i, r = (np.concatenate((held[touched].ravel(), new)) for held, new in ((self.score, score), (self.id, ids), (self.row, rows)))
        order = np.lexsort((r, i, ~s, q))
        take = order[np.searchsorted(q[order], touched)[:, None] + np.arange(k)]
        self.score[touched], self.id[touched], self.row[touched] = s[take], i[take], r[take]


def pair_sums(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of chosen pairs of rows, some at a time."""
    out = np.empty(len(i), a.dtype)
    for lo in range(0, len(i), 65_536):
        at = slice(lo, lo + 65_536)
        out[at] = np.einsum("ij,ij->i", a[i[at]], b[j[at]])
    return out


@dataclass
class Block:
    """Queries of one dimension with their statistics."""

    whole: np.ndarray
    rows: np.ndarray
    wide: np.ndarray
    square: np.ndarray
    levels: list[np.ndarray]

    @classmethod
    def of(cls, x: np.ndarray, rows: np.ndarray, config: SearchConfig) -> Block:
        wide = x.astype(np.float64)
        return cls(x, rows, wide, (wide * wide).sum(axis=1), [statistics(wide, n) for n in config.levels])

    def part(self, at: slice) -> Block:
        return Block(self.whole[at], self.rows[at], self.wide[at], self.square[at], [level[at] for level in self.levels])


def search_tile(block: Block, best: Best, tile: Block, ids: np.ndarray, config: SearchConfig) -> list[int]:
    """Ranks the vectors of ``tile`` for the queries of ``block``; returns the pairs left at each level, the first being all."""
    n = tile.whole.shape[1]
    largest = max(int(np.abs(block.whole).max(initial=0)), int(np.abs(tile.whole).max(initial=0)))
    if largest >= 2**52 or largest * largest * max(n, 1) >= 2**63:
        raise OverflowError("components too large for 64-bit scores")
    small = largest * largest * max(n, 1) < 2**53
    least = best.least().astype(np.float64)
    left = [len(block.rows) * len(tile.rows)]
    i = j = None
    for own, other in zip(block.levels, tile.levels, strict=True):
        # What rounding may take from a bound is far below the slack.
        if i is None:
            keep = own @ other.T + (1e-9 * (block.square[:, None] + tile.square[None, :]) + 1) >= least[:, None]
            left.append(int(keep.sum()))
            if left[-1] <= config.dense * keep.size:
                i, j = np.nonzero(keep)
        else:
            keep = pair_sums(own, other, i, j) + (1e-9 * (block.square[i] + tile.square[j]) + 1) >= least[i]
            i, j = i[keep], j[keep]
            left.append(len(i))
    if i is None:
        every = np.rint(block.wide @ tile.wide.T).astype(np.int64) if small else block.whole @ tile.whole.T
        i, j = np.nonzero(keep & (every >= best.least()[:, None]) if config.levels else every >= best.least()[:, None])
        found = every[i, j]
    else:
        found = np.rint(pair_sums(block.wide, tile.wide, i, j)).astype(np.int64) if small else pair_sums(block.whole, tile.whole, i, j)
    good = (found >= best.least()[i]) & (block.rows[i] != tile.rows[j])
    best.add(i[good], found[good], ids[j[good]], tile.rows[j[good]])
    return left


def blocks_of(queries: DataFrame, config: SearchConfig) -> list[DataFrame]:
    """The queries in parts of bounded bytes."""
    sized = running_totals(queries.withColumn("_bytes", 8 * F.size("_v") + 64), [F.col("_row")], {"_upto": F.col("_bytes")})
    numbered = written(sized.withColumn("_block", F.expr(f"_upto div {config.block_bytes}")), "queries")
    found = sorted(r[0] for r in numbered.select("_block").distinct().collect())
    return [numbered.filter(F.col("_block") == b) for b in found]


def top_k(vectors: DataFrame, is_query, config: SearchConfig = SearchConfig()) -> DataFrame:
    """query_id, rank, vec_id, score: the best of ``vectors`` for each of them that ``is_query`` (an expression over vec_id) names."""
    rows = quantised(vectors, config)
    spark = vectors.sparkSession
    found = None
    for block in blocks_of(rows.filter(is_query), config):
        asked = block.select("vec_id", "_row", "_v").toArrow()
        names = asked.column("vec_id").to_numpy()
        numbers = asked.column("_row").to_numpy()
        shared = spark.sparkContext.broadcast({n: (names[at], numbers[at], x) for n, (at, x) in matrix(asked.column("_v")).items()})

        def search(parts: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            held = {n: (q, Block.of(x, r, config), Best.none(len(x), config.k)) for n, (q, r, x) in shared.value.items()}
            step = 4 * config.tile
            for part in parts:
                ids = part.column("vec_id").fill_null(NO_ID).to_numpy()
                own = part.column("_row").to_numpy()
                for n, (at, x) in matrix(part.column("_v")).items():
                    if n not in held:
                        continue
                    _, asked, best = held[n]
                    for lo in range(0, len(at), config.tile):
                        one = at[lo : lo + config.tile]
                        tile = Block.of(x[lo : lo + config.tile], own[one], config)
                        for first in range(0, len(asked.rows), step):
                            some = slice(first, first + step)
                            search_tile(asked.part(some), best.part(some), tile, ids[one], config)
            for q, asked, best in held.values():
                i, j = np.nonzero(best.row >= 0)
                missing = best.id[i, j] == NO_ID
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q[i]), pa.array(asked.rows[i]), pa.array(best.id[i, j], mask=missing), pa.array(best.row[i, j]), pa.array(best.score[i, j])], names=["query_id", "_query", "vec_id", "_row", "score"]
                )

        one = rows.mapInArrow(search, "query_id long, _query long, vec_id long, _row long, score long")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("_query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "_row"))
    return found.withColumn("rank", place).filter(F.col("rank") <= config.k).select("query_id", "rank", "vec_id", "score")
