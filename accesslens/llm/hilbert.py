"""Sharding by Hilbert-curve order.

Each metadata dimension is cut into 2^bits bins at its quantiles, the bins are
the coordinates of a cell, and rows are sorted by the cell's index on the
Hilbert curve. Equal runs of that order are the shards, so that each shard
covers a small range in every dimension and readers can skip files by any of
them. The order is total (index, text checksum, id, row tag), so many rows in
one cell spread over range partitions like any others, and equal texts with
equal metadata lie side by side.

Defined results: a null text has no bytes; null or blank metadata is the lowest
bin; ties and repeated rows are ordered by a tag given once; an empty table
gives no rows; columns that are not used may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accesslens.llm.common import row_key, text_of, written
from accesslens.operators.scan import running_totals


@dataclass(frozen=True)
class HilbertConfig:
    """shards: runs; bits: bins per dimension are 2^bits; accuracy: of the quantiles that cut the bins."""

    shards: int = 16
    bits: int = 6
    accuracy: int = 10_000


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of ``cells`` (rows x dimensions, below 2^bits each)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:  # undo the rotations of each level
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    index = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            index = (index << 1) | ((x[i] >> bit) & 1)
    return index


def default_dimensions() -> dict[str, Column]:
    """Source, language, length and id; a text counts by its rank among the values that occur."""
    return {"source": F.col("source"), "lang": F.col("lang"), "length": F.octet_length(text_of()).cast("long"), "id": F.col("doc_id").cast("long")}


def by_rank(rows: DataFrame, dim: str) -> DataFrame:
    """``rows``, a written table, with the texts of a column replaced by their rank; null and blank come first, as one."""
    named = F.coalesce(F.col(dim), F.lit(""))
    ranks = running_totals(rows.groupBy(named.alias("_value")).agg(F.lit(1).alias("_one")), [F.col("_value")], {"_place": F.lit(1)})
    return rows.withColumn("_value", named).join(ranks.select("_value", "_place"), "_value").drop("_value", dim).withColumnRenamed("_place", dim)


def with_index(rows: DataFrame, dims: list[str], config: HilbertConfig) -> DataFrame:
    """``rows`` with ``_hilbert``; ``dims`` are numeric columns of a written table."""
    points = [i / 2**config.bits for i in range(1, 2**config.bits)]
    cuts = rows.agg(*[F.percentile_approx(d, points, config.accuracy).alias(d) for d in dims]).first()
    edges = [np.unique(np.array(cuts[d] if cuts[d] is not None else [], dtype=np.int64)) for d in dims]
    bits = config.bits

    @F.pandas_udf("long")
    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for part in batches:
            cells = np.stack([np.searchsorted(e, part[c].to_numpy(), side="right") for e, c in zip(edges, part.columns, strict=True)], axis=1)
            yield pd.Series(hilbert_index(cells, bits))

    lowest = F.lit(-(2**63)).cast("long")
    return rows.withColumn("_hilbert", index(F.struct(*[F.coalesce(F.col(d), lowest).alias(d) for d in dims])))


def hilbert_shards(docs: DataFrame, config: HilbertConfig = HilbertConfig(), dimensions: dict[str, Column] | None = None, whole_rows: bool = True) -> DataFrame:
    """Each row of ``docs`` with its place: shard, slot (from 0 within the shard) and curve index.

    The result has ``doc_id``, ``size`` (bytes of the text plus 1), ``text_crc32``, ``hilbert``, ``shard``, ``slot``
    and, with ``whole_rows``, the row itself as the struct ``row``. Shards differ by one row at most.
    """
    dims = dimensions or default_dimensions()
    text = text_of().cast("binary")
    rows = written(
        docs.select(
            row_key(docs).alias("_key"), F.col("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
            *[c.alias(f"_d_{n}") for n, c in dims.items()],
        ).withColumn("_tag", F.monotonically_increasing_id()),
        "metadata",
    )
    total = rows.count()
    texts = [c for c, kind in rows.dtypes if c.startswith("_d_") and kind == "string"]
    if texts:
        for dim in texts:
            rows = by_rank(rows, dim)
        rows = written(rows, "metadata")
    placed = with_index(rows, [f"_d_{n}" for n in dims], config).drop(*[f"_d_{n}" for n in dims])
    order = [F.col("_hilbert"), F.col("text_crc32"), F.col("doc_id"), F.col("_tag")]
    ranked = running_totals(placed, order, {"_rank": F.lit(1)}).withColumn("_at", F.col("_rank") - 1)
    shard = F.expr(f"(_at * {config.shards}) div {max(total, 1)}")
    first = F.expr(f"(shard * {total} + {config.shards - 1}) div {config.shards}")
    placed = ranked.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("_at") - first)
    found = placed.select("_key", "doc_id", "size", "text_crc32", F.col("_hilbert").alias("hilbert"), "shard", "slot")
    if not whole_rows:
        return found.drop("_key")
    # Only narrow rows were sorted. Whole rows move once, one of each kind of equal rows, and meet all its places.
    once = docs.select(F.struct("*").alias("row"), row_key(docs).alias("_key")).dropDuplicates(["_key"])
    return once.join(written(found, "places"), "_key").drop("_key")


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder per shard, files in slot order; a large shard is several files. ``placed`` comes from ``hilbert_shards`` with whole rows."""
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
