"""Running totals over orders too long for one task, and the hot-entity helpers built on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accesslens.session import written


@dataclass(frozen=True)
class SkewConfig:
    """Sizes that decide when one entity is too long for one task.

    hot_rows    an entity with more rows is processed in blocks
    block_rows  rows per block of a hot entity
    salts       copies of a hot key's build row in a join
    """

    hot_rows: int = 2_000_000
    block_rows: int = 500_000
    salts: int = 64

    def __post_init__(self) -> None:
        if self.block_rows < 16 or self.hot_rows < self.block_rows or self.salts < 1:
            raise ValueError("need hot_rows >= block_rows >= 16 and salts >= 1")


def running_totals(
    df: DataFrame, order: list[Column], sums: dict[str, Column], group: tuple[str, ...] = ()
) -> DataFrame:
    """Inclusive running sums in a total order, without sending a group to one task.

    Rows are range-partitioned by (group, order), so a large group spreads over
    many partitions and a tie is split like anything else. Each partition's
    totals (one row per partition and group) are prefix-summed and added to the
    sums inside the partition. ``order`` must be unique within a group.
    """
    group_cols = [F.col(name) for name in group]
    ranged = written(
        df.select("*", *[expr.cast("long").alias(f"_add_{name}") for name, expr in sums.items()])
        .repartitionByRange(*group_cols, *order)
        .withColumn("_slice", F.spark_partition_id()),
        "ranged",
    )
    slices = ranged.groupBy(*group, "_slice").agg(*[F.sum(f"_add_{name}").alias(f"_add_{name}") for name in sums])
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select(
        slot(*group, "_slice").alias("_slot"), *[F.coalesce(F.sum(f"_add_{name}").over(before), F.lit(0)).alias(f"_off_{name}") for name in sums]
    )
    # One column for both, so that the join finds the rows where the window has them.
    inside = Window.partitionBy("_slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.select("*", slot(*group, "_slice").alias("_slot")).select("*", *[F.sum(f"_add_{name}").over(inside).alias(f"_in_{name}") for name in sums])
    return local.join(offsets, "_slot").select(
        *df.columns, *[(F.col(f"_in_{name}") + F.col(f"_off_{name}")).alias(name) for name in sums]
    )


def quantiles(df: DataFrame, value: str, points: dict[str, float]) -> DataFrame:
    """Interpolated quantiles of any number of distinct values, as one row."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_c"))
    cumulative = running_totals(counts, [F.col(value)], {"_upto": F.col("_c")})
    total = cumulative.select(F.max("_upto")).scalar()
    ranked = cumulative.select(value, "_upto", total.alias("_n"))
    edges = []
    for name, point in points.items():
        position = F.lit(point) * (F.col("_n") - 1)
        edges += [
            F.min(F.when(F.col("_upto") > F.floor(position), F.col(value))).alias(f"_lo_{name}"),
            F.min(F.when(F.col("_upto") > F.ceil(position), F.col(value))).alias(f"_hi_{name}"),
            F.max(position - F.floor(position)).alias(f"_f_{name}"),
        ]
    row = ranked.agg(*edges)
    return row.select(
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n)
            for n in points
        ]
    )


def hot_keys(df: DataFrame, key: str, config: SkewConfig) -> DataFrame | None:
    """Keys with more than ``hot_rows`` rows, or None when there are none.

    One pass over one column with partial aggregation. The result has at most
    rows/hot_rows entries and is a written table, so that later joins know its
    true size and broadcast it only below the session's threshold.
    """
    counts = df.groupBy(key).agg(F.count("*").alias("_rows"))
    longest = counts.agg(F.max("_rows")).first()[0]
    if longest is None or longest <= config.hot_rows:
        return None
    return written(counts.filter(F.col("_rows") > config.hot_rows).select(key), "hot")


def split_hot(df: DataFrame, key: str, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of ordinary keys, rows of hot keys)."""
    return df.join(hot, key, "left_anti"), df.join(hot, key, "left_semi")


def ranked(
    df: DataFrame, key: str, order: list[str], config: SkewConfig, hot: DataFrame | None, name: str = "_rn"
) -> DataFrame:
    """1-based position of each row within its key, in a unique order."""
    position = F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long").alias(name)
    if hot is None:
        return df.select("*", position)
    cold_rows, hot_rows = split_hot(df, key, hot)
    return cold_rows.select("*", position).unionByName(
        running_totals(hot_rows, [F.col(c) for c in order], {name: F.lit(1)}, (key,))
    )


def with_context(df: DataFrame, rank: str, config: SkewConfig, before: int = 0, after: int = 0) -> DataFrame:
    """Cut each key into blocks of ``block_rows`` ranks and copy edge rows into the neighbour block.

    Adds ``_block`` and ``_copy``. A window over (key, _block) that looks at most
    ``before`` rows back or ``after`` rows ahead then sees what a window over the
    whole key would see, for rows with ``_copy`` false. Keys within one block get
    no copies.
    """
    size = F.lit(config.block_rows)
    place = (F.col(rank) - 1) % size
    home = F.floor((F.col(rank) - 1) / size)
    placed = [F.struct(home.alias("b"), F.lit(False).alias("copy"))]
    if before:
        placed.append(F.when(place >= size - before, F.struct((home + 1).alias("b"), F.lit(True).alias("copy"))))
    if after:
        placed.append(F.when((place < after) & (home > 0), F.struct((home - 1).alias("b"), F.lit(True).alias("copy"))))
    if len(placed) == 1:
        return df.select("*", home.alias("_block"), F.lit(False).alias("_copy"))
    spread = df.withColumn("_at", F.explode(F.filter(F.array(*placed), lambda p: p.isNotNull())))
    return spread.select(*df.columns, F.col("_at.b").alias("_block"), F.col("_at.copy").alias("_copy"))


def hot_by_history(engineered: DataFrame, key: str, config: SkewConfig) -> DataFrame | None:
    """Hot keys of a table that carries ``history_length``; the filter reaches the scan."""
    hot = engineered.filter(F.col("history_length") >= config.hot_rows).select(key).distinct()
    return None if hot.isEmpty() else written(hot, "hot")


def slot(*parts: Column | str) -> Column:
    """One column that stands for several, such as a key and its block number.

    Joins that must not fall back to the placement by key alone use it: rows
    hashed by the key do not count as hashed by its slots.
    """
    return F.concat_ws("#", *[F.col(p) if isinstance(p, str) else p for p in parts])


def add_salt(df: DataFrame, key: str, spread: str, config: SkewConfig, hot: DataFrame | None) -> DataFrame:
    """``_slot``: which of the reducers of a hot key takes the row; one slot for an ordinary key."""
    if hot is None:
        return df
    marked = df.join(hot.withColumn("_hot", F.lit(True)), key, "left")
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(config.salts))).otherwise(0)
    return marked.withColumn("_slot", slot(key, salt)).drop("_hot").repartition("_slot")


def skew_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    key: str,
    config: SkewConfig,
    hot: DataFrame | None,
    how: str = "left",
) -> DataFrame:
    """Join in which rows of hot keys, marked by ``add_salt``, are spread over many reducers.

    The right side is unique per ``keys``; only its rows for hot keys are copied,
    once per salt. Without hot keys this is a plain join.
    """
    if hot is None:
        return left.join(right, keys, how)
    every = F.sequence(F.lit(0), F.lit(config.salts - 1))
    copies = (
        right.join(hot.withColumn("_hot", F.lit(True)), key, "left")
        .withColumn("_salt", F.explode(F.when(F.col("_hot"), every).otherwise(F.array(F.lit(0)))))
        .withColumn("_slot", slot(key, "_salt"))
        .drop("_hot", "_salt", key)
    )
    return left.join(copies, ["_slot", *[k for k in keys if k != key]], how)
