"""Column expressions and joins shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from accesslens.session import written

#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of a side that may be broadcast; every caller counts the side first.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """``text`` with A to Z in lower case and all else as it is."""
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """The words of a text that is not null; no words for a blank one."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))


def row_key(df: DataFrame) -> Column:
    """A 128-bit key of all columns: equal for equal rows only."""
    plain = [F.to_json(F.struct(F.col(f"`{c}`"))) if kind.startswith(("map", "variant")) else F.col(f"`{c}`") for c, kind in df.dtypes]
    # Each value goes in with its null flag: the hash skips nulls.
    every = [x for c in plain for x in (c, c.isNull())]
    return F.struct(F.xxhash64(*every).alias("a"), F.xxhash64(F.lit(7), *every).alias("b"))


def sized(small: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``small``, a written table, hinted for broadcast if it has at most ``rows`` rows; else as it is, for a shuffled join."""
    return F.broadcast(small) if small.limit(rows + 1).count() <= rows else small


__all__ = [
    "BROADCAST_ROWS", "GAP", "LOWER", "SPACES", "UPPER", "WORD", "lower_ascii", "row_key", "sized", "table", "text_of", "words_of", "written",
]
