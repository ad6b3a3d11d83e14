"""Exact dedup by a heavy-hitter split.

A Misra-Gries pass (Spark's frequent-items sketch) over the digests names the
candidates for frequent texts. Their true counts are then taken, and the at
most ``candidates`` verified ones are broadcast: rows with such a digest are
decided where they are, without a shuffle. All other digests are shuffled; by
the sketch's guarantee none of them is a large share of the rows.

Defined results: a null text counts as empty; rows equal in text and id are
still separate rows, of which one is kept; null ids lose against any other; an
empty table gives no rows; extra columns do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accesslens.llm.common import lower_ascii, text_of, written


@dataclass(frozen=True)
class HeavyHitters:
    """candidates: frequent digests at most, which bounds the broadcast; counters: items the sketch holds;
    copies: fewer are left to the shuffle."""

    candidates: int = 1024
    counters: int = 8192
    copies: int = 64


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row its id, the digest of its normalised text and a tag that tells equal rows apart. Written, so that tags stay."""
    sha = F.sha2(lower_ascii(text_of(text)).cast("binary"), 256)
    return written(docs.select(F.col(doc_id).alias("doc_id"), sha.alias("text_sha256")).withColumn("_tag", F.monotonically_increasing_id()), "digests")


def frequent_digests(rows: DataFrame, config: HeavyHitters = HeavyHitters()) -> DataFrame:
    """The verified frequent digests with their winning row and true count: at most ``config.candidates`` rows."""
    top = rows.agg(F.expr(f"approx_top_k(text_sha256, {config.candidates}, {config.counters})").alias("_top"))
    names = top.select(F.explode("_top.item").alias("text_sha256"))
    counted = rows.join(F.broadcast(names), "text_sha256").groupBy("text_sha256").agg(*[f.alias(n) for n, f in _winner().items()])
    return written(counted.filter(F.col("group_size") >= config.copies), "frequent")


def _winner() -> dict[str, Column]:
    return {"_win": F.max(F.struct("doc_id", "_tag")), "group_size": F.count("*")}


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", config: HeavyHitters = HeavyHitters()) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256. Of equal texts the row with the largest id is kept."""
    rows = digests(docs, doc_id, text)
    frequent = F.broadcast(frequent_digests(rows, config))
    hot = rows.join(frequent, "text_sha256")
    group = Window.partitionBy("text_sha256")
    rest = rows.join(frequent.select("text_sha256"), "text_sha256", "left_anti")
    cold = rest.select("*", *[f.over(group).alias(n) for n, f in _winner().items()])
    return hot.unionByName(cold).select(
        "doc_id", F.col("_win.doc_id").alias("keep_id"), "group_size", (F.col("_tag") == F.col("_win._tag")).alias("kept"), "text_sha256"
    )


def survivors(docs: DataFrame, decisions: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``decisions`` keeps, one per digest, with all columns as they came."""
    rows = docs.select(F.struct("*").alias("_row"), F.col(doc_id).alias("_id"), F.sha2(lower_ascii(text_of(text)).cast("binary"), 256).alias("_sha"))
    kept = decisions.filter("kept").select(F.col("doc_id").alias("_keep"), F.col("text_sha256").alias("_keep_sha"))
    once = rows.join(kept, (F.col("_sha") == F.col("_keep_sha")) & F.col("_id").eqNullSafe(F.col("_keep"))).dropDuplicates(["_sha"])
    return once.select("_row.*")
