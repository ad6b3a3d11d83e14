"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents are long, so a MinHash of a whole document
says nothing about an item inside it. Instead the items are partitioned by
size (their number of shingles), and each keeps the shingles with the smallest
hash values, its bottom-k sketch, with k chosen per size class so that an item
contained to ``containment`` must show at least ``hits`` of its sketch in the
document: of n shingles at most n - ceil(containment * n) may be missing, so
k = missing + hits is enough, and no contained item is lost. Documents are
probed with every shingle of the whole text against these sketches. What
reaches the hits is a candidate, and candidates are verified by the exact
containment of the full shingle sets, compared as text.

Shingles are five words of the text in lower case (A to Z); fewer words make
one shingle of the whole sequence.

Defined results: null and blank texts or items have no shingles and match
nothing; equal items with one id count once; rows of equal id and text give
one result; a null document id is kept as null; an empty table gives no rows;
extra columns do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accesslens.llm.common import lower_ascii, sized, text_of, words_of, written


@dataclass(frozen=True)
class ContainmentConfig:
    """width: words in a shingle; containment: share of an item's shingles in the document; hits: sketch members a
    candidate must show; classes: upper ends of the size partitions, in shingles, with one more above the last."""

    width: int = 5
    containment: float = 0.8
    hits: int = 2
    classes: tuple[int, ...] = (8, 16, 32, 64, 128, 256, 512, 1024)


def shingle_rows(df: DataFrame, keep: list[str], width: int) -> DataFrame:
    """One row per shingle position: ``keep``, ``_hash`` of the shingle and ``_at``. ``_words`` is the whole sequence."""
    split = df.select(*keep, words_of(lower_ascii(text_of())).alias("_words")).filter(F.size("_words") > 0)
    last = F.greatest(F.size("_words") - width, F.lit(0))
    spread = split.select("*", F.explode(F.sequence(F.lit(0), last)).alias("_at"))
    parts = [F.get("_words", F.col("_at") + i) for i in range(width)]
    return spread.withColumn("_hash", F.xxhash64(*parts))


def shingle_text(width: int) -> Column:
    """The shingle at ``_at`` as text."""
    return F.array_join(F.slice("_words", F.col("_at") + 1, width), " ")


def item_shingles(benchmark: DataFrame, config: ContainmentConfig) -> DataFrame:
    """The distinct shingles of each item: item_id, _hash, _text, n (set size) and rank by hash value. Written."""
    items = benchmark.select(F.col("item_id").alias("item_id"), F.col("text"))
    each = shingle_rows(items, ["item_id"], config.width).select("item_id", "_hash", shingle_text(config.width).alias("_text")).distinct()
    by_item = F.sort_array(F.collect_set(F.struct("_hash", "_text")))  # as long as one item
    listed = each.groupBy("item_id").agg(by_item.alias("_all"))
    return written(
        listed.select("item_id", F.size("_all").alias("n"), F.posexplode("_all").alias("_rank", "_s")).select("item_id", "n", "_rank", "_s._hash", "_s._text"), "items"
    )


def sketches(items: DataFrame, config: ContainmentConfig) -> DataFrame:
    """The sketch of each item: its first k shingles by hash value, k by size class, with the hits it must show."""
    ends = [*config.classes, 2**31 - 1]
    top = F.element_at(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e >= F.col("n")), 1)
    # A class keeps as many members as its largest item needs.
    missing = top - F.ceil(F.lit(config.containment) * top - F.lit(1e-9))
    kept = items.withColumn("_class", top).withColumn("_k", F.least(F.col("n").cast("long"), missing + config.hits))
    own = F.col("n") - F.ceil(F.lit(config.containment) * F.col("n") - F.lit(1e-9))
    need = F.greatest(F.lit(1), F.least(F.lit(config.hits), F.col("_k") - own))
    return kept.withColumn("_need", need.cast("int")).filter(F.col("_rank") < F.col("_k")).select("item_id", "_class", "_hash", "_need")


def candidates(docs: DataFrame, items: DataFrame, config: ContainmentConfig) -> DataFrame:
    """Pairs of a document (``_id`` and ``_text_key``) and an item that reach the hits. Written."""
    probes = written(sketches(items, config), "sketches")
    keyed = docs.select(F.col("doc_id").alias("_id"), F.xxhash64(text_of()).alias("_text_key"), F.col("text"))
    found = shingle_rows(keyed, ["_id", "_text_key"], config.width).select("_id", "_text_key", "_hash").join(sized(probes), "_hash")
    once = found.groupBy("_id", "_text_key", "item_id").agg(F.size(F.collect_set("_hash")).alias("_hits"), F.first("_need").alias("_need"))
    return written(once.filter(F.col("_hits") >= F.col("_need")).select("_id", "_text_key", "item_id"), "candidates")


def contained(docs: DataFrame, benchmark: DataFrame, config: ContainmentConfig = ContainmentConfig()) -> DataFrame:
    """Verified pairs: doc_id, text_key, item_id, shared and total shingles of the item, containment."""
    items = item_shingles(benchmark, config)
    pairs = candidates(docs, items, config)
    ids = written(pairs.select("_id", "_text_key").distinct(), "candidate_docs")
    keyed = docs.select(F.col("doc_id").alias("_id"), F.xxhash64(text_of()).alias("_text_key"), F.col("text"))
    wanted = sized(ids.withColumnsRenamed({"_id": "_want", "_text_key": "_want_key"}))
    texts = keyed.join(wanted, F.col("_id").eqNullSafe(F.col("_want")) & (F.col("_text_key") == F.col("_want_key")), "left_semi")
    rows = shingle_rows(texts, ["_id", "_text_key"], config.width).select("_id", "_text_key", "_hash", shingle_text(config.width).alias("_text"))
    hits = rows.join(sized(items.select("item_id", "n", "_hash", F.col("_text").alias("_item_text"))), "_hash").filter(F.col("_text") == F.col("_item_text"))
    shared = hits.groupBy("_id", "_text_key", "item_id", "n").agg(F.size(F.collect_set("_hash")).alias("shared"))
    asked = pairs.withColumnsRenamed({"_id": "_want", "_text_key": "_want_key", "item_id": "_want_item"})
    same = F.col("_id").eqNullSafe(F.col("_want")) & (F.col("_text_key") == F.col("_want_key")) & F.col("item_id").eqNullSafe(F.col("_want_item"))
    return shared.join(asked, same, "left_semi").filter(F.col("shared") >= config.containment * F.col("n") - 1e-9).select(
        F.col("_id").alias("doc_id"), F.col("_text_key").alias("text_key"), "item_id", F.col("shared").cast("long"), F.col("n").cast("long").alias("total"), (F.col("shared") / F.col("n")).alias("containment"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, config: ContainmentConfig = ContainmentConfig()) -> DataFrame:
    """``docs`` without the documents that contain a test item, with the columns they came with."""
    bad = written(contained(docs, benchmark, config).select(F.col("doc_id").alias("_bad"), F.col("text_key").alias("_bad_key")).distinct(), "contaminated")
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64(text_of()).alias("_text_key"))
    return rows.join(sized(bad), F.col("_id").eqNullSafe(F.col("_bad")) & (F.col("_text_key") == F.col("_bad_key")), "left_anti").select("_row.*")
