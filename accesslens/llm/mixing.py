"""Mixing sources to target weights by entropy balancing.

Each document gets a rate between 0 and ``most`` copies. Among all rates that
give every source its target of words, the ones of greatest entropy (against a
rate in the middle of the range) are wanted. They are exponential tilts of the
document's size, odds(rate) = exp(lambda_source * size / mean size), and
lambda solves the convex dual: one smooth increasing equation per source,
solved by Newton steps inside a bracket. Rates depend on source and size only,
so the steps run on counts per (source, size), which are all the dual needs;
the state of all sources is a table and never leaves Spark.

Rates become whole copies in order of size: running sums of the expected
copies are rounded, which keeps a source's words within one document of its
target; a few single corrections then take up the rest. Within a (source,
size) level the copies go to documents by hash of their content.

Sums are exact decimals, so that reruns agree whatever the order of tasks.

Defined results: a null text has no words; the null source comes last; rows
without words have rate 1 (one copy); equal rows are interchangeable; an empty
table gives no rows; extra columns do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from accesslens.llm.common import WORD, row_key, text_of, written
from accesslens.operators.scan import running_totals


@dataclass(frozen=True)
class MixConfig:
    """weights: of the sources in code point order, repeating; budget: words of the mix per word of the input;
    most: copies of a document at most; steps, tolerance: of the Newton iteration; corrections: single copies moved per source;
    spread: copies of equal rows that are made at once."""

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    budget: float = 1.5
    most: int = 2
    steps: int = 40
    tolerance: float = 1e-7
    corrections: int = 4
    spread: int = 1000


EXACT = "decimal(38,10)"


def sizes(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, source, size in words, a key of the whole row and a tag. Written."""
    size = F.regexp_count(text_of(), F.lit(WORD)).cast("long")
    keyed = docs.select(F.col("doc_id"), F.col("source"), size.alias("size"), row_key(docs).alias("_key"))
    return written(keyed.withColumn("_tag", F.monotonically_increasing_id()), "sizes")


def targets(rows: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """Per source: number (by code point, null last), source_size, weight, target. Written."""
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = running_totals(sums, [F.col("source").asc_nulls_last()], {"number": F.lit(1)})
    weights = F.array(*[F.lit(float(w)) for w in config.weights])
    weighted = written(order.withColumn("weight", F.get(weights, ((F.col("number") - 1) % len(config.weights)).cast("int"))), "weights")
    cap, level = config.most * F.col("source_size"), 0.0
    full = None
    while True:  # sources whose share reaches their cap stay there; the level rises until none is above
        capped = cap <= F.col("weight") * F.lit(level)
        row = weighted.agg(
            (config.budget * F.sum("source_size")).alias("all"), F.sum(F.when(capped, cap)).alias("full"), F.sum(F.when(~capped, F.col("weight"))).alias("open"), F.sum(F.when(capped, 1)).alias("n")
        ).first()
        if not row.open or (row.n or 0) == full:
            break
        full, level = row.n or 0, (row["all"] - (row.full or 0)) / row.open
    target = F.least(cap.cast("double"), F.col("weight") * F.lit(float(level))) if row.open else cap.cast("double")
    return written(weighted.withColumn("target", target), "targets")


def tilted(levels: DataFrame, goals: DataFrame, config: MixConfig) -> DataFrame:
    """``levels`` (number, size, n) with the rate of each level that solves the dual."""
    middle = float(config.most) / 2
    mean = levels.filter("size > 0").groupBy("number").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    share = F.col("target") / (config.most * F.col("source_size"))
    state = goals.join(mean, "number").select(
        "number", "mean", "target", (F.col("target") >= config.most * F.col("source_size")).alias("all"),
        F.ln(F.greatest(share, F.lit(1e-9)) / F.greatest(1 - share, F.lit(1e-9))).alias("lam"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"),
        F.lit(1.0).alias("off"),
    )
    state = written(state, "dual")
    tilt = F.col("size") / F.col("mean")
    rate = config.most / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.col("lam") * tilt))))
    for _ in range(config.steps):
        if state.filter(~F.col("all") & (F.abs("off") > config.tolerance)).isEmpty():
            break
        words = levels.filter("size > 0").join(state, "number").groupBy("number").agg(
            F.sum((F.col("n") * F.col("size") * rate).cast(EXACT)).cast("double").alias("words"),
            F.sum((F.col("n") * F.col("size") * tilt * rate * (1 - rate / config.most)).cast(EXACT)).cast("double").alias("slope"),
        )
        over = F.col("words") - F.col("target")
        low = F.when(over < 0, F.col("lam")).otherwise(F.col("low"))
        high = F.when(over >= 0, F.col("lam")).otherwise(F.col("high"))
        stepped = F.col("lam") - F.when(F.col("slope") > 0, over / F.col("slope"))
        # Outside the bracket, or without a slope, the step halves the bracket, or leaves it while it is open.
        inside = (stepped > F.coalesce(low, F.lit(float("-inf")))) & (stepped < F.coalesce(high, F.lit(float("inf"))))
        halved = F.when(low.isNull(), high * 2 - 1).when(high.isNull(), low * 2 + 1).otherwise((low + high) / 2)
        limited = F.greatest(F.lit(-1e6), F.least(F.lit(1e6), F.when(F.coalesce(inside, F.lit(False)), stepped).otherwise(halved)))
        off = F.coalesce(F.try_divide(over, F.col("target")), F.lit(0.0))
        state = written(
            state.join(words, "number").select(
                "number", "mean", "target", "all", F.when(F.abs(off) > config.tolerance, limited).otherwise(F.col("lam")).alias("lam"), low.alias("low"), high.alias("high"), off.alias("off")
            ),
            "dual",
        )
    rated = levels.join(state.select("number", "mean", "all", "lam"), "number", "left")
    return rated.withColumn("rate", F.when(F.col("size") == 0, middle).when(F.col("all"), float(config.most)).otherwise(rate)).drop("mean", "all", "lam")


def copies_by_level(rated: DataFrame, goals: DataFrame, config: MixConfig) -> DataFrame:
    """Whole copies per (number, size) level whose words come near the targets. Written."""
    down = Window.partitionBy("number").orderBy(F.desc("size"))
    upto = F.sum((F.col("n") * F.col("rate")).cast(EXACT)).over(down)
    cut = rated.withColumn("_upto", F.floor(upto + F.lit(0.5)).cast("long"))
    levels = cut.withColumn("copies", F.least(F.col("_upto") - F.lag("_upto", 1, 0).over(down), config.most * F.col("n"))).drop("_upto", "rate")
    levels = written(levels, "levels")
    for _ in range(config.corrections):
        short = goals.select("number", "target").join(levels.groupBy("number").agg(F.sum(F.col("copies") * F.col("size")).alias("words")), "number").select("number", (F.col("target") - F.col("words")).alias("short"))
        room = F.when(F.col("short") > 0, F.col("copies") < config.most * F.col("n")).otherwise(F.col("copies") > 0)
        left = F.abs(F.abs("short") - F.col("size"))
        better = room & (left < F.abs("short")) & (F.col("size") > 0)
        moves = (
            levels.join(short, "number").filter(better).groupBy("number")
            .agg(F.min(F.struct(left.alias("left"), F.col("size"), F.signum("short").cast("long").alias("by"))).alias("_m"))
            .select("number", F.col("_m.size").alias("size"), F.col("_m.by").alias("_by"))
        )
        levels = written(levels.join(moves, ["number", "size"], "left").withColumn("copies", F.col("copies") + F.coalesce("_by", F.lit(0))).drop("_by"), "levels")
    return levels


def mix(docs: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target, copies, taken, and ``_key``, a key of the whole row."""
    rows = sizes(docs)
    goals = targets(rows, config)
    numbered = rows.join(goals.select("number", F.col("source").alias("_source"), "source_size", "target"), F.col("source").eqNullSafe(F.col("_source")))
    levels = written(numbered.groupBy("number", "size").agg(F.count("*").alias("n")), "histogram")
    copies = copies_by_level(tilted(levels, goals, config), goals, config)
    narrow = numbered.select("number", "size", "source_size", "target", "doc_id", "_key", F.xxhash64("_key").alias("_hash"), "_tag")
    placed = running_totals(narrow, [F.col("_hash"), F.col("_tag")], {"_at": F.lit(1)}, ("number", "size"))
    each = (F.expr("copies div n") + F.when(F.col("_at") <= F.col("copies") % F.col("n"), 1).otherwise(0)).cast("long")
    return placed.join(copies, ["number", "size"]).select(
        "doc_id", "size", "source_size", "target", each.alias("copies"), (each * F.col("size")).alias("taken"), "_key"
    )


def mixed(docs: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``mix`` takes it, with the columns it came with."""
    wanted = written(mix(docs, config).groupBy("_key").agg(F.sum("copies").alias("_n")).filter("_n > 0"), "wanted")
    once = docs.select(F.struct("*").alias("_row"), row_key(docs).alias("_key")).join(wanted, "_key")
    # Equal rows have one key; together they share its copies. Many copies are made by many tasks, some at a time.
    first = once.dropDuplicates(["_key"])
    few = first.filter(F.col("_n") <= config.spread)
    if not wanted.filter(F.col("_n") > config.spread).isEmpty():
        parts = F.explode(F.sequence(F.lit(0), F.expr(f"(_n - 1) div {config.spread}"))).alias("_part")
        many = first.filter(F.col("_n") > config.spread).select("_row", "_key", "_n", parts).repartition("_key", "_part")
        few = few.select("_row", "_n").unionByName(many.select("_row", F.least(F.lit(config.spread), F.col("_n") - F.col("_part") * config.spread).alias("_n")))
    return few.select("_row", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_copy")).select("_row.*")
