"""Chat formatting in budgeted windows.

A conversation becomes windows of whole turns. Prefix sums of the turns'
tokens give every turn its place; spans are cut greedily where the next turn
would leave the budget. Each window after the first repeats the system turn
and as many of the turns just before it as fit ``history`` tokens; repeated
turns are context only, so the loss mask covers the text of every assistant
turn exactly once.

A conversation may be of any length: prefix sums are distributed, the greedy
cut runs inside blocks of ``block`` budgets, and the last ``history`` tokens of
a block are copied to the next one. No list is longer than a block.

Marked up, a turn is ``<|im_start|>role\\ntext<|im_end|>\\n``, a window is
``<s>`` turns ``</s>``. Control strings inside texts get a backslash after
their first character (or one more, if there are some), which ``unescape``
takes away again; roles are URL-encoded.

Defined results: null roles and texts are empty; rows follow turn (null
first), then role, then text; equal rows are separate turns; the null conv_id
is a conversation of its own; the system turn is a first row with that role;
a turn longer than the budget is a window of its own and never cut
(``over_budget``); an empty table gives no rows; extra columns do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accesslens.operators.scan import running_totals

BEGIN, END, OPEN, CLOSE = "<s>", "</s>", "<|im_start|>", "<|im_end|>\n"
#: What follows the first character of a control string: of this template and of other common ones.
CONTROL = r"(/?s>|\|im_start\|>|\|im_end\|>|\|endoftext\|>|</?SYS>>|/?INST\])"
#: A token: a run of letters and digits, or any other character that is not blank.
TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
MARKERS = 4


@dataclass(frozen=True)
class WindowConfig:
    """budget: tokens of a window; history: tokens repeated at most, besides the system turn; block: budgets cut together."""

    budget: int = 2048
    history: int = 256
    block: int = 16


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + CONTROL, "$1$2$3")


def turns(conversations: DataFrame) -> DataFrame:
    """Every turn with its tokens, its running total and its 1-based position."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    rows = conversations.select(
        F.col("conv_id"), F.col("turn").alias("_turn"), F.url_encode(role).alias("_role"), escape(text).alias("_body"),
        (F.regexp_count(text, F.lit(TOKEN)) + MARKERS).cast("long").alias("_tokens"), F.xxhash64(role, text).alias("_hash"), F.monotonically_increasing_id().alias("_tag"),
    )
    order = [F.col("_turn").asc_nulls_first(), F.col("_role"), F.col("_hash"), F.col("_tag")]
    return running_totals(rows, order, {"_upto": F.col("_tokens"), "_nth": F.lit(1)}, ("conv_id",)).withColumn("_start", F.col("_upto") - F.col("_tokens"))


def blocks(rows: DataFrame, config: WindowConfig) -> DataFrame:
    """One row per conversation and block: its turns and the copied ones before them in order, the system turn, the room for new turns."""
    length = config.budget * config.block
    first = rows.filter((F.col("_nth") == 1) & (F.col("_role") == "system")).select(F.col("conv_id").alias("_conv"), F.struct("_role", "_body").alias("_system"), F.col("_tokens").alias("_system_tokens"))
    home = F.expr(f"_start div {length}")
    # The next block begins at (home + 1) * length or later.
    later = F.when(F.col("_start") >= (home + 1) * length - config.history, home + 1)
    places = F.array_compact(F.array(F.struct(home.alias("b"), F.lit(False).alias("copy")), F.when(later.isNotNull(), F.struct(later.alias("b"), F.lit(True).alias("copy")))))
    spread = rows.withColumn("_at", F.explode(places)).withColumn("_block", F.col("_at.b"))
    turn = F.struct("_nth", "_start", "_tokens", "_role", "_body", F.col("_at.copy").alias("_copy"))
    grouped = spread.groupBy("conv_id", "_block").agg(F.sort_array(F.collect_list(turn)).alias("_turns"))
    joined = grouped.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    room = F.greatest(F.lit(config.budget - config.history) - F.coalesce("_system_tokens", F.lit(0)), F.lit(config.budget // 4))
    return joined.withColumn("_room", room)


def cuts(config: WindowConfig) -> Column:
    """The positions in a block at which windows begin, chosen by the prefix sums."""
    own = F.transform(F.filter("_turns", lambda t: ~t["_copy"]), lambda t: F.struct(t["_nth"].alias("n"), t["_start"].alias("s"), (t["_start"] + t["_tokens"]).alias("e")))
    none = F.struct(F.lit(None).cast("long").alias("from"), F.array().cast("array<struct<n:bigint,s:bigint>>").alias("found"))

    def step(acc: Column, t: Column) -> Column:
        new = acc["from"].isNull() | (t["e"] - acc["from"] > F.col("_room"))
        return F.struct(
            F.when(new, t["s"]).otherwise(acc["from"]).alias("from"),
            F.when(new, F.concat(acc["found"], F.array(F.struct(t["n"].alias("n"), t["s"].alias("s"))))).otherwise(acc["found"]).alias("found"),
        )

    return F.aggregate(own, none, step, lambda acc: acc["found"])


def format_chat(conversations: DataFrame, config: WindowConfig = WindowConfig()) -> DataFrame:
    """Windows: conv_id, window (position of its first new turn, from 0), repeated and new turns, tokens, over_budget,
    formatted text and ``loss``, the character ranges [start, end) of the formatted text that are learned."""
    found = blocks(turns(conversations), config).withColumn("_cuts", cuts(config))
    each = found.select("conv_id", "_turns", "_system", "_system_tokens", F.posexplode("_cuts").alias("_i", "_cut"), F.get("_cuts", F.col("_i") + 1).alias("_next"))
    has_system = F.col("_system").isNotNull()
    past = F.filter("_turns", lambda t: (t["_nth"] < F.col("_cut.n")) & (t["_start"] >= F.col("_cut.s") - config.history) & ~(has_system & (t["_nth"] == 1)))
    new = F.filter("_turns", lambda t: ~t["_copy"] & (t["_nth"] >= F.col("_cut.n")) & (F.col("_next").isNull() | (t["_nth"] < F.col("_next.n"))))

    def shaped(turn: Column, learn: Column) -> Column:
        return F.struct(turn["_role"].alias("role"), turn["_body"].alias("body"), learn.alias("learn"))

    system = F.when(has_system & (F.col("_cut.n") > 1), F.array(shaped(F.col("_system"), F.lit(False)))).otherwise(F.array().cast("array<struct<role:string,body:string,learn:boolean>>"))
    picked = each.withColumn("_past", past).withColumn("_new", new).select(
        "conv_id", (F.col("_cut.n") - 1).alias("window"), F.concat(system, F.transform("_past", lambda t: shaped(t, F.lit(False)))).alias("_before"),
        F.transform("_new", lambda t: shaped(t, t["_role"] == "assistant")).alias("_own"),
        (F.aggregate(F.concat("_past", "_new"), F.lit(0).cast("long"), lambda a, t: a + t["_tokens"]) + F.when(F.col("_cut.n") > 1, F.coalesce("_system_tokens", F.lit(0))).otherwise(0)).alias("tokens"),
    )
    every = F.concat("_before", "_own")
    rendered = F.transform(every, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["body"], F.lit(CLOSE)))
    start = F.struct(F.lit(len(BEGIN)).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def mark(acc: Column, t: Column) -> Column:
        body = acc["at"] + len(OPEN) + F.length(t["role"]) + 1
        end = body + F.length(t["body"])
        return F.struct(
            (end + len(CLOSE)).cast("long").alias("at"),
            F.when(t["learn"], F.concat(acc["spans"], F.array(F.struct(body.cast("long").alias("start"), end.cast("long").alias("end"))))).otherwise(acc["spans"]).alias("spans"),
        )

    return picked.select(
        "conv_id", "window", F.size("_before").cast("long").alias("repeated"), F.size("_own").cast("long").alias("new"), "tokens", (F.col("tokens") > config.budget).alias("over_budget"),
        F.concat(F.lit(BEGIN), F.array_join(rendered, ""), F.lit(END)).alias("formatted"), F.aggregate(every, start, mark, lambda acc: acc["spans"]).alias("loss"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """The new turns of each window, parsed from the formatted text: conv_id, window, ``turns`` (role, text), ``learned`` texts, formatted_chars."""
    body = F.substr("formatted", F.lit(len(BEGIN) + 1), F.length("formatted") - len(BEGIN) - len(END))
    parts = F.split(body, CLOSE.replace("|", r"\|"))
    new = F.slice(parts, (F.col("repeated") + 1).cast("int"), F.col("new").cast("int"))

    def parsed(part: Column) -> Column:
        line = F.instr(part, F.lit("\n"))
        role = F.substr(part, F.lit(len(OPEN) + 1), line - len(OPEN) - 1)
        return F.struct(F.url_decode(role).alias("role"), unescape(F.substr(part, line + 1, F.length(part) - line)).alias("text"))

    learned = F.transform("loss", lambda s: unescape(F.substr("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return windows.select("conv_id", "window", F.transform(new, parsed).alias("turns"), learned.alias("learned"), F.length("formatted").cast("long").alias("formatted_chars"))
