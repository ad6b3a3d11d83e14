"""Phrase collocations by vertical partitioning of the suffix tree (after ERA).

A suffix is what begins at a word of a piece and runs on to the end of the
piece; the tree is truncated at ``longest`` words. It is never built whole:
word prefixes are grouped so that the suffixes of a group fit a memory
``budget``, and each group's subtree is built by one task from its own
suffixes alone.

* Words are counted first. In the order of their keys their totals are summed
  up (a distributed running total) and cut every ``budget`` suffixes: that is
  the grouping. A word above the budget is extended by its next word, a pair
  above it by the word after that; extended prefixes are dealt out by hash.
* The tree then grows a level at a time. For level k the texts are scanned
  again; a suffix of k words takes part only if its first and its last k - 1
  words can be frequent, which a bitmap of the frequent phrases of the level
  before tells (it may say yes too often, never no wrongly). Nothing that
  occurs ``least`` times is lost, as all its parts occur as often.
* Equal suffixes of a task are counted before they move. A group's task sorts
  them: runs are the leaves, their totals the counts.

Words travel as 64-bit keys of (language, word). That no two words share a key
is checked on all counted words; else another seed is taken. Counts are exact,
scores are formed in decimals.

Defined results: null text counts as empty, null language as ``und``; repeated
rows count each time; ties go to the smallest cut and to the phrase that is
first in byte order; an empty table gives no rows; extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accesslens.llm.chosen_path import grouped
from accesslens.llm.common import text_of, written
from accesslens.llm.wordhash import PIECE, batches, hash_words, mixed, pieces
from accesslens.operators.scan import running_totals
#: Texts taken from a batch at once.
TEXTS = 500


@dataclass(frozen=True)
class PhraseConfig:
    """longest: words of a phrase at most; least: occurrences of a phrase at least; within: hundredths of a phrase's occurrences that lie
    in one longer phrase from which on it is dropped; top: phrases per language; budget: suffixes of a group; held: suffixes a task
    holds before it passes them on; most_bits: size of a bitmap."""

    longest: int = 3
    least: int = 10
    within: int = 50
    top: int = 2000
    budget: int = 250_000
    held: int = 500_000
    most_bits: int = 1 << 27


def byte_classes() -> tuple[np.ndarray, np.ndarray]:
    """Which bytes words consist of, and which end a piece."""
    ends = np.zeros(256, bool)
    ends[list(b".,;:!?\n\x0b\x0c\r")] = True
    of_word = ~ends
    of_word[list(b" \t")] = False
    return of_word, ends


def scanned(texts: list[bytes], langs: np.ndarray, seed: int, carry: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For some texts at a time: bytes, starts and ends of the words, their keys, which of them open a piece, and the index of their text.

    ``langs``: a random number per text. A text too long to be read at once comes in parts; each but the first repeats the last ``carry``
    words before it, with index -1.
    """
    of_word, ends = byte_classes()
    for lo, hi in batches(texts, PIECE):
        parts = pieces(texts[lo], PIECE) if hi == lo + 1 and len(texts[lo]) > PIECE else [b"\n".join(texts[lo:hi])]
        bounds = np.cumsum([len(t) + 1 for t in texts[lo:hi]])
        before = b""
        for part in parts:
            data = np.frombuffer(before + part, np.uint8)
            found, starts, stops = hash_words(data, of_word)
            if not len(found):
                continue
            cuts = np.concatenate(([0], np.cumsum(ends[data])))
            opens = np.concatenate(([True], cuts[starts[1:]] > cuts[stops[:-1]]))
            doc = lo + np.searchsorted(bounds, starts, side="right") if len(parts) == 1 else np.full(len(found), lo)
            key = mixed(found ^ langs[doc] ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (2**64 - 1)))
            yield data, starts, stops, key, opens, np.where(starts < len(before), -1, doc)
            last = int(stops[-1])
            before = data[starts[-min(carry, len(starts))] : last].tobytes() + (b"\n" if cuts[-1] > cuts[last] else b" ")


def sliced(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut so that few texts are held as Python objects."""
    for part in parts:
        for lo in range(0, part.num_rows, TEXTS):
            yield part.slice(lo, TEXTS)


def suffixes(key: np.ndarray, opens: np.ndarray, k: int) -> np.ndarray:
    """Positions at which k words of one piece begin."""
    m = len(key) - k + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    whole = np.ones(m, bool)
    for j in range(1, k):
        whole &= ~opens[j : j + m]
    return np.flatnonzero(whole)


def blend(words: list[np.ndarray]) -> np.ndarray:
    """One number for several words, in their order."""
    total = words[0].astype(np.uint64)
    for w in words[1:]:
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + w.astype(np.uint64))
    return total


def summed(words: list[np.ndarray], counts: np.ndarray, exact: bool = False) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal suffixes put together. Unless ``exact``, equal ones may stay apart where others have the same blend."""
    order = np.lexsort(words[::-1]) if exact else np.argsort(blend(words), kind="stable")
    words = [w[order] for w in words]
    first = np.flatnonzero(np.concatenate(([True], np.logical_or.reduce([w[1:] != w[:-1] for w in words]))))
    return [w[first] for w in words], np.add.reduceat(counts[order], first)


def count_words(docs: DataFrame, config: PhraseConfig) -> tuple[DataFrame, int]:
    """Lang, word, key and total of every word, and the seed with which no two of them share a key. Written."""

    def scan(seed: int):
        def words(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list] = {}
            names = {}

            def out():
                keys = list(held)
                return pa.RecordBatch.from_arrays(
                    [pa.array([names[held[k][0]] for k in keys]), pa.array([held[k][1].decode() for k in keys]), pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array([held[k][2] for k in keys], pa.int64())],
                    names=["lang", "word", "_key", "_c"],
                )

            for part in sliced(parts):
                langs = part.column("lang").to_pylist()
                marks = part.column("_lang").to_numpy().view(np.uint64)
                names.update(zip(marks.tolist(), langs, strict=True))
                for data, starts, stops, key, _, seen in scanned(part.column("_text").to_pylist(), marks, seed, config.longest):
                    own = seen >= 0
                    key, starts, stops, seen = key[own], starts[own], stops[own], seen[own]
                    distinct, first, counts = np.unique(key, return_index=True, return_counts=True)
                    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8).tobytes()
                    for k, at, c in zip(distinct.tolist(), first.tolist(), counts.tolist(), strict=True):
                        known = held.get(k)
                        if known is None:
                            held[k] = [int(marks[seen[at]]), low[starts[at] : stops[at]], c]
                        else:
                            known[2] += c
                    if len(held) > config.held // 2:
                        yield out()
                        held.clear()
            if held:
                yield out()

        return words

    for seed in range(1, 9):
        rows = prepared(docs).mapInArrow(scan(seed), "lang string, word string, _key long, _c long")
        named = F.struct("lang", "word")
        found = written(rows.groupBy("_key").agg(F.min(named).alias("_one"), F.max(named).alias("_other"), F.sum("_c").alias("f")), "words")
        if found.filter("_one <> _other").isEmpty():
            return found.select("_one.*", "_key", "f"), seed
    raise RuntimeError("more words than 64-bit keys can tell apart")


def prepared(docs: DataFrame) -> DataFrame:
    lang = F.coalesce("lang", F.lit("und"))
    return docs.select(lang.alias("lang"), F.xxhash64(lang).alias("_lang"), text_of().cast("binary").alias("_text"))


def bitmap(frequent: DataFrame, columns: list[str], config: PhraseConfig) -> np.ndarray:
    """Bits by two hashes of each row; at most ``most_bits``, and a few per row below that."""
    bits = 1 << 16
    rows = frequent.count()
    while bits < min(16 * rows, config.most_bits):
        bits <<= 1

    def blended(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            b = blend([part.column(c).to_numpy().view(np.uint64) for c in columns])
            at = np.concatenate([probe(b, s, bits) for s in (1, 2)])
            slot, inverse = np.unique(at >> 6, return_inverse=True)
            word = np.zeros(len(slot), np.uint64)
            np.bitwise_or.at(word, inverse, np.uint64(1) << (at & 63).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(word.view(np.int64))], names=["slot", "bits"])

    found = frequent.select(*columns).mapInArrow(blended, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    whole = np.zeros(bits >> 6, np.uint64)
    whole[found.column("slot").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return whole


def probe(b: np.ndarray, seed: int, bits: int) -> np.ndarray:
    return (mixed(b + np.uint64(seed)) & np.uint64(bits - 1)).astype(np.int64)


def may_hold(whole: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    b = blend(words)
    found = np.ones(len(b), bool)
    for s in (1, 2):
        at = probe(b, s, len(whole) << 6)
        found &= (whole[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
    return found


@dataclass(frozen=True)
class Groups:
    """Where the subtree of a prefix is built: cuts in key order for words within the budget, ``extra`` groups for prefixes longer than a
    word; ``heavy``: blends of the prefixes above the budget, by length."""

    cuts: np.ndarray
    extra: int
    heavy: tuple[np.ndarray, ...]

    def of(self, words: list[np.ndarray]) -> np.ndarray:
        group = np.searchsorted(self.cuts, words[0].view(np.int64), side="right").astype(np.int64)
        over = np.ones(len(group), bool)
        for n, heavy in enumerate(self.heavy[: len(words) - 1], 1):
            b = blend(words[:n])
            over &= np.isin(b, heavy)
            if not over.any():
                break
            longer = blend(words[: n + 1])
            group = np.where(over, len(self.cuts) + 1 + (mixed(longer) % np.uint64(self.extra)).astype(np.int64), group)
        return group


def vertical_groups(words: DataFrame, config: PhraseConfig) -> Groups:
    """Words in the order of their keys, cut every ``budget`` suffixes; there are at most total / budget cuts and heavy words."""
    light = words.filter(F.col("f") <= config.budget).select("_key", "f")
    upto = running_totals(light, [F.col("_key")], {"_upto": F.col("f")})
    group = F.expr(f"(_upto - f) div {config.budget}")
    cuts = sorted(r[0] for r in upto.groupBy(group.alias("g")).agg(F.min("_key")).select("min(_key)").collect())[1:]
    heavy = words.filter(F.col("f") > config.budget).select("_key", "f").collect()
    extra = max(1, 2 * sum(r.f for r in heavy) // config.budget)
    return Groups(np.array(cuts, np.int64), extra, (np.sort(np.array([r[0] for r in heavy], np.int64).view(np.uint64)),))


def frequent_suffixes(docs: DataFrame, k: int, seed: int, before: np.ndarray, groups: Groups, config: PhraseConfig) -> DataFrame:
    """Phrases of k words that occur ``least`` times: w1 .. wk and f. Written."""
    names = [f"w{j + 1}" for j in range(k)]
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((before, groups))

    def suffix_rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, dealt = shared.value
        held: list[list[np.ndarray]] = []
        rows = 0

        def out():
            words, counts = summed([np.concatenate(w) for w in zip(*held, strict=True)], np.ones(rows, np.int64))
            group = dealt.of(words)
            for lo in range(0, len(counts), 500_000):
                hi = lo + 500_000
                yield pa.RecordBatch.from_arrays([pa.array(group[lo:hi]), *[pa.array(w[lo:hi].view(np.int64)) for w in words], pa.array(counts[lo:hi])], names=["_group", *names, "_c"])

        for part in sliced(parts):
            marks = part.column("_lang").to_numpy().view(np.uint64)
            for _, _, _, key, opens, seen in scanned(part.column("_text").to_pylist(), marks, seed, config.longest):
                at = suffixes(key, opens, k)
                at = at[seen[at + k - 1] >= 0]  # what lies wholly in the part before was counted there
                words = [key[at + j] for j in range(k)]
                ok = may_hold(whole, words[:-1])
                ok[ok] = may_hold(whole, [w[ok] for w in words[1:]])
                if ok.any():
                    held.append([w[ok] for w in words])
                    rows += int(ok.sum())
                if rows > config.held:
                    yield from out()
                    held, rows = [], 0
        if rows:
            yield from out()

    def subtrees(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in grouped(parts, "_group", 100_000):
            words, counts = summed([part.column(n).to_numpy() for n in names], part.column("_c").to_numpy(), exact=True)
            keep = counts >= config.least
            if keep.any():
                yield pa.RecordBatch.from_arrays([*[pa.array(w[keep]) for w in words], pa.array(counts[keep])], names=[*names, "f"])

    fields = ", ".join(f"{n} long" for n in names)
    rows = prepared(docs).drop("lang").mapInArrow(suffix_rows, f"_group long, {fields}, _c long")
    found = rows.repartition("_group").sortWithinPartitions("_group").mapInArrow(subtrees, f"{fields}, f long")
    return written(found, f"phrases{k}")


def heavier(groups: Groups, level: DataFrame, k: int, config: PhraseConfig) -> Groups:
    """``groups`` with the prefixes of k words that are above the budget too; at most total / budget of them."""
    rows = level.filter(F.col("f") > config.budget).select(*[f"w{j + 1}" for j in range(k)]).collect()
    found = blend([np.array([r[j] for r in rows], np.int64).view(np.uint64) for j in range(k)]) if rows else np.zeros(0, np.uint64)
    return Groups(groups.cuts, groups.extra, (*groups.heavy, np.sort(found)))


def part_of(levels: list[DataFrame], lo: int, hi: int, name: str) -> tuple[DataFrame, list[str]]:
    """Counts of the phrases of words lo .. hi, to be joined to a longer phrase on those words."""
    keys = [f"w{j}" for j in range(lo, hi + 1)]
    level = levels[hi - lo]
    return level.select(*[F.col(f"w{j - lo + 1}").alias(f"w{j}") for j in range(lo, hi + 1)], F.col("f").alias(name)), keys


def scored(levels: list[DataFrame], k: int) -> DataFrame:
    """Phrases of k words with a, l, r and score of their weakest cut."""
    rows = levels[k - 1].withColumnRenamed("f", "a")
    cuts: list[Column] = []
    for cut in range(1, k):
        for lo, hi, name in ((1, cut, f"_l{cut}"), (cut + 1, k, f"_r{cut}")):
            part, keys = part_of(levels, lo, hi, name)
            rows = rows.join(part, keys)
        wide = "CAST({} AS DECIMAL(19, 0))"
        score = F.expr(f"(CAST({wide.format('a')} * {wide.format('a')} AS DECIMAL(31, 0)) * 1000000) div ({wide.format(f'_l{cut}')} * {wide.format(f'_r{cut}')})")
        cuts.append(F.struct(score.alias("score"), F.lit(cut).alias("cut"), F.col(f"_l{cut}").alias("l"), F.col(f"_r{cut}").alias("r")))
    weakest = F.array_min(F.array(*cuts))
    return rows.withColumn("_weak", weakest).select(*[f"w{j + 1}" for j in range(k)], "a", "_weak.l", "_weak.r", "_weak.score")


def alone(rows: DataFrame, levels: list[DataFrame], k: int, config: PhraseConfig) -> DataFrame:
    """Phrases of k words that do not mostly occur inside one longer phrase."""
    names = [f"w{j + 1}" for j in range(k)]
    within = []
    for n in range(k + 1, len(levels) + 1):
        within += [levels[n - 1].select(*[F.col(f"w{i + j + 1}").alias(f"w{j + 1}") for j in range(k)], "f") for i in range(n - k + 1)]
    if not within:
        return rows
    most = reduce(DataFrame.unionByName, within).groupBy(*names).agg(F.max("f").alias("_most"))
    inside = F.coalesce(F.col("_most"), F.lit(0)) * 100 >= F.col("a") * config.within
    return rows.join(most, names, "left").filter(~inside).drop("_most")


def collocations(docs: DataFrame, config: PhraseConfig = PhraseConfig()) -> DataFrame:
    """Per language the ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    if config.longest < 2 or config.least < 1:
        raise ValueError("phrases have two words at least and occur once at least")
    words, seed = count_words(docs, config)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = words.filter(F.col("f") >= config.least)
    groups = vertical_groups(frequent, config)
    levels = [frequent.select(F.col("_key").alias("w1"), "f")]
    for k in range(2, config.longest + 1):
        sieve = bitmap(levels[-1], [f"w{j + 1}" for j in range(k - 1)], config)
        levels.append(frequent_suffixes(docs, k, seed, sieve, groups, config))
        groups = heavier(groups, levels[-1], k, config)
    every = []
    for k in range(2, config.longest + 1):
        rows = alone(scored(levels, k), levels, k, config)
        every.append(rows.select(F.array(*[f"w{j + 1}" for j in range(k)]).alias("_words"), "a", "l", "r", "score"))
    names = frequent.select(F.col("_key").alias("_word"), "lang", "word")
    found = reduce(DataFrame.unionByName, every).withColumn("_word", F.col("_words")[0]).join(names.select("_word", "lang"), "_word").drop("_word")
    found = written(found, "phrases")
    # Equal numbers at the limit all stay until their words are known. A language's phrases are ranked in parts, then what is left of the parts.
    order = [F.desc("score"), F.desc("a")]
    salt = F.pmod(F.xxhash64("_words"), F.lit(1 + found.count() // 100_000))
    first = found
    for part in ([F.col("lang"), salt], [F.col("lang")]):
        first = first.withColumn("_place", F.rank().over(Window.partitionBy(*part).orderBy(*order))).filter(F.col("_place") <= config.top).drop("_place")
    first = written(first, "first")
    spelled = (
        first.select("*", F.posexplode("_words").alias("_i", "_word"))
        .join(names.select("_word", "word"), "_word")
        .groupBy("lang", "_words", "a", "l", "r", "score")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_i", "word"))), lambda w: w["word"]), " ").alias("phrase"))
    )
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))
    ranked = spelled.withColumn("rank", place).filter(F.col("rank") <= config.top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
