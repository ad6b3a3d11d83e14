"""Language-model scoring with a hashed maximum-entropy model.

Words have classes (from their last two letters), and a word's probability is
that of its class given the history times that of the word in its class. The
class is a softmax over hashed features: the last word, the word before it (a
skip), and both together. The word in its class is the maximum-entropy model
with the word alone as feature, whose solution is its smoothed share of the
class. Both factors add up to one, with one outcome per class for words that
training never saw.

Training takes every training document once, in ``rounds`` parts. In a round
each task makes stochastic gradient steps (Adagrad) over its documents from
the same weights; feature rows are then averaged over the tasks, weighted by
how often each was used. The sums are made block by block in Spark; the model
has a fixed size (``3 * buckets * classes`` numbers), which bounds what the
driver gathers and sends out. Word counts are a table that grows with the
corpus: words frequent enough to be among ``head`` go out with the model, and
the other words of the texts meet their counts in a join.

Defined results: null texts are empty and have the end token only; null ids
are hashed as an empty string; without training rows all words are unknown;
repeated rows are scored alike; an empty table gives no rows; extra columns
do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accesslens.llm.common import text_of, written
from accesslens.llm.wordhash import batches, constants, hash_words, mixed, pieces

TEMPLATES = 3
END = np.uint64(0x5E5E5E5E12345678)


@dataclass(frozen=True)
class MaxentConfig:
    """classes: of words; bits: 2^bits buckets per feature template; head: words sent to every task at most; step: tokens per
    gradient step; rate: of learning; rounds: times the tasks' weights are averaged."""

    classes: int = 32
    bits: int = 14
    head: int = 1 << 18
    step: int = 1024
    rate: float = 0.1
    rounds: int = 2
    block: int = 1024


@dataclass
class Model:
    """What scoring needs: class weights, the head words and the totals."""

    bias: np.ndarray
    weights: np.ndarray
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0))
    tokens: int = 0
    distinct: int = 0
    class_size: np.ndarray | None = None


def tokens_of(texts: list[bytes], config: MaxentConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes with their classes, text after text, each ended by the end token; and tokens per text."""
    lower, _, _ = constants()
    hashes, kinds, counts = [], [], []
    groups = [[t] for t in pieces(texts[0])] if len(texts) == 1 else [texts]
    for group in groups:
        data = np.frombuffer(b"\n".join(group) + b"\n", np.uint8)
        found, starts, ends = hash_words(data)
        last = lower[data[ends - 1]].astype(np.int64)
        before = np.where(ends - starts > 1, lower[data[ends - 2]], 0)
        hashes.append(found)
        kinds.append(1 + (mixed((last * 256 + before).astype(np.uint64)) % np.uint64(config.classes - 1)).astype(np.int64))
        edges = np.cumsum([len(t) + 1 for t in group])
        counts.append(np.diff(np.searchsorted(starts, np.concatenate(([0], edges)))))
    words, kind = np.concatenate(hashes), np.concatenate(kinds)
    count = np.concatenate(counts) if len(texts) > 1 else np.array([len(words)])
    ends = np.cumsum(count)
    return np.insert(words, ends, END), np.insert(kind, ends, 0), count + 1


def features_of(tokens: np.ndarray, counts: np.ndarray, config: MaxentConfig) -> np.ndarray:
    """The bucket of each template for each token (templates x tokens)."""
    first = np.cumsum(counts) - counts
    one = np.concatenate((np.zeros(1, np.uint64), tokens[:-1]))
    one[first] = 1
    two = np.concatenate((np.zeros(1, np.uint64), one[:-1]))
    two[first] = 2
    shift = np.uint64(64 - config.bits)
    keys = (one, two * np.uint64(0x9E3779B97F4A7C15) + np.uint64(7), (one * np.uint64(3)) ^ (two * np.uint64(0xC2B2AE3D27D4EB4F)))
    return np.stack([(mixed(k) >> shift).astype(np.uint16) for k in keys])


def class_odds(bias: np.ndarray, weights: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """Log probabilities of all classes for each token."""
    total = weights[0].take(buckets[0], axis=0)
    for k in range(1, TEMPLATES):
        total += weights[k].take(buckets[k], axis=0)
    total += bias
    total -= total.max(axis=1, keepdims=True)
    total -= np.log(np.exp(total).sum(axis=1, keepdims=True))
    return total


class Learner:
    """Adagrad over the documents of one task."""

    def __init__(self, model: Model, config: MaxentConfig) -> None:
        self.config, self.bias, self.weights = config, model.bias.copy(), model.weights.copy()
        self.bias_square = np.full_like(self.bias, 1e-3)
        self.square = np.full(self.weights.shape[:2], 1e-2, np.float32)
        self.used = np.zeros(self.weights.shape[:2], np.int64)
        self.seen = 0

    def learn(self, kinds: np.ndarray, buckets: np.ndarray) -> None:
        step, rate = self.config.step, self.config.rate
        for lo in range(0, len(kinds), step):
            kind, bucket = kinds[lo : lo + step], buckets[:, lo : lo + step]
            slope = np.exp(class_odds(self.bias, self.weights, bucket))
            slope[np.arange(len(kind)), kind] -= 1
            total = slope.mean(axis=0)
            self.bias_square += total * total
            self.bias -= rate * total / np.sqrt(self.bias_square)
            for k in range(TEMPLATES):
                order = np.argsort(bucket[k], kind="stable")
                own = bucket[k][order]
                first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                row, n = own[first], np.diff(np.append(first, len(own)))
                # The mean slope of a row in this step, so that frequent rows do not overshoot.
                mean = np.add.reduceat(slope[order], first, axis=0) / n[:, None]
                self.square[k, row] += (mean * mean).mean(axis=1)
                self.weights[k, row] -= (rate * mean / np.sqrt(self.square[k, row])[:, None]).astype(np.float32)
                self.used[k, row] += n
            self.seen += len(kind)


def training_rows(docs: DataFrame, held_out: Column) -> DataFrame:
    return docs.filter(~held_out).select(text_of().cast("binary").alias("_text"))


def count_words(docs: DataFrame, held_out: Column, config: MaxentConfig) -> DataFrame:
    """Training counts: _word (hash), _kind (class), _count. Written."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column(0).to_pylist()
            for lo, hi in batches(texts):
                tokens, kinds, _ = tokens_of(texts[lo:hi], config)
                word, first, n = np.unique(tokens, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(kinds[first].astype(np.int32)), pa.array(n)], names=["_word", "_kind", "_count"])

    each = training_rows(docs, held_out).mapInArrow(count, "_word long, _kind int, _count long")
    return written(each.groupBy("_word").agg(F.min("_kind").alias("_kind"), F.sum("_count").alias("_count")), "words")


def train(docs: DataFrame, held_out: Column, config: MaxentConfig = MaxentConfig()) -> tuple[Model, DataFrame]:
    """The model, and the table of the counts of all training words."""
    words = count_words(docs, held_out, config)
    kinds = words.groupBy("_kind").agg(F.sum("_count").alias("n"), F.count("*").alias("v")).collect()
    size, distinct = np.zeros(config.classes), np.zeros(config.classes)
    for row in kinds:
        size[row._kind], distinct[row._kind] = row.n, row.v
    model = Model(np.zeros(config.classes, np.float32), np.zeros((TEMPLATES, 1 << config.bits, config.classes), np.float32))
    model.tokens, model.distinct, model.class_size = int(size.sum()), int(distinct.sum()), size + distinct + 1
    model.bias[:] = np.log((size + 1) / (size.sum() + config.classes))
    for turn in range(config.rounds):
        model.bias, model.weights = round_of(docs, held_out, model, turn, config)
    # The most frequent words by powers of two of their count, as many as the head holds.
    levels = words.groupBy(F.floor(F.log2("_count")).cast("int").alias("b")).agg(F.count("*").alias("v")).orderBy(F.desc("b")).collect()
    held, least = 0, 64
    for row in levels:
        if held + row.v > config.head:
            break
        held, least = held + row.v, row.b
    top = words.filter(F.col("_count") >= F.lit(2**least if least < 63 else 2**62)).select("_word", "_count").toPandas()
    order = np.argsort(top["_word"].to_numpy(np.int64).view(np.uint64))
    model.words, model.counts = top["_word"].to_numpy(np.int64).view(np.uint64)[order], top["_count"].to_numpy(np.float64)[order]
    return model, words.filter(F.col("_count") < F.lit(2**least if least < 63 else 2**62))


def round_of(docs: DataFrame, held_out: Column, model: Model, turn: int, config: MaxentConfig) -> tuple[np.ndarray, np.ndarray]:
    """One pass of all tasks over their part of the documents; the averaged weights."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((model.bias, model.weights))
    part_of = F.pmod(F.xxhash64("doc_id", text_of()), F.lit(config.rounds)) == turn
    rows = training_rows(docs.filter(part_of), held_out)
    width, blocks = config.classes, (TEMPLATES << config.bits) // config.block

    def steps(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner = Learner(Model(*sent.value), config)
        for part in parts:
            texts = part.column(0).to_pylist()
            for lo, hi in batches(texts, 1_000_000):
                tokens, kinds, counts = tokens_of(texts[lo:hi], config)
                learner.learn(kinds, features_of(tokens, counts, config))
        if not learner.seen:
            return
        used, weights = learner.used.reshape(-1), learner.weights.reshape(-1, width)
        salt = int(np.random.default_rng(learner.seen).integers(16))
        for b in range(blocks):
            at = slice(b * config.block, (b + 1) * config.block)
            yield block_row(b, salt, used[at].astype(np.float64), weights[at] * used[at, None])
        yield block_row(blocks, salt, np.array([learner.seen], np.float64), learner.bias[None] * learner.seen)

    def block_row(block: int, salt: int, used: np.ndarray, weighted: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int32()), pa.array([salt], pa.int32()), pa.array([used.tobytes()], pa.binary()), pa.array([weighted.astype(np.float32).tobytes()], pa.binary())],
            names=["_block", "_salt", "_used", "_weighted"],
        )

    def summed(group: pd.DataFrame) -> pd.DataFrame:
        used = np.sum([np.frombuffer(x, np.float64) for x in group["_used"]], axis=0)
        weighted = np.sum([np.frombuffer(x, np.float32) for x in group["_weighted"]], axis=0, dtype=np.float64)
        return pd.DataFrame({"_block": [group["_block"].iloc[0]], "_salt": [0], "_used": [used.tobytes()], "_weighted": [weighted.astype(np.float32).tobytes()]})

    schema = "_block int, _salt int, _used binary, _weighted binary"
    partial = rows.mapInArrow(steps, schema).groupBy("_block", "_salt").applyInPandas(summed, schema)
    found = partial.groupBy("_block").applyInPandas(summed, schema).collect()
    bias, weights = model.bias.copy(), model.weights.reshape(-1, width).copy()
    for row in found:
        used = np.frombuffer(row._used, np.float64)
        mean = np.frombuffer(row._weighted, np.float32).reshape(-1, width) / np.maximum(used, 1)[:, None]
        if row._block == blocks:
            bias = mean[0].astype(np.float32)
        else:
            at = slice(row._block * config.block, (row._block + 1) * config.block)
            weights[at] = np.where(used[:, None] > 0, mean, weights[at])
    sent.unpersist()
    return bias, weights.reshape(model.weights.shape).astype(np.float32)


def score(docs: DataFrame, model: Model, rest: DataFrame, held_out: Column, config: MaxentConfig = MaxentConfig()) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))  # plain arrays: a broadcast value is not sent with its class

    def judge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(**sent.value)
        base_size, class_size = np.log10(own.tokens + own.distinct + 1), np.log10(own.class_size)
        known_log = np.log10(own.counts + 1)
        for part in parts:
            texts = part.column("_text").to_pylist()
            for lo, hi in batches(texts, 1_000_000):
                tokens, kinds, counts = tokens_of(texts[lo:hi], config)
                buckets = features_of(tokens, counts, config)
                odds = np.empty(len(tokens))
                for a in range(0, len(tokens), 8192):
                    odds[a : a + 8192] = class_odds(own.bias, own.weights, buckets[:, a : a + 8192])[np.arange(len(kinds[a : a + 8192])), kinds[a : a + 8192]]
                at = np.minimum(np.searchsorted(own.words, tokens), max(len(own.words) - 1, 0))
                known = own.words[at] == tokens if len(own.words) else np.zeros(len(tokens), bool)
                logs = np.where(known, known_log[at], 0.0) if len(own.words) else np.zeros(len(tokens))
                first = np.cumsum(counts) - counts
                share = np.add.reduceat(logs, first)
                text = np.repeat(np.arange(len(counts)), counts)[~known]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("_id").slice(lo, hi - lo), part.column("held_out").slice(lo, hi - lo), pa.array(counts.astype(np.int64)), pa.array(np.add.reduceat(known.astype(np.int64), first)),
                        pa.array(share - counts * base_size), pa.array(share + np.add.reduceat(odds / np.log(10) - class_size[kinds], first)),
                        pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(counts) + 1)).astype(np.int32)), pa.array(tokens[~known].view(np.int64))),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "_known", "_base", "_score", "_rest"],
                )

    rows = docs.select(F.col("doc_id").alias("_id"), held_out.alias("held_out"), text_of().cast("binary").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    judged = rows.mapInArrow(judge, f"doc_id {kind}, held_out boolean, n_tokens long, _known long, _base double, _score double, _rest array<long>")
    judged = written(judged.withColumn("_row", F.monotonically_increasing_id()), "judged")
    asked = judged.select("_row", F.explode("_rest").alias("_word"))
    met = asked.join(rest.select("_word", "_count"), "_word").groupBy("_row").agg(F.count("*").alias("_more"), F.sum(F.log10(F.col("_count") + 1)).alias("_logs"))
    more, logs = F.coalesce("_more", F.lit(0)), F.coalesce("_logs", F.lit(0.0))
    return judged.drop("_rest").join(met, "_row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("_known") + more).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("_base") + logs).alias("base_score"), (F.col("_score") + logs).alias("score")
    )
