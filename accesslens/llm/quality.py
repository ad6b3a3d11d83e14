"""Quality classifier: a byte-level convolutional network in numpy.

A text is its UTF-8 bytes, cut into overlapping chunks that cover all of it.
Learned filters run over every position of a chunk (a filter is a table from
byte and offset to a weight, so a convolution is a sum of look-ups), the
largest response of each filter is the chunk's feature, and the mean and the
maximum over the chunks are combined into one probability. Nothing but the
text is an input.

The network is fitted in one task on a bounded sample of the labelled rows:
``sample`` rows per class in expectation, chosen by hash of the id, as far as
their whole texts fit in ``sample_bytes``. All chunks of a sampled text count,
as they do in scoring. The fitted tables (some 150 kB) go to the tasks, which
score whole texts row by row.

Defined results: null and empty texts are scored from one blank chunk; labels
of one id are averaged, ties count as good; without labels every score is 0.5,
with one class its share; repeated rows are scored alike; an empty table gives
no rows; extra columns do not matter.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from accesslens.llm.common import sized, text_of, written


@dataclass(frozen=True)
class ConvConfig:
    """width: bytes a filter sees; chunk, overlap: of the text, in bytes; sample, sample_bytes: bounds of the fit, rows a class and
    bytes of whole texts together; steps: gradient steps on ``batch`` texts each."""

    filters: int = 24
    width: int = 6
    chunk: int = 1024
    overlap: int = 128
    sample: int = 2000
    sample_bytes: int = 48 << 20
    steps: int = 600
    batch: int = 64
    rate: float = 0.02
    seed: int = 17


def chunk_starts(length: int, config: ConvConfig) -> range:
    """Where chunks begin: the last one reaches the end of the text."""
    step = config.chunk - config.overlap
    return range(0, max(length - config.overlap, 1), step)


def chunk_rows(data: bytes, config: ConvConfig) -> list[bytes]:
    starts = chunk_starts(len(data), config)
    # A filter may look past the end of its chunk; past the end of the text there are zeros.
    reach = config.chunk + config.width - 1
    return [data[s : s + reach].ljust(reach, b"\0") for s in starts]


def respond(tables: np.ndarray, bias: np.ndarray, chunks: np.ndarray, config: ConvConfig, where: bool = False):
    """The largest response of each filter in each chunk, and with ``where`` its position."""
    n, out = len(chunks), np.empty((len(chunks), config.filters), np.float32)
    at = np.empty((n, config.filters), np.int64) if where else None
    step = 16
    total = np.empty((step, config.chunk, config.filters), np.float32)
    part = np.empty_like(total)
    for lo in range(0, n, step):
        x = chunks[lo : lo + step]
        m = len(x)
        np.take(tables[0], x[:, : config.chunk], axis=0, out=total[:m], mode="clip")
        for k in range(1, config.width):
            np.take(tables[k], x[:, k : k + config.chunk], axis=0, out=part[:m], mode="clip")
            total[:m] += part[:m]
        if where:
            at[lo : lo + m] = total[:m].argmax(axis=1)
        out[lo : lo + m] = total[:m].max(axis=1)
    return np.maximum(out + bias, 0), at


def pool(response: np.ndarray, owner: np.ndarray, n: int):
    """Mean and maximum over the chunks of each text; ``owner`` is sorted and every text has a chunk."""
    first = np.searchsorted(owner, np.arange(n))
    count = np.diff(np.append(first, len(owner)))[:, None]
    return np.add.reduceat(response, first, axis=0) / count, np.maximum.reduceat(response, first, axis=0), first, count


def fit(pieces: list[list[bytes]], labels: np.ndarray, weights: np.ndarray, config: ConvConfig) -> dict[str, np.ndarray]:
    """Filters and weights by stochastic gradient (Adam) on the weighted log loss; ``pieces`` has the chunks of each text."""
    rng = np.random.default_rng(config.seed)
    model = {
        "tables": rng.normal(0, 0.3, (config.width, 256, config.filters)).astype(np.float32), "bias": np.zeros(config.filters, np.float32),
        "mean": rng.normal(0, 0.1, config.filters).astype(np.float32), "max": rng.normal(0, 0.1, config.filters).astype(np.float32), "base": np.zeros(1, np.float32),
    }
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.items()}
    steps = 0
    while steps < config.steps:
        order = rng.permutation(len(pieces))
        for lo in range(0, len(order), config.batch):
            rows = order[lo : lo + config.batch]
            rate = config.rate * max(0.05, 1 - steps / config.steps)
            n = len(rows)
            x = np.frombuffer(b"".join(c for r in rows for c in pieces[r]), np.uint8).reshape(-1, config.chunk + config.width - 1)
            owner = np.repeat(np.arange(n), [len(pieces[r]) for r in rows])
            response, at = respond(model["tables"], model["bias"], x, config, where=True)
            mean, top, first, count = pool(response, owner, n)
            p = 1 / (1 + np.exp(-np.clip(mean @ model["mean"] + top @ model["max"] + model["base"], -30, 30)))
            g = ((p - labels[rows]) * weights[rows] / weights[rows].sum()).astype(np.float32)
            is_top = (response == top[owner]) & (response > 0)
            back = g[owner, None] * (model["mean"] / count[owner] + model["max"] * is_top) * (response > 0)
            grad = {"mean": mean.T @ g, "max": top.T @ g, "base": np.array([g.sum()]), "bias": back.sum(axis=0)}
            column, chunk = np.arange(config.filters), np.arange(len(x))[:, None]
            grad["tables"] = np.stack(
                [
                    np.bincount((x[chunk, at + k].astype(np.int64) * config.filters + column).ravel(), back.ravel(), 256 * config.filters).reshape(256, -1)
                    for k in range(config.width)
                ]
            )
            steps += 1
            for name, gradient in grad.items():
                a, b = moment[name]
                a += 0.1 * (gradient - a)
                b += 0.01 * (gradient**2 - b)
                model[name] -= rate * (a / (1 - 0.9**steps)) / (np.sqrt(b / (1 - 0.99**steps)) + 1e-6)
    return model


def probabilities(texts: list[bytes], model: dict[str, np.ndarray], config: ConvConfig) -> np.ndarray:
    """The score of each whole text."""
    out = np.empty(len(texts))
    lo = 0
    while lo < len(texts):  # as many texts at a time as make some 4 MB of chunks; a long text alone is cut further below
        hi, held, chunks, owner = lo, 0, [], []
        while hi < len(texts) and (hi == lo or held < 4_000_000):
            new = chunk_rows(texts[hi], config)
            chunks += new
            owner += [hi - lo] * len(new)
            held += len(texts[hi])
            hi += 1
        x = np.frombuffer(b"".join(chunks), np.uint8).reshape(len(chunks), -1)
        response, _ = respond(model["tables"], model["bias"], x, config)
        mean, top, _, _ = pool(response, np.array(owner), hi - lo)
        out[lo:hi] = 1 / (1 + np.exp(-np.clip(mean @ model["mean"] + top @ model["max"] + model["base"], -30, 30)))
        lo = hi
    return out


def to_bytes(model: dict[str, np.ndarray]) -> bytes:
    held = io.BytesIO()
    np.savez(held, **model)
    return held.getvalue()


def from_bytes(data: bytes) -> dict[str, np.ndarray]:
    return dict(np.load(io.BytesIO(data)))


def train(docs: DataFrame, labels: DataFrame, held_out, config: ConvConfig = ConvConfig()) -> dict[str, np.ndarray] | float:
    """Fit on labelled rows of ``docs`` outside ``held_out`` (a column of ``docs``); with less than two classes, their share of good rows."""
    marks = labels.filter(F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("_good"))
    known = written(docs.filter(~held_out).select(F.col("doc_id").alias("_id")).join(marks, "_id"), "labelled")
    counts = {r._good: r.n for r in known.groupBy("_good").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return float(next(iter(counts), 0.5))
    share = {k: min(1.0, config.sample / n) for k, n in counts.items()}
    spread = F.pmod(F.xxhash64(F.col("_id"), F.lit(config.seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = written(known.distinct().filter(spread < F.when(F.col("_good") == 1, share[1]).otherwise(share[0])), "sample")
    text = docs.filter(~held_out).select(F.col("doc_id").alias("_id"), text_of().cast("binary").alias("_text"), F.xxhash64(text_of()).alias("_hash"))
    # Whole rows, in the order of a hash, until their texts fill the bound: some thousand narrow rows in one window.
    measured = text.join(sized(chosen), "_id").select("_id", "_good", "_hash", F.octet_length("_text").cast("long").alias("_bytes"), spread.alias("_spread"))
    upto = F.sum("_bytes").over(Window.orderBy("_spread", "_id", "_hash").rowsBetween(Window.unboundedPreceding, 0))
    kept = written(measured.withColumn("_upto", upto).filter(F.col("_upto") <= config.sample_bytes).select("_id", "_good", "_hash").distinct(), "fitted")
    taken = {r._good: r.n for r in kept.groupBy("_good").agg(F.count("*").alias("n")).collect()}
    weight = {k: n / max(1, taken.get(k, 0)) for k, n in counts.items()}
    rows = text.join(sized(kept), ["_id", "_hash"]).select("_id", "_hash", "_good", "_text")

    def learn(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["_id", "_hash"])
        good = part["_good"].to_numpy()
        weights = np.where(good == 1, weight[1], weight[0])
        return pd.DataFrame({"model": [to_bytes(fit([chunk_rows(t, config) for t in part["_text"]], good.astype(np.float32), weights.astype(np.float32), config))]})

    found = rows.groupBy(F.lit(0).alias("_all")).applyInPandas(learn, "model binary")
    fitted = written(found, "model").first()
    return from_bytes(fitted.model) if fitted else 0.5


def score(docs: DataFrame, model: dict[str, np.ndarray] | float, config: ConvConfig = ConvConfig()) -> DataFrame:
    """``docs`` with ``score``: each row as it came, as the struct ``row``."""
    rows = docs.select(F.struct("*").alias("row"))
    return rows.withColumn("score", scorer(model, config)(text_of("row.text").cast("binary")))


def scorer(model: dict[str, np.ndarray] | float, config: ConvConfig = ConvConfig()):
    """A function of a binary column: the probability of good quality."""

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in batches:
            if isinstance(model, float):
                yield pa.array(np.full(len(part), model))
            else:
                yield pa.array(probabilities(part.to_pylist(), model, config))

    return scored


def keep_good(docs: DataFrame, model: dict[str, np.ndarray] | float, config: ConvConfig = ConvConfig(), least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score at least ``least``, with the columns they came with."""
    return score(docs, model, config).filter(F.col("score") >= least).select("row.*")


def held_out_column(buckets: int = 3, bucket: int = 1):
    """True for ids in the bucket that is never learned from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % buckets == bucket
