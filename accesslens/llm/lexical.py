"""Ranked lexical search with sorted access only (NRA, no random access).

Documents are read once: their terms are counted, of which only those that
some item holds are kept. From the counts come the statistics of the whole
table and each term's weight.

A task then scores all items over its documents, some tens of thousands at a
time. Their postings are put in lists per term, largest impact first. For an
item its lists are read in step, each step twice as long as the one before.
A document that has been met has a lower bound, the impacts read so far, and
an upper bound, with the last impact read of each list that has not yet
shown it. Reading goes on until no document outside can reach the ``top``-th
best lower bound, and those inside that still can have equal bounds: then
membership, ties and scores are settled. The ``top``-th best score carries
over to the task's next documents. The tasks' best are ranked once more.

Items are taken in blocks of bounded bytes, whose terms and weights are sent to
all tasks; postings never move between machines, so a frequent term is spread
as its documents are.

Impacts are 64-bit integers, a document's length measure a decimal division.

Defined results: null text has no terms; documents and items without terms
give no rows; repeated rows and ids are documents and items of their own (an
id may then stand twice); equal scores go to the smaller id, null ids last;
empty tables give no rows; extra columns do not matter. Ids are integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from accesslens.llm.common import lower_ascii, text_of, written
from accesslens.llm.wordhash import PIECE, batches, constants, hash_words, pieces
from accesslens.operators.scan import running_totals

NO_ID = 2**63 - 1
#: Terms are runs of ASCII letters and digits and of everything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class LexicalConfig:
    """top: documents per item; chunk: documents scored at once; postings: of a chunk at most, unless one document has more; step: postings
    of a list read first; block_bytes: texts of the items taken together."""

    top: int = 20
    chunk: int = 65_536
    postings: int = 4_000_000
    step: int = 256
    block_bytes: int = 16 << 20


def of_term() -> np.ndarray:
    kinds = np.zeros(256, bool)
    for lo, hi in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
        kinds[lo : hi + 1] = True
    return kinds


class Vocabulary:
    """The items' terms in the order of their hashes; finds them in texts and compares their bytes."""

    def __init__(self, terms: list[bytes]):
        hashes = np.array([hash_words(np.frombuffer(t, np.uint8), of_term())[0][0] for t in terms], np.uint64)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise RuntimeError("two terms share a hash")
        own = [terms[i] for i in self.order]
        self.length = np.array([len(t) for t in own], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(own), np.uint8)

    def find(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all terms of a text, and which term of the vocabulary each is (-1: none)."""
        lower = constants()[0]
        found, starts, ends = hash_words(data, of_term())
        if not len(found) or not len(self.hashes):
            return starts, np.full(len(found), -1)
        at = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
        hit = np.flatnonzero((self.hashes[at] == found) & (self.length[at] == ends - starts))
        length = ends[hit] - starts[hit]
        if not len(hit):
            return starts, np.full(len(found), -1)
        inside = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        same = lower[data[np.repeat(starts[hit], length) + inside]] == self.bytes[np.repeat(self.start[at[hit]], length) + inside]
        whole = np.logical_and.reduceat(same, np.cumsum(length) - length)
        term = np.full(len(found), -1)
        term[hit[whole]] = self.order[at[hit[whole]]]
        return starts, term


def counted(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """Of each document with terms: doc_id, _row, n, and its terms of the vocabulary with their counts. Written."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(shared.value)
        size = max(1, len(shared.value))
        for part in parts:
            texts = part.column("_text").to_pylist()
            n = np.zeros(len(texts), np.int64)
            pairs, times = [], []
            for lo, hi in batches(texts):
                bounds = np.cumsum([len(t) + 1 for t in texts[lo:hi]])
                for piece in pieces(texts[lo]) if hi == lo + 1 and len(texts[lo]) > PIECE else [b"\n".join(texts[lo:hi])]:
                    starts, term = vocabulary.find(np.frombuffer(piece, np.uint8))
                    doc = lo + (np.searchsorted(bounds, starts, side="right") if hi > lo + 1 else np.zeros(len(starts), np.int64))
                    n += np.bincount(doc, minlength=len(n))
                    pair, c = np.unique((doc * size + term)[term >= 0], return_counts=True)
                    pairs.append(pair)
                    times.append(c)
            pair, inverse = np.unique(np.concatenate(pairs), return_inverse=True) if pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            tf = np.zeros(len(pair), np.int64)
            np.add.at(tf, inverse, np.concatenate(times) if times else np.zeros(0, np.int64))
            edges = pa.array(np.searchsorted(pair, np.arange(len(texts) + 1) * size).astype(np.int32))
            out = pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("_row"), pa.array(n), pa.ListArray.from_arrays(edges, pa.array((pair % size).astype(np.int32))), pa.ListArray.from_arrays(edges, pa.array(tf))],
                names=["doc_id", "_row", "n", "terms", "tfs"],
            )
            yield out.filter(pa.array(n > 0))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("_row"), text_of().cast("binary").alias("_text"))
    return written(rows.mapInArrow(count, "doc_id long, _row long, n long, terms array<int>, tfs array<long>"), "counted")


def settle(lists: list[tuple[np.ndarray, np.ndarray]], docs: int, least: int, config: LexicalConfig) -> tuple[np.ndarray, np.ndarray, int]:
    """NRA over impact-sorted lists of (document, impact): the documents that reach the ``top``-th best score, or ``least`` if that is more,
    their scores, and the postings read."""
    lower = np.zeros(docs, np.int64)
    seen = np.zeros((len(lists), docs), bool)
    inside = np.zeros(docs, bool)  # may be among the best
    met = np.zeros(docs, bool)
    frontier = np.array([int(impact[0]) if len(impact) else 0 for _, impact in lists], np.int64)
    at, step, read = 0, config.step, 0
    open_ = True  # documents not yet met may be among the best
    live = np.zeros(0, np.int64)
    while True:
        fresh = []
        for j, (doc, impact) in enumerate(lists):
            d, add = doc[at : at + step], impact[at : at + step]
            read += len(d)
            frontier[j] = int(add[-1]) if at + step < len(doc) else 0
            if not open_:
                keep = inside[d]
                d, add = d[keep], add[keep]
            else:
                fresh.append(d[~met[d]])
                met[d] = True
            lower[d] += add
            seen[j, d] = True
        if open_:
            new = np.unique(np.concatenate(fresh))
            live = np.concatenate((live, new))
            inside[new] = True
        if len(live) >= config.top:
            least = max(least, int(np.partition(lower[live], len(live) - config.top)[len(live) - config.top]))
        rest = frontier @ ~seen[:, live]
        stay = lower[live] + rest >= least
        inside[live[~stay]] = False
        live, rest = live[stay], rest[stay]
        open_ = open_ and bool(frontier.any()) and int(frontier.sum()) >= least
        if not open_ and not rest.any():
            return live, lower[live], read
        at += step
        step *= 2


class Chunk:
    """Postings of some documents as one list per term, largest impact first."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray):
        order = np.lexsort((-impact, term))
        self.doc, self.impact = doc[order], impact[order]
        self.terms, self.first = np.unique(term[order], return_index=True)
        self.last = np.append(self.first[1:], len(order))

    def lists(self, terms: np.ndarray, times: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        found = []
        if not len(self.terms):
            return found
        for t, c, k in zip(terms, times, np.searchsorted(self.terms, terms), strict=True):
            if k < len(self.terms) and self.terms[k] == t:
                rows = slice(self.first[k], self.last[k])
                if self.impact[rows.start] > 0:
                    found.append((self.doc[rows], self.impact[rows] * c))
        return found


def rank_documents(rows: DataFrame, weights: np.ndarray, items: list[tuple[int, np.ndarray, np.ndarray]], config: LexicalConfig) -> DataFrame:
    """_item, doc_id, _row, score: each task's best documents of every item. ``rows``: counted documents with m; ``items``: number, terms, repeats."""
    shared = rows.sparkSession.sparkContext.broadcast((weights, items))

    def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, asked = shared.value
        best: dict[int, list[tuple[int, int, int]]] = {number: [] for number, _, _ in asked}

        def score(held: list[pa.RecordBatch]) -> None:
            whole = pa.Table.from_batches(held).combine_chunks()
            ids, own, m = whole.column("doc_id").fill_null(NO_ID).to_numpy(), whole.column("_row").to_numpy(), whole.column("m").to_numpy()
            terms, tfs = whole.column("terms").combine_chunks(), whole.column("tfs").combine_chunks()
            doc = np.repeat(np.arange(len(ids)), terms.value_lengths().to_numpy())
            term, tf = terms.flatten().to_numpy(), tfs.flatten().to_numpy()
            chunk = Chunk(term, doc, weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc])))
            for number, wanted, times in asked:
                lists = chunk.lists(wanted, times)
                if not lists:
                    continue
                kept = best[number]
                found, scores, _ = settle(lists, len(ids), -kept[-1][0] if len(kept) == config.top else 1, config)
                kept += zip((-scores).tolist(), ids[found].tolist(), own[found].tolist(), strict=True)
                kept.sort()
                del kept[config.top :]

        held, docs, postings = [], 0, 0
        for part in parts:
            lo = 0
            sizes = np.cumsum(part.column("terms").value_lengths().to_numpy(zero_copy_only=False))
            while lo < part.num_rows:
                before = int(sizes[lo - 1]) if lo else 0
                hi = max(lo + 1, min(lo + config.chunk - docs, int(np.searchsorted(sizes, before + config.postings - postings, side="right"))))
                held.append(part.slice(lo, hi - lo))
                docs, postings, lo = docs + hi - lo, postings + int(sizes[hi - 1]) - before, hi
                if docs >= config.chunk or postings >= config.postings or lo < part.num_rows:
                    score(held)
                    held, docs, postings = [], 0, 0
        if held:
            score(held)
        flat = [(number, None if i == NO_ID else i, r, -s) for number, kept in best.items() for s, i, r in kept]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*flat, strict=True) if flat else ([], [], [], []))], names=["_item", "doc_id", "_row", "score"])

    return rows.select("doc_id", "_row", "m", "terms", "tfs").mapInArrow(search, "_item long, doc_id long, _row long, score long")


def item_terms(items: DataFrame, config: LexicalConfig) -> DataFrame:
    """_item (a number of the row), item_id, term, times and _block, a number shared by items of bounded bytes. Written."""
    numbered = written(items.select(F.col("item_id"), F.monotonically_increasing_id().alias("_item"), lower_ascii(text_of()).alias("_text")), "items")
    upto = running_totals(numbered.select("_item", (F.octet_length("_text") + 8).alias("_bytes")), [F.col("_item")], {"_upto": F.col("_bytes")})
    block = upto.select("_item", F.expr(f"_upto div {config.block_bytes}").alias("_block"))
    terms = numbered.select("_item", "item_id", F.explode(F.regexp_extract_all("_text", F.lit(TERM), F.lit(0))).alias("term"))
    return written(terms.groupBy("_item", "item_id", "term").agg(F.count("*").alias("times")).join(block, "_item"), "terms")


def search(docs: DataFrame, items: DataFrame, config: LexicalConfig = LexicalConfig()) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of each item."""
    spark = docs.sparkSession
    asked = item_terms(items, config)
    found = None
    for block in sorted(r[0] for r in asked.select("_block").distinct().collect()):
        # The terms of one block: bounded by block_bytes and one item.
        table = asked.filter(F.col("_block") == block).select("_item", "term", "times").toArrow()
        terms = sorted(set(table.column("term").to_pylist()))
        place = {t: i for i, t in enumerate(terms)}
        items_of: dict[int, tuple[list[int], list[int]]] = {}
        for number, term, times in zip(*(table.column(c).to_pylist() for c in ("_item", "term", "times")), strict=True):
            own = items_of.setdefault(number, ([], []))
            own[0].append(place[term])
            own[1].append(times)
        rows = counted(docs, [t.encode() for t in terms])
        total = rows.agg(F.count("*").alias("N"), F.sum("n").alias("L")).first()
        if not total.N:
            continue
        n_docs, length = total.N, total.L
        df = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2.0) / (2.0 * F.col("df") + 1.0))).cast("long")
        weights = np.zeros(len(terms), np.int64)
        heavy = df.select("term", weight.alias("w")).toArrow()
        weights[heavy.column("term").to_numpy()] = heavy.column("w").to_numpy()
        measure = F.expr(f"75 + CAST((CAST(25 AS DECIMAL(10, 0)) * n * CAST({n_docs} AS DECIMAL(20, 0))) div CAST({length} AS DECIMAL(20, 0)) AS BIGINT)")
        ordered = [(number, np.array(t), np.array(c)) for number, (t, c) in items_of.items()]
        one = rank_documents(rows.withColumn("m", measure), weights, ordered, config).withColumn("_part", F.spark_partition_id() % 64)
        found = one if found is None else found.unionByName(one)
    if found is None:
        kind = items.schema["item_id"].dataType.simpleString()
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.col("_row")]
    for part in (["_item", "_part"], ["_item"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*part).orderBy(*order))).filter(F.col("rank") <= config.top)
    names = asked.select("_item", "item_id").distinct()
    return found.join(names, "_item").select("item_id", "rank", "doc_id", "score")
