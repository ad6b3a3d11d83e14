"""Removal of repeated byte strings with suffix arrays.

Every byte covered by a string of ``length`` bytes that also starts earlier in
the corpus (documents in order of id) is removed; matches never cross documents.

Each window of ``length`` bytes is sent to a shard by the smallest hash of the
short strings inside it, its anchor. Equal windows have equal anchors, so they
meet in one shard, and neighbouring windows mostly share one, so what moves is
runs of windows, not windows. A run that occurs again as a whole is settled by
its digest, in its own batch already where that holds an earlier one; where
different runs share an anchor and what stands on one side of it, the shard's suffix array, sorted by induction,
and its permuted common prefixes tell which windows are equal, byte by byte.

Anchors that a Misra-Gries sketch finds with ``crowd`` runs or more are heavy:
their runs travel as single windows under their own digests, which spreads
them over all tasks and leaves one kind per digest.

Defined results: null texts are empty; ids compare as numbers, null last;
documents with the same id follow a hash of their text; repeated rows count as
later copies; shorter texts than ``length`` keep all; an empty table gives no rows;
extra columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accesslens.llm.chosen_path import grouped
from accesslens.llm.common import text_of, written
from accesslens.llm.induced import common_prefixes, suffix_array
from accesslens.llm.wordhash import batches, mixed


@dataclass(frozen=True)
class RepeatConfig:
    """length: bytes of a repeat; seed: bytes of the strings anchors are chosen from; crowd: runs that make an
    anchor heavy; shard: bytes of text per suffix array, about."""

    length: int = 100
    seed: int = 16
    crowd: int = 4096
    shard: int = 1_000_000


#: Bytes worked on at once; a longer text is cut in overlapping pieces.
PIECE = 1_000_000
HELD: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number per byte, powers of an odd base and of its inverse; made once a process."""
    if "made" not in HELD:
        base = 0x9E3779B97F4A7C15
        n = 2 * PIECE + 1024
        up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        HELD["made"] = (np.random.default_rng(7).integers(0, 2**64, 256, dtype=np.uint64), up, down)
    return HELD["made"]


def anchors(data: np.ndarray, config: RepeatConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of ``data``: where its anchor is; the hashes of all short strings; and the running sums that hash any string."""
    random, up, down = powers()
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(random[data] * up[: len(data)], dtype=np.uint64)))
    hashes = mixed((total[config.seed :] - total[: -config.seed]) * down[: len(data) - config.seed + 1])
    # The leftmost of the smallest: the position breaks ties.
    key = (hashes & ~np.uint64((1 << 24) - 1)) | np.arange(len(hashes), dtype=np.uint64)
    span, reach = config.length - config.seed + 1, 1
    while reach * 2 <= span:
        key = np.minimum(key[:-reach], key[reach:])
        reach *= 2
    if span > reach:
        key = np.minimum(key[: len(key) - (span - reach)], key[span - reach :])
    return (key & np.uint64((1 << 24) - 1)).astype(np.int64), hashes, total


def sides(total: np.ndarray, anchor: np.ndarray, start: np.ndarray, end: np.ndarray, config: RepeatConfig) -> np.ndarray:
    """Hashes of what stands left and right of each run's anchor, 32 bits each, 0 where the run does not reach that far.

    A window is the anchor's string and ``length - seed`` bytes around it, at least half of them on one side: runs
    that share a window share a side.
    """
    down, reach = powers()[2], (config.length - config.seed) // 2
    packed = np.zeros(len(anchor), np.uint64)
    for low, inside, shift in ((anchor - reach, anchor - reach >= start, 32), (anchor + config.seed, anchor + config.seed + reach <= end, 0)):
        at = low[inside]
        packed[inside] |= ((mixed((total[at + reach] - total[at]) * down[at]) >> np.uint64(32)) | np.uint64(1)) << np.uint64(shift)
    return packed.view(np.int64)


def cut_up(texts: list[bytes], config: RepeatConfig) -> list[tuple[int, int, bytes]]:
    """Every text that has a window, in parts of at most ``PIECE`` windows: which text, where the part starts, its bytes."""
    return [
        (k, lo, text[lo : lo + PIECE + config.length - 1]) for k, text in enumerate(texts) for lo in range(0, max(len(text) - config.length + 1, 0), PIECE)
    ]


def runs_of(parts: list[bytes], config: RepeatConfig):
    """Runs of windows with one anchor: which part, start in it, windows, the anchor's hash and sides, place in the joined parts, and these."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    where, hashes, total = anchors(data, config)
    size = np.array([len(p) for p in parts])
    begin = np.cumsum(size) - size
    count = size - config.length + 1
    # Windows inside one part only.
    part = np.repeat(np.arange(len(parts)), count)
    window = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + begin[part]
    anchor = where[window]
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])))
    first = np.flatnonzero(new)
    width = np.diff(np.append(first, len(window)))
    start, whose = window[first], part[first]
    at = anchor[first]
    return whose, start - begin[whose], width, hashes[at].view(np.int64), sides(total, at, start, start + width + config.length - 1, config), start, data.tobytes()


def removed_windows(texts: list[bytes], places: np.ndarray, widths: np.ndarray, config: RepeatConfig) -> list[tuple[int, int, int]]:
    """Among runs of windows (texts, corpus positions, windows): (run, first, end) of windows that also start earlier."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    order = suffix_array(data, 256)
    shared = common_prefixes(data, order, config.length)
    size = np.array([len(t) for t in texts])
    begin = np.cumsum(size) - size
    run = np.repeat(np.arange(len(texts)), size)
    inside = np.arange(len(data)) - begin[run]
    place = np.where(inside < widths[run], places[run] + inside, np.iinfo(np.int64).max)
    block = np.cumsum(shared[order] < config.length) - 1
    least = np.minimum.reduceat(place[order], np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))))
    later = np.zeros(len(data), bool)
    later[order] = place[order] > least[block]
    later &= inside < widths[run]
    edge = np.diff(np.concatenate(([False], later, [False])).view(np.int8))
    out = []
    for lo, hi in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
        while lo < hi:  # neighbouring runs may both end and begin with a removed window
            end = min(hi, begin[run[lo]] + size[run[lo]])
            out.append((int(run[lo]), int(inside[lo]), int(inside[lo] + end - lo)))
            lo = end
    return out


LAST = 2**63 - 1


def keyed(docs: DataFrame) -> DataFrame:
    """Documents by _doc (the id, a null one last) and _t (a hash of the text), with the text's bytes."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_doc"), F.xxhash64(text_of()).alias("_t"), text_of().cast("binary").alias("_text"))


def with_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (_doc, _t, and more; a written table) with the texts; equal rows of ``docs`` give one each.

    Documents are first looked up in a bitmap of the wanted hashes, of at most 8 MB, so that of the others next
    to none moves.
    """
    bits = 1 << min(26, max(15, (16 * wanted.count()).bit_length()))
    value = F.pmod(F.col("_t"), F.lit(bits)) + 1
    bucket, bit = F.bitmap_bucket_number(value), F.bitmap_bit_position(value)
    maps = wanted.select(bucket.alias("_bucket"), bit.alias("_bit")).groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_map"))
    near = keyed(docs).withColumns({"_bucket": bucket, "_bit": bit}).join(F.broadcast(written(maps, "bitmap")), "_bucket")
    byte = F.conv(F.hex(F.substring("_map", (F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = F.expr("shiftright(_byte, cast(_bit % 8 as int))").bitwiseAND(F.lit(1)) == 1
    return near.withColumn("_byte", byte).filter(marked).select("_doc", "_t", "_text").join(wanted, ["_doc", "_t"])


def cut(config: RepeatConfig, heavy: np.ndarray, anchors_only: bool = False):
    """All runs of the texts of a task. A run that the same batch holds earlier is settled (``_open`` false) on the spot.

    Runs of a ``heavy`` anchor become single windows under their own hash, which spreads them.
    """

    def runs(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts, doc, text_hash = part.column("_text").to_pylist(), part.column("_doc").to_numpy(), part.column("_t").to_numpy()
            cuts = cut_up(texts, config)
            owner, shift = np.array([c[0] for c in cuts], np.int64), np.array([c[1] for c in cuts], np.int64)
            held = []
            for lo, hi in batches([c[2] for c in cuts], PIECE + config.length):
                whose, start, width, anchor, side, at, data = runs_of([c[2] for c in cuts[lo:hi]], config)
                if anchors_only:
                    yield pa.RecordBatch.from_arrays([pa.array(anchor)], names=["_fp"])
                    continue
                crowd = np.isin(anchor, heavy)
                if crowd.any():
                    n = np.where(crowd, width, 1)
                    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    crowd, whose, start, at, anchor, side = (np.repeat(v, n) for v in (crowd, whose, start, at, anchor, side))
                    width = np.where(crowd, 1, np.repeat(width, n))
                    start, at = start + step * crowd, at + step * crowd
                ends = at + width + config.length - 1
                digest = np.frombuffer(b"".join([hashlib.blake2b(data[a:b], digest_size=8).digest() for a, b in zip(at.tolist(), ends.tolist(), strict=True)]), np.int64)
                held.append((np.where(crowd, digest, anchor), digest, owner[lo:hi][whose], start + shift[lo:hi][whose], width, side))
            if not held:
                continue
            anchor, digest, whose, start, width, side = (np.concatenate(v) for v in zip(*held, strict=True))
            order = np.lexsort((start, text_hash[whose], doc[whose], digest, anchor))
            anchor, digest, whose, start, width, side = (v[order] for v in (anchor, digest, whose, start, width, side))
            first = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (digest[1:] != digest[:-1])))
            # The same place comes again from repeated rows: it is not later than itself, and its lead stands for it.
            lead = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
            again = ~first & (doc[whose] == doc[whose[lead]]) & (text_hash[whose] == text_hash[whose[lead]]) & (start == start[lead])
            anchor, digest, whose, start, width, side, first = (v[~again] for v in (anchor, digest, whose, start, width, side, first))
            # What is settled needs no meeting and goes anywhere.
            to = np.where(first, anchor, text_hash[whose])
            yield pa.RecordBatch.from_arrays(
                [pa.array(to), pa.array(digest), pa.array(doc[whose]), pa.array(text_hash[whose]), pa.array(start.astype(np.int32)), pa.array(width.astype(np.int32)), pa.array(side), pa.array(first)],
                names=["_fp", "_r", "_doc", "_t", "_start", "_width", "_side", "_open"],
            )

    return runs


def settle(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs that are sorted by anchor: later occurrences of a run (``_kinds`` 0), and the first of each run where an anchor has several kinds."""
    for part in grouped(parts, "_fp", 50_000):
        fp, r, doc, t, start, width, side, is_open = (part.column(n).to_numpy() for n in ("_fp", "_r", "_doc", "_t", "_start", "_width", "_side", "_open"))
        order = np.lexsort((start, t, doc, r, fp, ~is_open))
        fp, r, doc, t, start, width, side, is_open = (v[order] for v in (fp, r, doc, t, start, width, side, is_open))
        own = np.concatenate(([True], (fp[1:] != fp[:-1]) | (is_open[1:] != is_open[:-1])))
        first = own | np.concatenate(([True], r[1:] != r[:-1]))
        # The same place may come twice, from repeated rows: it is not later than itself.
        lead = np.maximum.accumulate(np.where(first, np.arange(len(fp)), 0))
        same = (doc == doc[lead]) & (t == t[lead]) & (start == start[lead])
        group = np.cumsum(own) - 1
        kinds = np.bincount(group, first)[group].astype(np.int32)
        kinds[~is_open | ~same] = 0
        several = np.flatnonzero(first & (kinds > 1))
        # Of different runs only those that share a side with another can share a window.
        near = np.zeros(len(several), bool)
        for own_side in (side[several].view(np.uint64) >> np.uint64(32), side[several].view(np.uint64) & np.uint64(0xFFFFFFFF)):
            _, which, n = np.unique(mixed(fp[several].view(np.uint64)) + own_side, return_inverse=True, return_counts=True)
            near |= (own_side > 0) & (n[which] > 1)
        out = (~is_open) | (~same)
        out[several[near]] = True
        yield pa.RecordBatch.from_arrays([pa.array(v[out]) for v in (fp, doc, t, start, width, kinds)], names=["_fp", "_doc", "_t", "_start", "_width", "_kinds"])


def repeats(docs: DataFrame, config: RepeatConfig) -> DataFrame:
    """Intervals of bytes to remove: _doc, _t, _from, _to; they overlap."""
    long = keyed(docs).filter(F.octet_length("_text") >= config.length)
    top = long.mapInArrow(cut(config, np.zeros(0, np.int64), anchors_only=True), "_fp long").agg(F.expr("approx_top_k(_fp, 1024, 8192)").alias("_top"))
    heavy = np.array([x["item"] for x in top.first()._top or [] if x["count"] >= config.crowd], np.int64)  # at most 1,024
    runs = long.mapInArrow(cut(config, heavy), "_fp long, _r long, _doc long, _t long, _start int, _width int, _side long, _open boolean")
    judged = runs.repartition("_fp").sortWithinPartitions("_fp").mapInArrow(settle, "_fp long, _doc long, _t long, _start int, _width int, _kinds int")
    judged = written(judged, "judged")
    whole = judged.filter("_kinds = 0").select("_doc", "_t", F.col("_start").cast("long").alias("_from"), (F.col("_start") + F.col("_width") + config.length - 1).cast("long").alias("_to"))
    asked = judged.filter("_kinds > 1").groupBy("_doc", "_t").agg(F.collect_list(F.struct("_fp", "_start", "_width")).alias("_runs"))
    one = with_texts(docs, written(asked, "open")).dropDuplicates(["_doc", "_t"]).select("_doc", "_t", "_text", F.explode("_runs").alias("_r"))
    run = F.substring("_text", F.col("_r._start") + 1, F.col("_r._width") + config.length - 1)
    texts = one.select("_doc", "_t", F.col("_r._fp").alias("_fp"), F.col("_r._start").cast("long").alias("_start"), F.col("_r._width").alias("_width"), run.alias("_run"))
    found = texts.repartition("_fp").sortWithinPartitions("_fp").mapInArrow(shard_repeats(config), "_doc long, _t long, _from long, _to long")
    return whole.unionByName(found)


def shard_repeats(config: RepeatConfig):
    """Suffix arrays over the runs of a shard, some anchors at a time: intervals (_doc, _t, _from, _to) to remove."""

    def settle(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in grouped(parts, "_fp", 2000):
            group = part.column("_fp").to_numpy()
            texts, start, width = part.column("_run").to_pylist(), part.column("_start").to_numpy(), part.column("_width").to_numpy()
            # One number per place: the rank of the document among those of this batch, then the offset.
            docs = np.stack([part.column("_doc").to_numpy(), part.column("_t").to_numpy()])
            _, rank = np.unique(docs, axis=1, return_inverse=True)
            place = (rank.ravel().astype(np.int64) << 40) + start
            ends = np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, len(group))
            found, lo, held, seen = [], 0, 0, 0
            for hi in ends:
                held += sum(len(t) for t in texts[seen:hi])
                seen = hi
                if held >= config.shard or hi == ends[-1]:
                    found += [(lo + run, a, b) for run, a, b in removed_windows(texts[lo:hi], place[lo:hi], width[lo:hi], config)]
                    lo, held = hi, 0
            run, a, b = (np.array([f[k] for f in found], np.int64) for k in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(docs[0][run]), pa.array(docs[1][run]), pa.array(start[run] + a), pa.array(start[run] + b - 1 + config.length)], names=["_doc", "_t", "_from", "_to"])

    return settle


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping or touching intervals as one."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > ends[:-1]))
    return starts[new], ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)]


def without_repeats(docs: DataFrame, config: RepeatConfig = RepeatConfig(), texts: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with ``texts`` also the remaining bytes, ``kept``."""
    rows = written(
        docs.select(
            F.col("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_doc"), F.xxhash64(text_of()).alias("_t"),
            F.octet_length(text_of()).cast("long").alias("n_bytes"), F.sha2(text_of().cast("binary"), 256).alias("_sha"),
        ).withColumn("_tag", F.monotonically_increasing_id()), "texts",
    )
    cuts = repeats(docs, config).groupBy("_doc", "_t").agg(F.collect_list(F.struct("_from", "_to")).alias("_cuts"))

    def trim(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = []
            for doc, t, text, spans in zip(part.column("_doc").to_pylist(), part.column("_t").to_pylist(), part.column("_text"), part.column("_cuts"), strict=True):
                flat = spans.values.flatten()
                lo, hi = merged(flat[0].to_numpy(), flat[1].to_numpy())
                data = text.as_py()
                kept = b"".join(data[a:b] for a, b in zip([0, *hi.tolist()], [*lo.tolist(), len(data)], strict=True))
                out.append({"_doc": doc, "_t": t, "_gone": int((hi - lo).sum()), "_spans": len(lo), "_kept_sha": hashlib.sha256(kept).hexdigest(), "kept": kept if texts else None})
            yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("_doc", pa.int64()), ("_t", pa.int64()), ("_gone", pa.int64()), ("_spans", pa.int64()), ("_kept_sha", pa.string()), ("kept", pa.binary())])
    trimmed = with_texts(docs, written(cuts, "cuts")).mapInArrow(trim, "_doc long, _t long, _gone long, _spans long, _kept_sha string, kept binary")
    cleaned = written(trimmed, "cleaned").dropDuplicates(["_doc", "_t"])
    again = rows.groupBy("_doc", "_t").agg(F.min("_tag").alias("_first"), F.count("*").alias("_times")).filter("_times > 1").drop("_times")
    marked = rows.join(again, ["_doc", "_t"], "left").join(cleaned, ["_doc", "_t"], "left")
    # All but the first of equal rows go whole.
    copy = (F.col("_tag") > F.coalesce("_first", "_tag")) & (F.col("n_bytes") >= config.length)
    own = F.col("_gone").isNotNull()
    empty = hashlib.sha256(b"").hexdigest()
    return marked.select(
        "doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).when(own, F.col("_gone")).otherwise(0).cast("long").alias("n_removed"),
        F.when(copy, 1).when(own, F.col("_spans")).otherwise(0).cast("long").alias("n_spans"), F.when(copy, empty).when(own, F.col("_kept_sha")).otherwise(F.col("_sha")).alias("kept_sha256"),
        *[F.when(copy, F.lit(b"")).when(own, F.col("kept")).alias("kept")] * texts,
    )
