"""Structured Streaming jobs: keyed state per entity, then the same column expressions as in batch."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from accesslens.operators import detect as de
from accesslens.operators import features as fe
from accesslens.operators.profiles import KEY, Profiles
from accesslens.operators.scan import SkewConfig
from accesslens.schemas import OPTIONAL_EVENT_COLUMNS, REQUIRED_EVENT_COLUMNS
from accesslens.session import work_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class StreamConfig:
    """late       how far behind the newest event a row may arrive; it waits that long for rows before it
    expiry_ms     event time after which the state of a silent entity is cleared; None keeps it for good
    files         files per micro-batch
    groups        entities of one hash group share a call of the Python worker; the state is keyed by it, so a
                  checkpoint can be resumed only with the number it began with
    """

    late: str = "1 day"
    expiry_ms: int | None = None
    files: int = 16
    groups: int = 1024

    @property
    def bucket_ms(self) -> int:
        """Event time of the waiting rows that are stored, and come out, together."""
        return max(1000, int(pd.Timedelta(self.late).total_seconds() * 1000) // 64)


#: Entity of the row that ends a finite stream (see ``closing_row``); it never appears in an output.
END_ENTITY = "\x7fend-of-stream"


#: Column by which the state is keyed: the hash group of the entity.
GROUP = "entity_group"


class Parts:
    """Rows that lie part after part, each part in order: where the parts begin, and slots for running values.

    A part has a slot for the value before each of its rows, and one for the value after all of them.
    """

    def __init__(self, sizes: np.ndarray, names: list[str] | None = None) -> None:
        self.names, self.sizes = names, np.asarray(sizes, np.int64)
        number = len(self.sizes)
        self.first = np.concatenate(([0], np.cumsum(self.sizes)))[:-1]
        self.last = self.first + self.sizes - 1
        self.code = np.repeat(np.arange(number), self.sizes)
        self.place = np.arange(len(self.code)) - self.first[self.code]
        #: Slot of the value before each row, and of the value after each part.
        self.before, self.after = np.arange(len(self.code)) + self.code, self.last + 1 + np.arange(number)
        self.owner = np.repeat(np.arange(number), self.sizes + 1)
        self.slots = np.arange(len(self.owner)) - self.owner

    def shifted(self, values: list, start: list) -> list:
        """The value before each one in its part; ``start`` stands before the first ones."""
        found = [None, *values[:-1]]
        for row, one in zip(self.first.tolist(), start, strict=True):
            found[row] = one
        return found


def _entity_key(name: str | None) -> str:
    """Key of an entity in state; there is one for rows without an entity."""
    return "" if pd.isna(name) else f"={name}"


class InOrder(StatefulProcessor):
    """Hands each entity's rows to ``advance`` in (timestamp, event_id) order, however they arrive.

    The state is keyed by groups of entities, so that the work per call and per row that waits is shared; what
    is known of an entity lies under its own key inside the group.

    Rows wait in state until the watermark has passed them: then no accepted row can come before them any
    more, so the result does not depend on arrival order or on how files fall into micro-batches. They come
    out in buckets of event time. A bucket with many rows is a piece of its own, stored once and read once,
    however long the lateness and however many rows wait behind it; small neighbouring ones share a piece,
    of which the rows that are not due are put back. A piece has one timer, for its first bucket.
    """

    #: Rows of a piece of several buckets, at most: reading so many takes hardly longer than reading one.
    PIECE_ROWS = 512

    def __init__(self, config: StreamConfig) -> None:
        self.expiry_ms, self.bucket_ms = config.expiry_ms, config.bucket_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "first bigint, last bigint, part bigint", "rows binary")
        self.parts = handle.getValueState("parts", "next bigint")
        self.newest = handle.getMapState("newest", "entity string", "ms bigint")
        self.swept = None
        self.open_state(handle)

    def open_state(self, handle: StatefulProcessorHandle) -> None:
        """Declare the state of the entities."""
        raise NotImplementedError

    def advance(self, batch: pd.DataFrame, parts: Parts) -> pd.DataFrame:
        """Rows that follow all rows seen before of their entities, a part each, with what they need from state."""
        raise NotImplementedError

    def forget(self, entity: str) -> None:
        """Clear the state of an entity."""
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self._wait(pd.concat(list(rows), ignore_index=True))
        return iter([])

    def _bucket(self, rows: pd.DataFrame) -> np.ndarray:
        return (_micros(rows) // (1000 * self.bucket_ms)).to_numpy()

    def _wait(self, rows: pd.DataFrame) -> None:
        """Store rows in pieces: a bucket each, or neighbouring buckets with few rows in all."""
        bucket = self._bucket(rows)
        order = np.argsort(bucket, kind="stable")
        data, bucket = pa.Table.from_pandas(rows.take(order), preserve_index=False), bucket[order]
        found = self.parts.get()
        part = found[0] if found is not None else 0
        for low, high in _pieces(bucket, self.PIECE_ROWS):
            self.waiting.updateValue((int(bucket[low]), int(bucket[high - 1]), part), (_packed(data.slice(low, high - low)),))
            self.handle.registerTimer((int(bucket[low]) + 1) * self.bucket_ms)
        self.parts.update((part + 1,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        due = sorted(k for k in map(tuple, self.waiting.keys()) if (k[0] + 1) * self.bucket_ms <= passed)
        if due:
            pieces = [pa.ipc.open_stream(bytes(self.waiting.getValue(k)[0])).read_all() for k in due]
            rows = pa.concat_tables(pieces, promote_options="permissive").to_pandas()
            for k in due:
                self.waiting.removeKey(k)
            ready = (self._bucket(rows) + 1) * self.bucket_ms <= passed
            if not ready.all():
                self._wait(rows[~ready])
            # Rows that name no entity are of one.
            rows = rows[ready]
            code, names = pd.factorize(rows[KEY] if KEY in rows else np.zeros(len(rows)), use_na_sentinel=False)
            names = [_entity_key(name) for name in names.tolist()]
            order = _in_time(rows, code)
            batch, code = rows.take(order).reset_index(drop=True), code[order]
            if self.expiry_ms is None:
                yield self.advance(batch, Parts(np.bincount(code, minlength=len(names)), names))
            else:
                yield from self._between_silences(batch, code, names)
        if self.expiry_ms is not None and self.swept != (key, passed):
            self.swept = (key, passed)
            self._expire(passed)

    def _between_silences(self, batch: pd.DataFrame, code: np.ndarray, names: list[str]) -> Iterator[pd.DataFrame]:
        """The ordered rows, cut where an entity was silent for longer than the expiry; its state is cleared there."""
        ms = (_micros(batch) // 1000).to_numpy()
        begins = np.concatenate(([True], code[1:] != code[:-1]))
        before = np.concatenate((ms[:1], ms[:-1]))
        for row in np.flatnonzero(begins).tolist():
            found = self.newest.getValue((names[code[row]],))
            before[row] = found[0] if found is not None else ms[row]
        silent = ms - before > self.expiry_ms
        # Which silence of the batch a row comes after: the first parts of all entities go on together, then the second ones.
        total = np.cumsum(silent)
        past = total - total[np.maximum.accumulate(np.where(begins, np.arange(len(code)), 0))]
        for turn in range(int(past.max()) + 1):
            own = np.flatnonzero(past == turn)
            for c in np.unique(code[own[silent[own]]]).tolist():
                self.forget(names[c])
            present, at = np.unique(code[own], return_inverse=True)
            yield self.advance(batch.iloc[own].reset_index(drop=True), Parts(np.bincount(at), [names[c] for c in present.tolist()]))
        ends = np.flatnonzero(np.concatenate((begins[1:], [True]))).tolist()
        for row in ends:
            self.newest.updateValue((names[code[row]],), (int(ms[row]),))
        for bucket in np.unique((ms[ends] + self.expiry_ms) // self.bucket_ms).tolist():
            self.handle.registerTimer((bucket + 2) * self.bucket_ms + 1)

    def _expire(self, passed: int) -> None:
        """Clear the entities none of whose waiting rows can follow their newest one within the expiry."""
        for entity, ms in [(k[0], v[0]) for k, v in self.newest.iterator()]:
            if ms + self.expiry_ms + self.bucket_ms < passed:
                self.newest.removeKey((entity,))
                self.forget(entity)

    def close(self) -> None:
        pass


def _in_time(rows: pd.DataFrame, code: np.ndarray) -> np.ndarray:
    """Order by code, timestamp and event id; unknown ones come last."""
    at = np.where(rows["timestamp"].isna(), np.iinfo(np.int64).max, _micros(rows))
    order = np.lexsort((at, code))
    if ((at[order][1:] == at[order][:-1]) & (code[order][1:] == code[order][:-1])).any():
        event, found = pd.factorize(rows["event_id"], sort=True)
        order = np.lexsort((np.where(event < 0, len(found), event), at, code))
    return order


def _pieces(bucket: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Slices of ordered buckets that hold one bucket, or several with ``most`` rows in all at most."""
    edges = [*(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
    found, low, before = [], 0, 0
    for edge in edges:
        if before > low and edge - low > most:
            found.append((low, before))
            low = before
        before = edge
    return [*found, (low, len(bucket))]


def _micros(rows: pd.DataFrame) -> pd.Series:
    return rows["timestamp"].astype("datetime64[us]").astype("int64")


def _packed(data: pa.Table) -> bytes:
    """Rows as an Arrow stream."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, data.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
        writer.write_table(data)
    return sink.getvalue().to_pybytes()


class PreviousResource(InOrder):
    """Adds the entity's preceding resource to each event; state is the last one."""

    def open_state(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getMapState("last", "entity string", "resource string")

    def advance(self, batch: pd.DataFrame, parts: Parts) -> pd.DataFrame:
        before = [self.last.getValue((name,)) for name in parts.names]
        resources = batch["resource_accessed"].tolist()
        batch["previous_resource"] = parts.shifted(resources, [found[0] if found is not None else None for found in before])
        for name, row in zip(parts.names, parts.last.tolist(), strict=True):
            self.last.updateValue((name,), (resources[row],))
        return batch

    def forget(self, entity: str) -> None:
        self.last.removeKey((entity,))


#: Sums that may pass 64 bits leave the worker as two words: high and low, with so many bits in the low one.
WIDE_BITS = {"_s_x": 30, "_s_xx": 60, "_ma_sum": 30}
RAW_FEATURES = {
    "_rn": "bigint", "_n_device": "bigint", "_n_resource": "bigint", "_n_geo": "bigint", "_n_os": "bigint", "_n_mac": "bigint",
    "_le": "bigint", "_prev_us": "bigint", "_prev_geo": "string", "_prev_country": "string", "previous_resource": "string",
    "_ma_n": "bigint", "_drift_new": "bigint", "_drift_all": "bigint", "_s_ok": "bigint", "_s_mfa": "bigint",
    "_s_city": "bigint", "_s_res": "bigint", "_n_x": "bigint", "_last_ok": "bigint", "_older": "bigint",
    **{f"{name}_{word}": "bigint" for name in WIDE_BITS for word in ("high", "low")},
}
#: Running counts, in the order in which the state holds them.
COUNTS = ("_s_ok", "_s_mfa", "_s_city", "_s_res", "_n_x")
LIMB = 30
MASK = (1 << LIMB) - 1


def _carried(limbs: list[np.ndarray]) -> list[np.ndarray]:
    """The same numbers with every limb but the last below 2^30."""
    limbs = [limb.copy() for limb in limbs]
    for low, high in zip(limbs[:-1], limbs[1:]):
        high += low >> LIMB
        low &= MASK
    return limbs


def square_limbs(x: np.ndarray) -> list[np.ndarray]:
    """The squares of 64-bit integers as five limbs of 30 bits, lowest first."""
    a = np.abs(x).astype(np.uint64)  # the smallest integer stays negative, and is its own size without a sign
    low, mid, top = ((a >> np.uint64(LIMB * k)).astype(np.int64) & MASK for k in range(3))
    return _carried([low * low, 2 * low * mid, 2 * low * top + mid * mid, 2 * mid * top, top * top])


def _running(start: list, steps: list[np.ndarray], parts: Parts | None = None) -> list[np.ndarray]:
    """Limbs of the running sums of each part, the start included, in its slots: one entry more than there are steps."""
    parts = parts or Parts([len(steps[0])])
    found = []
    for before, step in zip(start, steps, strict=True):
        upto = np.concatenate(([0], np.cumsum(step)))
        found.append(np.atleast_1d(before)[parts.owner] + upto[parts.slots] - upto[parts.first][parts.owner])
    return _carried(found)


def _window(values: np.ndarray, at: np.ndarray, low: np.ndarray, width: int) -> np.ndarray:
    """Sums of the ``width`` values before each position, none of them before ``low``."""
    upto = np.concatenate(([0], np.cumsum(values)))
    return upto[at] - upto[np.maximum(low, at - width)]


class DigitCounts:
    """Order statistics of 64-bit integers in state: a radix tree of counts.

    Integers are classed by sign and number of base-16 digits; the node of ``CLASSES`` holds a count per class.
    Within a class there is a node for every run of leading digits that occurs, with a count for each digit that
    may follow. An integer touches one node per digit, so what a micro-batch reads and writes is proportional to
    its own integers, whatever the state holds. Each entity of the group has nodes of its own.
    """

    ZERO = 16
    CLASSES = (-1, -1, 0)

    def __init__(self, handle: StatefulProcessorHandle, name: str) -> None:
        self.nodes = handle.getMapState(f"{name}Nodes", "entity string, class int, level int, lead bigint", "n array<bigint>")

    def clear(self, entity: str) -> None:
        for key in [k for k in self.nodes.keys() if k[0] == entity]:
            self.nodes.removeKey(key)

    @classmethod
    def class_of(cls, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class, the digits as a number that is not negative); a negative integer is taken as its complement."""
        z = np.where(x < 0, ~x, x)
        digits = np.ones(len(x), np.int64)
        for k in range(1, 16):
            digits += z >> (4 * k) > 0
        return np.where(x < 0, cls.ZERO - digits, cls.ZERO + digits), z

    def add(self, x: np.ndarray, entity: str = "") -> np.ndarray:
        """How many stored integers of the entity are at most each of ``x``; stores them afterwards."""
        stored = self.nodes.getValue((entity, *self.CLASSES))
        totals = np.array(stored[0] if stored is not None else [0] * (2 * self.ZERO + 1), np.int64)
        kind, z = self.class_of(x)
        found = np.concatenate(([0], np.cumsum(totals)))[kind]
        for c in np.unique(kind).tolist():
            own = np.flatnonzero(kind == c)
            below = self._below_and_add(entity, c, z[own], inclusive=c > self.ZERO)
            # Of negative integers the complements run the other way.
            found[own] += below if c > self.ZERO else totals[c] - below
        self.nodes.updateValue((entity, *self.CLASSES), ((totals + np.bincount(kind, minlength=len(totals))).tolist(),))
        return found

    def _below_and_add(self, entity: str, kind: int, z: np.ndarray, inclusive: bool) -> np.ndarray:
        found = np.zeros(len(z), np.int64)
        for level in range(abs(kind - self.ZERO)):
            lead = z >> (4 * level + 4) if level < 15 else np.zeros_like(z)
            digit = (z >> (4 * level)) & 15
            leads, node = np.unique(lead, return_inverse=True)
            counts = np.zeros((len(leads), 16), np.int64)
            for i, one in enumerate(leads.tolist()):
                if (stored := self.nodes.getValue((entity, kind, level, one))) is not None:
                    counts[i] = stored[0]
            before = np.cumsum(counts, axis=1)
            if not (inclusive and level == 0):
                before = before - counts
            found += before[node, digit]
            np.add.at(counts, (node, digit), 1)
            for one, row in zip(leads.tolist(), counts.tolist(), strict=True):
                self.nodes.updateValue((entity, kind, level, one), (row,))
        return found


@dataclass
class Known:
    """What is known of an entity: totals, the last event, the tail the short windows look at, counts of the seen
    values (by tracked column) and the sorted durations; the last two are None where they lie in maps of their own."""

    n: int = 0
    last_ok: int = 0
    dropped: int = 0
    us: int | None = None
    geo: str | None = None
    country: str | None = None
    counts: tuple = (0,) * len(COUNTS)
    x: tuple = (0,) * 2
    xx: tuple = (0,) * 5
    #: Durations, whether they are known, resources and whether they were new, of the last rows.
    tail: tuple = ([], [], [], [])
    recent: list = field(default_factory=list)
    seen: list | None = field(default_factory=lambda: [{} for _ in fe.TRACKED])
    durations: bytes | None = b""


class PriorTotals(InOrder):
    """Adds to each event the raw prior quantities the feature expressions need.

    An entity is one record in state, which is read and written once per micro-batch. Counts of seen values and
    durations beyond ``INLINE`` move from it to maps, so that it stays small however long the history is. Within
    a micro-batch everything is vectorised; durations of any size are summed and squared without loss, and an
    unknown one counts nowhere.
    """

    #: Values, and durations, that an entity's record holds itself.
    INLINE = 1024

    def __init__(self, features: fe.FeatureConfig, config: StreamConfig) -> None:
        super().__init__(config)
        self.features = features

    def open_state(self, handle: StatefulProcessorHandle) -> None:
        self.records = handle.getMapState("records", "entity string", "record binary")
        self.durations = DigitCounts(handle, "durations")
        self.seen = handle.getMapState("seen", "entity string, value string", "n bigint")

    def _known(self, entity: str) -> Known:
        found = self.records.getValue((entity,))
        return Known(*pickle.loads(bytes(found[0]))) if found is not None else Known()

    def _occurrences(self, number: int, column: str, values: pd.Series, parts: Parts, known: list[Known]) -> np.ndarray:
        """Earlier rows of the entity with the same value, before and within this batch."""
        value, names = pd.factorize(values)
        names = names.tolist()
        pairs, pair, sizes = np.unique(parts.code * len(names) + value, return_inverse=True, return_counts=True)
        order = np.argsort(pair, kind="stable")
        found = np.empty(len(pair), np.int64)
        found[order] = np.arange(len(pair)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        earlier = []
        for at, size in zip(pairs.tolist(), sizes.tolist(), strict=True):
            one, name = at // len(names), names[at % len(names)]
            if (inline := known[one].seen) is not None:
                before = inline[number].get(name, 0)
                inline[number][name] = before + size
            else:
                key = (parts.names[one], f"{column}|{name}")
                stored = self.seen.getValue(key)
                before = stored[0] if stored is not None else 0
                self.seen.updateValue(key, (before + size,))
            earlier.append(before)
        return found + np.array(earlier, np.int64)[pair]

    def _not_above(self, x: np.ndarray, known: np.ndarray, parts: Parts, records: list[Known]) -> np.ndarray:
        """Earlier durations of the entity that are at most each one, before and within this batch."""
        found, rows = np.zeros(len(x), np.int64), np.flatnonzero(known)
        x, code = x[rows], parts.code[rows]
        within = _earlier_not_above(x, code)
        edges = np.searchsorted(code, np.arange(len(records) + 1)).tolist()
        for one, (low, high) in enumerate(zip(edges[:-1], edges[1:])):
            if low == high:
                continue
            record, entity, own = records[one], parts.names[one], x[low:high]
            if record.durations is None:
                within[low:high] += self.durations.add(own, entity)
                continue
            held = np.frombuffer(record.durations, np.int64)
            within[low:high] += np.searchsorted(held, own, side="right")
            held = np.sort(np.concatenate((held, own)))
            if len(held) > self.INLINE:
                self.durations.add(held, entity)
            record.durations = held.tobytes() if len(held) <= self.INLINE else None
        found[rows] = within
        return found

    def advance(self, batch: pd.DataFrame, parts: Parts) -> pd.DataFrame:
        cfg, code = self.features, parts.code
        records = [self._known(name) for name in parts.names]
        start = lambda name: np.array([getattr(r, name) for r in records], np.int64)
        us, x, known = batch["s_us"].to_numpy("int64"), batch["s_xv"].to_numpy("int64"), batch["s_xk"].to_numpy(bool)
        ok = batch["s_ok"].to_numpy(bool)
        n, last_ok, dropped = start("n"), start("last_ok"), start("dropped")
        out = {"_rn": n[code] + 1 + parts.place}
        for number, (column, name) in enumerate(fe.TRACKED.items()):
            out[name] = self._occurrences(number, column, batch[column].where(batch[column].notna(), "\0"), parts, records)
        fresh = (out["_n_resource"] == 0).astype("int64")
        geo, country, resource = (batch[c].tolist() for c in ("geo_location", "s_country", "resource_accessed"))
        out["_prev_us"] = pd.array(parts.shifted(us.tolist(), [r.us for r in records]), dtype="Int64")
        out["_prev_geo"] = parts.shifted(geo, [r.geo for r in records])
        out["_prev_country"] = parts.shifted(country, [r.country for r in records])
        out["previous_resource"] = parts.shifted(resource, [r.tail[2][-1] if r.tail[2] else None for r in records])
        # Short windows: the stored tail of each entity in front of its rows.
        ahead = np.array([len(r.tail[0]) for r in records], np.int64)
        low = parts.first + np.cumsum(ahead) - ahead
        at, low_at = (low + ahead)[code] + parts.place, low[code]

        def spread(number: int, values: np.ndarray, kind: str) -> np.ndarray:
            found = np.empty(len(values) + int(ahead.sum()), kind)
            found[at] = values
            for r, place, rows in zip(records, low.tolist(), ahead.tolist(), strict=True):
                found[place : place + rows] = r.tail[number]
            return found

        all_x, all_known, all_resources, all_fresh = (
            spread(number, values, kind) for number, (values, kind) in enumerate(((x, "int64"), (known, "int64"), (batch["resource_accessed"].to_numpy(object), "object"), (fresh, "int64")))
        )
        words = (_window(word, at, low_at, cfg.moving_average_window) for word in (all_x & MASK, all_x >> LIMB))
        out["_ma_sum_low"], out["_ma_sum_high"] = _carried(list(words))
        out["_ma_n"] = _window(all_known, at, low_at, cfg.moving_average_window)
        out["_drift_new"] = _window(all_fresh, at, low_at, cfg.drift_window)
        out["_drift_all"] = _distinct_before(all_resources, np.repeat(np.arange(len(records)), ahead + parts.sizes), at, low_at, cfg.drift_window)
        moved = np.array([p is not None and p != g for p, g in zip(out["_prev_geo"], geo)], bool)
        steps = {"_s_ok": ok, "_s_mfa": batch["auth_method"].to_numpy() == "mfa", "_s_city": moved, "_s_res": fresh, "_n_x": known}
        begin = list(start("counts").T)
        counts = [_running([one], [np.asarray(steps[name], "int64")], parts)[0] for name, one in zip(COUNTS, begin, strict=True)]
        for name, count in zip(COUNTS, counts, strict=True):
            out[name] = count[parts.before]
        sums = _running(list(start("x").T), [x & MASK, x >> LIMB], parts)
        squares = _running(list(start("xx").T), square_limbs(x), parts)
        if (squares[4] >= 8).any():
            raise OverflowError("the squares of an entity's durations pass 123 bits")
        out["_s_x_low"], out["_s_x_high"] = (word[parts.before] for word in sums)
        out["_s_xx_low"] = (squares[0] + (squares[1] << LIMB))[parts.before]
        out["_s_xx_high"] = (squares[2] + (squares[3] << LIMB) + (squares[4] << 2 * LIMB))[parts.before]
        # The last success up to each row, or what the record says where the entity's rows hold none.
        found = np.maximum.accumulate(np.where(ok, np.arange(len(code)), -1))
        upto = np.where(found >= parts.first[code], out["_rn"][found], last_ok[code])
        out["_last_ok"] = np.array(parts.shifted(upto.tolist(), last_ok.tolist()), np.int64)
        out["_older"] = np.empty(len(code), np.int64)
        out["_le"] = self._not_above(x, known, parts, records)
        keep = cfg.lookback
        last = [np.stack([word[parts.after] for word in words], axis=1).tolist() for words in (counts, sums, squares)]
        for one, (r, name, size, first) in enumerate(zip(records, parts.names, parts.sizes.tolist(), parts.first.tolist(), strict=True)):
            recent, end = np.concatenate((np.array(r.recent, "int64"), us[first : first + size])), first + size - 1
            out["_older"][first : end + 1] = r.dropped + np.searchsorted(recent, recent[-size:] - cfg.burst_us, side="left")
            cut = int(np.searchsorted(recent, recent[-1] - cfg.burst_us, side="left"))
            high = int(at[end]) + 1
            tail = slice(max(int(low[one]), high - keep), high)
            if r.seen is not None and sum(map(len, r.seen)) > self.INLINE:
                for column, held in zip(fe.TRACKED, r.seen, strict=True):
                    for value, count in held.items():
                        self.seen.updateValue((name, f"{column}|{value}"), (count,))
                r.seen = None
            record = (
                r.n + size, int(upto[end]), r.dropped + cut, int(us[end]), geo[end], country[end], *(tuple(words[one]) for words in last),
                tuple(values[tail].tolist() for values in (all_x, all_known, all_resources, all_fresh)), recent[cut:].tolist(), r.seen, r.durations,
            )
            self.records.updateValue((name,), (pickle.dumps(record),))
        return pd.concat([batch, pd.DataFrame({_shown(name): out[name] for name in RAW_FEATURES})], axis=1)

    def forget(self, entity: str) -> None:
        record = self._known(entity)
        if record.durations is None:
            self.durations.clear(entity)
        if record.seen is None:
            for key in [k for k in self.seen.keys() if k[0] == entity]:
                self.seen.removeKey(key)
        self.records.removeKey((entity,))


def _distinct_before(values: np.ndarray, part: np.ndarray, at: np.ndarray, low: np.ndarray, width: int) -> np.ndarray:
    """How many different values, nulls apart, stand on the ``width`` places before each position, none before ``low``."""
    value = pd.factorize(values)[0]
    last = pd.Series(np.arange(len(value))).groupby(part * (value.max(initial=0) + 2) + value + 1).shift(1).fillna(-1).to_numpy("int64")
    found = np.zeros(len(at), np.int64)
    for back in range(1, width + 1):
        place = np.maximum(at - back, 0)
        # The first of its value in the window.
        found += (at - back >= low) & (value[place] >= 0) & (last[place] < np.maximum(at - width, low))
    return found


def _earlier_not_above(x: np.ndarray, part: np.ndarray) -> np.ndarray:
    """How many earlier elements of its part are at most each element: merging sorted halves, bottom up."""
    n = len(x)
    found = np.zeros(n, np.int64)
    rank = np.empty(n, np.int64)
    # Parts follow each other: elements of earlier ones rank higher, and so are never below.
    rank[np.lexsort((np.arange(n), x, -part))] = np.arange(n)
    order, width = np.arange(n), 1
    while width < n:
        block = order // (2 * width)
        right = (order // width) % 2 == 1
        by = np.lexsort((rank, block))
        lefts = np.cumsum(~right[by])
        first = np.concatenate(([True], block[by][1:] != block[by][:-1]))
        base = np.maximum.accumulate(np.where(first, lefts - ~right[by], 0))
        found[by] += np.where(right[by], lefts - base, 0)
        width *= 2
    return found


def _shown(name: str) -> str:
    """Name of an internal column inside the Python worker, where a leading underscore is not kept."""
    return f"s{name}" if name.startswith("_") else name


def _joined_words(name: str, bits: int) -> Column:
    wide = "decimal(38,0)"
    return F.col(_shown(f"{name}_high")).cast(wide) * F.lit(1 << bits).cast("decimal(19,0)") + F.col(_shown(f"{name}_low")).cast(wide)


def _with(schema: T.StructType, columns: dict[str, str]) -> T.StructType:
    extra = T.StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind in columns.items()))
    return T.StructType([*schema.fields, *extra.fields])


def _stateful(rows: DataFrame, processor: StatefulProcessor, columns: dict[str, str], config: StreamConfig) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = rows.withColumn(GROUP, F.pmod(F.xxhash64(KEY), F.lit(config.groups)))
    return (
        rows.withWatermark("timestamp", config.late)
        .groupBy(GROUP)
        .transformWithStateInPandas(processor, _with(rows.schema, columns), "Append", "EventTime")
        .drop(GROUP)
        .filter(F.col(KEY) != END_ENTITY)
    )


def read_events(spark: SparkSession, path: str, schema: T.StructType, config: StreamConfig | None = None) -> DataFrame:
    config = config or StreamConfig()
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", config.files).parquet(path)


def stream_detect(
    engineered: DataFrame, latest: Profiles, detection: de.DetectConfig | None = None, config: StreamConfig | None = None
) -> DataFrame:
    """Score a stream of engineered events against the stored profiles (stream-static joins)."""
    config = config or StreamConfig()
    columns = [c for c in de.EVENT_COLUMNS if c != "previous_resource"]
    rows = _stateful(
        engineered.select(*columns), PreviousResource(config), {"previous_resource": "string"}, config
    )
    return de.score(de.join_profile(rows, latest, SkewConfig(), None), detection or de.DetectConfig())


def stream_features(
    events: DataFrame, entities: DataFrame, features: fe.FeatureConfig | None = None, config: StreamConfig | None = None
) -> DataFrame:
    """Engineer the features of a stream of access events; only the prior quantities come from state."""
    features, config = features or fe.FeatureConfig(), config or StreamConfig()
    prepared = fe.prepared(events)
    # Pandas has no null among integers: a duration travels as a number and whether it is known.
    plain = [c for c in prepared.columns if c not in ("_x", "session_duration")]
    shown = prepared.select(*[F.col(c).alias(_shown(c)) for c in plain], F.coalesce("_x", F.lit(0)).alias("s_xv"), F.col("_x").isNotNull().alias("s_xk"))
    raw = {_shown(name): kind for name, kind in RAW_FEATURES.items()}
    rows = _stateful(shown, PriorTotals(features, config), raw, config)
    duration = F.when(F.col("s_xk"), F.col("s_xv"))
    kind = prepared.schema["session_duration"].dataType
    rows = rows.select(
        *[F.col(_shown(c)).alias(c) for c in (*plain, *RAW_FEATURES)], duration.alias("_x"), duration.cast(kind).alias("session_duration"),
        *[_joined_words(name, bits).alias(name) for name, bits in WIDE_BITS.items()],
    )
    joined = fe.join_entity_static(rows, entities, SkewConfig(), None)
    return joined.select(
        *REQUIRED_EVENT_COLUMNS, *OPTIONAL_EVENT_COLUMNS,
        *[value.alias(name) for name, value in fe.feature_columns(features).items()], "previous_resource",
    )


def run_available(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Process what the source holds now, into parquet, and stop. The checkpoint makes a restart resume."""
    stream.sparkSession.conf.set("spark.sql.streaming.numRecentProgressUpdates", REPORTS)
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(target)
    )
    query.awaitTermination()
    return query


#: Progress reports a query keeps, so that ``late_count`` sees all micro-batches of a run.
REPORTS = 100_000


def late_count(query: StreamingQuery) -> int:
    """How many rows a query has left out because they came after the watermark had passed them, over all its micro-batches."""
    reports = query.recentProgress
    if len(reports) >= REPORTS:
        raise RuntimeError(f"only the last {REPORTS} micro-batches are known")
    return sum(op.numRowsDroppedByWatermark for report in reports for op in report.stateOperators)


def replay(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream from a fresh state (a new checkpoint location) and read its output."""
    spark = stream.sparkSession
    base = work_path(spark, name)
    run_available(stream, f"{base}/out", f"{base}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def closing_row(df: DataFrame, after: str = "1 day") -> DataFrame:
    """One row that ends a finite stream: written last, it moves the watermark past all others (``after`` beyond the
    configured lateness), and rows that waited come out."""
    last = df.agg(F.max("timestamp")).first()[0]
    row = df.limit(1).withColumns({KEY: F.lit(END_ENTITY), "event_id": F.lit(END_ENTITY), "timestamp": F.lit(last) + F.expr(f"INTERVAL {after}")})
    return row.select(*df.columns)


def late_rows(source: DataFrame, output: DataFrame) -> DataFrame:
    """The side output: rows of a closed stream's source that came after the watermark had passed them.

    ``late_count`` tells how many there are; rows are compared by entity and event.
    """
    keys = [KEY, "event_id"]
    return source.filter(F.col(KEY) != END_ENTITY).join(output.select(*keys), keys, "left_anti")
