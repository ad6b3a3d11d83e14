from collections import Counter

import numpy as np
import pandas as pd
import pytest

from accesslens.operators import features as fe
from accesslens.streaming import stateful as st
from test_waiting_rows import Cell, Clock, Handle

DAY = 86_400_000


class Group(Cell):
    """A state variable that counts reads as well, and lists pairs."""

    reads = 0

    def getValue(self, key):
        self.reads += 1
        return self.held.get(key)

    def removeKey(self, key):
        self.held.pop(key, None)

    def iterator(self):
        return iter(list(self.held.items()))


class Groups(Handle):
    def cell(self, name, *schema):
        return self.cells.setdefault(name, Group())

    getMapState = getValueState = cell


def rows(entities, per, seed=3):
    rng, m = np.random.default_rng(seed), entities * per
    us = rng.permutation(m).astype(np.int64) * 60_000_000 * 10
    pick = lambda name, of: [None if k == 0 else f"{name}{k}" for k in rng.integers(0, of, m)]
    known = rng.random(m) < 0.9
    return pd.DataFrame({
        "entity_id": [f"USR-{i % entities}" for i in range(m)], "event_id": [f"e{i:05d}" for i in range(m)], "timestamp": pd.to_datetime(us, unit="us"),
        **{c: pick(c, 5) for c in ("device_fingerprint", "geo_location", "device_os", "device_mac", "s_country", "auth_method")}, "resource_accessed": pick("r", 30),
        "s_us": us, "s_xv": np.where(known, rng.integers(-50, 2**40, m) // rng.integers(1, 2**35, m), 0), "s_xk": known, "s_ok": rng.random(m) < 0.7,
    })


def totals(**config):
    stream, handle = st.PriorTotals(fe.FeatureConfig(), st.StreamConfig(late="1 hour", **config)), Groups()
    stream.init(handle)
    return stream, handle


def run(stream, handle, data, edges):
    out = []
    for low, high in zip(edges[:-1], edges[1:]):
        list(stream.handleInputRows((0,), iter([data[low:high]]), Clock(0)))
        passed = int(data["s_us"][low:high].max() // 1000) + stream.bucket_ms
        for at in sorted(t for t in handle.timers if t <= passed):
            handle.timers.discard(at)
            out += list(stream.handleExpiredTimer((0,), Clock(passed), None))
    return pd.concat(out, ignore_index=True).sort_values("event_id", ignore_index=True)


def brute(data):
    found = {}
    for _, own in data.sort_values(["timestamp", "event_id"]).groupby("entity_id"):
        past, seen = [], Counter()
        for r in own.to_dict("records"):
            x = [p["s_xv"] for p in past if p["s_xk"]]
            last = past[-1] if past else {}
            total = sum(x)
            found[r["event_id"]] = {
                "s_rn": len(past) + 1, "previous_resource": last.get("resource_accessed"), "s_prev_geo": last.get("geo_location"), "s_n_x": len(x),
                **{f"s{n}": seen[c, r[c]] for c, n in fe.TRACKED.items()}, "s_s_ok": sum(p["s_ok"] for p in past),
                "s_le": sum(v <= r["s_xv"] for v in x) if r["s_xk"] else 0, "s_s_x_low": total & st.MASK, "s_s_x_high": total >> st.LIMB,
                "s_last_ok": max([i + 1 for i, p in enumerate(past) if p["s_ok"]], default=0), "s_ma_n": sum(p["s_xk"] for p in past[-5:]),
                "s_drift_all": len({p["resource_accessed"] for p in past[-10:]} - {None}), "s_older": sum(p["s_us"] < r["s_us"] - 300_000_000 for p in past),
            }
            past.append(r)
            seen.update((c, r[c]) for c in fe.TRACKED)
    return pd.DataFrame.from_dict(found, orient="index").sort_index()


@pytest.mark.parametrize("inline", [1024, 7])
def test_entities_of_a_group_advance_together(inline):
    data = rows(6, 60).sort_values("s_us", ignore_index=True)
    stream, handle = totals()
    stream.INLINE = inline  # beyond it values and durations lie in maps of their own
    out, want = run(stream, handle, data, [0, 150, 151, 360]), brute(data)
    for column in want:
        assert [None if pd.isna(v) else v for v in out[column]] == [None if pd.isna(v) else v for v in want[column]], column
    assert bool(handle.cells["seen"].held) == bool(handle.cells["durationsNodes"].held) == (inline == 7)


def test_a_micro_batch_reads_and_writes_an_entity_once():
    # Each value and each digit of a duration had a read and a write of its own: about 2,000 of either for these rows.
    data = rows(10, 40)
    stream, handle = totals()
    run(stream, handle, data, [0, 400])
    assert sum(c.writes for name, c in handle.cells.items() if name not in ("waiting", "parts")) == 10
    assert sum(c.reads for name, c in handle.cells.items() if name != "waiting") == 10


@pytest.mark.parametrize("inline", [1024, 7])
def test_silent_entities_are_forgotten_alone(inline):
    data = rows(4, 50).sort_values("s_us", ignore_index=True)
    data["s_us"] *= 36  # 50 days
    data["timestamp"] = pd.to_datetime(data["s_us"], unit="us")
    # Entity 1 is silent for 12 and 11 days, inside a micro-batch and between two; the others never are.
    own, spell = data["entity_id"] == "USR-1", np.select([data.index < 60, data.index >= 185], ["a", "c"], "b")
    kept = ~own | (spell != "b") | ((data.index >= 110) & (data.index < 140))
    data, parts = data[kept].reset_index(drop=True), data["entity_id"].where(~own, "USR-1" + pd.Series(spell, dtype=object))[kept].tolist()
    stream, handle = totals(expiry_ms=10 * DAY)
    stream.INLINE = inline
    out, want = run(stream, handle, data, [0, 150, len(data)]), brute(data.assign(entity_id=parts))
    for column in want:
        assert [None if pd.isna(v) else v for v in out[column]] == [None if pd.isna(v) else v for v in want[column]], column
    while handle.timers:
        at = handle.timers.pop()
        list(stream.handleExpiredTimer((0,), Clock(at + 90 * DAY), None))
    assert not any(handle.cells[name].held for name in ("records", "newest", "seen", "durationsNodes", "waiting"))


def test_previous_resources_of_a_group():
    data = rows(6, 60).sort_values("s_us", ignore_index=True)
    stream, handle = st.PreviousResource(st.StreamConfig(late="1 hour")), Groups()
    stream.init(handle)
    out = run(stream, handle, data, [0, 150, 151, 360])
    assert out["previous_resource"].where(out["previous_resource"].notna(), None).tolist() == brute(data)["previous_resource"].where(brute(data)["previous_resource"].notna(), None).tolist()
