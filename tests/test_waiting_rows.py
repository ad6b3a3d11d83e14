import numpy as np
import pandas as pd

from accesslens.streaming import stateful as st


class Cell:
    """A state variable, value or map, that counts its writes."""

    def __init__(self):
        self.held, self.writes = {}, 0

    def exists(self):
        return None in self.held

    def get(self):
        return self.held.get(None)

    def update(self, value):
        self.updateValue(None, value)

    def keys(self):
        return iter(list(self.held))

    def getValue(self, key):
        return self.held.get(key)

    def updateValue(self, key, value):
        self.held[key], self.writes = value, self.writes + 1

    def removeKey(self, key):
        del self.held[key]


class Handle:
    def __init__(self):
        self.timers, self.cells = set(), {}

    def registerTimer(self, at):
        self.timers.add(at)

    def cell(self, name, *schema):
        return self.cells.setdefault(name, Cell())

    getMapState = getValueState = cell


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def arrived(minutes):
    return pd.DataFrame({"timestamp": pd.to_datetime(np.array(minutes) * 60_000_000_000), "event_id": [f"e{m:06d}" for m in minutes], "resource_accessed": [f"r{m}" for m in minutes]})


def test_few_rows_in_many_buckets_wait_together():
    # Buckets of 15 minutes; every row is in one of its own. Each had a state write and a timer of its own.
    stream, handle = st.PreviousResource(st.StreamConfig(late="16 hours")), Handle()
    stream.init(handle)
    minutes = [20 * k for k in range(60)]
    list(stream.handleInputRows(("a",), iter([arrived(minutes[::-1])]), Clock(0)))
    assert handle.cells["waiting"].writes == 1 and len(handle.timers) == 1
    out, at = [], 0
    while handle.timers:
        at = handle.timers.pop()
        out += list(stream.handleExpiredTimer(("a",), Clock(at + 90 * 60_000), None))
    rows = pd.concat(out)
    assert rows["event_id"].tolist() == [f"e{m:06d}" for m in minutes] and not handle.cells["waiting"].held
    assert rows["previous_resource"].tolist() == [None, *[f"r{m}" for m in minutes[:-1]]]


def test_a_large_bucket_is_a_piece_of_its_own():
    sizes = [3, 600, 2, 5, 500, 20, 1]
    bucket = np.repeat(np.arange(len(sizes)), sizes)
    pieces = [sorted(set(bucket[low:high].tolist())) for low, high in st._pieces(bucket, 512)]
    assert pieces == [[0], [1], [2, 3, 4], [5, 6]]
