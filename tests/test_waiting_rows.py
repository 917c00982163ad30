"""Waiting rows of a cell: bounded state values, event order, ties in order of arrival."""

import pickle
import random
from types import SimpleNamespace

import pandas as pd
import pyarrow as pa
import pytest

from policylake.streaming import cell_state, waiting


class Entries:
    """Value, list and map state of one key over a dict, with the largest value it ever held."""

    def __init__(self):
        self.held, self.largest = {}, 0

    def _put(self, key, value):
        self.held[key] = value
        self.largest = max(self.largest, sum(len(pickle.dumps(v)) for v in (value if isinstance(value, list) else [value])))

    def exists(self):
        return bool(self.held)

    def get(self):
        return self.held[0]

    def update(self, value):
        self._put(0, value)

    put = update

    def appendList(self, rows):
        self._put(0, [*self.held.get(0, []), *rows])

    def clear(self):
        self.held = {}

    def getValue(self, key):
        return self.held[key]

    def updateValue(self, key, value):
        self._put(key, value)

    def removeKey(self, key):
        del self.held[key]


class Handle:
    def __init__(self):
        self.states = []

    def _state(self, *_):
        self.states.append(Entries())
        return self.states[-1]

    getValueState = getListState = getMapState = _state

    def registerTimer(self, at):
        pass


def frame(rows):
    return pd.DataFrame([
        (i, t, p, 10.0 + i % 7, 0.0, 1.0 + i % 5, float(i % 11), None) for i, t, p in rows], columns=list(cell_state.INPUT))


def fired(cell, until):
    clock = SimpleNamespace(getCurrentWatermarkInMs=lambda: int(until * 1000))
    return [*cell.handleExpiredTimer(("c",), clock, None)]


def processor():
    handle = Handle()
    cell = cell_state.CellProcessor(cell_state.Guard(5.0, 60.0, 6), 1e9)
    cell.init(handle)
    return cell, handle


def test_no_state_value_or_frame_grows_with_the_rows_of_a_cell():
    rng, n = random.Random(1), 60_000
    rows = [(i, float(rng.randrange(n)), rng.choice("ab")) for i in range(n)]
    rng.shuffle(rows)
    cell, handle = processor()
    for at in range(0, n, 20_000):
        batch = [frame(rows[k:k + 5_000]) for k in range(at, at + 20_000, 5_000)]
        assert not [*cell.handleInputRows(("c",), iter(batch), None)]
    out = fired(cell, n)
    assert max(s.largest for s in handle.states) < 1_000_000
    assert max(map(len, out)) < n / 2
    state, guard = cell_state.CellState(), cell_state.Guard(5.0, 60.0, 6)
    want = [cell_state.step(guard, state, "c", r) for r in frame(sorted(rows, key=lambda r: (r[1], r[0]))).itertuples(index=False)]
    got = pd.concat(out)
    for i, name in enumerate(got.columns):
        if name != "confidence":
            assert [None if v != v else v for v in got[name]] == [w[i] for w in want]


@pytest.mark.parametrize("fan_in", [2, 3, 64])
def test_rows_leave_by_time_and_id_and_ties_as_they_came(monkeypatch, fan_in):
    monkeypatch.setattr(waiting, "RUN_BYTES", 600)
    monkeypatch.setattr(waiting, "BLOCK_BYTES", 130)
    monkeypatch.setattr(waiting, "FAN_IN", fan_in)
    rng, handle = random.Random(2), Handle()
    rows, held, number = waiting.WaitingRows(handle), [], 0
    for until in (3.0, 9.0, 9.0, 20.0, 40.0):
        for _ in range(4):
            new = [{"epoch_s": float(rng.randrange(40)), "event_id": rng.randrange(4), "n": number + k} for k in range(rng.randrange(60))]
            number += len(new)
            held += new
            first = rows.add([pa.Table.from_pylist(new[k:k + 9]) for k in range(0, len(new), 9)])
            assert first == min((r["epoch_s"] for r in new), default=None)
        held.sort(key=lambda r: (r["epoch_s"], r["event_id"], r["n"]))
        assert [r for t in rows.release(until) for r in t.to_pylist()] == [r for r in held if r["epoch_s"] <= until]
        held = [r for r in held if r["epoch_s"] > until]
        assert rows.next_time() == (held[0]["epoch_s"] if held else None)
    assert not any(s.exists() for s in handle.states)
