"""Waiting rows of a cell: an external merge sort in the state store.

Rows that arrive become sorted runs, cut into blocks of bounded size; a map entry of the state holds one
block, a value the list of runs. Releasing merges the runs with one block of each in memory, so neither
the state store nor the worker ever holds all waiting rows of a cell as one value. `FAN_IN` runs of a
level become one of the next, so there are at most `FAN_IN` of each of a logarithmic number of levels.

Rows leave by time and event id; rows that share both leave in the order in which they arrived.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.streaming.stateful_processor import StatefulProcessorHandle

RUN_BYTES = 16 << 20
BLOCK_BYTES = 512 << 10
FAN_IN = 64


def packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def unpacked(block: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(block)).read_all().combine_chunks()


class Keys:
    """(time, event id) of ordered rows."""

    def __init__(self, rows: pa.Table):
        self.time, self.event = rows["epoch_s"].to_numpy(), rows["event_id"].to_numpy()

    def __getitem__(self, i: int) -> tuple[float, int]:
        return self.time[i], self.event[i]

    def until(self, key: tuple[float, int], side: str) -> int:
        """Rows before `key`; those that equal it count where `side` is right."""
        first, end = np.searchsorted(self.time, key[0], "left"), np.searchsorted(self.time, key[0], "right")
        return int(first + np.searchsorted(self.event[first:end], key[1], side))


def ordered(rows: pa.Table) -> pa.Table:
    keys = Keys(rows)
    return rows.take(np.lexsort((keys.event, keys.time)))


class Cursor:
    """The next rows of a run: its first unread block, from the first row that has not left."""

    def __init__(self, waiting: WaitingRows, run: dict):
        self.waiting, self.run = waiting, run
        self._load()

    def _load(self) -> None:
        self.rows = unpacked(self.waiting.blocks.getValue((self.run["id"], self.run["first"]))[0])
        self.keys = Keys(self.rows)

    @property
    def ended(self) -> bool:
        return self.run["first"] == self.run["end"]

    @property
    def last_block(self) -> bool:
        return self.run["first"] + 1 == self.run["end"]

    def take(self, end: int) -> pa.Table:
        """Rows up to place `end` of the block leave; a block that is used up leaves the state."""
        out = self.rows.slice(self.run["skip"], end - self.run["skip"])
        self.run["skip"] = end
        if end == len(self.rows):
            self.waiting.blocks.removeKey((self.run["id"], self.run["first"]))
            self.run["first"] += 1
            self.run["skip"] = 0
            if not self.ended:
                self._load()
        if not self.ended:
            self.run["head"] = float(self.keys.time[self.run["skip"]])
        return out


class WaitingRows:
    """Rows of the current key that the watermark has not passed; they have `epoch_s` and `event_id`."""

    def __init__(self, handle: StatefulProcessorHandle):
        self.blocks = handle.getMapState("blocks", "run long, block int", "rows binary")
        self.listed = handle.getValueState("runs", "listed string")

    def _runs(self) -> list[dict]:
        return json.loads(self.listed.get()[0]) if self.listed.exists() else []

    def _keep(self, runs: list[dict]) -> None:
        if runs:
            self.listed.update((json.dumps(runs),))
        else:
            self.listed.clear()

    def add(self, arriving: Iterable[pa.Table]) -> float | None:
        """Rows of one batch as sorted runs; the time of the earliest."""
        runs, gathered, size, first = self._runs(), [], 0, None

        def close() -> None:
            nonlocal gathered, size, first
            rows = ordered(pa.concat_tables(gathered).combine_chunks())
            gathered, size = [], 0
            run = self._written(runs, 0, [rows])
            first = run["head"] if first is None else min(first, run["head"])
            runs.append(run)
            self._merged(runs)

        for rows in arriving:
            gathered.append(rows)
            size += rows.nbytes
            if size >= RUN_BYTES:
                close()
        if gathered:
            close()
        if first is not None:
            self._keep(runs)
        return first

    def release(self, until: float) -> Iterator[pa.Table]:
        """Rows up to time `until`, in order; they leave the state."""
        runs = self._runs()
        if any(r["head"] <= until for r in runs):
            yield from self._in_order(runs, until)
            self._keep([r for r in runs if r["first"] < r["end"]])

    def next_time(self) -> float | None:
        """Time of the earliest waiting row."""
        return min((r["head"] for r in self._runs()), default=None)

    def _written(self, runs: list[dict], level: int, parts: Iterable[pa.Table]) -> dict:
        """Ordered rows as a run; blocks are as large as `BLOCK_BYTES` allows, of one row at least."""
        run = {"id": 1 + max((r["id"] for r in runs), default=-1), "level": level, "first": 0, "end": 0, "skip": 0, "head": None}
        for rows in parts:
            if run["head"] is None:
                run["head"] = float(rows["epoch_s"][0].as_py())
            n = max(1, int(len(rows) * BLOCK_BYTES / max(rows.nbytes, 1)))
            for at in range(0, len(rows), n):
                self.blocks.updateValue((run["id"], run["end"]), (packed(rows.slice(at, n)),))
                run["end"] += 1
        return run

    def _merged(self, runs: list[dict]) -> None:
        """The last runs become one while `FAN_IN` of them have the same level; runs stay in order of arrival."""
        while len(runs) >= FAN_IN and runs[-FAN_IN]["level"] == runs[-1]["level"]:
            last = runs[-FAN_IN:]
            run = self._written(runs, last[0]["level"] + 1, self._blocks_of(self._in_order(last, np.inf)))
            runs[-FAN_IN:] = [run]

    def _blocks_of(self, parts: Iterable[pa.Table]) -> Iterator[pa.Table]:
        gathered, size = [], 0
        for rows in parts:
            gathered.append(rows)
            size += rows.nbytes
            if size >= BLOCK_BYTES:
                yield pa.concat_tables(gathered).combine_chunks()
                gathered, size = [], 0
        if gathered:
            yield pa.concat_tables(gathered).combine_chunks()

    def _in_order(self, runs: list[dict], until: float) -> Iterator[pa.Table]:
        """Merge of `runs` up to time `until`. What precedes the least last key of the blocks at hand is complete."""
        cursors = [Cursor(self, r) for r in runs if r["head"] <= until]
        while cursors:
            bounds = [(c.keys[-1], i) for i, c in enumerate(cursors) if not c.last_block]
            bound, of = min(bounds, default=((np.inf, 0), -1))
            if bound[0] > until:
                bound, of = (until, np.iinfo(np.int64).max), len(cursors)
            parts = []
            for i, c in enumerate(cursors):
                # of rows that equal the bound, those of later runs leave after all of the run that sets it
                end = c.keys.until(bound, "right" if i <= of else "left")
                if end > c.run["skip"]:
                    parts.append(c.take(end))
            cursors = [c for c in cursors if not c.ended and c.run["head"] <= until]
            if parts:
                yield parts[0] if len(parts) == 1 else ordered(pa.concat_tables(parts).combine_chunks())
