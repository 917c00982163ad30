"""Ordered state of one cell in a stream: guard, rollback baseline, history, audit chain, control step.

Rows of any micro-batch wait in sorted runs (`waiting`) until the watermark has passed them; an event-time
timer then releases them in event order, block by block, so the result does not depend on how rows were
dealt over batches. Rows behind the watermark are late and dropped by the stream itself. A cell that stays
silent for `idle` seconds of event time loses its state.

State of a cell is bounded by the watermark's delay (waiting rows, on disk), the churn window (executed
actions) and 120 history points; one cell is one task's work, as for any keyed state.
"""

from __future__ import annotations

import hashlib
import json
from collections import deque, namedtuple
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from policylake.streaming.waiting import WaitingRows

KEEP_HISTORY = 120
EWMA_POINTS = 24
NO_HASH = "0" * 64
CANDIDATE = "struct<idx: int, policy: string, prob: double, score: double, safe: boolean>"
INPUT = {
    "event_id": "long", "epoch_s": "double", "policy": "string", "downlink_mbps": "double", "packet_loss_pct": "double",
    "latency_ms": "double", "throughput_demand_mbps": "double", "control": "string",
}
ROWS = pa.schema([(c, {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}[t]) for c, t in INPUT.items()])
OUTPUT = (
    "event_id long, cell_id string, policy string, dwell_reject boolean, churn_reject boolean, rollback boolean, "
    "points int, ewma double, executed boolean, confidence double, previous_hash string, record_hash string"
)
NAMES = [c.split()[0] for c in OUTPUT.split(", ")]

quoted = lru_cache(4096)(json.dumps)


def canonical(cell: str, event_id: int, policy: str, previous: str) -> str:
    """JSON with sorted keys and no spaces; a hash needs no escapes."""
    return f'{{"cell_id":{quoted(cell)},"event_id":{event_id},"policy":{quoted(policy)},"previous_hash":"{previous}"}}'


@dataclass
class CellState:
    """What is kept of a cell between rows."""

    # (time, policy, switches up to it) of the recorded actions in the churn window, and the last one
    actions: deque = field(default_factory=deque)
    baseline: list | None = None  # downlink, loss, latency of the armed row
    history: deque = field(default_factory=deque)
    last_hash: str = NO_HASH

    def __post_init__(self) -> None:
        self.actions, self.history = deque(self.actions), deque(self.history, KEEP_HISTORY)

    def kept(self) -> str:
        return json.dumps({**self.__dict__, "actions": list(self.actions), "history": list(self.history)})


@dataclass(frozen=True)
class Guard:
    dwell: float = 5.0
    window: float = 60.0
    max_switches: int = 6
    alpha: float = 0.45
    least_confidence: float = 0.55

    def rejects(self, state: CellState, now: float, policy: str) -> tuple[bool, bool]:
        """(too soon after the last action, too many switches) of a change to `policy`.

        Actions are in event order, so those behind the window leave at the front, once each.
        """
        if not state.actions or state.actions[-1][1] == policy:
            return False, False
        self.forget(state, now)
        return now - state.actions[-1][0] < self.dwell, state.actions[-1][2] - state.actions[0][2] >= self.max_switches

    def forget(self, state: CellState, now: float) -> None:
        while len(state.actions) > 1 and not now - state.actions[0][0] <= self.window:
            state.actions.popleft()

    def record(self, state: CellState, now: float, policy: str) -> None:
        last = state.actions[-1] if state.actions else None
        switches = 0 if last is None else last[2] + (last[1] != policy)
        state.actions.append([now, policy, switches])
        self.forget(state, now)

    def worse(self, state: CellState, row) -> bool:
        """Whether the row is below the armed baseline beyond the rollback thresholds."""
        if state.baseline is None:
            return False
        downlink, loss, latency = state.baseline
        return bool(
            (downlink > 0 and (downlink - row.downlink_mbps) / downlink * 100 > 15.0)
            or row.packet_loss_pct - loss > 5.0
            or (latency > 0 and (row.latency_ms - latency) / latency * 100 > 20.0)
        )


def best_candidate(guard: Guard, state: CellState, now: float, control: dict) -> tuple[dict, float, bool]:
    """Chosen candidate, confidence and approval, temporal reasons included.

    A candidate that the guard rejects is not safe. The best safe one is taken, `balanced` if there is none.
    """
    judged = [c | {"safe": c["safe"] and not any(guard.rejects(state, now, c["policy"]))} for c in control["cand"]]
    pool = [c for c in judged if c["safe"]] or [c for c in judged if c["policy"] == "balanced"]
    chosen = max(pool, key=lambda c: (round(c["score"] + 8.0 * c["prob"], 9), -c["idx"]))
    scores = sorted((c["score"] for c in pool), reverse=True)
    margin = chosen["score"] - (scores[1] if len(scores) > 1 else 0.0)
    trust = 0.48 + 0.34 * chosen["prob"] + min(0.18, max(0.0, margin / 100.0))
    confidence = min(max(trust * (1.0 - min(0.45, control["uncertainty"] * 0.45)), 0.0), 0.99)
    return chosen, confidence, chosen["safe"] and control["open"] and confidence >= guard.least_confidence


def forecast(guard: Guard, state: CellState, values: list) -> list[tuple[int, float | None]]:
    """History points and the EWMA of the last 24 of them at each value; the history moves on."""
    held = len(state.history)
    points = [min(held + i, KEEP_HISTORY) for i in range(1, len(values) + 1)]
    series = np.array([*list(state.history)[1 - EWMA_POINTS:], *values], dtype=float)
    state.history.extend(values)

    def over(tails: list) -> np.ndarray:
        level = tails[0]
        for v in tails[1:]:
            level = guard.alpha * v + (1 - guard.alpha) * level
        return level

    last = len(series)
    short = [over(series[:i]).item() if i > 2 else None for i in range(last - len(values) + 1, min(last + 1, EWMA_POINTS))]
    full = over([series[i:last - EWMA_POINTS + 1 + i] for i in range(EWMA_POINTS)]).tolist() if last >= EWMA_POINTS else []
    return [*zip(points, short + full, strict=True)]


def judged(guard: Guard, state: CellState, row) -> tuple[str, bool, bool, bool, bool, float | None]:
    """Action, dwell and churn verdict, rollback, execution and confidence of one row; the guard's state moves on.

    Without `control` the row's policy counts as executed, whatever the guard says, and any policy but
    `balanced` arms the baseline. With it the candidates are judged, a rollback forces `balanced`, and
    only an executed action is recorded and arms the baseline; the audit record names that action.
    """
    rollback = guard.worse(state, row)
    if row.control is None:
        policy, confidence, executed = row.policy, None, True
        young, churn = guard.rejects(state, row.epoch_s, policy)
    else:
        control = json.loads(row.control)
        first = max(control["cand"], key=lambda c: (c["prob"], -c["idx"]))["policy"]
        young, churn = guard.rejects(state, row.epoch_s, first)
        chosen, confidence, executed = best_candidate(guard, state, row.epoch_s, control)
        policy = chosen["policy"]
        if rollback:
            policy, executed = "balanced", True
    if executed:
        guard.record(state, row.epoch_s, policy)
        if row.control is not None or policy != "balanced":
            state.baseline = [row.downlink_mbps, row.packet_loss_pct, row.latency_ms]
    return policy if executed else "none", young, churn, rollback, executed, confidence


def steps(guard: Guard, state: CellState, cell: str, rows: list) -> list[tuple]:
    """Output of rows in event order; `state` moves on. The audit chain links every record to the one before."""
    out, previous = [], state.last_hash
    for row, (points, level) in zip(rows, forecast(guard, state, [r.throughput_demand_mbps for r in rows]), strict=True):
        named, young, churn, rollback, executed, confidence = judged(guard, state, row)
        record = hashlib.sha256(canonical(cell, int(row.event_id), named, previous).encode()).hexdigest()
        out.append((int(row.event_id), cell, named, young, churn, rollback, points, level, executed, confidence, previous, record))
        previous = record
    state.last_hash = previous
    return out


def step(guard: Guard, state: CellState, cell: str, row) -> tuple:
    """Output of one row in event order."""
    return steps(guard, state, cell, [row])[0]


Row = namedtuple("Row", INPUT)


def arrived(pdf: pd.DataFrame) -> pa.Table:
    """Rows of a batch without marks, which only move the watermark; a filter would keep them from doing so."""
    table = pa.Table.from_pandas(pdf.loc[pdf["event_id"] >= 0, list(INPUT)], ROWS, preserve_index=False)
    if table["epoch_s"].null_count:
        raise ValueError("a row without timestamp has no place in event order")
    return table


def released(table: pa.Table) -> list[Row]:
    """Rows as tuples; numbers that are missing are NaN."""
    columns = [c.to_numpy().tolist() if pa.types.is_floating(c.type) else c.to_pylist() for c in table.itercolumns()]
    return [*map(Row._make, zip(*columns, strict=True))]


class CellProcessor(StatefulProcessor):
    """Waits for the watermark, then moves the cell on row by row."""

    def __init__(self, guard: Guard, idle: float):
        self.guard, self.idle = guard, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = WaitingRows(handle)
        self.due = handle.getValueState("due", "at long")
        self.kept = handle.getValueState("kept", "state string, seen double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = self.waiting.add(table for table in map(arrived, rows) if len(table))
        if first is not None:
            self._wake(int(first * 1000))
        return iter(())

    def _wake(self, at: int) -> None:
        """One timer at the earliest waiting row."""
        if not self.due.exists() or at < self.due.get()[0]:
            self.due.update((at,))
            self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() / 1000.0
        text, seen = self.kept.get() if self.kept.exists() else (None, None)
        if self.waiting.next_time() is None:
            if seen is not None and seen + self.idle <= passed:
                self.kept.clear()
            return
        state = None
        for table in self.waiting.release(passed):
            times = table["epoch_s"]
            if state is None:
                state = CellState(**json.loads(text)) if text and times[0].as_py() - seen <= self.idle else CellState()
            seen = times[-1].as_py()
            out = zip(*steps(self.guard, state, key[0], released(table)), strict=True)
            yield pd.DataFrame(dict(zip(NAMES, out, strict=True)))
        if state is not None:
            self.kept.update((state.kept(), seen))
            self.handle.registerTimer(int((seen + self.idle) * 1000) + 1)
        self.due.clear()
        later = self.waiting.next_time()
        if later is not None:
            self._wake(int(later * 1000))

    def close(self) -> None:
        pass
