"""A streamed row costs the same however many actions its window holds."""

import random
from types import SimpleNamespace

from policylake.streaming import cell_state


class Clock(float):
    """A time that counts how often it is compared with another."""

    asked = 0

    def __sub__(self, other):
        Clock.asked += 1
        return float(self) - float(other)


def test_a_streamed_row_costs_the_same_in_a_full_window():
    guard, state, rng = cell_state.Guard(dwell=0.5, window=1e6, max_switches=6), cell_state.CellState(), random.Random(1)
    policies = [rng.choice("ab") for _ in range(2000)]
    rows = [SimpleNamespace(event_id=i, epoch_s=Clock(i), policy=p, downlink_mbps=1.0, packet_loss_pct=1.0, latency_ms=1.0, throughput_demand_mbps=1.0, control=None) for i, p in enumerate(policies)]
    out = [cell_state.step(guard, state, "c", r) for r in rows]
    assert Clock.asked <= 8 * len(rows)
    for i in (0, 1, 7, 500, 1999):
        switches = sum(a != b for a, b in zip(policies[:i], policies[1:i]))
        assert out[i][4] == (i > 0 and policies[i - 1] != policies[i] and switches >= 6)
