"""Feature columns of learners and controllers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from policylake.constants import SLICE_NAMES


def encode_columns(budget: float) -> list[Column]:
    """Log of heavy-tailed counters, PRB fraction, scheduler index, time phase, slice flags."""
    def r(c: Column, name: str) -> Column:
        return F.round(c, 9).alias(name)

    cols = [
        r(F.log1p("dl_buffer_bytes"), "log_buffer"),
        r(F.log1p("requested_prbs"), "log_requested"),
        r(F.log1p("num_ues"), "log_ues"),
        r(F.col("slice_prb") / budget, "prb_fraction"),
        r(F.rint("scheduler_code") / 2, "sched_index"),
        r(F.sin(F.col("timestamp_s") / 8), "time_sin"),
        r(F.cos(F.col("timestamp_s") / 8), "time_cos"),
    ]
    return cols + [(F.col("slice_type") == s).cast("int").alias(f"is_{s.lower()}") for s in SLICE_NAMES]
