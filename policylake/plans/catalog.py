"""Imports every query module so that the registry is complete."""

from policylake.plans import decision_queries, inference_queries, joint_queries, kpi_queries, telemetry_queries, trace_queries  # noqa: F401
from policylake.plans import learning_queries, streaming_queries, study_queries, support_queries  # noqa: F401, E402
from policylake.plans.registry import QUERIES, SQL  # noqa: F401
