"""All queries of the library."""

from watchlake.plans import q_logs, q_ops, q_reid, q_streams, q_tracks  # noqa: F401
from watchlake.plans.registry import ORACLES, QUERIES  # noqa: F401
