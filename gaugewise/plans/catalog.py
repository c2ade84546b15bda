"""All registered queries."""

from gaugewise.plans import (  # noqa: F401
    queries_evidence, queries_operations, queries_quality, queries_signals, queries_streams, queries_tables)
from gaugewise.plans.registry import ORACLES, QUERIES  # noqa: F401
