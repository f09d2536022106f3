"""All named queries: importing the modules registers them."""

from __future__ import annotations

from . import context, evidence, facts, graphs, lifecycle, queues, relational, reports, retrieval, rules, shapes, streams, tiers, upkeep, workflows  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
