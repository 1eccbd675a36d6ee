"""All registered queries of the core."""

from __future__ import annotations

from panelweave.plans import queries_cross, queries_factors, queries_options, queries_panel, queries_series  # noqa: F401
from panelweave.plans.registry import ORACLE, QUERIES  # noqa: F401
