"""Registered queries: name -> (spark, sf_dir) -> DataFrame, plus SQL oracles.

Importing this module registers every query; the modules below group them
by area. ``QUERIES`` and ``ORACLES`` are shared dictionaries.
"""

from __future__ import annotations

from evtide.plans import (  # noqa: F401
    q_bitmaps, q_deltas, q_exports, q_keyed, q_mutations, q_ranked, q_reads, q_report, q_streams,
)
from evtide.plans.registry import AS_OF, FROM, ORACLES, QUERIES, TO, TYPE, USER  # noqa: F401
