"""Join helpers shared by the operators.

Broadcast policy: plain joins are left to Spark, whose size estimate
(``autoBroadcastJoinThreshold``) and AQE's runtime statistics pick
broadcast-hash or sort-merge. Nothing whose size grows with the fact table is
ever hinted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def with_type_name(events: DataFrame, event_types: DataFrame,
                   name_col: str = "event_type") -> DataFrame:
    """Inner equi-join of events with their type name."""
    t = event_types.select(F.col("id").alias("event_type_id"),
                           F.col("name").alias(name_col))
    return events.join(t, "event_type_id")


def type_ids_named(event_types: DataFrame, name: str | None) -> DataFrame | None:
    """The type ids carrying ``name`` (0 or 1 row), or None when no filter."""
    if name is None:
        return None
    return event_types.filter(F.col("name") == F.lit(name)).select(
        F.col("id").alias("event_type_id"))


def restrict_type(events: DataFrame, event_types: DataFrame,
                  name: str | None) -> DataFrame:
    """Keep events of the type called ``name`` (no-op for None).

    A semi-join against the filtered dimension (names are unique: at most one
    row). No hint: Spark's size estimate of the filtered dimension scan, and
    AQE at run time, make it a broadcast, so the events are not shuffled.
    """
    ids = type_ids_named(event_types, name)
    if ids is None:
        return events
    return events.join(ids, "event_type_id", "left_semi")
