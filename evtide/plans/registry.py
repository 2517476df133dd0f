"""Registry of the driver queries and their fixed parameters.

Every query reads the driver tables in full through the adapter
(``evtide.sources.driver_tables``) and runs the library's own operators.
Fixed parameters (data span 2024-01-01 .. 2024-01-30):
as_of 2024-02-05, from 2024-01-10 06:30, to 2024-01-20 18:15, type click,
user 3.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evtide.plans.oracle import tsl
from evtide.sources.driver_tables import stored


AS_OF = "2024-02-05 00:00:00"
FROM = "2024-01-10 06:30:00"
TO = "2024-01-20 18:15:00"
FROM_H = "2024-01-10 06:00:00"   # floor_hour(FROM)
TO_H = "2024-01-20 18:00:00"     # floor_hour(TO)
TYPE = "click"
ABSENT_TYPE = "no_such_type"
USER = 3
LOOKUP_IDS = (0, 5, 17, 123, 4567, 99999, 10 ** 12)
AT = "2024-01-15 12:34:56"
Query = Callable[[SparkSession, str], DataFrame]


QUERIES: dict[str, Query] = {}


ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def _t(spark, sf_dir):
    return stored(spark, sf_dir)


def _range_where(alias: str = "e") -> str:
    return f'{alias}."timestamp" >= {tsl(FROM)} AND {alias}."timestamp" <= {tsl(TO)}'
_TYPED_JOIN = "JOIN c_event_types t ON e.event_type_id = t.id"
_RESPONSE = ('e.id, e.user_id AS "userId", t.name AS "eventType", e.event_type_id, '
             'e."timestamp", e.metadata')
_BARE = 'id, user_id, event_type_id, "timestamp", metadata'
