"""ANSI-SQL (DuckDB dialect) twins of the registered queries.

Each oracle starts from the same adapter rule as
``evtide.sources.driver_tables`` written as CTEs over the driver tables
(``events``, ``customer``), so both sides read identical canonical rows.
"""

from __future__ import annotations

from evtide.sources.driver_tables import REFERRERS, USERS_EPOCH

_REF_CASE = "CASE k % 5 " + " ".join(
    f"WHEN {i} THEN '{r}'" for i, r in enumerate(REFERRERS)) + " END"

META_OK = """(json_type(metadata) = 'OBJECT'
  AND coalesce(json_type(metadata, '$.page'), 'NULL') IN ('VARCHAR', 'NULL')
  AND coalesce(json_type(metadata, '$.referrer'), 'NULL') IN ('VARCHAR', 'NULL')
  AND coalesce(json_type(metadata, '$.session_id'), 'NULL') IN ('VARCHAR', 'NULL')
  AND (coalesce(json_type(metadata, '$.product_id'), 'NULL') = 'NULL'
       OR (json_type(metadata, '$.product_id') IN ('BIGINT', 'UBIGINT')
           AND TRY_CAST(json_extract_string(metadata, '$.product_id') AS INTEGER) IS NOT NULL)))"""

CANON = f"""
c_event_types AS (
  SELECT CAST(row_number() OVER (ORDER BY name) AS INTEGER) AS id, name
  FROM (SELECT DISTINCT event_type AS name FROM events) t),
c_users AS (
  SELECT c_custkey AS id, c_name AS name,
         TIMESTAMP '{USERS_EPOCH}' + to_minutes(c_custkey) AS created_at
  FROM customer),
c_raw AS (
  SELECT event_id, user_id, event_type, ts,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events),
c_events AS (
  SELECT r.event_id AS id, r.user_id, t.id AS event_type_id,
    '{{' || CASE WHEN k % 7 = 0 THEN '' WHEN k % 11 = 0 THEN '"page":null,'
                ELSE '"page":"/p/' || CAST(k % 12 AS VARCHAR) || '",' END
    || '"referrer":"' || {_REF_CASE} || '",'
    || CASE WHEN k % 13 = 0 THEN '"session_id":' || CAST(r.user_id AS VARCHAR)
            ELSE '"session_id":"' || CAST(r.user_id AS VARCHAR) || '-'
                 || CAST(CAST(r.ts AS DATE) AS VARCHAR) || '"' END
    || CASE WHEN r.event_type = 'purchase' THEN ',"product_id":' || CAST(k AS VARCHAR)
            ELSE '' END
    || '}}' AS metadata,
    r.ts AS "timestamp"
  FROM c_raw r JOIN c_event_types t ON t.name = r.event_type),
c_typed AS (
  SELECT e.*, ok AS meta_ok,
    CASE WHEN ok THEN json_extract_string(metadata, '$.page') END AS page,
    CASE WHEN ok THEN json_extract_string(metadata, '$.referrer') END AS referrer,
    CASE WHEN ok THEN json_extract_string(metadata, '$.session_id') END AS session_id,
    CASE WHEN ok THEN CAST(json_extract_string(metadata, '$.product_id') AS INTEGER) END
      AS product_id
  FROM (SELECT *, {META_OK} AS ok FROM c_events) e)
"""


def sql(body: str, ctes: str = "") -> str:
    """Prefix ``body`` with the canonical CTEs (and optional extra CTEs)."""
    extra = f",\n{ctes}" if ctes.strip() else ""
    return f"WITH {CANON.strip()}{extra}\n{body}"


def has_page(col: str = "metadata") -> str:
    return f"list_contains(json_keys({col}), 'page')"


def tsl(value: str) -> str:
    return f"TIMESTAMP '{value}'"
