"""String functions of the exporters and the generator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: mail domain of the derived user e-mail.
EMAIL_DOMAIN = "@example.com"


def email_from_name(name) -> Column:
    """Strip spaces, lower-case, append the domain."""
    col = F.col(name) if isinstance(name, str) else name
    return F.concat(F.lower(F.regexp_replace(col, " ", "")), F.lit(EMAIL_DOMAIN))


def category(name) -> Column:
    """Text before the first dot."""
    col = F.col(name) if isinstance(name, str) else name
    return F.substring_index(col, ".", 1)


def type_label(event_type_id) -> Column:
    """Fallback label when no name is joined."""
    col = F.col(event_type_id) if isinstance(event_type_id, str) else event_type_id
    return F.concat(F.lit("event_type_"), col.cast("string"))
