"""Metadata JSON column functions.

The metadata column is free JSON text. Readers see it through a fixed typed
view (page, referrer, session_id, product_id) with strict rules:

* unknown keys are ignored;
* any value of the wrong JSON type makes the *whole* typed struct null, not
  just the offending field (a plain ``from_json`` keeps partial structs and
  turns the number 123 into the string "123", so it is not enough);
* JSON null is an allowed value for every field.

All checks run on one ``try_parse_json`` per row (Variant), JVM-side.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evtide.sources.schemas import METADATA

STRING_FIELDS = ("page", "referrer", "session_id")
INT_FIELDS = ("product_id",)

# Fixed values of the validity rule: accepted referrer prefixes.
URL_PREFIXES = ("http://", "https://")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def variant(metadata) -> Column:
    """Parse JSON text to Variant; invalid text gives null."""
    return F.try_parse_json(_c(metadata))


def _field_type(v: Column, field: str) -> Column:
    # null when the key is missing; 'VOID' for a JSON null value
    return F.schema_of_variant(F.variant_get(v, f"$.{field}", "variant"))


def variant_ok(v) -> Column:
    """Strictness check on an already parsed Variant column."""
    v = _c(v)
    cond = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    for f in STRING_FIELDS:
        t = _field_type(v, f)
        cond = cond & (t.isNull() | t.isin("STRING", "VOID"))
    for f in INT_FIELDS:
        t = _field_type(v, f)
        fits = F.try_variant_get(v, f"$.{f}", "int").isNotNull()
        cond = cond & (t.isNull() | (t == "VOID") | ((t == "BIGINT") & fits))
    return cond


def variant_struct(v) -> Column:
    """Typed struct of an already parsed Variant column (no strictness)."""
    v = _c(v)
    return F.struct(*[F.try_variant_get(v, f"$.{f.name}", f.dataType.simpleString())
                      .alias(f.name) for f in METADATA.fields])


def typed_metadata(metadata) -> Column:
    """Strict typed view as ONE expression that parses the JSON once.

    The parsed Variant is bound to a lambda variable (``transform`` over a
    one-element array), so the strictness checks and the field reads all
    reuse it. This matters because Catalyst pushes filters on the typed
    fields (``meta.page IS NOT NULL``) below the projection by substituting
    the expression: with the Variant bound once, a pushed filter costs one
    parse instead of one per check.
    """
    return F.transform(F.array(variant(metadata)),
                       lambda v: F.when(variant_ok(v), variant_struct(v)))[0]


def with_typed_metadata(df, metadata: str = "metadata", out: str = "meta",
                        ok_col: str | None = None):
    """Add the strict typed view as struct column ``out`` (P5), and the
    strictness flag as ``ok_col`` when asked (true exactly when the struct
    is not null)."""
    d = df.withColumn(out, typed_metadata(metadata))
    if ok_col:
        d = d.withColumn(ok_col, F.col(out).isNotNull())
    return d


def has_key(metadata, key: str) -> Column:
    """JSON object has ``key`` (P9), true even when its value is JSON null."""
    return F.coalesce(F.array_contains(F.json_object_keys(_c(metadata)), F.lit(key)),
                      F.lit(False))


def json_text(metadata, key: str) -> Column:
    """Text of a top-level key (F5): null for a missing key or a JSON null."""
    return F.get_json_object(_c(metadata), f"$.{key}")


def metadata_issue(typed) -> Column:
    """Validity rule (P12) on a typed struct: first failing reason, or null.

    referrer, when present, must start with http:// or https://; product_id,
    when present, must be positive.
    """
    t = _c(typed)
    ref = t.getField("referrer")
    pid = t.getField("product_id")
    ok_prefix = F.lit(False)
    for p in URL_PREFIXES:
        ok_prefix = ok_prefix | ref.startswith(p)
    return (F.when(ref.isNotNull() & ~ok_prefix, F.lit("invalid_referrer"))
            .when(pid.isNotNull() & (pid <= 0), F.lit("invalid_product_id")))


# Columns that ingest extracts from the JSON once, beside the raw text: whether
# there is a ``page`` key and its text, and the fields of the strict typed view.
HOT_COLUMNS = ("m_has_page", "m_page_text", "m_page", "m_referrer", "m_session_id",
               "m_product_id")


def with_hot_columns(df, metadata: str = "metadata"):
    """``df`` with ``HOT_COLUMNS``; unchanged if it has them already.

    Reports and analytics read these columns, so the JSON is parsed once, when
    an event is stored, and never by a query.
    """
    if set(HOT_COLUMNS) <= set(df.columns):
        return df
    # in steps, so that the parsed value and the keys are computed once a row
    parsed = df.select(*df.columns, variant(metadata).alias("_v"),
                       F.json_object_keys(_c(metadata)).alias("_keys"))
    typed = parsed.select("*", *[_field_type(F.col("_v"), f.name).alias(f"_t_{f.name}")
                                 for f in METADATA.fields])
    ok = F.col("_keys").isNotNull() & F.col("_v").isNotNull()   # an object, well formed
    for f in STRING_FIELDS:
        t = F.col(f"_t_{f}")
        ok = ok & (t.isNull() | t.isin("STRING", "VOID"))
    for f in INT_FIELDS:
        t = F.col(f"_t_{f}")
        fits = F.try_variant_get("_v", f"$.{f}", "int").isNotNull()
        ok = ok & (t.isNull() | (t == "VOID") | ((t == "BIGINT") & fits))
    fields = [F.when(F.col("_ok"), F.try_variant_get("_v", f"$.{f.name}",
                                                     f.dataType.simpleString()))
              .alias(f"m_{f.name}") for f in METADATA.fields]
    # a text value is its own raw text; anything else is read from the JSON
    text = (F.when(F.col("_t_page") == "STRING", F.try_variant_get("_v", "$.page", "string"))
            .otherwise(json_text(metadata, "page")))
    return typed.select("*", ok.alias("_ok")).select(
        *df.columns, F.coalesce(F.array_contains("_keys", "page"), F.lit(False))
        .alias("m_has_page"), text.alias("m_page_text"), *fields)


def metadata_text(**fields) -> Column:
    """JSON text of the given fields, in their order; null fields are left out
    (F16, F17: which keys there are may differ from row to row)."""
    return F.to_json(F.struct(*[_c(v).alias(k) for k, v in fields.items()]))


#: Column that keeps the parsed metadata beside its text.
VARIANT_COLUMN = "m_variant"


def with_variant(df, metadata: str = "metadata"):
    """``df`` with the metadata as a VARIANT, null where it isn't JSON. Stored once,
    it answers any path, hot or not, without a parse (P5, P9, F5)."""
    return df if VARIANT_COLUMN in df.columns else df.withColumn(
        VARIANT_COLUMN, variant(metadata))


def at_path(path: str, kind: str = "string") -> Column:
    """The value at a JSON path of the stored VARIANT, null if it isn't of ``kind``."""
    return F.try_variant_get(VARIANT_COLUMN, path, kind)


def kind_at(path: str) -> Column:
    """The JSON kind at a path of the stored VARIANT: STRING, BIGINT, VOID (JSON
    null), OBJECT<...>, ...; null where there is nothing."""
    return F.schema_of_variant(F.try_variant_get(VARIANT_COLUMN, path, "variant"))
