"""Readers with explicit schemas (S10, S11); nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evtide.sources import schemas


def csv_table(spark: SparkSession, path: str, schema, limit: int | None = None) -> DataFrame:
    """CSV with a header and quoted fields, columns by position (S11),
    optionally the first ``limit`` rows."""
    df = (spark.read.option("header", True).option("escape", '"').schema(schema).csv(path))
    return df.limit(limit) if limit is not None else df


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """Ingest records from JSON lines (S10), batch form."""
    return spark.read.schema(schemas.INGEST_RECORD).json(path)
