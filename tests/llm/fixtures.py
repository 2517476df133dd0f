"""Small tables for the corpus operators' tests."""

from __future__ import annotations

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "alpha beta gamma " * 20_000

ODD_TEXTS = [
    (1, "One two three four five six seven eight nine ten."), (2, None), (3, ""), (4, " \n\t "),
    (5, "One two three four five six seven eight nine ten."),       # an exact copy
    (None, "no id here, only text"), (7, LONG), (7, "a row that repeats its id"),
    (7, "a row that repeats its id"), (8, "Été à Paris, 日本語 😀 ​ end"), (9, "x"),
    (10, "\n\nA shared line of text, long enough\n\nown 10"),
    (11, "a SHARED line of text, long enough\t\nown 11"),
    (12, "  A shared line of text, long enough\nA shared line of text, long enough"),
]


def docs(spark, rows=ODD_TEXTS, extra: bool = True):
    """A documents table; ``extra`` adds columns with names operators use inside."""
    full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    df = spark.createDataFrame(full, DOCS)
    if extra:
        from pyspark.sql import functions as F
        for name in ("fp", "key", "hash", "pos", "spans", "score", "component_id", "ids", "row"):
            df = df.withColumn(name, F.lit("clash"))
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows(df):
    return [tuple(r) for r in df.collect()]
