"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evtide.session import delete_path, scratch_path
from evtide.shipping import ship_package

#: A-Z to a-z, everything else untouched (``str.translate`` table).
ASCII_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: The white space that the contracts name: [\x20\x09-\x0D].
ASCII_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, by a path that only Spark needs to understand."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the cluster's shared folder and read it back.

    Cuts lineage and computes the rows once; the files outlive any executor.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    for made in _RECORDING:
        made.append(out)
    return out


def release(*written: DataFrame) -> None:
    """Delete tables of ``materialise`` that nothing will read again."""
    for df in written:
        delete_path(df.sparkSession, df.scratch)


_RECORDING: list[list[DataFrame]] = []


@contextmanager
def recorded() -> Iterator[list[DataFrame]]:
    """The tables that ``materialise`` writes meanwhile, in order."""
    made: list[DataFrame] = []
    _RECORDING.append(made)
    try:
        yield made
    finally:
        _RECORDING.remove(made)


#: Largest Arrow batch that a task hands to Python; whole texts count.
BATCH_BYTES = 8 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to ``BATCH_BYTES`` if it is larger:
    a worker holds a batch's texts several times over."""
    now = spark.conf.get(_BATCH_CONF).lower().removesuffix("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None],
                schema: str) -> DataFrame:
    """``mapInArrow`` with one output batch per input batch."""
    ship_package(df.sparkSession)
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = fn(b)
                if out is not None:
                    yield out
    return df.mapInArrow(run, schema)


def sha256_of(col):
    """Lowercase hex SHA-256 of a string column's UTF-8 bytes."""
    return F.sha2(col, 256)


class WordCache:
    """Words and their ids in two generations: when the young one is full it
    becomes the old one, and words still in use move back as they are asked for."""

    def __init__(self, size: int):
        self.size = size
        self.young: dict = {}
        self.old: dict = {}

    def turn(self) -> None:
        """Start a new generation if the young one is full."""
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}

    def missing(self, wanted: set) -> set:
        """Of words that are not in ``young`` those that aren't in ``old`` either;
        the others are in ``young`` afterwards."""
        if not self.old:
            return wanted
        get, gone = self.old.get, set()
        for w in wanted:
            v = get(w)
            if v is None:
                gone.add(w)
            else:
                self.young[w] = v
        return gone


def plain_names(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns that stages pass through named by their place, so
    that none has a name an operator uses; ``toDF(*docs.columns)`` turns back."""
    return docs.toDF(*(c if c in ("doc_id", "text", "n_chars") else f"column_{i}"
                       for i, c in enumerate(docs.columns)))


def replace_text(b: pa.RecordBatch, names: list[str], changed: dict[int, str]) -> pa.RecordBatch:
    """The batch's columns ``names`` with the texts of some rows replaced, and
    their ``n_chars``, where there is such a column, counted anew."""
    columns = []
    for name in names:
        c = b.column(b.schema.get_field_index(name))
        if changed and name in ("text", "n_chars"):
            values = c.to_pylist()
            for i, t in changed.items():
                values[i] = t if name == "text" else len(t)
            c = pa.array(values, c.type)
        columns.append(c)
    return pa.RecordBatch.from_arrays(columns, names=names)
