r"""SimHash near-dedup over an index of positional bytes.

Fingerprint: A-Z lower-cased, words split at ASCII white space, ``shingle``
consecutive words joined by a space (a shorter text is one shingle; a text
without words has fingerprint zero); a bit is 1 if it is set in more than half
of the XXH64 hashes (seed 42) of the shingles, repeats included.

Linking: two 64-bit fingerprints that differ in at most d bits differ in at
most d of their eight bytes, so they share at least m = 8 - d bytes at the same
positions. That guaranteed count prunes the index of positional bytes:

* postings hold k bytes at once: any pair that shares m bytes shares a posting
  of its k-byte combinations over the first 8 - (m - k) positions, so lists are
  256**k times shorter than lists of one byte. This is the count filter with a
  prefix of one shared posting: all m positions are in play, and a pair that
  can reach m meets at least once;
* every pair that meets has its shared positional bytes tallied, pairs below m
  are dropped, and the rest are verified by counting bits. (A pair within d bits
  always reaches m, so the tally spares the bit count and decides nothing more.)

Equal fingerprints are one node (a group of copies costs one row). Dense
groups are contracted first on pairs that share seven bytes -- a posting of
seven bytes holds at most 256 nodes -- and later postings whose nodes are
already in one component are dropped by a pre-aggregated minimum and maximum
before any pair is formed; a pair inside one component can change nothing.
No link between different components is lost, so components are exact.

Defined results: a null text is empty; null ids take part and are never the
smallest; rows that repeat an id keep one row each; an empty table gives no
rows; a component's id is its smallest doc_id, null if it has none.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from evtide.llm.common import map_batches, materialise, plain_names
from evtide.llm.components import components

SHINGLE = 3
MAX_BITS = 3
SEED = 42
_SLICE = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint, as a signed number."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    if len(words) <= shingle:
        spans = [(0, len(line))]
    else:
        spans = list(zip([0, *ends], [e - 1 for e in ends[shingle - 1:]]))
    votes = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(spans), _SLICE):
        h = np.array([digest(line[a:b], SEED) for a, b in spans[i:i + _SLICE]], "<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1,
                               bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(votes * 2 > len(spans), bitorder="little")
    return int(bits.view("<i8")[0])


def with_fingerprint(docs: DataFrame, column: str, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with its fingerprint as bigint ``column`` (which must be new)."""
    at = docs.columns.index("text")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        prints = [fingerprint(t, shingle) for t in b.column(at).to_pylist()]
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(prints, pa.int64())],
                                          names=[*b.schema.names, column])
    schema = StructType([*docs.schema.fields, StructField(column, LongType())])
    return map_batches(docs, run, schema)


def _byte(col: str, i: int):
    return F.shiftrightunsigned(F.col(col), 8 * i).bitwiseAND(F.lit(255))


def _choices(positions: int, k: int) -> list[tuple[int, ...]]:
    return list(combinations(range(positions), k))


def _postings(nodes: DataFrame, choices: list[tuple[int, ...]]) -> DataFrame:
    """(posting, fp, comp): a row per node and choice of byte positions; the
    posting holds the number of the choice above the chosen bytes."""
    keys = []
    for number, chosen in enumerate(choices):
        key = F.lit(number).cast("bigint")
        for i in chosen:
            key = F.shiftleft(key, 8).bitwiseOR(_byte("fp", i))
        keys.append(key)
    # a table of few bytes lies in few files; each row makes dozens of postings
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return nodes.repartition(n, "fp").select(
        F.explode(F.array(*keys)).alias("posting"), "fp", "comp")


def _pairs(nodes: DataFrame, choices: list[tuple[int, ...]], least: int,
           max_bits: int) -> DataFrame:
    """Links between components, from pairs that share a posting: their shared
    positional bytes are tallied (``least`` at least), then bits are counted."""
    rows = _postings(nodes, choices)
    mixed = (rows.groupBy("posting")
             .agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
             .where("lo != hi").select("posting"))
    rows = rows.join(mixed, "posting", "left_semi")
    a = rows.select("posting", F.col("fp").alias("x"), F.col("comp").alias("cx"))
    b = rows.select("posting", F.col("fp").alias("y"), F.col("comp").alias("cy"))
    tally = sum((_byte("x", i) == _byte("y", i)).cast("int") for i in range(8))
    bits = F.bit_count(F.col("x").bitwiseXOR(F.col("y")))
    return (a.join(b, "posting")
            .where((F.col("cx") < F.col("cy")) & (tally >= least) & (bits <= max_bits))
            .select(F.col("cx").alias("u"), F.col("cy").alias("v")))


def _contract(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes with their component after the links between components."""
    roots = components(links)
    return nodes.join(roots.select(F.col("u").alias("comp"), F.col("v").alias("root")),
                      "comp", "left").select("fp", F.coalesce("root", "comp").alias("comp"))


def link_fingerprints(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, comp): distinct fingerprints of ``prints.fp`` and the smallest
    fingerprint that links of at most ``max_bits`` bits reach (0 to 7)."""
    if not 0 <= max_bits <= 7:
        raise ValueError("max_bits must be 0 to 7: at least one byte must be shared")
    nodes = prints.select("fp").distinct().withColumn("comp", F.col("fp"))
    if not max_bits:
        return nodes
    least = 8 - max_bits
    nodes = materialise(nodes, "nodes")
    nodes = materialise(_contract(nodes, _pairs(nodes, _choices(8, 7), 7, max_bits)), "nodes")
    # of the m bytes that a pair shares, m - 1 lie in any seven positions
    k = max(1, least - 1)
    choices = _choices(7, k) if least > 1 else _choices(8, 1)
    return materialise(_contract(nodes, _pairs(nodes, choices, least, max_bits)), "nodes")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id): one row per row of ``docs``."""
    prints = materialise(
        with_fingerprint(docs.select("doc_id", "text"), "fp", shingle).select("doc_id", "fp"),
        "prints")
    nodes = link_fingerprints(prints, max_bits)
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    groups = least.join(nodes, "fp").groupBy("comp").agg(F.min("first").alias("component_id"))
    labels = nodes.join(groups, "comp").select("fp", "component_id")
    return prints.join(labels, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs``, every column, with one row of each component: that of the
    smallest doc_id (then the smallest text; null ids last).

    Copies are pruned in their own tasks before the texts are shuffled.
    """
    rows = materialise(with_fingerprint(plain_names(docs), "fp", shingle), "prints")
    nodes = link_fingerprints(rows, max_bits)
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    kept = (least.join(nodes, "fp").groupBy("comp")
            .agg(F.min_by("fp", F.struct(F.isnull("first"), "first", "fp")).alias("kept"))
            .select("kept"))
    order = Window.partitionBy("fp").orderBy(F.col("doc_id").asc_nulls_last(), "text")
    one = rows.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")
    return one.join(kept, F.col("fp") == F.col("kept"), "left_semi").drop("fp").toDF(
        *docs.columns)


def hex_digits(col):
    """A bigint's 64 bits as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(col), 16, "0"))
