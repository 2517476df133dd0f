r"""SimHash document fingerprints and permuted block tables, in Spark's own functions.

A term is a pair of neighbouring words (words split at ASCII white space, the
last word also alone); its weight is its number of characters. Each term's
64-bit hash votes with its weight for its set bits and against the others; a
fingerprint bit is 1 where the votes for it outweigh those against. The votes
of two bits share one 64-bit sum (32 bits each), so a text's terms collapse to
32 sums in its own task before anything is shuffled.

Block tables: 64 bits are cut into ``radius + 3`` blocks; fingerprints within
``radius`` bits agree on at least three whole blocks, so one table per choice
of three blocks, keyed by those blocks, meets every such pair. A pair is kept
from the first table it agrees on and verified by counting bits.

Defined results: a null text is empty; a text without words has fingerprint
zero; equal texts have equal fingerprints. Documents are ordered by doc_id
descending, null last; rows that share a doc_id follow each other by the hash
of their text, and fully equal rows are one document whose result every row
gets. The only document of a table is its own next. An empty table gives no
rows.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evtide.llm.common import materialise

_SPACES = r"[ \t-\r]+"
_LANES = 0x0000000100000001
_ROW_BITS = 33      # monotonically_increasing_id: row of the partition below, partition above


def fingerprints(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, fp): the fingerprint of every distinct ``keys`` of ``texts``.

    ``keys`` must determine the text; rows that repeat them change nothing.
    """
    words = F.split(F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(" \t\n\x0b\x0c\r")),
                    _SPACES)
    pairs = (texts.select(*keys, words.alias("__w"))
             .select(*keys, F.explode(F.arrays_zip(
                 F.col("__w").alias("a"),
                 F.slice("__w", 2, F.greatest(F.size("__w") - 1, F.lit(0))).alias("b")))
                 .alias("__t")))
    h = F.when(F.length("__t.a") > 0, F.xxhash64("__t.a", "__t.b"))
    weight = F.length("__t.a") + F.coalesce(F.length("__t.b"), F.lit(0))
    votes = (pairs.select(*keys, h.alias("__h"), weight.cast("bigint").alias("__n"))
             .groupBy(*keys).agg(
        F.sum("__n").alias("__all"),
        *[F.sum(F.col("__n") * F.shiftrightunsigned("__h", i).bitwiseAND(F.lit(_LANES)))
          .alias(f"__v{i}") for i in range(32)]))
    fp: Column = F.lit(0).cast("bigint")
    for i in range(64):
        lane = F.shiftrightunsigned(f"__v{i % 32}", 32 if i > 31 else 0).bitwiseAND(
            F.lit(0xFFFFFFFF))
        fp = fp.bitwiseOR(F.when(lane * 2 > F.col("__all"), F.lit(_signed(1 << i)))
                          .otherwise(F.lit(0).cast("bigint")))
    return votes.select(*keys, fp.alias("fp"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def likeness(a, b) -> Column:
    """Share of equal bits, 0 to 1."""
    return F.lit(1.0) - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / F.lit(64.0)


def _blocks(n: int) -> list[tuple[int, int]]:
    """(shift, width) of n blocks that make up 64 bits."""
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def block_tables(prints: DataFrame, radius: int) -> DataFrame:
    """(fp, table, key): the permuted tables, three blocks brought to the front."""
    blocks = _blocks(radius + 3)
    rows = []
    for number, chosen in enumerate(combinations(blocks, 3)):
        key = F.lit(0).cast("bigint")
        for shift, width in chosen:
            key = F.shiftleft(key, width).bitwiseOR(
                F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1)))
        rows.append(F.struct(F.lit(number).alias("table"), key.alias("key")))
    return prints.select("fp", F.explode(F.array(*rows)).alias("__r")).select(
        "fp", "__r.table", "__r.key")


def within_radius(queries: DataFrame, prints: DataFrame, radius: int = 3) -> DataFrame:
    """(query, fp): for each distinct ``queries.fp`` every other distinct
    ``prints.fp`` within ``radius`` bits (at most 13, so that three blocks
    hold 12 bits)."""
    if not 0 <= radius <= 13:
        raise ValueError("radius must be 0 to 13")
    blocks = _blocks(radius + 3)
    asked = block_tables(queries.select("fp").distinct(), radius).withColumnRenamed("fp", "query")
    stored = block_tables(prints.select("fp").distinct(), radius)
    diff = F.col("query").bitwiseXOR(F.col("fp"))
    first = None        # the first table on which the pair agrees
    for number, chosen in reversed(list(enumerate(combinations(blocks, 3)))):
        mask = _signed(sum(((1 << w) - 1) << s for s, w in chosen))
        agree = diff.bitwiseAND(F.lit(mask)) == 0
        first = (F.when(agree, F.lit(number)).otherwise(first) if first is not None
                 else F.when(agree, F.lit(number)))
    return (asked.join(stored, ["table", "key"])
            .where((F.col("query") != F.col("fp")) & (F.bit_count(diff) <= radius)
                   & (first == F.col("table")))
            .select("query", "fp"))


#: What tells one document from another; no column is null.
_KEY = ["id", "no_id", "hash", "n_chars"]


def numbered(docs: DataFrame) -> DataFrame:
    """(id, no_id, hash, n_chars, doc_id, copies, pos): the distinct documents in
    descending doc_id, numbered from 0 without a gap.

    Keys are range-partitioned and sorted; a key's number is its row in the
    partition plus the sizes of the partitions before, one row each.
    """
    keys = docs.groupBy(*_KEY, "doc_id").agg(F.count(F.lit(1)).alias("copies"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("hash"), F.col("n_chars")]
    rows = materialise(keys.repartitionByRange(*order).sortWithinPartitions(*order)
                       .withColumn("row", F.monotonically_increasing_id()), "doc-order")
    part = F.shiftright("row", _ROW_BITS)
    sizes = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        .alias("before"))
    pos = F.col("before") + F.col("row").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (rows.withColumn("part", part).join(F.broadcast(before), "part")
            .select(*_KEY, "doc_id", "copies", pos.alias("pos")))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, edited_sha256, fp and
    edited_fp (bigint), near_edited, near_next, pos.

    The edited text is the text with its last third of code points replaced by
    as many from the start of the next document.
    """
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", text.alias("text")).select(
        "doc_id", "text", F.coalesce("doc_id", F.lit(0)).alias("id"),
        F.isnull("doc_id").alias("no_id"), F.xxhash64("text").alias("hash"),
        F.length("text").cast("bigint").alias("n_chars"))
    places = materialise(numbered(base.drop("text")), "doc-places")
    n = places.count()
    # one row of each set of equal rows, partitioned as the joins below need it
    once = (base.drop("doc_id").withColumn("__k", F.row_number().over(
        Window.partitionBy(*_KEY).orderBy("hash"))).where("__k = 1").drop("__k"))
    third = F.floor(F.col("n_chars") / 3)
    wanted = places.select(
        F.pmod(F.col("pos") + 1, F.lit(max(n, 1))).alias("__next"), F.col("pos").alias("to"),
        third.alias("chars"))
    asked = places.join(wanted, F.col("pos") == F.col("__next")).select(*_KEY, "to", "chars")
    heads = once.join(asked, _KEY).select("to", F.col("text").substr(F.lit(1), F.col("chars").cast("int"))
                                   .alias("head"))
    heads = heads.join(places.select(F.col("pos").alias("to"), *_KEY), "to")
    kept = F.col("text").substr(F.lit(1), (F.col("n_chars") - third).cast("int"))
    both = once.join(heads, _KEY).select("to", "text", F.concat(kept, F.col("head")).alias("edited"))
    sides = both.select(
        "to", F.unhex(F.sha2("edited", 256)).alias("sha"),
        F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("t")),
                          F.struct(F.lit(1).alias("side"), F.col("edited").alias("t"))))
        .alias("s")).select("to", "sha", "s.side", F.col("s.t").alias("t"))
    prints = (fingerprints(sides, ["to", "sha", "side"], "t").groupBy("to")
              .agg(F.max(F.when(F.col("side") == 0, F.col("fp"))).alias("fp"),
                   F.max(F.when(F.col("side") == 1, F.col("fp"))).alias("edited_fp"),
                   F.max("sha").alias("sha")))
    prints = materialise(places.join(prints, places["pos"] == prints["to"]).drop("to"),
                         "doc-prints")
    nxt = prints.select(F.col("pos").alias("__at"), F.col("fp").alias("next_fp"))
    out = prints.join(nxt, F.pmod(F.col("pos") + 1, F.lit(max(n, 1))) == F.col("__at"))
    return (out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
            .select("doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"),
                    "fp", "edited_fp", likeness("fp", "edited_fp").alias("near_edited"),
                    likeness("fp", "next_fp").alias("near_next"), "pos"))
