"""Prefix trie of conversations, by collapsing whole sequences.

Every conversation is rebuilt: of another's head (the conversation whose id is
the next lower multiple of 20) and its own turns after as many. A node of the
trie is a distinct sequence of first turns.

Texts stay where they are: a turn travels as 128 bits of SHA-256 and its word
count. A prefix is known by the running sum of the keyed hashes of its places
and turns, so a conversation of any length may lie across many partitions.
Identical rebuilt conversations collapse into one weighted sequence with the
list of those that end there; sequences that are proper prefixes of others are
found by an anti-join, the rest are leaves. One representative path per distinct
sequence is then aggregated by prefix:

* members: the sequences' weights; the smallest member owns the node;
* leaves: the leaf flags;
* saved tokens: words below the node over all members, less words of the
  distinct nodes below. The latter is summed by owners: a sequence owns its path
  from some depth on, so its part is a difference of two running word counts.

Rows without a conv_id belong to no conversation. A null turn comes first, rows
of one turn go by the SHA-256 of their role's length, role and text; null role or
text is empty. Repeated rows are turns of their own. No conversation, no node,
not even the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evtide.llm.common import materialise
from evtide.operators.running import running
from evtide.shipping import ship_package

#: Conversations share the head of every so-manieth.
BASE_EVERY = 20
#: A head has fewer turns than this.
HEADS = 4
#: Ids of a sequence's end list that are joined to one string at a time.
CHUNK = 4096
WORD = r"[^\x20\x09-\x0D]+"


def _long(hex16):
    return F.conv(hex16, 16, -10).cast("bigint")


def turn_digests(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, a, b, words): every turn with 128 bits of the SHA-256 of
    its role and text, and its words."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    d = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)
    return conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn",
        d.alias("d"), F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words")).select(
        "conv_id", "turn", _long(F.substring("d", 1, 16)).alias("a"),
        _long(F.substring("d", 17, 16)).alias("b"), "words")


def _base(conv_id):
    return F.col(conv_id) - F.col(conv_id) % BASE_EVERY


def _head(conv_id):
    """How many turns a conversation takes over."""
    return F.crc32(F.col(conv_id).cast("string").cast("binary")) % HEADS


def rebuild(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, a, b, words): the rebuilt conversations, turns from
    depth 1, and a row of depth 0 for every conversation."""
    # equal rows may take any order, so a number of their own may spread them
    numbered = materialise(running(
        turns.withColumn("tie", F.monotonically_increasing_id()), ["conv_id"],
        [F.col("turn").asc_nulls_first(), (F.col("a") < 0).asc(), F.col("a").asc(),
         (F.col("b") < 0).asc(), F.col("b").asc(), F.col("tie").asc()], "pos").select("conv_id", "pos", "a", "b", "words"), "turns")
    convs = numbered.where("pos = 0").select("conv_id")
    is_base = F.col("conv_id") % BASE_EVERY == 0
    heads = numbered.where(is_base & (F.col("pos") < HEADS - 1)).withColumnRenamed(
        "conv_id", "base")
    taken = (convs.where(~is_base).withColumn("base", _base("conv_id"))
             .join(heads, "base").where(F.col("pos") < _head("conv_id"))
             .select("conv_id", (F.col("pos") + 1).alias("depth"), "a", "b", "words"))
    whole = numbered.where(is_base).select(
        "conv_id", (F.col("pos") + 1).alias("depth"), "a", "b", "words")
    known = heads.groupBy("base").agg((F.max("pos") + 1).alias("n"))
    own = (numbered.where(~is_base & (F.col("pos") >= _head("conv_id")))
           .withColumn("base", _base("conv_id")).join(known, "base", "left")
           .select("conv_id", (F.col("pos") + 1 - _head("conv_id") + F.least(
               _head("conv_id"), F.coalesce("n", F.lit(0)))).alias("depth"), "a", "b", "words"))
    zero = F.lit(0).cast("bigint")
    root = convs.select("conv_id", zero.alias("depth"), zero.alias("a"), zero.alias("b"),
                        zero.alias("words"))
    return whole.unionByName(taken).unionByName(own).unionByName(root)


def prefixes(rebuilt: DataFrame) -> DataFrame:
    """The rebuilt turns with the key (k1, k2) of the prefix that ends there and
    of the one before (p1, p2), the words of both (upto, before), and whether
    the conversation ends there."""
    def keyed(seed):
        return F.when(F.col("depth") > 0, F.xxhash64(F.lit(seed), "depth", "a", "b")).otherwise(
            F.lit(0).cast("bigint"))
    r = running(rebuilt.select("conv_id", "depth", "words", keyed(1).alias("g1"),
                               keyed(2).alias("g2")),
                ["conv_id"], [F.col("depth").asc()], size="n",
                sums={"k1": "g1", "k2": "g2", "upto": "words"},
                before={"p1": "g1", "p2": "g2", "before": "words"})
    return r.select("conv_id", "depth", "k1", "k2", "p1", "p2", "upto", "before",
                    (F.col("depth") == F.col("n") - 1).alias("ends"))


def _hash_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, ends_sha256) of chunks sorted by (k1, k2, chunk): one hash runs
    over the chunks of a list, which is never put together."""
    at, h = None, None

    def done(keys, digests):
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()),
             pa.array(digests, pa.string())], names=["k1", "k2", "ends_sha256"])
    for b in batches:
        keys, digests = [], []
        for k1, k2, ids in zip(*(b.column(i).to_pylist() for i in range(3))):
            if (k1, k2) == at:
                h.update(b",")
            else:
                if at:
                    keys.append(at)
                    digests.append(h.hexdigest())
                at, h = (k1, k2), hashlib.sha256()
            h.update(ids.encode())
        yield done(keys, digests)
    if at:
        yield done([at], [h.hexdigest()])


def end_lists(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of the conversations that end at a node, in order
    of their ids. A list of any length is numbered across partitions and joined
    in chunks first."""
    ship_package(ends.sparkSession)
    placed = running(ends.select("k1", "k2", "conv_id"), ["k1", "k2"],
                     [F.col("conv_id").asc()], "place")
    chunks = (placed.groupBy("k1", "k2", F.floor(F.col("place") / CHUNK).alias("chunk"))
              .agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
              .select("k1", "k2", "chunk", F.array_join(
                  F.transform("ids", lambda x: x.cast("string")), ",").alias("ids")))
    return (chunks.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "chunk")
            .select("k1", "k2", "ids")
            .mapInArrow(_hash_lists, "k1 bigint, k2 bigint, ends_sha256 string"))


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    paths = materialise(prefixes(rebuild(turn_digests(conversations))), "paths")
    ends = paths.where("ends")
    sequences = materialise(
        ends.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("weight"),
                                     F.min("conv_id").alias("rep"), F.max("upto").alias("total"),
                                     F.max("depth").alias("length")), "sequences")
    kept = materialise(paths.drop("ends").withColumnRenamed("conv_id", "rep").join(
        sequences.drop("k1", "k2"), "rep"), "kept")

    inner = kept.where("depth < length").select("k1", "k2").distinct()
    leaves = sequences.join(inner, ["k1", "k2"], "left_anti").select(
        "rep", F.lit(1).cast("bigint").alias("leaf"))
    nodes = materialise(kept.groupBy("k1", "k2").agg(
        F.min("rep").alias("conv_id"), F.max("depth").alias("depth"),
        F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.max("before").alias("before"),
        F.sum("weight").alias("n_convs"),
        F.sum(F.col("weight") * (F.col("total") - F.col("before"))).alias("all_words")), "nodes")
    owned = nodes.groupBy(F.col("conv_id").alias("rep")).agg(F.min("before").alias("owned"))
    info = (sequences.select("rep").join(owned, "rep", "left").join(leaves, "rep", "left"))
    below = kept.join(info, "rep").groupBy("k1", "k2").agg(
        F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"),
        F.sum(F.col("total") - F.greatest("before", F.coalesce("owned", "total")))
        .alias("node_words"))
    children = nodes.where("depth > 0").groupBy("p1", "p2").agg(
        F.count(F.lit(1)).alias("n_children")).withColumnsRenamed({"p1": "k1", "p2": "k2"})
    # every first turn hangs on the root: its id is one value, not a join key
    root = nodes.where("depth = 0").select("conv_id").first()
    parents = nodes.where("depth > 0").select(
        F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent"))
    whole = (nodes.join(below, ["k1", "k2"]).join(children, ["k1", "k2"], "left")
             .join(end_lists(ends), ["k1", "k2"], "left"))
    first = F.col("depth") <= 1

    def shaped(df, parent):
        return df.select(
            "conv_id", "depth", parent.cast("bigint").alias("parent_conv_id"), "n_convs",
            F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"), "n_leaves",
            (F.col("all_words") - F.col("node_words")).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
    at_root = F.when(F.col("depth") == 1, F.lit(root.conv_id if root else None))
    whole = materialise(whole, "trie")
    return shaped(whole.where(first), at_root).unionByName(
        shaped(whole.where(~first).join(parents, ["p1", "p2"]), F.col("parent")))
