"""Approximate nearest neighbours on a hierarchical k-means tree.

The tree is fitted by numpy on a bounded sample (``SAMPLE`` distinct vectors,
chosen by hash) and is small enough for every task. Every distinct vector of
the table is put in its leaf; a query walks the tree best bin first, a priority
queue ordering the nodes seen so far by the inner product with
their centre plus a share of their radius,
until it has visited as many leaves as calibration asks for. Calibration finds
the true neighbours of ``PROBES`` queries by a full scan and widens the number
of visits until their recall reaches ``TARGET``.

Scale: equal vectors are one row with their ``k + 1`` smallest ids (more can't
be among the k nearest), so a vector held by a third of all rows is no hot
leaf. Neighbouring leaves are kept together in blocks of bounded size (a larger
leaf is split); a query goes once to each block that holds leaves of its visit,
in blocks of queries of bounded size, and each pair of blocks is one matrix
product that returns the best of the visited leaves.

Nearness is the largest inner product in double precision, ties to the smaller
id. Rows are numbered in the order of their ids and known by that number, so
rows that share an id are queries and candidates of their own (each query row
has its ranks; a row isn't its own neighbour, another with its id may be).
Defined results: rows with a null id or a vector that is null, zero, of
another length than most, or holds a null or non-finite component take no part.
An empty table, or one without queries, gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evtide.llm.common import map_batches, materialise
from evtide.operators.running import running

SAMPLE = 10_000
BRANCH = 8
LEAF = 24
PROBES = 128
TARGET = 0.96
#: Share of a node's radius (times the query's length) added to its priority.
REACH = 0.3
#: Numbers in a block of vectors (8 MB), and queries in a block of queries.
BLOCK_VALUES = 1 << 20
QUERY_BLOCK = 2048
SEED = 11


class Tree:
    """Nodes in one array; a node without children is a leaf."""

    def __init__(self, sample: np.ndarray, branch: int = BRANCH, leaf: int = LEAF):
        self.rng = np.random.default_rng(SEED)
        self.centres: list[np.ndarray] = [sample.mean(axis=0) if len(sample) else
                                          np.zeros(sample.shape[1])]
        self.children: list[list[int]] = [[]]
        self.radius: list[float] = [0.0]
        self._split(0, sample, branch, leaf)
        self.leaves = [i for i, c in enumerate(self.children) if not c]
        self.stacked = [np.array([self.centres[c] for c in kids]) if kids else None
                        for kids in self.children]
        self.reach = [REACH * np.array([self.radius[c] for c in kids]) for kids in self.children]
        del self.rng

    def _split(self, node: int, x: np.ndarray, branch: int, leaf: int) -> None:
        if len(x) <= leaf:
            return
        centres = x[self.rng.choice(len(x), min(branch, len(x)), replace=False)]
        for _ in range(8):
            near = _nearest(x, centres)
            centres = np.array([x[near == k].mean(axis=0) if (near == k).any() else c
                                for k, c in enumerate(centres)])
        near = _nearest(x, centres)
        groups = [k for k in range(len(centres)) if (near == k).any()]
        if len(groups) < 2:
            return
        for k in groups:
            self.centres.append(centres[k])
            self.children.append([])
            self.radius.append(float(np.linalg.norm(x[near == k] - centres[k], axis=1).mean()))
            self.children[node].append(len(self.centres) - 1)
        for k, child in zip(groups, list(self.children[node])):
            self._split(child, x[near == k], branch, leaf)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each row of x descends to, by the nearest centre."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                out[rows] = node
                continue
            near = _nearest(x[rows], self.stacked[node])
            for k, child in enumerate(self.children[node]):
                if (part := rows[near == k]).size:
                    todo.append((child, part))
        return out

    def visit(self, q: np.ndarray, most: int, held: dict[int, int] | None = None,
              need: int = 0) -> list[int]:
        """The first leaves in best-bin-first order: ``most`` of them, and on
        until they hold ``need`` vectors (``held``: vectors in each leaf)."""
        heap, out, have = [(0.0, 0)], [], 0
        size = float(np.linalg.norm(q))
        while heap and (len(out) < most or have < need):
            _, node = heapq.heappop(heap)
            kids = self.children[node]
            if not kids:
                out.append(node)
                have += held.get(node, 0) if held else 0
                continue
            for child, s in zip(kids, (self.stacked[node] @ q
                                       + size * self.reach[node]).tolist()):
                heapq.heappush(heap, (-s, child))
        return out


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(x @ centres.T - 0.5 * (centres * centres).sum(axis=1), axis=1)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten() if not isinstance(column, pa.ChunkedArray) else \
        column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _top(rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, keep: int,
         leaf: np.ndarray | None = None, visited: list | None = None
         ) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per query the ``keep`` best (ids, scores) among the rows, or those of the
    leaves it visits; ties to the smaller id."""
    out = []
    for at in range(0, len(queries), 128):
        rough = queries[at:at + 128] @ rows.T
        for k, s in enumerate(rough, start=at):
            q = queries[k]
            among = np.arange(len(s)) if visited is None else np.flatnonzero(
                np.isin(leaf, visited[k]))
            s = s[among]
            if len(s) > keep:       # everything that rounding could put among the best
                floor = np.partition(s, len(s) - keep)[len(s) - keep]
                among = among[s >= floor - 1e-9 * max(1.0, abs(floor))]
            exact = (rows[among] * q).sum(axis=1)
            order = np.lexsort((ids[among], -exact))[:keep]
            out.append((ids[among][order], exact[order]))
    return out


def valid_vectors(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, v, row): the usable double vectors, numbered in the order of their
    ids, and the vectors' length."""
    v = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"),
                       F.col("embedding").cast("array<double>").alias("v")).where(
        "vec_id is not null and v is not null and size(v) > 0")
    v = v.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)
                         & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    most = (v.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "dim").first())
    dim = most.dim if most else 1
    # rows that share an id may take any order, so a number of their own spreads them
    return running(v.where(F.size("v") == dim).withColumn("tie", F.monotonically_increasing_id()),
                   [], [F.col("vec_id").asc(), F.col("tie").asc()], "row").drop("tie"), dim


def distinct_vectors(v: DataFrame, keep: int) -> DataFrame:
    """(rep, members, v): distinct vectors with their ``keep`` first rows (row, vec_id)."""
    first = Window.partitionBy("v").orderBy("row")
    return (v.withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= keep)
            .groupBy("v").agg(F.min("row").alias("rep"),
                              F.array_sort(F.collect_list(F.struct("row", "vec_id")))
                              .alias("members")))


def _best(found: DataFrame, keep: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
    return (found.withColumn("__n", F.row_number().over(order))
            .where(F.col("__n") <= keep).drop("__n"))


def true_neighbours(base: DataFrame, probes: list[tuple[int, list[float]]], dim: int,
                    keep: int) -> DataFrame:
    """(q, rep, score) of a few probe vectors, by a full scan."""
    ids = [p[0] for p in probes]
    queries = base.sparkSession.sparkContext.broadcast(
        np.array([p[1] for p in probes], np.float64).reshape(-1, dim))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        best = _top(_matrix(b.column(1), dim), b.column(0).to_numpy(), queries.value, keep)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(ids, [len(r) for r, _ in best]), pa.int64()),
             pa.array(np.concatenate([r for r, _ in best]), pa.int64()),
             pa.array(np.concatenate([s for _, s in best]), pa.float64())],
            names=["q", "rep", "score"])
    return _best(map_batches(base.select("rep", "v"), run, "q bigint, rep bigint, score double"),
                 keep)


def calibrate(tree: Tree, probes: list[tuple[int, list[float]]],
              truth: dict[int, list[int]], target: float = TARGET) -> int:
    """Leaf visits, doubled and then cut back by halves, that find ``target`` of
    the probes' true neighbours (given as leaves) on average."""
    place = {q: {leaf: k for k, leaf in enumerate(
        tree.visit(np.array(v), len(tree.leaves)))} for q, v in probes}

    def recall(visits: int) -> float:
        got = [np.mean([place[q][leaf] < visits for leaf in truth[q]])
               for q, _ in probes if truth.get(q)]
        return float(np.mean(got)) if got else 1.0
    high = 1
    while high < len(tree.leaves) and recall(high) < target:
        high = min(2 * high, len(tree.leaves))
    low = high // 2
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if recall(mid) >= target else (mid, high)
    return high


def _in_leaves(base: DataFrame, tree: Tree, dim: int) -> DataFrame:
    shared = base.sparkSession.sparkContext.broadcast(tree)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        leaf = shared.value.leaf_of(_matrix(b.column(1), dim))
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(leaf)],
                                          names=["rep", "v", "leaf"])
    return map_batches(base.select("rep", "v"), run, "rep bigint, v array<double>, leaf bigint")


def leaf_blocks(tree: Tree, held: dict[int, int], size: int) -> dict[int, tuple[int, int]]:
    """leaf -> (block, parts): leaves in tree order share a block up to ``size``
    vectors; a larger leaf has a block of its own in several parts."""
    order, todo = [], [0]
    while todo:
        node = todo.pop()
        kids = tree.children[node]
        todo += reversed(kids)
        if not kids:
            order.append(node)
    out, block, full = {}, 0, 0
    for leaf in order:
        n = held.get(leaf, 0)
        if full and full + n > size:
            block, full = block + 1, 0
        out[leaf] = (block, max(1, -(-n // size)))
        full += n
    return out


def _visits(queries: DataFrame, tree: Tree, dim: int, most: int, held: dict[int, int],
            need: int, blocks: dict[int, tuple[int, int]]) -> DataFrame:
    """(q, v, block, parts, leaves): a row per query and block that it visits."""
    shared = queries.sparkSession.sparkContext.broadcast((tree, held, blocks))
    there = pa.list_(pa.struct([("block", pa.int64()), ("parts", pa.int64()),
                                ("leaves", pa.list_(pa.int64()))]))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        tree_, held_, blocks_ = shared.value
        out = []
        for q in _matrix(b.column(1), dim):
            per: dict[int, list[int]] = {}
            for leaf in tree_.visit(q, most, held_, need):
                per.setdefault(blocks_[leaf][0], []).append(leaf)
            out.append([{"block": k, "parts": max(blocks_[x][1] for x in leaves),
                         "leaves": leaves} for k, leaves in per.items()])
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, there)],
                                          names=["q", "v", "there"])
    # walks take long for their few rows: one stretch of queries to each core
    spread = queries.select("q", "v").repartition(
        queries.sparkSession.sparkContext.defaultParallelism, "q")
    return map_batches(spread, run,
                       "q bigint, v array<double>, there array<struct<block:bigint,parts:bigint,"
                       "leaves:array<bigint>>>").select(
        "q", "v", F.explode("there").alias("t")).select("q", "v", "t.*")


def nearest(vectors: DataFrame, is_query, k: int = 20, sample: int = SAMPLE,
            target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``is_query`` holds its
    k nearest other rows, nearest first; all of them if they are fewer. A query
    visits further leaves until it has seen more than k distinct vectors."""
    spark = vectors.sparkSession
    v, dim = valid_vectors(vectors)
    v = materialise(v, "vectors")
    keep = k + 1
    base = materialise(distinct_vectors(v, keep), "distinct-vectors")
    asked = v.where(is_query)
    q_of = asked.groupBy("v").agg(F.min("row").alias("q"))
    q_of = materialise(q_of, "query-vectors")
    picked = (base.select("rep", "v").orderBy(F.xxhash64("v"), "rep").limit(sample)
              .select("v").toArrow())
    points = _matrix(picked.column(0), dim) if picked.num_rows else np.zeros((0, dim))
    tree = Tree(points)
    placed = materialise(_in_leaves(base, tree, dim), "leaves")
    probes = [(r.q, list(r.v)) for r in q_of.orderBy(F.xxhash64("v"), "q").limit(PROBES).collect()]
    truth: dict[int, list[int]] = {}
    if probes:
        rows = true_neighbours(base, probes, dim, keep).join(
            placed.select("rep", "leaf"), "rep").select("q", "leaf").collect()
        for r in rows:
            truth.setdefault(r.q, []).append(r.leaf)
    held = {r.leaf: r.n for r in placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = leaf_blocks(tree, held, max(1, BLOCK_VALUES // dim))
    visits = materialise(_visits(q_of, tree, dim, calibrate(tree, probes, truth, target), held,
                                 keep, blocks), "visits")
    where = spark.createDataFrame([(k, *v) for k, v in blocks.items()],
                                  "leaf long, block long, parts long")    # a row per leaf
    asked_of = visits.groupBy("block").agg(
        F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).alias("nq"))
    data = placed.join(F.broadcast(where), "leaf").join(F.broadcast(asked_of), "block").select(
        "rep", "v", "leaf", "block", F.pmod(F.xxhash64("rep"), F.col("parts")).alias("part"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("nq") - 1)).alias("qb"))
    queries = visits.join(F.broadcast(asked_of), "block").select(
        "q", "v", "leaves", "block", F.pmod(F.xxhash64("q"), F.col("nq")).alias("qb"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
    key = ["block", "part", "qb"]

    def score(rows: pa.Table, asked_: pa.Table) -> pa.Table:
        best, ids = [], np.zeros(0, np.int64)
        if rows.num_rows and asked_.num_rows:
            ids = asked_.column("q").to_numpy()
            best = _top(_matrix(rows.column("v"), dim), rows.column("rep").to_numpy(),
                        _matrix(asked_.column("v"), dim), keep, rows.column("leaf").to_numpy(),
                        asked_.column("leaves").to_pylist())
        none = [np.zeros(0)]
        return pa.table({
            "q": pa.array(np.repeat(ids, [len(r) for r, _ in best]), pa.int64()),
            "rep": pa.array(np.concatenate([r for r, _ in best] or none).astype(np.int64)),
            "score": pa.array(np.concatenate([s for _, s in best] or none), pa.float64())})
    found = (data.groupBy(*key).cogroup(queries.groupBy(*key))
             .applyInArrow(score, "q bigint, rep bigint, score double"))
    best = _best(found, keep).join(base.select("rep", "members"), "rep").select(
        "q", "score", F.explode("members").alias("m"))
    best = _best(best.select("q", "score", F.col("m.row").alias("rep"),
                             F.col("m.vec_id").alias("vec_id")), keep)
    members = asked.join(q_of, "v").select(F.col("vec_id").alias("query_id"), "row", "q")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "rep")
    return (members.join(best, "q").where(F.col("row") != F.col("rep"))
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
