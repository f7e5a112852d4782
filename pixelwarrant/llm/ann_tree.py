"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first traversal; nearness is the inner product.

The tree is fitted on at most `SAMPLE` vectors: k-means splits every node into `BRANCH` children until a leaf holds few. Every vector is
then indexed: it descends to one leaf. Equal vectors are one entry, with the ids that can matter: the k + 1 smallest.

A query goes down the tree with a priority queue: the node popped next is the one with the largest bound q . c + |q| r on the
inner products below it (c its middle, r the distance within which all but a few sampled members lie), until enough leaves are
collected. How many is calibrated: on sampled queries, whose exact neighbours are found by brute force over the sample, the
number of leaves is widened until the recall goal is met.

Queries and leaves meet in a join on the leaf: blocks of queries against blocks of entries, so that a leaf with very many
entries is many rows and many tasks. A task holds the best of each query over all its blocks, and hands on k of them: what moves
grows with the queries and tasks, not with the pairs of blocks. Tasks with more queries than `HELD_BYTES` allows hand on in parts.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, neither do rows whose id is null;
vectors of another length than the most common one are an error; the query's own id is no candidate, other rows with an equal
vector are; rows repeated with the same id count once; ties go to the smaller id; fewer candidates than k are all returned, and
then (the tree has one leaf) the search is exact; an empty table gives an empty one; other columns are ignored.
"""
from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 20_000  # vectors that the tree is fitted on
BRANCH = 8
LEAF = 100  # sampled vectors that are not split further
BLOCK = 1024  # entries, and queries, that are compared at once
SALTS = 8
HELD_BYTES = 64 << 20  # of vectors that a task holds for its queries before it hands on what it has found
GOAL = 0.97
TRIALS = 200  # sampled queries of the calibration

FOUND = {"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """`id` and `v` (array of double) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), v.alias("v")).where(F.coalesce(fine, F.lit(False)))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Cluster of every row; fewer than k clusters if the rows don't allow more."""
    centers = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        to = (x @ centers.T - (centers**2).sum(1) / 2).argmax(1)
        present = np.unique(to)
        centers = np.stack([x[to == c].mean(0) for c in present])
    return (x @ centers.T - (centers**2).sum(1) / 2).argmax(1)


def grow(x: np.ndarray, seed: int = 9) -> dict[str, np.ndarray]:
    """The tree as arrays: middle and radius of every node, its children (-1: none), and its leaf number (-1: inner)."""
    rng = np.random.default_rng(seed)
    middle, radius, children, leaf, todo = [], [], [], [], [np.arange(len(x))]
    leaves = 0
    while len(middle) < len(todo):
        own = x[todo[len(middle)]]
        c = own.mean(0) if len(own) else np.zeros(x.shape[1])
        middle.append(c)
        radius.append(np.quantile(np.linalg.norm(own - c, axis=1), 0.95) if len(own) else 0.0)
        kids = np.full(BRANCH, -1)
        if len(own) > LEAF:
            to = _kmeans(own, BRANCH, rng)
            parts = np.unique(to)
            if len(parts) > 1:
                for j, part in enumerate(parts):
                    kids[j] = len(todo)
                    todo.append(todo[len(middle) - 1][to == part])
        children.append(kids)
        leaf.append(-1 if kids[0] >= 0 else leaves)
        leaves += kids[0] < 0
    return {"middle": np.array(middle), "radius": np.array(radius), "children": np.array(children), "leaf": np.array(leaf), "leaves": np.array(leaves)}


def descend(tree: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Leaf of every vector: the nearest child's middle, level after level."""
    node = np.zeros(len(x), np.int64)
    while True:
        inner = np.flatnonzero(tree["leaf"][node] < 0)
        if not len(inner):
            return tree["leaf"][node]
        for n in np.unique(node[inner]):
            at = inner[node[inner] == n]
            kids = tree["children"][n][tree["children"][n] >= 0]
            c = tree["middle"][kids]
            node[at] = kids[(x[at] @ c.T - (c**2).sum(1) / 2).argmax(1)]


def best_bins(tree: dict[str, np.ndarray], q: np.ndarray, most: int) -> list[int]:
    """The `most` leaves that a best-bin-first traversal visits first."""
    bounds = tree["middle"] @ q + np.linalg.norm(q) * tree["radius"]
    heap, out = [(-bounds[0], 0)], []
    while heap and len(out) < most:
        _, n = heapq.heappop(heap)
        if tree["leaf"][n] >= 0:
            out.append(int(tree["leaf"][n]))
        else:
            for kid in tree["children"][n]:
                if kid >= 0:
                    heapq.heappush(heap, (-bounds[kid], kid))
    return out


def calibrate(tree: dict[str, np.ndarray], x: np.ndarray, k: int, goal: float = GOAL, seed: int = 10) -> int:
    """Leaves to visit for `goal` recall of the k nearest, measured on sampled vectors against all of the sample."""
    leaves = int(tree["leaves"])
    if leaves == 1:
        return 1
    rng = np.random.default_rng(seed)
    of = descend(tree, x)
    trials = rng.choice(len(x), min(TRIALS, len(x)), replace=False)
    needed = []  # place, in the order of visits, of every true neighbour's leaf
    for t in trials:
        s = x @ x[t]
        s[t] = -np.inf
        near = np.argpartition(-s, min(k, len(x) - 1) - 1)[:k]
        place = np.empty(leaves, int)
        place[best_bins(tree, x[t], leaves)] = np.arange(leaves)
        needed.append(place[of[near]])
    return int(np.quantile(np.concatenate(needed), goal)) + 1


def nearest(candidates: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", goal: float = GOAL) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of every query, nearest first."""
    spark = candidates.sparkSession
    rows, asked = usable(candidates, key, vector), usable(queries, key, vector).dropDuplicates(["id"])
    schema = "query_id long, rank int, vec_id long, score double"
    lengths = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows")).limit(2).collect()
    if not lengths:
        return spark.createDataFrame([], schema)
    if len(lengths) > 1:
        raise ValueError(f"vectors of {lengths[0].n} and of {lengths[1].n} components")
    share = min(1.0, SAMPLE / lengths[0].rows)
    picked = rows.where(F.pmod(F.xxhash64("id", F.lit(9)), F.lit(1 << 30)) < int(share * (1 << 30))).dropDuplicates(["v"])
    sample = np.array(picked.orderBy("id").toArrow().column("v").to_pylist(), float).reshape(-1, lengths[0].n)
    if not len(sample):
        sample = np.array([r.v for r in rows.limit(1).collect()])
    tree = grow(sample)
    visits = calibrate(tree, sample, k, goal)
    shared = spark.sparkContext.broadcast(tree)

    # The k + 1 smallest ids of every distinct vector; partial results are merged, so no group is gathered.
    parts = rows.groupBy("v", F.pmod("id", F.lit(64)).alias("salt")).agg(F.slice(F.sort_array(F.collect_set("id")), 1, k + 1).alias("ids"))
    entries = parts.groupBy("v").agg(F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = descend(shared.value, _matrix(batch.column("v")))
            yield pa.RecordBatch.from_pydict({"leaf": pa.array(leaf), "v": batch.column("v"), "ids": batch.column("ids")})

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = [best_bins(shared.value, q, visits) for q in _matrix(batch.column("v"))]
            at = pa.array(np.repeat(np.arange(len(bins)), [len(b) for b in bins]))
            leaf = pa.array([x for b in bins for x in b], pa.int64())
            yield pa.RecordBatch.from_pydict({"leaf": leaf, "v": batch.column("v").take(at), "ids": batch.column("id").take(at)})

    # A leaf's entries are dealt to SALTS places, so that a leaf that very many fall in is many rows and tasks.
    indexed = entries.mapInArrow(index, "leaf long, v array<double>, ids array<long>")
    indexed = indexed.repartition("leaf", F.pmod(F.xxhash64("ids"), F.lit(SALTS))).sortWithinPartitions("leaf")
    indexed = indexed.mapInArrow(_blocks(pa.list_(pa.list_(pa.int64()))), "leaf long, v array<double>, ids array<array<long>>")
    probes = asked.mapInArrow(probe, "leaf long, v array<double>, ids long").repartition("leaf").sortWithinPartitions("leaf")
    probes = probes.mapInArrow(_blocks(pa.list_(pa.int64())), "leaf long, v array<double>, ids array<long>")
    # Spark sizes what Python hands on by its input, visits not counted, and would broadcast queries many times as large.
    met = probes.toDF("leaf", "qv", "qids").hint("merge").join(indexed.toDF("leaf", "ev", "eids"), "leaf")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, _Held] = {}
        room = max(1, HELD_BYTES // (8 * (k + 1) * (sample.shape[1] + 1)))

        def flush() -> pa.RecordBatch:
            out = [row for q_id, own in held.items() for row in _best(q_id, own.query, own.vectors, own.ids, own.scores, k)]
            return pa.RecordBatch.from_pydict({n: pa.array([r[j] for r in out], t) for j, (n, t) in enumerate(FOUND.items())})

        for batch in batches:
            for i in range(batch.num_rows):
                q_ids, e_ids = batch.column("qids")[i].as_py(), batch.column("eids")[i].as_py()
                q = np.asarray(batch.column("qv")[i].values).reshape(len(q_ids), -1)
                e = np.asarray(batch.column("ev")[i].values).reshape(len(e_ids), -1)
                if held and len(held) + len(q_ids) > room and any(x not in held for x in q_ids):
                    yield flush()
                    held = {}
                s = q @ e.T
                floors = np.array([held[x].floor if x in held else -np.inf for x in q_ids])
                for j in np.flatnonzero((s >= floors[:, None]).any(1)):
                    held[q_ids[j]] = _merged(held.get(q_ids[j]), q[j], e, e_ids, s[j], k)
        if held:
            yield flush()

    return ranked(met.mapInArrow(compare, "query_id long, vec_id long, score double"), k)


@dataclass
class _Held:
    """What a task has found for a query: the entries that can be among its k best, and the product below which none is."""

    query: np.ndarray
    floor: float
    scores: np.ndarray
    vectors: np.ndarray
    ids: list[list[int]]


def _merged(held: _Held | None, q: np.ndarray, e: np.ndarray, e_ids: list[list[int]], s: np.ndarray, k: int) -> _Held:
    """`held` with a block's entries: k + 1 of them stay, as one may be the query's own only, and those that rounding could tie."""
    at = np.flatnonzero(s >= (held.floor if held else -np.inf))
    scores, floor = (np.concatenate([held.scores, s[at]]) if held else s[at]), -np.inf
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
        floor = cut - 1e-9 * (1 + abs(cut))
    old = len(scores) - len(at)
    stay = np.flatnonzero(scores >= floor)
    ids = [held.ids[x] if x < old else e_ids[at[x - old]] for x in stay]
    new = e[at[stay[stay >= old] - old]]
    vectors = np.concatenate([held.vectors[stay[stay < old]], new]) if held else new
    return _Held(q.copy(), floor, scores[stay], vectors, ids)


def _best(q_id: int, q: np.ndarray, e: np.ndarray, e_ids: list[list[int]], s: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """The k best (query, id, score) of a block. `s` picks the vectors; their scores are summed exactly, in any order the same."""
    near = np.arange(len(s))
    if len(s) > k + 1:  # one vector more than k, as one of them may be the query's own only
        cut = np.partition(s, len(s) - k - 1)[len(s) - k - 1]
        near = np.flatnonzero(s >= cut - 1e-9 * (1 + abs(cut)))
    scored = ((-math.fsum((q * e[j]).tolist()), x) for j in near for x in e_ids[j] if x != q_id)
    # Equal vectors have equal products, so the exact sums tie where they should.
    return [(q_id, x, -away) for away, x in heapq.nsmallest(k, scored)]


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of every query, by score and then id; in two steps, so that no group holds what all blocks found."""
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("away"), F.col("vec_id")))), 1, k)
    parts = found.groupBy("query_id", F.pmod("vec_id", F.lit(SALTS)).alias("salt")).agg(best.alias("best"))
    merged = parts.groupBy("query_id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
    rows = merged.select("query_id", F.posexplode("best").alias("at", "b"))
    return rows.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.away")).alias("score"))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _blocks(kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows, in order of their leaf, to rows of up to `BLOCK` vectors of one leaf each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf, vectors, ids = None, [], []

        def row() -> pa.RecordBatch:
            flat = pa.array([np.concatenate(vectors)], pa.list_(pa.float64()))
            return pa.RecordBatch.from_pydict({"leaf": pa.array([leaf], pa.int64()), "v": flat, "ids": pa.array([ids], kind)})

        for batch in batches:
            for at, v, own in zip(batch.column("leaf").to_pylist(), _matrix(batch.column("v")), batch.column("ids").to_pylist()):
                if ids and (at != leaf or len(ids) == BLOCK):
                    yield row()
                    vectors, ids = [], []
                leaf = at
                vectors.append(v)
                ids.append(own)
        if ids:
            yield row()

    return run
