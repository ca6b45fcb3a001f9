"""Approximate nearest neighbours with a hierarchical k-means tree.

The tree is fitted on the driver on at most FIT_ROWS vectors (those with the smallest hash of
vec_id): every node splits its vectors by k-means into BRANCHES children until they are few. Every
vector then descends to the nearest centre at each node; the leaf it reaches holds it.

A query walks the tree best bin first: a priority queue holds the nodes seen but not entered, by
the distance of their centres, and the nearest is entered next, until a number of leaves has been
visited. That number is calibrated: for CALIBRATION of the queries the true neighbours are found
by brute force against all rows, and the places of their leaves in the query's visiting order are
noted; visits widen until RECALL of these neighbours lie in visited leaves.

Leaves are searched in blocks: a leaf with many vectors is split by hash, and so are many queries
on one leaf, so that no task gathers a common vector's copies. Within a visited leaf the search is
exact, on the original vectors in double precision.
"""

from __future__ import annotations

import functools
import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoaffinity.llm.frames import checkpointed, smallest_hashes, stored

FIT_ROWS = 20_000
BRANCHES = 8
#: A leaf holds LEAF_ROWS vectors or LEAF_ROOTS times the root of their number, whichever is more:
#: with leaves in proportion to the vectors, queries in many dimensions would visit as many more.
#: A leaf is fitted on LEAF_FIT vectors or more.
LEAF_ROWS, LEAF_ROOTS, LEAF_FIT = 256, 4, 4
CALIBRATION = 64
RECALL = 0.97
BLOCK_ROWS = 2048
_STEPS = 8


@dataclass
class Node:
    """centres: of the children, one row each. leaf: the leaf's number, or -1."""

    centres: np.ndarray | None = None
    children: list[Node] = field(default_factory=list)
    leaf: int = -1


@dataclass
class Tree:
    root: Node
    leaves: int

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        leaf = np.zeros(len(vectors), np.int64)
        todo = [(self.root, np.arange(len(vectors)))]
        while todo:
            node, rows = todo.pop()
            if node.centres is None:
                leaf[rows] = node.leaf
                continue
            near = distances(vectors[rows], node.centres).argmin(axis=1)
            todo += [(child, rows[near == n]) for n, child in enumerate(node.children) if (near == n).any()]
        return leaf

    def visit(self, query: np.ndarray, count: int, sizes: np.ndarray | None = None, least: int = 0) -> list[int]:
        """The first leaves that a query visits, best bin first: count of them, and more until their
        sizes add up to least."""
        found: list[int] = []
        held = 0
        queue = [(0.0, 0, self.root)]
        seen = 1
        while queue and (len(found) < count or (sizes is not None and held < least)):
            _, _, node = heapq.heappop(queue)
            if node.centres is None:
                found.append(node.leaf)
                held += 0 if sizes is None else int(sizes[node.leaf])
                continue
            for distance, child in zip(distances(query[None], node.centres)[0].tolist(), node.children, strict=True):
                heapq.heappush(queue, (distance, seen, child))
                seen += 1
        return found


def distances(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of all vectors from all centres."""
    squares = np.square(vectors).sum(axis=1)[:, None] + np.square(centres).sum(axis=1)[None]
    return squares - 2 * (vectors @ centres.T)


def fit_tree(vectors: np.ndarray, leaf_size: int) -> Tree:
    """Split vectors by k-means until a node holds leaf_size or fewer; the same for the same input."""
    random = np.random.default_rng(4)
    leaves = 0

    def grow(rows: np.ndarray) -> Node:
        nonlocal leaves
        own = vectors[rows]
        different = np.unique(own, axis=0) if len(rows) > leaf_size else own[:1]
        if len(different) < 2:
            leaves += 1
            return Node(leaf=leaves - 1)
        k = min(BRANCHES, len(different))
        centres = different[random.choice(len(different), k, replace=False)]
        for _ in range(_STEPS):
            near = distances(own, centres).argmin(axis=1)
            for n in range(k):
                if (near == n).any():
                    centres[n] = own[near == n].mean(axis=0)
        near = distances(own, centres).argmin(axis=1)
        used = [n for n in range(k) if (near == n).any()]
        if len(used) < 2:
            leaves += 1
            return Node(leaf=leaves - 1)
        return Node(centres[used], [grow(rows[near == n]) for n in used])

    root = grow(np.arange(len(vectors))) if len(vectors) else Node(leaf=0)
    return Tree(root, max(1, leaves))


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vector): one row for each id whose vector can take part."""
    vector = embeddings["embedding"]
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < math.inf), F.lit(False)))
    return (
        embeddings.select(embeddings["vec_id"].cast("long").alias("vec_id"), vector.alias("vector"))
        .filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & finite & F.exists(vector, lambda x: x != 0))
        .groupBy("vec_id")
        .agg(F.min("vector").alias("vector"))
    )


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def in_leaves(points: DataFrame, tree: Tree) -> DataFrame:
    """(leaf, vec_id, vector) of all points."""
    shared = points.sparkSession.sparkContext.broadcast(tree)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = shared.value.assign(_matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array(leaf), *batch.columns], names=["leaf", "vec_id", "vector"])

    return points.mapInArrow(rows, f"leaf long, vec_id long, vector {points.schema['vector'].dataType.simpleString()}")


def nearest_in(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> list[tuple]:
    """For each query its k nearest of a block: (query_id, vec_id, score, place in the block)."""
    found = []
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    for query_id, query in zip(query_ids.tolist(), queries, strict=True):
        score = np.sqrt(np.square(vectors - query).sum(axis=1))
        score[ids == query_id] = np.inf
        best = np.argsort(score, kind="stable")[: k + 1]
        found += [(query_id, int(ids[i]), float(score[i]), int(order[i])) for i in best if ids[i] != query_id][:k]
    return found


def calibrated_visits(members: DataFrame, tree: Tree, sample: list[tuple[int, np.ndarray]], k: int, recall: float) -> int:
    """How many leaves to visit, from the true neighbours of some queries in all members."""
    ids = np.array([i for i, _ in sample])
    queries = np.array([v for _, v in sample])
    shared = members.sparkSession.sparkContext.broadcast((ids, queries))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_ids, own = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            leaf = batch.column(0).to_numpy()
            found = nearest_in(own_ids, own, batch.column(1).to_numpy(), _matrix(batch.column(2)), k)
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()),
                 pa.array([f[2] for f in found], pa.float64()), pa.array([int(leaf[f[3]]) for f in found], pa.int64())],
                names=["query_id", "vec_id", "score", "leaf"],
            )

    true = nearest_overall(members.mapInArrow(rows, "query_id long, vec_id long, score double, leaf long"), k).collect()
    place = {i: {leaf: n for n, leaf in enumerate(tree.visit(v, tree.leaves))} for i, v in sample}
    needed = sorted(place[row["query_id"]][row["leaf"]] + 1 for row in true)
    if not needed:
        return tree.leaves
    return needed[min(len(needed), math.ceil(recall * len(needed))) - 1]


def nearest_overall(found: DataFrame, k: int) -> DataFrame:
    """The k nearest rows of each query, ties to the smaller vec_id, with their rank."""
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(embeddings: DataFrame, every: int = 100, k: int = 10, recall: float = RECALL, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The k nearest other vectors found of each vector whose id is divisible by every.

    embeddings: (vec_id, embedding). Returns query_id, rank, vec_id, score (Euclidean distance).
    Vectors that are null or zero, or hold null or non-finite components, take no part, nor do rows
    without vec_id. Vectors of different lengths have no distance: each length has a tree of its own
    and is searched by itself, one after the other. Of rows with the same vec_id the least vector
    counts. Ties go to the smaller vec_id. With fewer than k candidates a query gets those found.
    Other columns are not read. Without queries the result is empty.
    """
    points = stored(usable(embeddings))
    asked = F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("asked")
    lengths = points.groupBy(F.size("vector").alias("length")).agg(F.count(F.lit(1)).alias("total"), asked)
    lengths = [(r["length"], r["total"]) for r in lengths.filter("asked > 0 and total > 1").orderBy("length").collect()]
    found = [
        search_length(points.filter(F.size("vector") == length), total, every, k, recall, fit_rows)
        for length, total in lengths or [(0, 0)]
    ]
    return functools.reduce(DataFrame.unionByName, found)


def search_length(points: DataFrame, total: int, every: int, k: int, recall: float, fit_rows: int) -> DataFrame:
    """The search among so many points (vec_id, vector), each id once, of one length."""
    spark = points.sparkSession
    place = F.xxhash64("vec_id")
    sample = points.filter(smallest_hashes(place, fit_rows, total)[0]).orderBy(place, "vec_id").limit(fit_rows).select("vector").collect()
    leaf_rows = max(LEAF_ROWS, LEAF_ROOTS * math.isqrt(total))
    leaf_fit = max(LEAF_FIT, math.ceil(leaf_rows * len(sample) / max(1, total)))
    tree = fit_tree(np.array([row["vector"] for row in sample], np.float64), leaf_fit)
    members = stored(in_leaves(points, tree))
    asked = members.filter(F.col("vec_id") % every == 0)
    chosen = asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(CALIBRATION).select("vec_id", "vector").collect()
    visits = calibrated_visits(members, tree, [(r[0], np.array(r[1], np.float64)) for r in chosen], k, recall) if chosen else 1
    # one number a leaf
    sizes = np.zeros(tree.leaves, np.int64)
    for leaf, held in members.groupBy("leaf").count().collect():
        sizes[leaf] = held
    shared = spark.sparkContext.broadcast((tree, sizes))

    def visiting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, held = shared.value
            leaves = [own.visit(v, visits, held, k + 1) for v in _matrix(batch.column(1))] if batch.num_rows else []
            rows = pa.array([n for n, found in enumerate(leaves) for _ in found], pa.int64())
            leaf = pa.array([leaf for found in leaves for leaf in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [leaf, batch.column(0).take(rows), batch.column(1).take(rows)], names=["leaf", "query_id", "vector"]
            )

    kind = points.schema["vector"].dataType.simpleString()
    visitors = asked.select("vec_id", "vector").mapInArrow(visiting, f"leaf long, query_id long, vector {kind}")
    visitors = stored(visitors)
    # at most one row a leaf, and the number of leaves is bounded by the fit
    blocks = checkpointed(
        members.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("parts"))
        .join(visitors.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("turns")), "leaf")
    )

    def numbered(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))

    left = (
        visitors.join(F.broadcast(blocks), "leaf")
        .withColumn("turn", F.pmod(F.xxhash64("query_id"), "turns").cast("int"))
        .withColumn("part", numbered("parts"))
    )
    right = (
        members.join(F.broadcast(blocks), "leaf")
        .withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts").cast("int"))
        .withColumn("turn", numbered("turns"))
    )

    def block(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        found = nearest_in(
            queries["query_id"].to_numpy(), np.stack(queries["vector"]).astype(np.float64),
            rows["vec_id"].to_numpy(), np.stack(rows["vector"]).astype(np.float64), k,
        )
        return pd.DataFrame([f[:3] for f in found], columns=["query_id", "vec_id", "score"])

    key = ["leaf", "part", "turn"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(block, "query_id long, vec_id long, score double")
    return nearest_overall(found, k).select("query_id", "rank", "vec_id", "score")
