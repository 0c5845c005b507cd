"""Nearest neighbours by inner product: a forest of random-projection trees searched through one priority queue."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgeloom.llm.common import durable

NEIGHBOURS = 20
QUERY_STEP = 20
TREES, LEAF_ROWS, SEED = 8, 256, 42
#: Rows that the trees are fitted on at most; all rows are indexed.
MAX_SAMPLE = 40_000
#: Leaves that a query visits over all trees together: the share of them that brings ``RECALL`` of the neighbours of ``TRIALS`` sample points, and ``LEAST_VISITS`` if that is more.
RECALL, TRIALS, LEAST_VISITS = 0.97, 48, 200
#: Rows of one leaf, and queries that visit one leaf, that meet in one task; larger leaves are dealt in blocks.
BLOCK_ROWS, BLOCK_QUERIES = 8_192, 2_048
#: Visits that a task writes at once.
VISIT_ROWS = 51_200


@dataclass(frozen=True)
class Forest:
    """Complete trees of equal depth: ``planes[tree, node]`` with ``cuts[tree, node]``, nodes as in a heap from 1."""

    planes: np.ndarray
    cuts: np.ndarray
    depth: int

    def leaves(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point in each tree."""
        node = np.ones((len(points), len(self.planes)), np.int64)
        for _ in range(self.depth):
            for t in range(len(self.planes)):
                margin = np.einsum("pd,pd->p", points, self.planes[t][node[:, t]]) - self.cuts[t][node[:, t]]
                node[:, t] = 2 * node[:, t] + (margin > 0)
        return node

    @property
    def size(self) -> int:
        """Leaves of all trees."""
        return len(self.planes) << self.depth

    def visits(self, point: np.ndarray, most: int) -> list[tuple[int, int]]:
        """The most promising (tree, leaf) pairs: all trees share a queue ordered by the least margin on the way."""
        margins = self.planes @ point - self.cuts
        queue = [(-math.inf, t, 1) for t in range(len(self.planes))]
        found: list[tuple[int, int]] = []
        first_leaf = 1 << self.depth
        while queue and len(found) < most:
            worst, tree, node = heapq.heappop(queue)
            if node >= first_leaf:
                found.append((tree, node))
                continue
            margin = float(margins[tree, node])
            heapq.heappush(queue, (max(worst, margin), tree, 2 * node))
            heapq.heappush(queue, (max(worst, -margin), tree, 2 * node + 1))
        return found


def fit_forest(sample: np.ndarray, rows: int, trees: int = TREES, leaf_rows: int = LEAF_ROWS, seed: int = SEED) -> Forest:
    """Trees on a sample of the points, deep enough for ``rows`` points.

    A node's plane lies between the means of two groups that two random points of the
    node gather (a few rounds of 2-means), cut at the median. Below a node with few
    sample points planes are random through it, so that every depth splits all points.
    """
    width = sample.shape[1]
    depth = max(0, min(math.ceil(math.log2(max(1, rows / leaf_rows))), int(math.log2(max(1, len(sample) / 8)))))
    rng = np.random.default_rng(seed)
    planes, cuts = np.zeros((trees, 1 << depth, width), np.float32), np.zeros((trees, 1 << depth), np.float32)
    for t in range(trees):
        inside = {1: np.arange(len(sample))}
        for node in range(1, 1 << depth):
            own = inside.pop(node, np.zeros(0, np.int64))
            points = sample[own]
            direction = rng.normal(size=width)
            if len(own) >= 2:
                a, b = points[rng.choice(len(own), 2, replace=False)].astype(np.float64)
                near = points[rng.choice(len(own), min(len(own), 400), replace=False)]
                for _ in range(4):
                    side = near @ (b - a) > (b @ b - a @ a) / 2
                    if side.all() or not side.any():
                        break
                    a, b = near[~side].mean(axis=0), near[side].mean(axis=0)
                if np.abs(b - a).max() > 1e-9:
                    direction = b - a
            direction /= np.linalg.norm(direction)
            at = points @ direction
            cut = float(np.median(at)) if len(own) else 0.0
            planes[t, node], cuts[t, node] = direction, cut
            right = (points @ planes[t, node] - cuts[t, node]) > 0
            inside[2 * node], inside[2 * node + 1] = own[~right], own[right]
    return Forest(planes, cuts, depth)


def lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with one more component that makes them equally long, so that the largest inner product is the least angle."""
    scaled = vectors / longest
    rest = np.sqrt(np.clip(1 - np.einsum("ij,ij->i", scaled, scaled), 0, None))
    return np.column_stack([scaled, rest]).astype(np.float32)


def visits_needed(forest: Forest, sample: np.ndarray, longest: float, k: int, recall: float = RECALL, trials: int = TRIALS) -> int:
    """Leaves that a query must visit so that this share of its neighbours lies in one of them.

    Measured on the sample: of some of its points the ``k`` nearest of the sample are
    found by looking at all, and how many visits it takes until each lies in a visited
    leaf. As a share of all leaves this holds on the whole table, whose nearest are nearer
    than the sample's. So data with structure is searched in few leaves, data without any
    in many, and recall doesn't depend on the number of rows.
    """
    if len(sample) <= k + 1 or forest.size <= LEAST_VISITS:
        return forest.size
    placed = forest.leaves(lifted(sample, longest))
    taken: list[int] = []
    for q in np.linspace(0, len(sample) - 1, min(trials, len(sample))).astype(int):
        scores = sample @ sample[q]
        scores[q] = -np.inf
        nearest_rows = np.argpartition(-scores, k - 1)[:k]
        direction = sample[q] / np.linalg.norm(sample[q])
        turn = np.full((len(forest.planes), 1 << forest.depth), forest.size)
        for i, (tree, leaf) in enumerate(forest.visits(np.append(direction, 0.0), forest.size)):
            turn[tree, leaf - (1 << forest.depth)] = i
        own = placed[nearest_rows] - (1 << forest.depth)
        taken += turn[np.arange(len(forest.planes)), own].min(axis=1).tolist()
    return max(LEAST_VISITS, sorted(taken)[math.ceil(recall * len(taken)) - 1] + 1)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a column of float lists as a matrix."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)


def _placed(batches: Iterator[pa.RecordBatch], forest: Forest, longest: float, width: int) -> Iterator[pa.RecordBatch]:
    """(tree, leaf, node, vec) of every vector in every tree."""
    for batch in batches:
        leaves = forest.leaves(lifted(_matrix(batch.column(1), width), longest)) if batch.num_rows else np.zeros((0, len(forest.planes)))
        for t in range(len(forest.planes)):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, t), pa.int32()), pa.array(leaves[:, t].astype(np.int32)), *batch.columns], names=["tree", "leaf", "node", "vec"])


def _visited(batches: Iterator[pa.RecordBatch], forest: Forest, width: int, most: int) -> Iterator[pa.RecordBatch]:
    """(tree, leaf, node, vec) of every leaf that a query visits."""
    for whole in batches:
        step = max(1, VISIT_ROWS // most)
        for start in range(0, whole.num_rows, step):
            batch = whole.slice(start, step)
            points = _matrix(batch.column(1), width)
            points = points / np.linalg.norm(points, axis=1, keepdims=True)
            places = [forest.visits(p, most) for p in np.column_stack([points, np.zeros(len(points))])]
            row = np.repeat(np.arange(len(places)), [len(p) for p in places])
            tree, leaf = (pa.array([x[i] for p in places for x in p], pa.int32()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([tree, leaf, *(c.take(pa.array(row)) for c in batch.columns)], names=["tree", "leaf", "node", "vec"])


def _best(key: tuple, rows: pa.Table, width: int, most: int) -> pa.Table:
    """The best ``most`` vectors of one block of a leaf for each query that visits it."""
    asks = rows["asks"].combine_chunks()
    own, queries = rows.filter(pa.compute.invert(asks)), rows.filter(asks)
    shape = pa.schema([("query", pa.int64()), ("node", pa.int64()), ("score", pa.float64())])
    if not own.num_rows or not queries.num_rows:
        return shape.empty_table()
    ids, points = own["node"].to_numpy(), _matrix(own["vec"].combine_chunks(), width)
    order = np.argsort(ids)
    ids, points = ids[order], points[order]
    names, asked, found = queries["node"].to_numpy(), _matrix(queries["vec"].combine_chunks(), width), []
    for start in range(0, len(names), 256):
        part = asked[start : start + 256]
        scores = part @ points.T
        least = np.partition(scores, -most, axis=1)[:, -most, None] if len(ids) > most else np.full((len(scores), 1), -np.inf)
        at, which = np.nonzero(scores >= least - 1e-9 * np.abs(least))
        # products added one after the other: a pair has the same score wherever it meets, and equal ones stay equal
        exact = np.zeros(len(at))
        for left, right in zip(part.T, points.T, strict=True):
            exact += left[at] * right[which]
        found.append((names[start + at], ids[which], exact))
    return pa.table([np.concatenate(c) for c in zip(*found, strict=True)], schema=shape)


def nearest(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", query_step: int = QUERY_STEP, k: int = NEIGHBOURS, trees: int = TREES, visits: int | None = None, max_sample: int = MAX_SAMPLE) -> DataFrame:
    """The ``k`` rows of largest inner product found for every row whose id is divisible by ``query_step``.

    Columns ``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` (double precision on the
    original vectors); ties go to the smaller id, and a row never finds its own id.

    Equal vectors are one point of the index with the ``k + 1`` smallest of their ids: no
    other row of that vector can be among a query's ``k`` best, so a vector that a third
    of all rows share costs as much as any. Trees are fitted on at most ``max_sample``
    points, and every point is placed in every tree. A query visits ``visits`` leaves
    over all trees (if None, as many as ``visits_needed`` finds); leaves larger than
    ``BLOCK_ROWS`` and those visited by more than ``BLOCK_QUERIES`` queries are dealt in
    blocks. With 4,096 points or fewer all leaves are visited and the result is exact. Trees are no
    deeper than the sample allows, so beyond it leaves grow with the table.

    Rows take no part whose id or vector is null, whose vector is zero, holds a null or a
    number that isn't finite, or has another length than most. Repeated rows count once.
    An empty table gives an empty one. Other columns aren't read.
    """
    spark = vectors.sparkSession
    whole = F.transform(embedding, lambda x: x.cast("double"))
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), whole.alias("vec")).filter(
        F.col("id").isNotNull() & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    )
    lengths = rows.groupBy(F.size("vec").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("n")).first()
    result = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return spark.createDataFrame([], result)
    width = lengths["n"]
    rows = durable(rows.filter(F.size("vec") == width).distinct(), "forest-rows")
    few = rows.withColumn("r", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).filter(F.col("r") <= k + 1)
    points = few.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("node"), "vec", "ids")
    points = durable(points, "forest-points")
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    size = points.agg(F.count("*").alias("n"), F.max(norm).alias("longest")).first()
    share = F.pmod(F.xxhash64("node"), F.lit(1_000_003)) < math.ceil(min(1.0, max_sample / size["n"]) * 1_000_003)
    sample = points.filter(share).select("node", "vec").orderBy("node").toArrow()
    longest = size["longest"]
    known = _matrix(sample["vec"].combine_chunks(), width) if sample.num_rows else np.zeros((0, width))
    forest = fit_forest(lifted(known, longest) if sample.num_rows else np.zeros((0, width + 1), np.float32), size["n"], trees)
    most = visits or visits_needed(forest, known, longest, k)

    asked = rows.filter(F.col("id") % query_step == 0).join(points.select("vec", "node"), "vec").select(F.col("id").alias("query_id"), "node")
    asked = durable(asked, "forest-asked")
    shape = "tree int, leaf int, node long, vec array<double>"
    index = points.select("node", "vec").mapInArrow(lambda b: _placed(b, forest, longest, width), shape)
    queries = points.select("node", "vec").join(asked.select("node").distinct(), "node").select("node", "vec").mapInArrow(lambda b: _visited(b, forest, width, most), shape)
    cells = index.groupBy("tree", "leaf").agg(F.count("*").alias("n")).join(queries.groupBy("tree", "leaf").agg(F.count("*").alias("q")), ["tree", "leaf"])
    cells = durable(cells.select("tree", "leaf", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("n_blocks"), F.ceil(F.col("q") / BLOCK_QUERIES).cast("int").alias("q_blocks")), "forest-cells")
    deal = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = index.join(cells, ["tree", "leaf"]).withColumn("n_block", deal("n_blocks")).withColumn("q_block", every("q_blocks"))
    ask = queries.join(cells, ["tree", "leaf"]).withColumn("q_block", deal("q_blocks")).withColumn("n_block", every("n_blocks"))
    key = ["tree", "leaf", "n_block", "q_block"]
    both = own.select(*key, F.lit(False).alias("asks"), "node", "vec").unionByName(ask.select(*key, F.lit(True).alias("asks"), "node", "vec"))
    met = both.groupBy(*key).applyInArrow(lambda name, t: _best(name, t, width, k + 1), "query long, node long, score double")
    met = met.groupBy("query", "node").agg(F.max("score").alias("score"))
    best = met.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "node"))).filter(F.col("r") <= k + 1)
    ids = best.join(points.select("node", "ids"), "node").select("query", "score", F.explode("ids").alias("vec_id"))
    ids = ids.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).filter(F.col("r") <= k + 1)
    lists = ids.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("found"))
    answers = asked.join(lists, F.col("node") == F.col("query")).select("query_id", F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("found"))
    return answers.select("query_id", F.posexplode("found").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def op4_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every query row, over the whole table."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: All pairs: on the given tables every leaf is visited, so the search is exact there. Products are added in order, as the query adds them.
OP4_SQL = """
WITH vecs AS (
  SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = (SELECT len(embedding) FROM embeddings WHERE embedding IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1)
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip(q.v, c.v), lambda x: x[1] * x[2])), lambda a, b: a + b) AS score
  FROM vecs q JOIN vecs c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM pairs QUALIFY rank <= 20
"""
