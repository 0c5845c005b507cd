"""Density clusters: vectors with many others near them, and what these reach."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.operators.cells import BLOCK, HEAVY, KdTree, fit_cells
from edgeloom.operators.components import linked_components
from edgeloom.operators.neighbours import _matrix
from edgeloom.operators.ranks import ordered_rank
from edgeloom.storage import durable

NOISE = -1


def _celled(batches: Iterator[pa.RecordBatch], tree: KdTree, margin: float) -> Iterator[pa.RecordBatch]:
    """(cell, home, others of the row, vec): each vector in all cells within the margin; ``home``: the one it lies in."""
    for batch in batches:
        if batch.num_rows:
            vectors = _matrix(batch.column("vec"))
            rows, cells = tree.halo(vectors, margin)
            taken = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(cells == tree.home(vectors)[rows]), *taken.columns], names=["cell", "home", *batch.schema.names])


def _near_pairs(asked: np.ndarray, known: np.ndarray, epsilon: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row, point, square) of all pairs within ``epsilon``, some rows at a time; exact, whichever side a vector is on."""
    lengths = (known * known).sum(axis=1)
    for start in range(0, len(asked), 256):
        part = asked[start : start + 256]
        own = (part * part).sum(axis=1)[:, None]
        at, which = np.nonzero(own - 2 * part @ known.T + lengths <= epsilon * epsilon + 1e-12 * (own + lengths))
        square = np.zeros(len(at))
        for left, right in zip(part.T, known.T, strict=True):
            square += (left[at] - right[which]) ** 2
        near = square <= epsilon * epsilon
        yield start, at[near], which[near], square[near]


def _counted(_: tuple, table: pa.Table, epsilon: float) -> pa.Table:
    """(point, near): how many rows lie within ``epsilon`` of each asking vector of a block."""
    shape = pa.schema([("point", pa.int64()), ("near", pa.int64())])
    asks, holds = (table.filter(pa.compute.equal(table["asks"], x)) for x in (True, False))
    if not asks.num_rows or not holds.num_rows:
        return shape.empty_table()
    weights, near = holds["n"].to_numpy(), np.zeros(asks.num_rows, np.int64)
    for start, at, which, _ in _near_pairs(_matrix(asks["vec"].combine_chunks()), _matrix(holds["vec"].combine_chunks()), epsilon):
        near += np.bincount(start + at, weights[which], len(near)).astype(np.int64)
    return pa.table([asks["point"].combine_chunks(), pa.array(near)], schema=shape)


def _linked(_: tuple, table: pa.Table, epsilon: float) -> pa.Table:
    """What a block says about its asking vectors: ``src``, ``dst``, and the square of their distance.

    A core vector is linked to the least core vector near it and, where the ranges of two
    of them only touch, to those that the least one doesn't reach itself; another vector
    to its nearest core vector, ties to the smaller.
    """
    shape = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("core", pa.bool_()), ("square", pa.float64())])
    asks, holds = (table.filter(pa.compute.equal(table["asks"], x)) for x in (True, False))
    holds = holds.filter(holds["core"]).sort_by("point")
    if not asks.num_rows or not holds.num_rows:
        return shape.empty_table()
    ids, names, core = asks["point"].to_numpy(), holds["point"].to_numpy(), asks["core"].to_numpy(zero_copy_only=False)
    # each core vector of the block stands for the group of those that were found to be linked so far
    group = np.arange(len(names))
    place = {int(x): i for i, x in enumerate(names)}
    links: dict[tuple[int, int], float] = {}
    nearest: list[tuple[int, int, float]] = []

    def root(i: int) -> int:
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    for start, at, which, square in _near_pairs(_matrix(asks["vec"].combine_chunks()), _matrix(holds["vec"].combine_chunks()), epsilon):
        order = np.lexsort((which, square, at))
        at, which, square = start + at[order], which[order], square[order]
        ends = np.flatnonzero(np.append(np.diff(at) != 0, True)) + 1 if len(at) else []
        begin = 0
        for end in ends:
            row, own = at[begin], which[begin:end]
            if not core[row]:
                nearest.append((int(ids[row]), int(names[own[0]]), float(square[begin])))
            else:
                mine = place.get(int(ids[row]))
                base = root(mine) if mine is not None else root(int(own[0]))
                if mine is None:
                    links[int(ids[row]), int(names[base])] = 0.0
                for other in np.unique([root(int(i)) for i in np.unique(group[own])]):
                    if (far := root(int(other))) != base:
                        low, high = min(far, base), max(far, base)
                        group[high] = base = low
                        links[int(names[high]), int(names[low])] = 0.0
            begin = end
    found = [(a, b, True, s) for (a, b), s in links.items()] + [(a, b, False, s) for a, b, s in nearest]
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), shape, strict=True)], schema=shape) if found else shape.empty_table()


def density_clusters(rows: DataFrame, epsilon: float, vector: str = "vector", min_points: int = 5, min_size: int = 5, heavy: int = HEAVY) -> DataFrame:
    """``rows`` with ``cluster_id``: groups of vectors that are dense, -1 for noise.

    A vector is a core vector if ``min_points`` rows, itself included, lie within
    ``epsilon`` of it (Euclidean). Core vectors within ``epsilon`` of each other, and what
    they reach in steps, are a cluster; another row within ``epsilon`` of a core vector
    belongs to the nearest one's, ties to the smaller vector. Clusters of fewer than
    ``min_size`` rows, and all else, are noise. This is the level ``epsilon`` of the
    density hierarchy. The id of a cluster is a hash of its least core vector.

    Equal vectors count as often as they occur and are compared once. Vectors meet in the
    cells of a k-d tree (see ``cells``), where each has all its neighbours; blocks of a
    cell say which core vectors hang together by few links, not by all pairs, and the
    links of all cells make components. Exact. Null vectors are noise; all others must have
    one length.
    """
    known = rows.filter(F.col(vector).isNotNull()).groupBy(F.col(vector).cast("array<double>").alias("vec")).agg(F.count("*").alias("n"))
    first = known.select(F.size("vec").alias("w")).first()
    if first is None:
        return rows.withColumn("cluster_id", F.lit(NOISE).cast("long"))
    points = durable(ordered_rank(known, [], [F.col("vec")], "point"), "density-points")  # numbered in the order of the vectors
    tree = fit_cells(points.select("vec"), first["w"], epsilon, heavy)
    shape = "cell int, home boolean, point long, n long, vec array<double>"
    placed = durable(points.select("point", "n", "vec").mapInArrow(lambda b: _celled(b, tree, epsilon), shape), "density-cells")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("k_blocks"), F.ceil(F.count_if("home") / BLOCK).cast("int").alias("q_blocks")).filter("q_blocks > 0")
    sizes = durable(sizes, "density-sizes")

    def met(staged: DataFrame, more: list[str]):
        """Blocks of vectors of a cell, and blocks of those at home in it that ask about them."""
        dealt = staged.join(F.broadcast(sizes), "cell")  # a row for each cell
        deal = lambda n: F.pmod(F.xxhash64("point"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        held = dealt.withColumn("k", deal("k_blocks")).withColumn("q", every("q_blocks")).withColumn("asks", F.lit(False))
        asks = dealt.filter("home").withColumn("q", deal("q_blocks")).withColumn("k", every("k_blocks")).withColumn("asks", F.lit(True))
        columns = ["cell", "k", "q", "asks", "point", "n", "vec", *more]
        return held.select(columns).unionByName(asks.select(columns)).groupBy("cell", "k", "q")

    counts = met(placed, []).applyInArrow(lambda name, t: _counted(name, t, epsilon), "point long, near long").groupBy("point").agg((F.sum("near") >= min_points).alias("core"))
    counts = durable(counts, "density-core")
    links = met(placed.join(counts, "point"), ["core"]).applyInArrow(lambda name, t: _linked(name, t, epsilon), "src long, dst long, core boolean, square double")
    links = durable(links, "density-links")
    found = linked_components(links.filter("core").select("src", "dst"))
    cores = durable(counts.filter("core").join(found, F.col("point") == F.col("node"), "left").select("point", F.coalesce("component", "point").alias("of")), "density-cores")
    reach = links.filter("not core").groupBy("src").agg(F.min_by("dst", F.struct("square", "dst")).alias("dst"))
    joined = reach.join(cores.select(F.col("point").alias("dst"), "of"), "dst").select(F.col("src").alias("point"), "of")
    members = durable(cores.unionByName(joined).join(points.select("point", "n", "vec"), "point"), "density-members")
    large = members.groupBy("of").agg(F.sum("n").alias("rows")).filter(F.col("rows") >= min_size)
    named = large.join(points.select("point", "vec"), F.col("of") == F.col("point")).select("of", F.xxhash64("vec").bitwiseAND(F.lit((1 << 63) - 1)).alias("_id"))
    marked = members.join(named, "of").select(F.col("vec").alias("_vec"), "_id")
    joined = rows.join(marked, F.col(vector).cast("array<double>") == F.col("_vec"), "left")
    return joined.withColumn("cluster_id", F.coalesce("_id", F.lit(NOISE).cast("long"))).drop("_vec", "_id")

