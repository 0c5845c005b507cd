"""Vectors within a small distance of others, in the cells of a k-d tree."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.operators.neighbours import _matrix
from edgeloom.storage import durable

#: Numbers of the sample that a tree is fitted on, sampled vectors of a cell at which it isn't cut further, and cells.
SAMPLE_NUMBERS, CELL_SAMPLE, MOST_CELLS = 4_000_000, 64, 4_096
#: Points of a cell above which it is cut again, and points and rows that meet in one task.
HEAVY, BLOCK = 4_000, 4_000


@dataclass
class KdTree:
    """Cuts of space: at a node, vectors below ``cut`` in component ``axis`` go left; a leaf has axis -1.

    ``low`` and ``high`` are the nodes' children, and a cell's name is its leaf's number.
    """

    width: int
    axis: list[int] = field(default_factory=lambda: [-1])
    cut: list[float] = field(default_factory=lambda: [0.0])
    low: list[int] = field(default_factory=lambda: [0])
    high: list[int] = field(default_factory=lambda: [0])

    def cells(self) -> int:
        return sum(a < 0 for a in self.axis)

    def grow(self, leaf: int, sample: np.ndarray, margin: float, most: int = MOST_CELLS, size: int = CELL_SAMPLE) -> bool:
        """Cut a leaf by the medians of its sample, widest component first; whether it was cut at all.

        A leaf whose vectors lie within four margins of each other in every component stays:
        to cut it would put most of them on both sides of the cut.
        """
        done, todo = False, [(leaf, sample)]
        while todo:
            node, own = todo.pop(0)
            if len(own) <= size and done or len(own) < 2 or self.cells() >= most:
                continue
            spread = own.max(axis=0) - own.min(axis=0)
            axis = int(spread.argmax())
            if not spread[axis] > 4 * margin:
                continue
            values = np.sort(own[:, axis])
            cut = values[len(values) // 2]
            if cut == values[0]:
                cut = values[np.searchsorted(values, cut, "right")]
            left = own[:, axis] < cut
            children = [len(self.axis), len(self.axis) + 1]
            self.axis[node], self.cut[node], self.low[node], self.high[node] = axis, float(cut), *children
            for child, part in zip(children, (own[left], own[~left]), strict=True):
                self.axis.append(-1)
                self.cut.append(0.0)
                self.low.append(child)
                self.high.append(child)
                todo.append((child, part))
            done = True
        return done

    def home(self, vectors: np.ndarray) -> np.ndarray:
        """The cell of each vector."""
        return self._descend(vectors, np.arange(len(vectors)), 0.0)[1]

    def halo(self, vectors: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of every cell that comes within a margin of a vector in each component."""
        return self._descend(vectors, np.arange(len(vectors)), margin)

    def _descend(self, vectors: np.ndarray, rows: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
        axis, cut, low, high = map(np.array, (self.axis, self.cut, self.low, self.high))
        at, ended = np.zeros(len(rows), np.int64), []
        while len(rows):
            leaf = axis[at] < 0
            ended.append((rows[leaf], at[leaf]))
            rows, at = rows[~leaf], at[~leaf]
            value = vectors[rows, axis[at]]
            # a little wider than asked for, so that rounding loses nothing
            wide = margin * (1 + 1e-9) + 4e-16 * np.abs(value) if margin else 0.0
            left = value - wide < cut[at]
            right = value + wide >= cut[at]
            rows, at = np.concatenate([rows[left], rows[right]]), np.concatenate([low[at[left]], high[at[right]]])
        rows, at = (np.concatenate(parts) for parts in zip(*ended, strict=True)) if ended else (rows, at)
        order = np.argsort(rows, kind="stable")
        return rows[order], at[order]


def _placed(batches: Iterator[pa.RecordBatch], tree: KdTree, margin: float) -> Iterator[pa.RecordBatch]:
    """(cell, vec) of the cells of each vector: all within the margin."""
    for batch in batches:
        if batch.num_rows:
            rows, cells = tree.halo(_matrix(batch.column(0)), margin)
            yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), batch.column(0).take(pa.array(rows))], names=["cell", "vec"])


def _sampled(vectors: DataFrame, width: int, n: int) -> np.ndarray:
    """About so many vectors as ``SAMPLE_NUMBERS`` allows, chosen by hash."""
    share = min(1.0, SAMPLE_NUMBERS / max(1, width) / max(1, n))
    chosen = vectors.filter(F.pmod(F.xxhash64("vec", F.lit(7)), F.lit(1_000_003)) < int(np.ceil(share * 1_000_003))).select("vec").toArrow()
    return _matrix(chosen["vec"].combine_chunks()) if chosen.num_rows else np.empty((0, width))


def fit_cells(points: DataFrame, width: int, margin: float, heavy: int = HEAVY) -> KdTree:
    """A tree whose cells hold about ``heavy`` of the points (``vec``) at most, if they can be told apart.

    It is fitted on a bounded sample of them; then cells are counted over all points, with
    those that a margin brings in, and the heavy ones are cut again by samples of their
    own, until none is or none can be cut.
    """
    tree, n = KdTree(width), points.count()
    tree.grow(0, _sampled(points, width, n), margin, size=max(CELL_SAMPLE, 1))
    done: set[int] = set()
    while tree.cells() < MOST_CELLS:
        placed = durable(points.mapInArrow(lambda b: _placed(b, tree, margin), "cell int, vec array<double>"), "cells-counted")  # noqa: B023
        counts = placed.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > heavy)
        large = {r["cell"]: r["n"] for r in counts.collect() if r["cell"] not in done}  # a row for each cell
        if not large:
            break
        own = placed.filter(F.col("cell").isin(list(large)))
        total = sum(large.values())
        share = min(1.0, SAMPLE_NUMBERS / width / total)
        sample = own.filter(F.pmod(F.xxhash64("vec", F.lit(len(tree.axis))), F.lit(1_000_003)) < int(np.ceil(share * 1_000_003))).toArrow()
        cells, vectors = sample["cell"].to_numpy(), _matrix(sample["vec"].combine_chunks()) if sample.num_rows else np.empty((0, width))
        for cell in large:
            if not tree.grow(cell, vectors[cells == cell], margin):
                done.add(cell)
    return tree


def _near(_: tuple, table: pa.Table, epsilon: float) -> pa.Table:
    """The vectors of a block of rows that lie within ``epsilon`` of a point of a block of points."""
    shape = pa.schema([("vec", pa.list_(pa.float64()))])
    asks = table["asks"].combine_chunks()
    rows, points = table.filter(asks), table.filter(pa.compute.invert(asks))
    if not rows.num_rows or not points.num_rows:
        return shape.empty_table()
    vectors = rows["vec"].combine_chunks()
    asked, known = _matrix(vectors), _matrix(points["vec"].combine_chunks())
    lengths = (known * known).sum(axis=1)
    hit = np.zeros(len(asked), bool)
    for start in range(0, len(asked), 512):
        part = asked[start : start + 512]
        own = (part * part).sum(axis=1)[:, None]
        # products of large numbers are rough: what they leave possible is measured component by component
        at, which = np.nonzero(own - 2 * part @ known.T + lengths <= epsilon * epsilon + 1e-12 * (own + lengths))
        square = np.zeros(len(at))
        for left, right in zip(part.T, known.T, strict=True):
            square += (left[at] - right[which]) ** 2
        hit[start + at[square <= epsilon * epsilon]] = True
    return pa.table([vectors.filter(pa.array(hit))], schema=shape)


def vectors_near(rows: DataFrame, points: DataFrame, epsilon: float, vector: str = "vector", heavy: int = HEAVY) -> DataFrame:
    """Distinct vectors ``vec`` of ``rows`` within ``epsilon`` (Euclidean) of a vector of ``points``. Exact.

    Both sides count each vector once. A k-d tree of the points' cells is fitted; a row
    goes to the cell that it lies in, a point to all cells within ``epsilon`` of it (halo),
    so a pair meets in exactly one cell. What is left of heavy cells, vectors that lie too
    near each other to be cut apart, is dealt in blocks of points and rows.

    The points must have one length; rows of another length, or null, aren't near any.
    """
    spark = rows.sparkSession
    known = durable(points.filter(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("vec")).distinct(), "near-points")
    first = known.select(F.size("vec").alias("n")).first()
    if first is None:
        return spark.createDataFrame([], "vec array<double>")
    width = first["n"]
    asked = durable(rows.filter(F.size(vector) == width).select(F.col(vector).cast("array<double>").alias("vec")).distinct(), "near-rows")
    tree = fit_cells(known, width, epsilon, heavy) if width else KdTree(0)
    shape = "cell int, vec array<double>"
    own = durable(known.mapInArrow(lambda b: _placed(b, tree, epsilon), shape), "near-cells")
    ask = durable(asked.mapInArrow(lambda b: _placed(b, tree, 0.0), shape), "near-asked")
    blocks = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    counted = durable(blocks(own, "n_blocks").join(blocks(ask, "q_blocks"), "cell"), "near-blocks")
    deal = lambda n: F.pmod(F.xxhash64("vec"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # a row for each cell: at most MOST_CELLS of them
    held = own.join(F.broadcast(counted), "cell").withColumn("n", deal("n_blocks")).withColumn("q", every("q_blocks")).select("cell", "n", "q", F.lit(False).alias("asks"), "vec")
    asks = ask.join(F.broadcast(counted), "cell").withColumn("q", deal("q_blocks")).withColumn("n", every("n_blocks")).select("cell", "n", "q", F.lit(True).alias("asks"), "vec")
    return held.unionByName(asks).groupBy("cell", "n", "q").applyInArrow(lambda name, t: _near(name, t, epsilon), "vec array<double>").distinct()
