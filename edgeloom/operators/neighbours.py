"""Exact nearest neighbours of many rows among many points, in cells and blocks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.storage import durable

#: Cells that points are dealt to at most, and points of a cell at which another is worth while.
MOST_CELLS, CELL_POINTS = 256, 2_000
#: Points of a cell, and rows that visit it, that meet in one task.
BLOCK_POINTS, BLOCK_ROWS = 4_000, 4_000
#: Visits that leave a task together.
VISITS = 16_000


def _matrix(column: pa.Array) -> np.ndarray:
    """Float lists of equal length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _gaps(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Euclidean distance of each row to each point."""
    square = (rows * rows).sum(axis=1)[:, None] - 2 * rows @ points.T + (points * points).sum(axis=1)
    return np.sqrt(np.clip(square, 0, None))


def _celled(batches: Iterator[pa.RecordBatch], centres: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(cell, far, point, vec): the nearest centre of each point, and how far it is."""
    for batch in batches:
        if batch.num_rows:
            gaps = _gaps(_matrix(batch.column(1)), centres)
            cell = gaps.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(gaps[np.arange(len(cell)), cell]), *batch.columns], names=["cell", "far", "point", "vec"])


def _visited(batches: Iterator[pa.RecordBatch], centres: np.ndarray, sizes: np.ndarray, radii: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """(cell, row, vec) of every cell that can hold one of a row's k nearest points.

    All points of a cell lie within its radius of its centre. The k-th nearest is no
    farther than the radius beyond the centre of the cell in which the k-th point is
    counted, cells taken by that bound; a cell whose nearest possible point is farther is
    passed over.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        gaps = _gaps(_matrix(batch.column(1)), centres)
        bounds = gaps + radii
        order = bounds.argsort(axis=1)
        counted = np.cumsum(sizes[order], axis=1) >= min(k, sizes.sum())
        most = np.take_along_axis(bounds, order, axis=1)[np.arange(len(gaps)), counted.argmax(axis=1)]
        row, cell = np.nonzero(gaps - radii <= most[:, None] * (1 + 1e-9) + 1e-9)
        for start in range(0, len(row), VISITS):  # a row may visit every cell, and each visit holds its vector
            own = pa.array(row[start : start + VISITS])
            yield pa.RecordBatch.from_arrays([pa.array(cell[start : start + VISITS].astype(np.int32)), *(c.take(own) for c in batch.columns)], names=["cell", "row", "vec"])


def _best(key: tuple, table: pa.Table, k: int) -> pa.Table:
    """The k nearest points of one block of a cell for each row that visits it; equal distances at the end all stay."""
    shape = pa.schema([("row", pa.int64()), ("point", pa.int64()), ("distance", pa.float64())])
    asks = table["asks"].combine_chunks()
    points, rows = table.filter(pa.compute.invert(asks)), table.filter(asks)
    if not points.num_rows or not rows.num_rows:
        return shape.empty_table()
    ids, known = points["id"].to_numpy(), _matrix(points["vec"].combine_chunks())
    names, asked, found = rows["id"].to_numpy(), _matrix(rows["vec"].combine_chunks()), []
    for start in range(0, len(names), 256):
        part = asked[start : start + 256]
        gaps = _gaps(part, known)
        most = np.partition(gaps, k - 1, axis=1)[:, k - 1, None] if len(ids) > k else np.full((len(part), 1), np.inf)
        at, which = np.nonzero(gaps <= most * (1 + 1e-9) + 1e-6)
        # squares added one after the other: a pair is as far apart wherever it meets
        square = np.zeros(len(at))
        for left, right in zip(part.T, known.T, strict=True):
            square += (left[at] - right[which]) ** 2
        found.append((names[start + at], ids[which], np.sqrt(square)))
    return pa.table([np.concatenate(c) for c in zip(*found, strict=True)], schema=shape)


def nearest_points(rows: DataFrame, points: DataFrame, key: Sequence[str], k: int, vector: str = "vector", order: Sequence[str] = (), columns: Sequence[str] = (), prefix: str = "seed_") -> DataFrame:
    """The ``k`` nearest points of every row: key, ``place``, the points' ``columns`` (with ``prefix``) and ``distance``.

    Exact, for any number of rows and points; ties go by the points' ``order`` columns.
    Points are dealt to cells around a few of themselves, chosen by hash; a row is
    compared with the points of those cells only that can hold one of its nearest, block
    by block. Of points with equal vectors the first ``k`` in order are kept, so a vector
    that many share costs as much as any. Null vectors take no part; all vectors must
    have one length, and keys must be unique.
    """
    spark = rows.sparkSession
    shape = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*key).schema), "place int", *(f"`{prefix}{f.name}` {f.dataType.simpleString()}" for f in points.select(*columns).schema), "distance double"])
    extra = list(dict.fromkeys([*order, *columns]))
    copies = F.row_number().over(Window.partitionBy("_vec").orderBy(*order)) if order else F.row_number().over(Window.partitionBy("_vec").orderBy("_vec"))
    known = points.filter(F.col(vector).isNotNull()).select(*extra, F.col(vector).cast("array<double>").alias("_vec")).withColumn("_copy", copies).filter(F.col("_copy") <= k)
    known = durable(known.drop("_copy").withColumn("_point", F.monotonically_increasing_id()), "neighbour-points")
    asked = durable(rows.filter(F.col(vector).isNotNull()).select(*key, F.col(vector).cast("array<double>").alias("_vec")).withColumn("_row", F.monotonically_increasing_id()), "neighbour-rows")
    n = known.count()
    if not n:
        return spark.createDataFrame([], shape)
    chosen = known.select("_vec").distinct().orderBy(F.xxhash64("_vec")).limit(max(1, min(MOST_CELLS, n // CELL_POINTS))).toArrow()
    centres = _matrix(chosen["_vec"].combine_chunks())
    celled = durable(known.select("_point", "_vec").mapInArrow(lambda b: _celled(b, centres), "cell int, far double, id long, vec array<double>"), "neighbour-cells")
    cells = {r["cell"]: r for r in celled.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}
    used = sorted(cells)
    sizes, radii = np.array([cells[c]["n"] for c in used]), np.array([cells[c]["far"] for c in used])
    visits = asked.select("_row", "_vec").mapInArrow(lambda b: _visited(b, centres[used], sizes, radii, k), "cell int, id long, vec array<double>")
    number = F.element_at(F.create_map(*[F.lit(x) for i, c in enumerate(used) for x in (c, i)]), F.col("cell"))
    celled = celled.withColumn("cell", number)
    blocks = F.element_at(F.array(*[F.lit(int(-(-s // BLOCK_POINTS))) for s in sizes]), F.col("cell") + 1)
    every = celled.groupBy("cell").agg(F.first(blocks).alias("n_blocks"))
    counted = visits.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("q_blocks")).join(every, "cell")
    counted = durable(counted, "neighbour-blocks")
    deal = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    spread = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    block = ["cell", "n_block", "q_block"]
    own = celled.join(counted, "cell").withColumn("n_block", deal("n_blocks")).withColumn("q_block", spread("q_blocks")).select(*block, F.lit(False).alias("asks"), "id", "vec")
    ask = visits.join(counted, "cell").withColumn("q_block", deal("q_blocks")).withColumn("n_block", spread("n_blocks")).select(*block, F.lit(True).alias("asks"), "id", "vec")
    met = own.unionByName(ask).groupBy(*block).applyInArrow(lambda name, t: _best(name, t, k), "row long, point long, distance double")
    named = met.join(known.select("_point", *extra), F.col("point") == F.col("_point"))
    place = F.row_number().over(Window.partitionBy("row").orderBy("distance", *order, "point"))
    best = named.withColumn("place", place).filter(F.col("place") <= k)
    return best.select("row", "place", "distance", *[F.col(c).alias(f"{prefix}{c}") for c in columns]).join(asked.select(*key, "_row"), F.col("row") == F.col("_row")).select(*key, "place", *[f"{prefix}{c}" for c in columns], "distance")
