"""Hierarchical density clusters: a spanning tree of mutual reachability, condensed, with the most stable clusters."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.operators.components import linked_components
from edgeloom.operators.neighbours import BLOCK_POINTS, CELL_POINTS, MOST_CELLS, VISITS, _celled, _gaps, _matrix, nearest_points
from edgeloom.operators.ranks import ordered_rank
from edgeloom.storage import durable

NOISE = -1
#: Distances below this count as this much, so that copies have a finite density.
LEAST_DISTANCE = 1e-9
#: Groups from which clusters grow that the last step takes at most; there can be one for each ``min_size`` rows.
MOST_GROUPS = 2_000_000
EDGE = "w double, lo long, hi long"


def density_points(rows: DataFrame, vector: str, min_samples: int) -> DataFrame:
    """Distinct vectors: ``point`` (a number in their order), ``n`` (rows), ``vec`` and ``core``, the distance to the ``min_samples``-th other row; to the farthest if there are fewer."""
    known = rows.filter(F.col(vector).isNotNull()).groupBy(F.col(vector).cast("array<double>").alias("vec")).agg(F.count("*").alias("n"))
    points = durable(ordered_rank(known, [], [F.col("vec")], "point").withColumn("point", F.col("point").cast("long")), "hierarchy-points")
    others = points.select(F.col("point").alias("other"), "n", "vec")
    near = nearest_points(points.select("point", "vec"), others, ["point"], min_samples + 1, "vec", order=["other"], columns=["n"], prefix="to_")
    so_far = F.sum("to_n").over(Window.partitionBy("point").orderBy("place"))
    reached = near.withColumn("_rows", so_far - 1).groupBy("point").agg(F.coalesce(F.min(F.when(F.col("_rows") >= min_samples, F.col("distance"))), F.max("distance")).alias("core"))
    return durable(points.join(reached, "point"), "hierarchy-points")


def _filling(cells: list, centres: np.ndarray) -> dict[int, float]:
    """For each component that fills cells by itself an upper bound of its least edge out: the way to the nearest point of another cell that holds another component."""
    at = centres[[c["cell"] for c in cells]]
    far, core = np.array([c["far"] for c in cells]), np.array([c["core"] for c in cells])
    low, high = np.array([c["low"] for c in cells]), np.array([c["high"] for c in cells])
    alone = np.nonzero(low == high)[0]
    differs = (low != high)[None, :] | (low[alone, None] != low[None, :])
    upper = np.maximum(np.maximum(core[alone, None], core[None, :]), _gaps(at[alone], at) + far[alone, None] + far[None, :])
    bounds = np.where(differs, upper, np.inf).min(axis=1) + _slack(at)
    return {int(c): float(bounds[low[alone] == c].min()) for c in np.unique(low[alone])}


def _slack(*vectors: np.ndarray) -> float:
    """More than rounding can move a distance that is made of squares and products."""
    return 1e-9 + 1e-6 * max(float(np.abs(v).max(initial=0)) * v.shape[1] ** 0.5 for v in vectors)


def _in_reach(batches: Iterator[pa.RecordBatch], centres: np.ndarray, far: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(cell, point, comp, core, vec): each point with the other cells that may hold a point within its bound.

    All points of a cell lie within ``far`` of its centre, and on that centre's side of
    the plane between it and the centre of the asking point's cell. ``own``: the component
    that fills a cell by itself, else -1; its points don't ask there.
    """
    apart = _gaps(centres, centres)
    for whole in batches:
        for start in range(0, whole.num_rows, 2_000):
            batch = whole.slice(start, 2_000)
            cell, comp, bound = (batch.column(i).to_numpy() for i in (0, 2, 5))
            vectors = _matrix(batch.column(4))
            gaps, slack = _gaps(vectors, centres), _slack(vectors, centres)
            between = np.maximum(apart[cell], 1e-300)
            beyond = (gaps**2 - gaps[np.arange(len(cell)), cell][:, None] ** 2 - slack**2) / (2 * between)
            near = (np.maximum(gaps - far, beyond) - slack <= bound[:, None]) & (own[None, :] != comp[:, None])
            near[np.arange(len(cell)), cell] = False
            row, to = np.nonzero(near)
            for at in range(0, len(row), VISITS):
                taken = pa.array(row[at : at + VISITS])
                yield pa.RecordBatch.from_arrays([pa.array(to[at : at + VISITS].astype(np.int32)), *(batch.column(i).take(taken) for i in (1, 2, 3, 4))], names=["cell", "point", "comp", "core", "vec"])


def _least_out(_: tuple, table: pa.Table) -> pa.Table:
    """(comp, w, lo, hi, other): of two blocks, the least edge from each component to another."""
    shape = pa.schema([("comp", pa.int64()), ("w", pa.float64()), ("lo", pa.int64()), ("hi", pa.int64()), ("other", pa.int64())])
    left, right = (table.filter(pa.compute.equal(table["first"], x)) for x in (True, False))
    if not left.num_rows or not right.num_rows:
        return shape.empty_table()
    ids, comps, cores = ([t[c].to_numpy() for t in (left, right)] for c in ("point", "comp", "core"))
    vectors = [_matrix(t["vec"].combine_chunks()) for t in (left, right)]
    found = []
    for start in range(0, len(ids[0]), 256):
        part = slice(start, start + 256)
        square = np.zeros((len(ids[0][part]), len(ids[1])))
        for a, b in zip(vectors[0][part].T, vectors[1].T, strict=True):
            square += (a[:, None] - b[None, :]) ** 2
        w = np.maximum(np.sqrt(square), np.maximum(cores[0][part][:, None], cores[1][None, :]))
        w[comps[0][part][:, None] == comps[1][None, :]] = np.inf
        for side in (0, 1):
            least = w.min(axis=1 - side, keepdims=True)
            row, column = np.nonzero((w == least) & np.isfinite(w))
            x, y = ids[0][start + row], ids[1][column]
            of, to = comps[0][start + row], comps[1][column]
            of, to = (of, to) if side == 0 else (to, of)
            lo, hi, weight = np.minimum(x, y), np.maximum(x, y), w[row, column]
            order = np.lexsort((hi, lo, weight, of))
            order = order[np.append(True, np.diff(of[order]) != 0)] if len(order) else order
            found.append([c[order] for c in (of, weight, lo, hi, to)])
    columns = [np.concatenate(c) for c in zip(*found, strict=True)]
    order = np.lexsort((columns[3], columns[2], columns[1], columns[0]))
    order = order[np.append(True, np.diff(columns[0][order]) != 0)] if len(order) else order
    return pa.table([c[order] for c in columns], schema=shape)


def _least_edges(left: DataFrame, right: DataFrame, blocks: dict[int, tuple[int, int]], same: bool) -> DataFrame:
    """``comp``, ``e``: the least edge out of each component between points of ``left`` and ``right`` in one cell. ``blocks``: in how many blocks each cell's points meet; ``same``: both sides are the same points."""
    met = left.sparkSession.createDataFrame([(c, i, j) for c, (m, n) in blocks.items() for i in range(m) for j in range(n) if not same or i <= j], "_cell int, i int, j int")
    sides = []
    for side, rows, block in ((0, left, "i"), (1, right, "j")):
        sizes = rows.sparkSession.createDataFrame([(c, b[side]) for c, b in blocks.items()], "_at int, _blocks int")
        dealt = rows.join(F.broadcast(sizes), F.col("cell") == F.col("_at")).withColumn("_block", F.pmod(F.xxhash64("point"), F.col("_blocks")).cast("int"))  # at most MOST_CELLS
        sides.append(dealt.join(met, (F.col("cell") == F.col("_cell")) & (F.col("_block") == F.col(block))).select("_cell", "i", "j", F.lit(side == 0).alias("first"), "point", "comp", "core", "vec"))
    out = sides[0].unionByName(sides[1]).groupBy("_cell", "i", "j").applyInArrow(_least_out, "comp long, w double, lo long, hi long, other long")
    return out.groupBy("comp").agg(F.min(F.struct("w", "lo", "hi", "other")).alias("e"))


def spanning_tree(points: DataFrame) -> DataFrame:
    """``w``, ``lo``, ``hi``: the edges of the least spanning tree of ``point``, ``vec``, ``core`` under mutual reachability, the greater of a distance and both cores. Exact; equal weights go by the ends.

    Rounds: each component takes its least edge out, and components that edges join are
    one from then on. Points lie in cells around some of them. First the points of a cell
    of several components meet; the least edge found there bounds that of its component.
    Then only points whose core distance is within the bound meet those of other cells,
    and only of cells that reach into it.
    """
    spark = points.sparkSession
    n = points.count()
    edges = spark.createDataFrame([], EDGE)
    if n < 2:
        return edges
    chosen = points.select("vec").orderBy(F.xxhash64("vec")).limit(max(1, min(MOST_CELLS, 1 + n // CELL_POINTS * 4))).toArrow()
    centres = _matrix(chosen["vec"].combine_chunks())
    celled = points.select("point", "vec").mapInArrow(lambda b: _celled(b, centres), "cell int, far double, point long, vec array<double>")
    placed = durable(celled.join(points.select("point", "core"), "point"), "tree-cells")
    state = durable(points.select("point", F.col("point").alias("comp")), "tree-state")
    blocked = lambda k: -(-k // BLOCK_POINTS)
    while True:
        now = durable(placed.join(state, "point"), "tree-round")
        cells = sorted(now.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.max("core").alias("core"), F.min("comp").alias("low"), F.max("comp").alias("high")).collect(), key=lambda r: r["cell"])  # at most MOST_CELLS
        if len({x for c in cells for x in (c["low"], c["high"])}) == 1:
            return edges
        own_blocks = {c["cell"]: blocked(c["n"]) for c in cells}
        mixed = {c["cell"]: (own_blocks[c["cell"]],) * 2 for c in cells if c["low"] != c["high"]}
        inside = durable(_least_edges(now, now, mixed, True).select("comp", "e.*"), "tree-inside")
        filling = spark.createDataFrame(list(_filling(cells, centres).items()), "comp long, bound double")
        bounds = inside.select("comp", F.col("w").alias("bound")).unionByName(filling).groupBy("comp").agg(F.min("bound").alias("bound"))
        far, own = np.full(len(centres), -np.inf), np.full(len(centres), -1, np.int64)
        for c in cells:
            far[c["cell"]], own[c["cell"]] = c["far"], c["low"] if c["low"] == c["high"] else -1
        asking = now.join(bounds, "comp").filter("core <= bound").select("cell", "point", "comp", "core", "vec", "bound")
        visits = durable(asking.mapInArrow(partial(_in_reach, centres=centres, far=far, own=own), "cell int, point long, comp long, core double, vec array<double>"), "tree-visits")
        asked = {r["cell"]: (blocked(r["n"]), own_blocks[r["cell"]]) for r in visits.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most MOST_CELLS
        found = inside.select("comp", F.struct("w", "lo", "hi", "other").alias("e")).unionByName(_least_edges(visits, now, asked, False))
        best = durable(found.groupBy("comp").agg(F.min("e").alias("e")).select("comp", "e.*"), "tree-best")
        edges = durable(edges.unionByName(best.select("w", "lo", "hi")).distinct(), "tree-edges")
        joined = linked_components(best.select(F.col("comp").alias("src"), F.col("other").alias("dst")))
        state = durable(state.join(joined, F.col("comp") == F.col("node")).select("point", F.col("component").alias("comp")), "tree-state")


def grown_groups(points: DataFrame, edges: DataFrame, min_size: int) -> DataFrame:
    """``point``, ``n``, ``grp``, ``w``, ``lo``, ``hi``: to which group a point belongs and the edge by which it came to be in one of ``min_size`` rows or more.

    As the threshold rises, what a small component meets first is the other end of its
    least edge out. Two that point at each other are joined; one that comes by such edges
    to a group of ``min_size`` rows joins it. A component that reaches the size itself is a
    group from then on. So it takes about ``min_size`` rounds, whatever the table's size.
    Points of components that stay small have no group.
    """
    alone = F.col("n") >= min_size
    state = points.select("point", "n", F.col("point").alias("comp"), alone.alias("big"), F.when(alone, F.struct(F.col("core").alias("w"), F.col("point").alias("lo"), F.col("point").alias("hi"))).alias("came"))
    state = durable(state, "groups-state")
    while True:
        at = lambda end: state.select(F.col("point").alias(end), F.col("comp").alias(f"c_{end}"), F.col("big").alias(f"b_{end}"))  # noqa: E731, B023
        cut = edges.join(at("lo"), "lo").join(at("hi"), "hi").filter("c_lo <> c_hi and not (b_lo and b_hi)")
        e = F.struct("w", "lo", "hi").alias("e")
        ways = cut.select(F.col("c_lo").alias("comp"), e, F.col("c_hi").alias("other"), F.col("b_lo").alias("own_big"), F.col("b_hi").alias("other_big")).unionByName(cut.select(F.col("c_hi").alias("comp"), e, F.col("c_lo").alias("other"), F.col("b_hi").alias("own_big"), F.col("b_lo").alias("other_big")))
        best = durable(ways.filter("not own_big").groupBy("comp").agg(F.min(F.struct("e", "other", "other_big")).alias("b")).select("comp", "b.*"), "groups-best")
        if best.isEmpty():
            return state.select("point", "n", F.when(F.col("big"), F.col("comp")).alias("grp"), "came.w", "came.lo", "came.hi")
        reached = not best.filter("other_big").isEmpty()
        joins, rest = _joining(best) if reached else (None, best)
        # of those whose way leads to no group, the two that have the same least edge
        twos = rest.groupBy("e").agg(F.min("comp").alias("to"), F.count("*").alias("k"), F.collect_list("comp").alias("both")).filter("k = 2")
        sizes = state.groupBy("comp").agg(F.sum("n").alias("size"))
        paired = twos.select(F.explode("both").alias("comp"), "to", "e").join(sizes, "comp")
        large = paired.groupBy("to").agg((F.sum("size") >= min_size).alias("now_big"))
        pairs = paired.join(large, "to").select("comp", "to", "e", "now_big")
        moves = durable(joins.unionByName(pairs) if reached else pairs, "groups-moves")
        moved = state.join(moves, "comp", "left")
        came = F.when(F.col("came").isNotNull(), F.col("came")).when(F.col("now_big"), F.col("e"))
        state = durable(moved.select("point", "n", F.coalesce("to", "comp").alias("comp"), F.coalesce("now_big", "big").alias("big"), came.alias("came")), "groups-state")


def _joining(best: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The components whose least edges lead to a group, over others or not, with that group; and the rest."""
    tree = linked_components(best.select(F.col("comp").alias("src"), F.col("other").alias("dst")))
    rooted = best.filter("other_big").join(tree, F.col("other") == F.col("node")).groupBy("component").agg(F.min("other").alias("root"))
    joins = durable(best.join(tree, F.col("comp") == F.col("node")).join(rooted, "component").select("comp", F.col("root").alias("to"), "e", F.lit(True).alias("now_big")), "groups-joins")
    return joins, best.join(joins.select("comp"), "comp", "left_anti")


@dataclass(frozen=True)
class Condensed:
    """The tree of clusters: first the groups, then what two of them make. ``up`` is a cluster's parent, -1 for a root; ``formed`` the edge (w, lo, hi) that made it."""

    groups: np.ndarray
    up: np.ndarray
    formed: np.ndarray

    def cluster_of(self, group: np.ndarray, came: np.ndarray) -> np.ndarray:
        """The cluster in which a point of a group is when it comes by an edge: the last of the group's line that was there."""
        at = np.searchsorted(self.groups, group)
        while True:
            parent = self.up[at]
            edge = self.formed[parent]
            before = (edge[:, 0] < came[:, 0]) | (edge[:, 0] == came[:, 0]) & ((edge[:, 1] < came[:, 1]) | (edge[:, 1] == came[:, 1]) & (edge[:, 2] < came[:, 2]))
            moves = (parent >= 0) & before
            if not moves.any():
                return at
            at = np.where(moves, parent, at)


def condensed(groups: list[tuple], bridges: list[tuple]) -> Condensed:
    """Groups (grp, w, lo, hi: the edge that made them) and the edges between them (w, lo, hi, one, other) as a tree."""
    groups = sorted(groups)
    number = {g[0]: i for i, g in enumerate(groups)}
    up, formed = [-1] * len(groups), [g[1:] for g in groups]
    head, link = list(range(len(groups))), list(range(len(groups)))

    def root(i: int) -> int:
        while link[i] != i:
            link[i] = link[link[i]]
            i = link[i]
        return i

    for w, lo, hi, one, other in sorted(bridges):
        a, b = root(number[one]), root(number[other])
        up[head[a]] = up[head[b]] = len(up)
        link[b] = a
        head[a] = len(up)
        up.append(-1)
        formed.append((w, lo, hi))
    return Condensed(np.array([g[0] for g in groups], np.int64), np.array(up, np.int64), np.array(formed, float).reshape(-1, 3))


def density(w: np.ndarray) -> np.ndarray:
    return 1 / np.maximum(w, LEAST_DISTANCE)


def most_stable(tree: Condensed, rows: np.ndarray, dense: np.ndarray, peak: np.ndarray, single: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each cluster the selected one that it lies in, -1 if in none; and each one's greatest density.

    ``rows``, ``dense``, ``peak``: of the points that come in a cluster itself, how many
    they are, the sum and the maximum of their densities. A cluster's stability is, over
    its rows, the density at which they come less that at which the cluster ends. From the
    groups up, a cluster stays if it is more stable than what is chosen within it
    together; a root only if ``single``.
    """
    n = len(tree.up)
    size, children = rows.astype(float).copy(), [[] for _ in range(n)]
    for i in range(n):  # children come before what they make
        if tree.up[i] >= 0:
            size[tree.up[i]] += size[i]
            children[tree.up[i]].append(i)
    formed = density(tree.formed[:, 0]) if n else np.zeros(0)
    ends = np.array([formed[p] if p >= 0 else 0.0 for p in tree.up])
    stable, best, chosen = np.zeros(n), np.zeros(n), np.zeros(n, bool)
    for i in range(n):
        inner = sum(size[c] for c in children[i])
        stable[i] = dense[i] - rows[i] * ends[i] + inner * (formed[i] - ends[i])
        below = sum(best[c] for c in children[i])
        chosen[i] = (not children[i] or stable[i] > below) and (single or tree.up[i] >= 0)
        best[i] = stable[i] if chosen[i] else below
    inside = np.full(n, -1)
    for i in range(n - 1, -1, -1):
        above = inside[tree.up[i]] if tree.up[i] >= 0 else -1
        inside[i] = above if above >= 0 else i if chosen[i] else -1
    top = np.array([max(peak[i], formed[i] if children[i] else 0.0) for i in range(n)])
    return inside, top


def _clustered(batches: Iterator[pa.RecordBatch], tree: Condensed) -> Iterator[pa.RecordBatch]:
    """(point, n, cluster, dense) of points with a group."""
    for batch in batches:
        if batch.num_rows:
            came = np.stack([batch.column(i).to_numpy().astype(float) for i in (3, 4, 5)], axis=1)
            at = tree.cluster_of(batch.column(2).to_numpy(), came)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(at), pa.array(density(came[:, 0]))], names=["point", "n", "cluster", "dense"])


def _named(batches: Iterator[pa.RecordBatch], inside: np.ndarray, top: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            at = inside[batch.column(1).to_numpy()]
            share = np.where(at >= 0, np.minimum(batch.column(2).to_numpy(), top[at]) / top[at], 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at.astype(np.int64)), pa.array(share)], names=["point", "_cluster", "_strength"])


def hierarchical_clusters(rows: DataFrame, vector: str = "vector", min_size: int = 5, min_samples: int | None = None, single: bool = False) -> DataFrame:
    """``rows`` with ``cluster_id`` and ``strength``: the most stable clusters of the density hierarchy, -1 and 0 for noise.

    No radius is given: clusters may be of different density. The core distance of a row
    is that to its ``min_samples``-th other row (``min_size`` if None). As a threshold falls, the spanning
    tree of mutual reachability comes apart; parts of ``min_size`` rows or more are
    clusters, smaller ones leave theirs as noise. Of a cluster and those that it comes
    apart into, the more stable stay (see ``most_stable``); the whole table is a cluster
    only if ``single``. ``strength`` is how dense a row lies, as a share of its cluster's densest.

    Equal vectors are one point that counts as often as they occur. The spanning tree and
    the growth of small components are joins over all points; only the tree of groups, at
    most one for each ``min_size`` rows and ``MOST_GROUPS`` in all, is put together on the
    driver. Null vectors are noise; all others must have one length. Ids are numbers of
    this table's clusters in no meaningful order.
    """
    none = rows.withColumns({"cluster_id": F.lit(NOISE).cast("long"), "strength": F.lit(0.0)})
    if rows.filter(F.col(vector).isNotNull()).isEmpty():
        return none
    points = density_points(rows, vector, min_samples or min_size)
    edges = spanning_tree(points)
    grown = durable(grown_groups(points, edges, min_size).filter("grp is not null"), "hierarchy-groups")
    made = grown.groupBy("grp").agg(F.min(F.struct("w", "lo", "hi")).alias("e")).select("grp", "e.*")
    if made.count() > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups: ask for larger clusters by min_size")
    group = lambda end: grown.select(F.col("point").alias(end), F.col("grp").alias(f"g_{end}"))
    bridges = edges.join(group("lo"), "lo").join(group("hi"), "hi").filter("g_lo <> g_hi").select("w", "lo", "hi", "g_lo", "g_hi")
    tree = condensed([tuple(r) for r in made.collect()], [tuple(r) for r in bridges.collect()])
    if not len(tree.groups):
        return none
    placed = durable(grown.mapInArrow(partial(_clustered, tree=tree), "point long, n long, cluster long, dense double"), "hierarchy-clusters")
    sums, k = np.zeros((3, len(tree.up))), len(tree.up)
    for r in placed.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("dense")).alias("d"), F.max("dense").alias("p")).collect():  # as many as the tree has
        sums[:, r["cluster"]] = r["n"], r["d"], r["p"]
    inside, top = most_stable(tree, *sums, single)
    named = placed.select("point", "cluster", "dense").mapInArrow(partial(_named, inside=inside, top=top), "point long, _cluster long, _strength double")
    marked = named.filter("_cluster >= 0").join(points.select("point", F.col("vec").alias("_vec")), "point").drop("point")
    joined = rows.join(marked, F.col(vector).cast("array<double>") == F.col("_vec"), "left")
    return joined.withColumns({"cluster_id": F.coalesce("_cluster", F.lit(NOISE).cast("long")), "strength": F.coalesce("_strength", F.lit(0.0))}).drop("_vec", "_cluster", "_strength")
