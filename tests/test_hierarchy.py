import numpy as np
import pytest

from edgeloom.operators import cluster, hierarchy, neighbours


def plain_tree(points, core):
    """The spanning tree, by adding the nearest point each time."""
    n, square = len(points), np.zeros((len(points), len(points)))
    for left in points.T:
        square += (left[:, None] - left[None, :]) ** 2
    w = np.maximum(np.sqrt(square), np.maximum(core[:, None], core[None, :]))
    edges = sorted((w[i, j], i + 1, j + 1) for i in range(n) for j in range(i + 1, n))
    link, out = list(range(n + 1)), []

    def root(i):
        while link[i] != i:
            link[i] = link[link[i]]
            i = link[i]
        return i

    for e in edges:
        a, b = root(e[1]), root(e[2])
        if a != b:
            link[a] = b
            out.append(e)
    return out


def plain_clusters(vectors, min_size, single=False):
    """Top down, row by row: remove the greatest edge, look at both parts."""
    points, counts = np.unique(vectors, axis=0, return_counts=True)
    gaps = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    core = np.array([np.repeat(g, counts)[np.argsort(np.repeat(g, counts), kind="stable")][min(min_size, counts.sum() - 1)] for g in gaps])
    edges = plain_tree(points, core)
    lam = lambda w: 1 / max(w, hierarchy.LEAST_DISTANCE)
    clusters, stack = [], []

    def parts(nodes, own):
        """A part's nodes and edges on both sides of its greatest edge."""
        top, rest = own[-1], own[:-1]
        link = {i: i for i in nodes}

        def root(i):
            while link[i] != i:
                link[i] = link[link[i]]
                i = link[i]
            return i

        for _, a, b in rest:
            link[root(a)] = root(b)
        side = root(top[1])
        left = {i for i in nodes if root(i) == side}
        return top, (left, [e for e in rest if e[1] in left]), (nodes - left, [e for e in rest if e[1] not in left])

    size = lambda nodes: sum(int(counts[i - 1]) for i in nodes)

    def new(birth, parent, nodes):
        clusters.append({"birth": birth, "parent": parent, "stability": 0.0, "children": [], "nodes": set(nodes), "peak": 0.0})
        return len(clusters) - 1

    everything = set(range(1, len(points) + 1))
    dense = {}
    if size(everything) >= min_size:
        stack.append((everything, edges, new(0.0, None, everything)))
    while stack:
        nodes, own, c = stack.pop()
        birth = clusters[c]["birth"]

        def leave(gone, at, c=c, birth=birth):
            clusters[c]["stability"] += size(gone) * (at - birth)
            clusters[c]["peak"] = max(clusters[c]["peak"], at)
            dense.update({i: at for i in gone})

        if not own:
            leave(nodes, lam(core[next(iter(nodes)) - 1]))
            continue
        top, *both = parts(nodes, own)
        at = lam(top[0])
        large = [p for p in both if size(p[0]) >= min_size]
        if len(large) == 2:
            clusters[c]["stability"] += size(nodes) * (at - birth)
            clusters[c]["peak"] = max(clusters[c]["peak"], at)
            for p in large:
                child = new(at, c, p[0])
                clusters[c]["children"].append(child)
                stack.append((*p, child))
        else:
            for p in both:
                if p in large:
                    stack.append((*p, c))
                else:
                    leave(p[0], at)
    best, chosen = {}, {}
    for c in range(len(clusters) - 1, -1, -1):
        below = sum(best[k] for k in clusters[c]["children"])
        chosen[c] = (not clusters[c]["children"] or clusters[c]["stability"] > below + 1e-12 * below) and (single or clusters[c]["parent"] is not None)
        best[c] = clusters[c]["stability"] if chosen[c] else below
    label = {}
    for c in range(len(clusters)):
        if chosen[c]:
            for i in clusters[c]["nodes"]:
                label.setdefault(i, c)
    where = {tuple(p): i + 1 for i, p in enumerate(points)}
    out = []
    for v in vectors:
        i = where[tuple(v)]
        c = label.get(i, -1)
        out.append((c, 0.0 if c < 0 else min(dense[i], clusters[c]["peak"]) / clusters[c]["peak"]))
    return out


def groups(labels):
    found = {}
    for i, (c, _) in enumerate(labels):
        found.setdefault(c, set()).add(i)
    return {frozenset(g) for c, g in found.items() if c != -1}, found.get(-1, set())


def table(n, rng):
    """Clouds of different density, one within another, some copies, and noise."""
    made = np.concatenate([rng.normal(0, 0.1, (n // 3, 2)), [2, 0] + rng.normal(0, 0.3, (n // 4, 2)), [2, 0] + rng.normal(0, 0.02, (n // 8, 2)), [0, 3] + rng.normal(0, 0.05, (n // 8, 2)), rng.random((n // 8, 2)) * 8 - 4])
    return np.round(np.concatenate([made, made[: n // 10], np.repeat([[5.0, 5.0]], 9, axis=0), np.repeat([[6.0, 6.0]], 3, axis=0)]), 4)


def run(spark, vectors, **more):
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, vector array<double>").repartition(4)
    found = {r["id"]: (r["cluster_id"], r["strength"]) for r in hierarchy.hierarchical_clusters(df, **more).collect()}
    return [found[i] for i in range(len(vectors))]


@pytest.mark.parametrize(("n", "min_size", "single", "cell"), [(120, 5, False, 30), (70, 8, True, 2_000)])
def test_as_a_plain_version(spark, monkeypatch, n, min_size, single, cell):
    monkeypatch.setattr(hierarchy, "CELL_POINTS", cell)
    monkeypatch.setattr(neighbours, "CELL_POINTS", cell)
    vectors = table(n, np.random.default_rng(n))
    found, expected = run(spark, vectors, min_size=min_size, single=single), plain_clusters(vectors, min_size, single)
    assert groups(found) == groups(expected) and len(groups(found)[0]) >= (1 if single else 3)
    assert np.allclose([s for _, s in found], [s for _, s in expected])


def test_two_thousand_rows(spark):
    vectors = table(1_800, np.random.default_rng(5))
    found, expected = run(spark, vectors, min_size=10), plain_clusters(vectors, 10)
    assert groups(found) == groups(expected) and len(groups(found)[0]) >= 4 and groups(found)[1]


def test_few_rows_nulls_and_copies(spark):
    assert [c for c, _ in run(spark, np.array([[1.0, 1.0]] * 7), single=True)] == [0] * 7
    assert [c for c, _ in run(spark, np.array([[1.0, 1.0], [2.0, 2.0]]))] == [-1, -1]
    df = spark.createDataFrame([(1, None), (2, [1.0])], "id long, vector array<double>")
    assert {(r["id"], r["cluster_id"], r["strength"]) for r in hierarchy.hierarchical_clusters(df).collect()} == {(1, -1, 0.0), (2, -1, 0.0)}
    assert hierarchy.hierarchical_clusters(df.limit(0)).count() == 0
    assert {r["cluster_id"] for r in hierarchy.hierarchical_clusters(df.filter("id = 1")).collect()} == {-1}


def test_the_flat_pipeline_takes_these_clusters(spark):
    rng = np.random.default_rng(7)
    vectors = np.concatenate([rng.normal(0, 0.05, (14, 2)), [3, 3] + rng.normal(0, 0.05, (14, 2)), [[9.0, 9.0], [9.0, -9.0]]])
    rows = [(i, [float(x) for x in v], 1 if i < 14 or i == 29 else 0, i % 2 == 0) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "id long, vector array<double>, label int, is_seed boolean")
    found = {r["id"]: (r["predicted_label"], r["confidence"]) for r in cluster.flat_pipeline(df, ["id"], clusters=lambda d: hierarchy.hierarchical_clusters(d)).collect()}
    assert [found[i][0] for i in range(28)] == [1] * 14 + [0] * 14 and found[28] == found[29] == (0, 0.0)
    assert all(0 < found[i][1] <= 1 for i in range(28)) and len({c for _, c in found.values()}) > 5


def test_few_points_meet_other_cells(spark, monkeypatch):
    """Outliers make wide cells; all the same a point meets those of few other cells, and the tree is exact."""
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(400, 2))
    core = np.sort(np.sqrt(((vectors[:, None] - vectors[None]) ** 2).sum(axis=2)), axis=1)[:, 3]
    monkeypatch.setattr(hierarchy, "CELL_POINTS", 100)
    rows, kept = [], hierarchy.durable

    def counted(df, label):
        out = kept(df, label)
        if label == "tree-visits":
            rows.append(out.count())
        return out

    monkeypatch.setattr(hierarchy, "durable", counted)
    points = spark.createDataFrame([(i + 1, v.tolist(), float(c)) for i, (v, c) in enumerate(zip(vectors, core, strict=True))], "point long, vec array<double>, core double")
    assert sorted(tuple(r) for r in hierarchy.spanning_tree(points).collect()) == sorted(plain_tree(vectors, core))
    assert rows and max(rows) < 3 * len(vectors)
