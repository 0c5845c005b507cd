"""Merkle manifest of a dataset: aligned subtrees in van Emde Boas layout, recursing over block roots."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm.common import documents, durable, id_hash, quoted
from edgeloom.operators.ranks import ordered_rank

#: Consecutive nodes that are hashed together.
FAN = 3
#: Levels that a block lifts its nodes by: 3 ** 6 = 729 nodes a block, 35 kB of digests.
LIFT = 6
DIGEST_BYTES = 32
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def tree_size(levels: int) -> int:
    """Nodes of a complete tree of so many levels."""
    return (FAN**levels - 1) // (FAN - 1)


def veb_address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places of the nodes ``index`` of one ``depth`` (0: the root) in a complete tree of ``levels`` levels.

    Van Emde Boas layout: the upper half of the levels lies first, itself laid out so, and
    after it one after the other the subtrees that hang below, each laid out so. Whatever
    the size of a cache line or page, a path from leaf to root touches few of them.
    """
    if levels == 1:
        return np.zeros_like(index)
    upper = levels // 2
    if depth < upper:
        return veb_address(upper, depth, index)
    lower, width = levels - upper, FAN ** (depth - upper)
    return tree_size(upper) + index // width * tree_size(lower) + veb_address(lower, depth - upper, index % width)


@lru_cache(maxsize=64)
def _addresses(height: int) -> tuple[tuple[int, ...], ...]:
    """Places of all nodes of a block, by depth."""
    return tuple(tuple(veb_address(height + 1, d, np.arange(FAN**d)).tolist()) for d in range(height + 1))


def height_of(nodes: int) -> int:
    """Levels that so many nodes are lifted until one remains."""
    height = 0
    while nodes > 1:
        nodes, height = -(-nodes // FAN), height + 1
    return height


def node_hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def build_block(digests: Sequence[str], height: int) -> bytes:
    """All nodes above some consecutive ones, and these, in van Emde Boas layout; places that a last, shorter run leaves free are zero."""
    places = _addresses(height)
    out = bytearray(tree_size(height + 1) * DIGEST_BYTES)
    level = list(digests)
    for depth in range(height, -1, -1):
        for place, digest in zip(places[depth], level, strict=False):
            out[place * DIGEST_BYTES : (place + 1) * DIGEST_BYTES] = bytes.fromhex(digest)
        if depth:
            level = [node_hash("".join(level[i : i + FAN])) for i in range(0, len(level), FAN)]
    return bytes(out)


def block_paths(nodes: bytes, height: int, count: int) -> list[list[tuple[str, str]]]:
    """For each depth from the block's own nodes up: what stands left and right of each node in its run, fetched by address."""
    found = []
    for depth in range(height, 0, -1):
        level = [nodes[p * DIGEST_BYTES : (p + 1) * DIGEST_BYTES].hex() for p in _addresses(height)[depth][:count]]
        found.append([("".join(level[i - i % FAN : i]), "".join(level[i + 1 : i - i % FAN + FAN])) for i in range(count)])
        count = -(-count // FAN)
    return found


def path_of(levels: list[list[tuple[str, str]]], place: int) -> list[tuple[str, str]]:
    """(left, right) of one of a block's nodes at each level."""
    out = []
    for level in levels:
        out.append(level[place])
        place //= FAN
    return out


def write_path(path: Sequence[tuple[str, str]]) -> str:
    """A path as text: of each level the siblings on the left, a dot, those on the right, a semicolon."""
    return "".join(f"{left}.{right};" for left, right in path)


def read_path(text: str) -> list[tuple[str, str]]:
    return [tuple(level.split(".")) for level in text.split(";")[:-1]]


def fold(digest: str, path: Sequence[tuple[str, str]]) -> str:
    """The root that a leaf's digest and its siblings lead to."""
    for left, right in path:
        digest = node_hash(left + digest + right)
    return digest


def record_digest(columns: Sequence[Column]) -> Column:
    """Digest of a row: each value as ``-`` if null, else its UTF-8 byte count, a colon and the value."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]).cast("binary"), 256)


def tree_key(tree: Column) -> Column:
    """A tree's name as a key without nulls, which sorts null first, then by UTF-8 bytes."""
    return F.when(tree.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), tree.cast("string")))


@dataclass
class Forest:
    """Tables of blocks, tier by tier from the leaves, and a root for each tree.

    A tier has ``tree``, ``block``, ``n`` (the tree's nodes in this tier), ``count`` (the
    block's), ``height``, ``nodes`` (digests in van Emde Boas layout) and, in the first,
    ``rows``: what was given with the leaves. Block roots are the nodes of the next tier.
    """

    tiers: list[DataFrame]
    roots: DataFrame
    lift: int


def _built(batches: Iterator[pa.RecordBatch], lift: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.schema.names
        sizes, packs = batch.column(names.index("n")).to_pylist(), batch.column(names.index("digests"))
        heights = [lift if n > FAN**lift else height_of(n) for n in sizes]
        nodes = [build_block(packs[i].as_py(), h) for i, h in enumerate(heights)]
        rest = batch.drop_columns(["digests"])
        yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(heights, pa.int32()), pa.array(nodes, pa.binary())], names=[*rest.schema.names, "height", "nodes"])


def build_forest(leaves: DataFrame, lift: int = LIFT) -> Forest:
    """A Merkle tree over the leaves of each ``tree``.

    ``leaves``: ``tree``, ``place`` (from 0 in each tree), ``digest`` and, if wanted, a
    struct ``row``. Blocks of ``FAN ** lift`` consecutive leaves are built by themselves,
    so that a tree with most of the leaves is dealt over all tasks and none holds more
    than a block's; their roots are the leaves of the next tier, until each tree has one
    block. Without leaves the forest has no trees.
    """
    width = FAN**lift
    has_rows = "row" in leaves.columns
    sizes = durable(leaves.groupBy("tree").agg(F.count("*").alias("n")), "merkle-sizes")
    most = sizes.agg(F.max("n").alias("most")).first()["most"] or 0
    nodes, tiers, roots = leaves, [], None
    while True:
        item = F.struct("place", "digest", *(["row"] if has_rows and not tiers else []))
        packs = nodes.groupBy("tree", F.expr(f"place div {width}").alias("block")).agg(F.array_sort(F.collect_list(item)).alias("items"))  # at most a block's
        cut = [F.transform("items", lambda x: x["digest"]).alias("digests"), F.size("items").alias("count")]
        if has_rows and not tiers:
            cut.append(F.transform("items", lambda x: x["row"]).alias("rows"))
        staged = packs.select("tree", "block", *cut).join(sizes, "tree")
        kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in staged.schema if f.name != "digests"]
        tier = durable(staged.mapInArrow(lambda b: _built(b, lift), ", ".join([*kinds, "height int", "nodes binary"])), "merkle-tier")
        tiers.append(tier)
        top = F.lower(F.hex(F.substring("nodes", 1, DIGEST_BYTES)))
        done = tier.filter(F.col("n") <= width).select("tree", top.alias("root"))
        roots = done if roots is None else roots.unionByName(done)
        if most <= width:
            return Forest(tiers, durable(roots, "merkle-roots"), lift)
        nodes = tier.filter(F.col("n") > width).select("tree", F.col("block").alias("place"), top.alias("digest"))
        sizes = sizes.filter(F.col("n") > width).select("tree", F.ceil(F.col("n") / width).alias("n"))
        most = -(-most // width)


def _blockwise(batch: pa.RecordBatch) -> Iterator[tuple[dict, list, list]]:
    """Each block of a batch: its columns, its own levels of siblings, and the path above it."""
    for i in range(batch.num_rows):
        row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
        yield row, block_paths(row["nodes"], row["height"], row["count"]), read_path(row["above"])


def _expanded(batches: Iterator[pa.RecordBatch], lift: int) -> Iterator[pa.RecordBatch]:
    """(tree, place, path) of every node of blocks."""
    for batch in batches:
        for row, levels, above in _blockwise(batch):
            tail, first = write_path(above), row["block"] * FAN**lift
            paths = [write_path(path_of(levels, i)) + tail for i in range(row["count"])]
            yield pa.RecordBatch.from_arrays([pa.array([row["tree"]] * len(paths)), pa.array([first + i for i in range(len(paths))], pa.int64()), pa.array(paths)], names=["tree", "place", "path"])


def with_paths(forest: Forest, above: DataFrame) -> DataFrame:
    """The blocks of the first tier with ``above``, the path from the block's root to the top.

    ``above``: ``tree`` and ``path``, what stands above each tree's root. Paths go down
    tier by tier; what is joined has a row per block, not per leaf.
    """
    lift, lower = forest.lift, None
    width = FAN**lift
    for level in range(len(forest.tiers) - 1, -1, -1):
        tier = forest.tiers[level]
        found = tier.filter(F.col("n") <= width).join(above.select("tree", F.col("path").alias("above")), "tree")
        if lower is not None:
            upper = lower.select("tree", F.col("place").alias("block"), F.col("path").alias("above"))
            found = found.unionByName(tier.filter(F.col("n") > width).join(upper, ["tree", "block"]).select(found.columns))
        if not level:
            return found
        kind = tier.schema["tree"].dataType.simpleString()
        lower = durable(found.mapInArrow(lambda b: _expanded(b, lift), f"tree {kind}, place long, path string"), "merkle-paths")
    raise AssertionError("a forest has a tier at least")


@dataclass
class Manifest:
    """The trees of all groups, the tree over their roots, and the dataset's root (null without rows)."""

    trees: Forest
    top: Forest
    subroots: DataFrame
    root: str | None


def build_manifest(leaves: DataFrame, lift: int = LIFT) -> Manifest:
    """One tree for each ``tree`` over its leaves in order, and one over the trees' roots in order of their keys.

    ``leaves``: ``tree`` (see ``tree_key``), ``place``, ``digest`` and a struct ``row``.
    """
    trees = build_forest(leaves, lift)
    ordered = ordered_rank(trees.roots, [], [F.col("tree")], "place")
    subroots = durable(ordered.select("tree", (F.col("place") - 1).alias("place"), F.col("root").alias("subroot")), "merkle-subroots")
    top = build_forest(subroots.select(F.lit("").alias("tree"), "place", F.col("subroot").alias("digest")), lift)
    only = top.roots.first()
    return Manifest(trees, top, subroots, only["root"] if only else None)


def located_blocks(manifest: Manifest) -> DataFrame:
    """The leaves' blocks with the path above each and the ``subroot`` of its tree."""
    spark = manifest.subroots.sparkSession
    tops = with_paths(manifest.top, spark.createDataFrame([("", "")], "tree string, path string"))
    lift = manifest.top.lift
    paths = tops.mapInArrow(lambda b: _expanded(b, lift), "tree string, place long, path string").select("place", "path")
    above = durable(manifest.subroots.join(paths, "place").select("tree", "path", "subroot"), "merkle-above")
    return with_paths(manifest.trees, above).join(above.select("tree", "subroot"), "tree")


def _proved(root: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index("rows")
            for i, (row, levels, above) in enumerate(_blockwise(batch.select([n for n in batch.schema.names if n != "rows"]))):
                items = batch.column(at)[i].values
                changed = items.field("changed").to_pylist()
                leaves = items.field("leaf").to_pylist()
                proofs, folded = [], []
                for place, (leaf, other) in enumerate(zip(leaves, changed, strict=True)):
                    path = path_of(levels, place) + above
                    proofs.append(node_hash("".join(left + right for left, right in path)))
                    folded.append(fold(other or leaf, path))
                n = len(leaves)
                columns = [items.field("doc_id"), pa.array(leaves), pa.array([row["subroot"]] * n), pa.array([root] * n), pa.array(proofs), pa.array(folded), pa.array([f == root for f in folded])]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return work


def numbered_leaves(docs: DataFrame, columns: Sequence[str] = COLUMNS, tree: str = "source", order: str = "doc_id", changed: Column | None = None) -> DataFrame:
    """``tree``, ``place``, ``digest`` and ``row`` (``doc_id``, ``leaf``, ``changed``) of every row of ``docs``.

    Within a tree leaves ascend by ``order``, null first; rows of one id by their digests,
    and rows equal in both as they come, which makes no difference. ``changed`` is what a
    row's digest is said to be when it is verified, null for the digest itself.
    """
    plain = [F.col(quoted(c)) for c in columns]
    other = changed if changed is not None else F.lit(None).cast("string")
    staged = docs.select(tree_key(F.col(quoted(tree))).alias("tree"), F.col(quoted(order)).alias("doc_id"), record_digest(plain).alias("leaf"), other.alias("changed"), F.monotonically_increasing_id().alias("tie"))
    ranked = ordered_rank(durable(staged, "merkle-leaves"), ["tree"], [F.col("doc_id"), F.col("leaf"), F.col("tie")], "rank")
    return ranked.select("tree", (F.col("rank") - 1).cast("long").alias("place"), F.col("leaf").alias("digest"), F.struct("doc_id", "leaf", "changed").alias("row"))


def verify_documents(docs: DataFrame, changed: Column | None = None, columns: Sequence[str] = COLUMNS, tree: str = "source", order: str = "doc_id", lift: int = LIFT) -> DataFrame:
    """``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root`` and ``verified`` of every row.

    The manifest is built from ``docs``; each row is then checked against it: its digest,
    or the digest ``changed`` where that isn't null, is folded with the siblings on its
    path up to the root. Nodes are SHA-256 of up to three consecutive digests as
    hexadecimal text; a shorter last run is hashed all the same.

    Nulls: a null value is a ``-`` in the digest, a null id or source comes first and a
    null source is a source of its own. Repeated rows are leaves of their own, next to
    each other. A text of any length is hashed whole. An empty table gives an empty one.
    Other columns aren't read, so their names can't clash.
    """
    kind = docs.schema[order].dataType.simpleString()
    shape = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    manifest = build_manifest(numbered_leaves(docs, columns, tree, order, changed), lift)
    if manifest.root is None:
        return docs.sparkSession.createDataFrame([], shape)
    return located_blocks(manifest).mapInArrow(_proved(manifest.root), shape)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the Merkle manifest of the table, and whether it, or it without line ends where its id's crc32 is even, is verified."""
    docs = documents(spark, sf_dir)
    bare = record_digest([F.replace("text", F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in COLUMNS])
    return verify_documents(docs, F.when(id_hash(F.col("doc_id")) % 2 == 0, bare))


_LEAF = "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END" for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
_CRC = "list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)), lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1))))"
OP12_SQL = f"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST) AS rid, doc_id, coalesce('1' || source, '0') AS tree, {_LEAF.format(text="text")} AS leaf,
    CASE WHEN xor({_CRC}, 4294967295::BIGINT) % 2 = 0 THEN {_LEAF.format(text="replace(text, chr(10), '')")} END AS changed
  FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM docs),
lower_tree AS (
  SELECT tree, 0 AS level, place, leaf AS digest FROM placed
  UNION ALL
  SELECT tree, level + 1, place // 3, sha256(string_agg(digest, '' ORDER BY place)) FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM lower_tree) WHERE n > 1 GROUP BY tree, level, place // 3),
subroots AS (SELECT tree, arg_max(digest, level) AS subroot, max(level) AS height FROM lower_tree GROUP BY tree),
ordered AS (SELECT *, row_number() OVER (ORDER BY tree COLLATE "C") - 1 AS place FROM subroots),
upper_tree AS (
  SELECT 0 AS level, place, subroot AS digest FROM ordered
  UNION ALL
  SELECT level + 1, place // 3, sha256(string_agg(digest, '' ORDER BY place)) FROM (SELECT *, count(*) OVER () AS n FROM upper_tree) WHERE n > 1 GROUP BY level, place // 3),
apex AS (SELECT arg_max(digest, level) AS root, max(level) AS height FROM upper_tree),
steps AS (
  SELECT p.rid, t.level, (p.place // (3 ** t.level)::BIGINT) AS own, t.place, t.digest
  FROM placed p JOIN ordered o USING (tree) JOIN lower_tree t ON t.tree = p.tree AND t.level < o.height AND t.place // 3 = p.place // (3 ** (t.level + 1))::BIGINT
  UNION ALL
  SELECT p.rid, o.height + u.level, o.place // (3 ** u.level)::BIGINT, u.place, u.digest
  FROM placed p JOIN ordered o USING (tree) JOIN upper_tree u ON u.level < (SELECT height FROM apex) AND u.place // 3 = o.place // (3 ** (u.level + 1))::BIGINT),
runs AS (SELECT rid, level, coalesce(string_agg(digest, '' ORDER BY place) FILTER (place < own), '') AS before, coalesce(string_agg(digest, '' ORDER BY place) FILTER (place > own), '') AS after FROM steps GROUP BY rid, level),
proofs AS (SELECT rid, sha256(string_agg(before || after, '' ORDER BY level)) AS proof FROM runs GROUP BY rid),
folded AS (
  SELECT rid, 0 AS level, coalesce(changed, leaf) AS digest FROM placed
  UNION ALL
  SELECT f.rid, f.level + 1, sha256(r.before || f.digest || r.after) FROM folded f JOIN runs r ON r.rid = f.rid AND r.level = f.level),
last AS (SELECT rid, arg_max(digest, level) AS folded_root FROM folded GROUP BY rid)
SELECT p.doc_id, p.leaf, o.subroot, (SELECT root FROM apex) AS root, coalesce(q.proof, sha256('')) AS proof_sha256, l.folded_root, l.folded_root = (SELECT root FROM apex) AS verified
FROM placed p JOIN ordered o USING (tree) LEFT JOIN proofs q USING (rid) JOIN last l USING (rid)
"""
