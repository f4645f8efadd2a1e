"""A Merkle tree over a dataset, with a proof for every row.

A node is labelled with the interval of leaf ranks it covers; a child's interval
lies in its parent's. Nodes of neighbouring levels are joined by containment
within buckets, where a bucket is a parent's place on its level, so no key has
more rows than a node has children, whatever share of the rows one group holds.
Within a parent the intervals before and after a node's own are its siblings.

Each group's rows make a tree, and the groups' subroots make the tree above.
Runs of ``FANOUT`` neighbours become their hash until one node is left; a lone
node is its own root. Spark functions only.

Defined cases: null fields hash as ``-``; a null group is a group and comes
first; rows with a null key come first in their group, rows that share a key are
ordered by their hash (equal rows have equal proofs but for their place); empty
texts have no special part; an empty table has no nodes; columns other than the
hashed ones are kept unless named like an output column, which replaces them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfline.session import written

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
OUTPUT = ("leaf", "subroot", "root", "proof", "folded_root", "verified")
_PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def framed(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(fields: dict[str, Column]) -> Column:
    return digest(*map(framed, fields.values()))


@dataclass
class Tree:
    """``levels[n]`` has the nodes of level n + 1: group, level, lo, hi, total, digest and children; ``tops`` one row per group."""

    levels: list[DataFrame]
    tops: DataFrame


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``rank`` by ``order`` within ``_group`` and the group's ``total``.

    Rows are range-partitioned and stored in order. A row's rank is its place in
    its partition, past the rows of its group in the partitions before, which
    are counted from one row per group and partition.
    """
    keys = ["_group", *order]
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    placed = written(placed, "ranked").withColumn("_part", F.shiftright("_at", 33))
    group = Window.partitionBy("_group")
    counted = placed.groupBy("_group", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = counted.select("_group", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(group).alias("total"))
    joined = placed.join(spans, ["_group", "_part"])
    return joined.withColumn("rank", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def grow(leaves: DataFrame, *payload: str) -> Tree:
    """The levels above ranked leaves; children of the first level carry the ``payload`` columns."""
    child = F.struct(F.col("rank").alias("lo"), F.col("rank").alias("hi"), "digest", *payload)
    below = leaves.select("_group", "total", child.alias("child"))
    levels: list[DataFrame] = []
    most = None
    while most is None or FANOUT ** len(levels) < most:
        # At most FANOUT rows share a key.
        runs = below.groupBy("_group", _bucket("child.lo", len(levels) + 1).alias("bucket")).agg(
            F.first("total").alias("total"), F.sort_array(F.collect_list("child")).alias("children")
        )
        hashed = digest(F.array_join(F.transform("children", lambda c: c["digest"]), ""))
        nodes = runs.select(
            "_group",
            F.lit(len(levels) + 1).alias("level"),
            F.col("children")[0]["lo"].alias("lo"),
            F.element_at("children", -1)["hi"].alias("hi"),
            "total",
            F.when(F.col("total") == 1, F.col("children")[0]["digest"]).otherwise(hashed).alias("digest"),
            "children",
        )
        levels.append(written(nodes, "nodes"))
        if most is None:
            most = levels[0].agg(F.max("total")).first()[0] or 0
        below = levels[-1].where(~is_top()).select("_group", "total", F.struct("lo", "hi", "digest").alias("child"))
    tops = [nodes.where(is_top()).select("_group", "digest") for nodes in levels]
    every = tops[0]
    for top in tops[1:]:
        every = every.unionByName(top)
    return Tree(levels, every)


def is_top() -> Column:
    return F.col("hi") - F.col("lo") + 1 == F.col("total")


def siblings(children: str, child: Column) -> Column:
    """The digests of the children before and after the interval of ``child``, each as one text."""

    def joined(side) -> Column:
        return F.array_join(F.transform(F.filter(children, side), lambda c: c["digest"]), "")

    return F.struct(joined(lambda c: c["hi"] < child["lo"]).alias("left"), joined(lambda c: c["lo"] > child["hi"]).alias("right"))


def with_paths(tree: Tree, above: DataFrame | None = None) -> DataFrame:
    """The nodes of the first level with the siblings of each and of its ancestors, nearest first, as ``path``.

    ``above`` has the ``path`` on which a group's top goes on, and columns that
    its nodes get; without it paths end at the tops.
    """
    extra = [name for name in above.columns if name not in ("_group", "path")] if above else []
    parents: DataFrame | None = None
    for number in reversed(range(len(tree.levels))):
        nodes = tree.levels[number]
        tops = nodes.where(is_top())
        reached = tops.join(above, "_group") if above else tops.withColumn("path", F.array().cast(_PATH))
        if parents is not None:
            outer = parents.select(
                "_group",
                _bucket("lo", number + 2).alias("bucket"),
                F.struct("lo", "hi").alias("_outer"),
                F.col("children").alias("_beside"),
                F.col("path").alias("_path"),
                *extra,
            )
            inner = nodes.where(~is_top()).withColumn("bucket", _bucket("lo", number + 2))
            inside = (F.col("_outer.lo") <= F.col("lo")) & (F.col("hi") <= F.col("_outer.hi"))
            step = F.array(siblings("_beside", F.struct("lo", "hi")))
            met = inner.join(outer, ["_group", "bucket"]).where(inside).withColumn("path", F.concat(step, "_path"))
            reached = reached.unionByName(met.select(reached.columns))
        parents = reached
    return parents


def _bucket(rank: str, level: int) -> Column:
    """Place on ``level`` of the node that covers a rank."""
    return F.expr(f"{rank} div {FANOUT**level}")


def fold(start: Column, path: Column) -> Column:
    """The root that ``start`` gives with the siblings on ``path``."""
    return F.aggregate(path, start, lambda below, step: digest(step["left"], below, step["right"]))


def build(docs: DataFrame, changed: dict[str, Column] | None = None, key: str = "doc_id", group: str = "source", fields: tuple[str, ...] = FIELDS) -> tuple[Tree, Tree]:
    """The trees of the groups and the tree above their subroots.

    The leaves carry ``key``, ``group`` and ``_given``, the hash of the row with
    the fields of ``changed`` in place of its own, which no node is made from.
    """
    own = {name: F.col(name) for name in fields}
    # Groups by name, so that a null group is told from an empty name and comes before it.
    name = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    original = leaf_digest(own)
    given = original
    for touched, value in (changed or {}).items():
        own = {**own, touched: value}
    if changed:
        given = leaf_digest(own)
    leaves = docs.select(name.alias("_group"), F.col(key).alias("_key"), F.col(group).alias("_name"), original.alias("digest"), given.alias("_given"))
    lower = grow(ranked(written(leaves, "leaves"), "_key", "digest"), "_key", "_name", "_given")
    subroots = lower.tops.select(F.lit("").alias("_group"), F.col("_group").alias("_below"), "digest")
    return lower, grow(ranked(subroots, "_below"), "_below")


def nodes(tree: Tree) -> DataFrame:
    """Every node above the leaves as (group, level, lo, hi, digest)."""
    columns = [F.expr("substring(_group, 2)").alias("group"), "level", "lo", "hi", "digest"]
    out = tree.levels[0].select(columns)
    for level in tree.levels[1:]:
        out = out.unionByName(level.select(columns))
    return out


def manifest(docs: DataFrame, changed: dict[str, Column] | None = None, key: str = "doc_id", group: str = "source", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(key, group, leaf, subroot, root, proof, folded_root, verified) of every row.

    ``proof`` has the siblings from the leaf up to the root as ``left`` and
    ``right`` texts of digests. ``folded_root`` follows it from the row as
    ``changed`` gives it, and ``verified`` tells whether that is the root.
    """
    lower, upper = build(docs, changed, key, group, fields)
    top = upper.tops.first()
    root = F.lit(top.digest if top else None).cast("string")
    groups = _leaves(with_paths(upper), "_below").select(F.col("_below").alias("_group"), F.col("digest").alias("subroot"), "path")
    leaves = _leaves(with_paths(lower, groups), "_key", "_name", "_given", "subroot")
    shown = leaves.select(
        F.col("_key").alias(key),
        F.col("_name").alias(group),
        F.col("digest").alias("leaf"),
        "subroot",
        root.alias("root"),
        F.col("path").alias("proof"),
        fold(F.col("_given"), F.col("path")).alias("folded_root"),
    )
    return shown.withColumn("verified", F.col("folded_root") == F.col("root"))


def _leaves(runs: DataFrame, *wanted: str) -> DataFrame:
    """The leaves of first-level nodes, each with its own ``path``."""
    carried = [name for name in wanted if name in runs.columns]
    each = runs.select(*carried, "total", "children", F.col("path").alias("_path"), F.explode("children").alias("_leaf"))
    stepped = F.concat(F.array(siblings("children", F.col("_leaf"))), "_path")
    path = F.when(F.col("total") == 1, F.col("_path")).otherwise(stepped).alias("path")
    return each.select(*[name if name in carried else F.col(f"_leaf.{name}") for name in wanted], F.col("_leaf.digest").alias("digest"), path)


def proof_digest(proof: Column) -> Column:
    """Hash of a proof's digests, level by level, left to right."""
    return digest(F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), ""))
