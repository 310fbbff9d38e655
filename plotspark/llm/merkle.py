"""A manifest of digests over a dataset: one tree per group, one tree over the groups' roots, and a proof for every row.

Rows are leaves in a total order, found by a range sort with counts per range. Every level is one self-join: a node meets its siblings by their
computed indices (index XOR 1 in a binary tree, the other slots of its run otherwise), and the rows in slot zero emit the parents. All groups
climb together, and a group whose nodes are down to one has its root. Proofs go the other way: a node's path is its own siblings followed by
its parent's path, one equality join per level. Joins are on (group, index), so neither a group nor a level is ever held by one task, and the
rows halve at every level; only the one root passes through the driver.

Defined results
* A digest is the lowercase hex sha256 of its inputs, joined; a value's input is ``-`` for null, else its UTF-8 byte count, ``:`` and itself.
* Runs hold ``fanout`` consecutive nodes, the last one fewer; a run of one is digested too, but a group's only leaf is its root.
* Rows of a group are ordered by the order column, nulls first, then by leaf, so ties and repeated rows have defined places; each row is a leaf.
* The null group comes first, the others bytewise. A null or empty text is digested like any value; texts are read whole.
* Only the named columns are read and result columns have their own names, so extra columns of any name do no harm. An empty table has no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotspark.llm.small import written
from plotspark.operators.ranking import ordered_rank, salted_join

#: Paths are written after so many levels.
LEVELS_A_WRITE = 4
#: Levels of no more nodes, whatever the dataset, are one task's work: near the roots there is nothing to deal out.
FEW_NODES = 10_000
NODE = ["grp", "idx", "n", "digest"]


def digest(*values: Column) -> Column:
    """Digest of a row's values, each with its length."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*parts), 256)


def _group_key(group: Column) -> Column:
    """Never null, and in the order nulls first, then bytewise."""
    return F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit(":"), group.cast("string")))


def _numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` (with grp) with idx, the place in the group from 0, and n, the group's size."""
    placed = ordered_rank(rows, [F.col("grp"), *order], "__place")
    groups = placed.groupBy("grp").agg(F.min("__place").alias("__first"), F.count(F.lit(1)).alias("n")).withColumn("__rows", F.col("n"))
    return salted_join(placed, groups, ["grp"], "__rows").withColumn("idx", F.col("__place") - F.col("__first")).drop("__place", "__first")


@dataclass
class Tree:
    """levels: (grp, idx, n, digest, others) of every level's nodes that have a parent; roots: (grp, level, digest); sizes: most nodes of each level."""

    levels: list[DataFrame]
    roots: DataFrame
    fanout: int
    sizes: list[int]


def _dealt(nodes: DataFrame, most: int) -> DataFrame:
    return nodes.coalesce(1) if most <= FEW_NODES else nodes


def _with_siblings(nodes: DataFrame, fanout: int) -> DataFrame:
    """``nodes`` with others, the binary digests of the rest of the node's run in slot order."""
    slot = F.col("idx") % fanout
    found, names = nodes, []
    for shift in range(1, fanout):
        at = F.col("idx").bitwiseXOR(F.lit(1)) if fanout == 2 else F.col("idx") - slot + (slot + shift) % fanout
        sibling = nodes.select("grp", at.alias("idx"), F.struct(F.col("idx").alias("i"), F.unhex("digest").alias("d")).alias(f"__s{shift}"))
        found = found.join(sibling, ["grp", "idx"], "left")
        names.append(f"__s{shift}")
    run = F.array_sort(F.filter(F.array(*names), lambda s: s.isNotNull()))
    others = F.aggregate(run, F.lit(b""), lambda joined, s: F.concat(joined, s["d"]))
    return found.select(*NODE, others.alias("others"))


def _joined(slot: Column, own: Column, others: Column) -> Column:
    """Digest of a run from one node's slot and digest and its siblings."""
    rest = F.lower(F.hex(others))
    return F.sha2(F.concat(F.substring(rest, F.lit(1), slot * 64), own, F.substring(rest, slot * 64 + 1, F.length(rest))), 256)


def build(leaves: DataFrame, fanout: int = 2) -> Tree:
    """The trees of all groups of ``leaves`` (grp, idx, n, digest)."""
    if fanout < 2:
        raise ValueError("a run needs two nodes or more")
    nodes = leaves.select(*NODE)
    most, total, groups = nodes.agg(F.max("n"), F.count(F.lit(1)), F.count_if(F.col("idx") == 0)).first()
    most = most or 0
    levels, roots, sizes = [], [], []
    while True:
        sizes.append(total // fanout ** len(levels) + groups)
        nodes = _dealt(nodes, sizes[-1])
        roots.append(nodes.where("n = 1").select("grp", F.lit(len(levels)).alias("level"), "digest"))
        if most <= 1:
            break
        level = written(_with_siblings(nodes.where("n > 1"), fanout))
        levels.append(level)
        slot_zero = level.where(F.col("idx") % fanout == 0)
        nodes = slot_zero.select("grp", F.floor(F.col("idx") / fanout).alias("idx"), F.ceil(F.col("n") / fanout).alias("n"), _joined(F.lit(0), F.col("digest"), F.col("others")).alias("digest"))
        most = -(-most // fanout)
    every = roots[0]
    for more in roots[1:]:
        every = every.unionAll(more)
    return Tree(levels, written(every), fanout, sizes)


def paths(tree: Tree, above: DataFrame) -> DataFrame:
    """grp, idx, path of every leaf: array of (slot, others) from its own level up, and then what ``above`` (grp, path) has for its group's root."""
    groups = tree.sizes[-1]
    tops = written(_dealt(tree.roots.select("grp", "level"), groups).join(_dealt(above, groups), "grp"))

    def roots_at(level: int) -> DataFrame:
        return tops.where(F.col("level") == level).select("grp", F.lit(0).cast("bigint").alias("idx"), "path")

    found = _dealt(roots_at(len(tree.levels)), groups)
    for k in range(len(tree.levels) - 1, -1, -1):
        step = F.struct((F.col("idx") % tree.fanout).cast("int").alias("slot"), "others").alias("step")
        nodes = tree.levels[k].select("grp", "idx", F.floor(F.col("idx") / tree.fanout).alias("up"), step)
        joined = _dealt(nodes, tree.sizes[k]).join(found.withColumnRenamed("idx", "up"), ["grp", "up"])
        found = _dealt(joined.select("grp", "idx", F.concat(F.array("step"), "path").alias("path")).unionAll(roots_at(k)), tree.sizes[k])
        if k and k % LEVELS_A_WRITE == 0:
            found = written(found)
    return found


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda own, step: _joined(step["slot"], own, step["others"]))


def proof(path: Column) -> Column:
    """All siblings of a path as hex text, from the leaf's level up."""
    return F.array_join(F.transform(path, lambda step: F.lower(F.hex(step["others"]))), "")


def manifest(rows: DataFrame, leaf: Column, group: str, order: str, carry: tuple[str, ...] = (), fanout: int = 2) -> DataFrame:
    """Every row's order column, ``carry`` columns, leaf, subroot, root and path (array of slot and siblings)."""
    slim = rows.select(_group_key(F.col(group)).alias("grp"), F.col(order).alias("__order"), leaf.alias("digest"), *[F.col(c).alias(f"__c{i}") for i, c in enumerate(carry)])
    leaves = written(_numbered(slim, [F.col("__order").asc_nulls_first(), F.col("digest")]))
    tree = build(leaves, fanout)
    named = tree.roots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest")
    if tree.sizes[-1] <= FEW_NODES:
        one = Window.partitionBy("grp")
        subroots = named.coalesce(1).withColumns({"idx": (F.row_number().over(one.orderBy("name")) - 1).cast("bigint"), "n": F.count(F.lit(1)).over(one)})
    else:
        subroots = _numbered(named, [F.col("name")])
    subroots = written(subroots)
    upper = build(subroots, fanout)
    root = upper.roots.first()
    empty = F.from_json(F.lit("[]"), "array<struct<slot: int, others: binary>>")
    above = paths(upper, upper.roots.select("grp", empty.alias("path")))
    above = above.join(subroots.select("grp", "idx", "name"), ["grp", "idx"]).select(F.col("name").alias("grp"), "path")
    sized = tree.roots.select("grp", F.col("digest").alias("subroot")).join(leaves.where("idx = 0").select("grp", F.col("n").alias("__rows")), "grp")
    placed = salted_join(leaves, written(sized), ["grp"], "__rows").join(paths(tree, above), ["grp", "idx"])
    carried = [F.col(f"__c{i}").alias(c) for i, c in enumerate(carry)]
    return placed.select(F.col("__order").alias(order), *carried, F.col("digest").alias("leaf"), "subroot", F.lit(root["digest"] if root else None).cast("string").alias("root"), "path")


def verify(found: DataFrame, leaf: Column) -> DataFrame:
    """``found``, a manifest, with folded_root, recomputed from ``leaf`` and the path, and verified, whether it is the root."""
    return found.withColumn("folded_root", folded(leaf, F.col("path"))).withColumn("verified", F.col("folded_root") == F.col("root"))
