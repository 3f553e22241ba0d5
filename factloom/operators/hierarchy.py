"""Parent links to whole hierarchies by pointer doubling.

``edges`` holds one row for each node with its parent (null: a root). Only nodes that have children are doubled: every
round joins the pointers of unresolved nodes with the pointers of all of them, so the distance jumped doubles and the
path segments are concatenated. What a round resolves is written once and never moves again but as the target of later
jumps. After round k every node less than 2^k steps below its root is resolved; when a round resolves nothing, what is
left lies on a cycle or leads into one, since an unresolved node below a root would have an ancestor that the round
resolved. Nodes without children take the result of their parent by one join at the end.

The rest is doubled on its own, with the smallest name of each jumped stretch. The set of places reached after 2^k
steps shrinks to the nodes on cycles. Once no stretch lowers the minimum of another, each stretch on a cycle holds the
smallest name of that cycle; once the jump maps the set of places reached onto itself one to one, all of it is on cycles.

Parents that hold many children are salted in every join, see ``skew_join``.

Defined cases: a parent that has no row is a root; a node that is its own parent is a cycle of one; null nodes are
dropped; of repeated nodes the smallest parent counts; an empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from factloom.operators.skew_join import unique_join
from factloom.session import cut, cut_counted, read_shared, write_shared

_NONE = "CAST(array() AS ARRAY<STRING>)"


def _double(nodes: DataFrame, paths: bool) -> tuple[DataFrame, DataFrame | None]:
    """nodes(node, parent), every parent with a row: resolved nodes (node, root, depth, path from the node to the last but
    one) and, if any, those that never resolve (node)."""
    none = F.expr(_NONE)
    top = F.col("parent").isNull()
    state = nodes.select(
        "node", F.coalesce("parent", "node").alias("anc"), (~top).cast("int").alias("dist"), (F.when(top, none).otherwise(F.array("node")) if paths else none).alias("path"), top.alias("done")
    )
    path, counts = write_shared(state, left=F.count_if(~F.col("done")))
    written, left = [path], counts["left"]
    while left:
        pending = read_shared(state, written[-1]).where("NOT done").drop("done")
        # the last table holds what is resolved and what isn't, of the others only what is resolved counts
        ahead = read_shared(state, written[-1])
        if written[:-1]:
            ahead = ahead.unionByName(read_shared(state, *written[:-1]).where("done"))
        ahead = ahead.select(F.col("node").alias("anc"), F.col("anc").alias("_anc"), F.col("dist").alias("_dist"), F.col("path").alias("_path"), F.col("done").alias("_done"))
        joined = unique_join(pending, ahead, "anc", "inner", total=left)
        moved = joined.select("node", F.col("_anc").alias("anc"), (F.col("dist") + F.col("_dist")).alias("dist"), (F.concat("path", "_path") if paths else none).alias("path"), F.col("_done").alias("done"))
        path, counts = write_shared(moved, left=F.count_if(~F.col("done")))
        if counts["left"] == left:
            break
        written.append(path)
        left = counts["left"]
    resolved = read_shared(state, *written).where("done").select("node", F.col("anc").alias("root"), F.col("dist").alias("depth"), "path")
    return resolved, read_shared(state, written[-1]).where("NOT done").select("node") if left else None


def _cycles(edges: DataFrame, size: int) -> DataFrame:
    """node, root (smallest name on the cycle it is on or leads into), on (whether it is on the cycle)."""
    state = edges.select("node", F.col("parent").alias("anc"), F.col("node").alias("least"))
    while True:
        ahead = state.select(F.col("node").alias("anc"), F.col("anc").alias("_anc"), F.col("least").alias("_least"))
        step = unique_join(state, ahead, "anc", "inner", total=size).withColumn("lowered", F.col("_least") < F.col("least"))
        state, counts = cut_counted(step.select("node", F.col("_anc").alias("anc"), F.least("least", "_least").alias("least"), "lowered"), lowered=F.count_if("lowered"))
        state = state.drop("lowered")
        if counts["lowered"]:
            continue
        on = cut(state.join(state.select(F.col("anc").alias("node")).distinct(), "node", "left_semi"))
        reached = on.agg(F.count(F.lit(1)), F.countDistinct("anc")).first()
        if reached[0] == reached[1]:
            break
    landed = unique_join(state.select("node", "anc"), on.select(F.col("node").alias("anc"), F.col("least").alias("root")), "anc", "inner", total=size)
    return landed.join(on.select("node", F.lit(True).alias("on")), "node", "left").select("node", "root", F.coalesce("on", F.lit(False)).alias("on"))


def hierarchy(edges: DataFrame, paths: bool = True, keep: Sequence[str] = (), unique: bool = False) -> DataFrame:
    """node, root, depth, path and the columns ``keep`` of ``edges`` (of repeated nodes the greatest value): the path runs
    from the root (or the node where a cycle is entered) down to the node.

    depth is the number of steps to the root, -1 on a cycle, -2 for a node that leads into one. ``paths=False`` carries
    no segments and gives a null path. ``unique`` says that no node is repeated, which spares an aggregate.
    """
    kept = ["_own", *keep]
    rows = edges.where(F.col("node").isNotNull()).withColumn("_own", F.lit(True))
    one = cut(rows.select("node", "parent", *kept) if unique else rows.groupBy("node").agg(F.min("parent").alias("parent"), *(F.max(c).alias(c) for c in kept)))
    above = one.where("parent IS NOT NULL").select(F.col("parent").alias("node"), F.lit(True).alias("_inner")).distinct()
    nodes = cut(one.join(above, "node", "full").withColumn("_inner", F.coalesce("_inner", F.lit(False))))
    inner, leaves = nodes.where("_inner").drop("_inner"), nodes.where("NOT _inner").drop("_inner")

    resolved, stuck = _double(inner.select("node", "parent"), paths)
    whole = F.reverse(F.concat("path", F.array("root"))) if paths else F.lit(None).cast("array<string>")
    tree = resolved.select("node", "root", "depth", whole.alias("path"))
    if stuck is not None:
        rest, counts = cut_counted(inner.select("node", "parent").join(stuck, "node", "left_semi"), size=F.count(F.lit(1)))
        cycles = cut(_cycles(rest, counts["size"]))
        if paths:
            # with the links out of cycle nodes taken away, what leads into a cycle is a tree below it
            cutting = cut(rest.join(cycles, "node").select("node", F.when(~F.col("on"), F.col("parent")).alias("parent")))
            below = _double(cutting, True)[0].select("node", F.reverse(F.concat("path", F.array("root"))).alias("path"))
        else:
            below = cycles.select("node", whole.alias("path"))
        tree = tree.unionByName(cycles.join(below, "node").select("node", "root", F.when(F.col("on"), -1).otherwise(-2).alias("depth"), "path"))
        tree = cut(tree)
    held = tree.join(inner.select("node", *kept), "node")
    tops = leaves.where("parent IS NULL").select("node", F.col("node").alias("root"), F.lit(0).alias("depth"), (F.array("node") if paths else whole).alias("path"), *kept)
    over = tree.select(F.col("node").alias("parent"), "root", F.col("depth").alias("_depth"), F.col("path").alias("_path"))
    below = unique_join(leaves.where("parent IS NOT NULL"), over, "parent", "inner")
    hung = below.select("node", "root", F.when(F.col("_depth") < 0, -2).otherwise(F.col("_depth") + 1).alias("depth"), (F.concat("_path", F.array("node")) if paths else whole).alias("path"), *kept)
    # parents without a row of their own were walked through only
    return held.unionByName(tops).unionByName(hung).where("_own").drop("_own")


def closure(tree: DataFrame) -> DataFrame:
    """ancestor, descendant, distance for each node and each of its proper ancestors on its path."""
    steps = F.size("path") - 1
    return (
        tree.where(F.size("path") > 1)
        .select(F.col("node").alias("descendant"), steps.alias("_n"), F.posexplode("path").alias("_at", "ancestor"))
        .where(F.col("_at") < F.col("_n"))
        .select("ancestor", "descendant", (F.col("_n") - F.col("_at")).alias("distance"))
    )


def descendant_counts(tree: DataFrame) -> DataFrame:
    """node, n_descendants, n_children; counts are combined before the shuffle, so a node above all others is no hot spot."""
    return closure(tree).groupBy(F.col("ancestor").alias("node")).agg(
        F.count(F.lit(1)).alias("n_descendants"), F.sum((F.col("distance") == 1).cast("bigint")).alias("n_children")
    )
