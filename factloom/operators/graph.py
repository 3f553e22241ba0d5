"""Type hierarchies and call graphs. Rows O1 to O10 of the survey.

Each level of a walk is one job over DataFrames; the driver holds a loop counter and a flag, never a frontier. Levels
are cut through checkpoints, so plans stay short and lost executors are survived.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factloom.functions.symbols import dashed
from factloom.operators.skew_join import heavy, repeated, salted, unique_join
from factloom.session import cut, read_shared, write_shared


def subtype_edges(classes: DataFrame, interfaces: bool = False) -> DataFrame:
    """parent, child; with ``interfaces`` the implemented ones too (an array column)."""
    edges = classes.where(F.col("super_fqn").isNotNull() & (F.col("super_fqn") != "")).select(F.col("super_fqn").alias("parent"), F.col("fqn").alias("child"))
    if interfaces:
        edges = edges.unionByName(classes.select(F.explode("interfaces").alias("parent"), F.col("fqn").alias("child")))
    return edges.distinct()


def subtype_closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """O1, O3: root, subtype, distance for every root of ``roots(root)``; a root holds itself at 0, cycles are walked once."""
    edges = cut(edges.select(F.col("parent").alias("subtype"), "child"))
    # children of parents that hold many are spread
    hot = heavy(edges, "subtype")
    spread = salted(edges, "subtype", hot)
    start = roots.select("root", F.col("root").alias("subtype"), F.lit(0).alias("distance")).distinct()
    written, level = [write_shared(start)[0]], 0
    while True:
        level += 1
        frontier = read_shared(start, written[-1])
        step = spread.join(repeated(frontier.drop("distance"), "subtype", hot), ["subtype", "_salt"]).select("root", F.col("child").alias("subtype")).distinct()
        path, counts = write_shared(_unseen(step, read_shared(start, *written), ["root", "subtype"]).select("root", "subtype", F.lit(level).alias("distance")), n=F.count(F.lit(1)))
        if not counts["n"]:
            return read_shared(start, *written)
        written.append(path)


def _unseen(step: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``step`` whose key was not found before. What was found is narrowed to the keys of the step first, so that late
    levels, which are small, don't move all of it."""
    again = found.select(*key).join(step.select(*key), key, "left_semi")
    return step.join(again, key, "left_anti")


def class_kinds(names: DataFrame, classes: DataFrame) -> DataFrame:
    """O3: fqn, is_interface, is_abstract of each name of ``names(fqn)`` by the access flags of ``classes(fqn, access)``; a name
    that is unknown is neither."""
    flags = classes.groupBy("fqn").agg(F.bit_or("access").alias("_a"))
    bit = lambda n: F.coalesce(F.col("_a").bitwiseAND(F.lit(n)) != 0, F.lit(False))
    return names.select("fqn").distinct().join(flags, "fqn", "left").select("fqn", bit(0x200).alias("is_interface"), bit(0x400).alias("is_abstract"))


def parents(classes: DataFrame, external: DataFrame) -> DataFrame:
    """O2: fqn, parent, origin: the own super class, else that of the external classes."""
    own = classes.where(F.col("super_fqn") != "").groupBy("fqn").agg(F.min("super_fqn").alias("own"))
    out = external.where(F.col("super_fqn") != "").groupBy("fqn").agg(F.min("super_fqn").alias("ext"))
    return own.join(out, "fqn", "full").select("fqn", F.coalesce("own", "ext").alias("parent"), F.when(F.col("own").isNotNull(), "index").otherwise("external").alias("origin"))


def declaring_types(calls: DataFrame, parent: DataFrame, declared: DataFrame) -> DataFrame:
    """Owner, name, desc, declaring: the nearest type on the way up that declares the method, null without one.

    ``parent(fqn, parent)`` is unique by fqn, ``declared(fqn, name, desc)`` are the known methods. Calls still on
    their way go up one step a round; a call that meets its own owner again is on a cycle and ends.
    """
    key = ["owner", "name", "desc"]
    place = F.when(F.col("name").isNotNull() & F.col("desc").isNotNull(), F.to_json(F.struct("at", "name", "desc"))).alias("_place")
    known = declared.select(F.col("fqn").alias("at"), "name", "desc").select(place).where("_place IS NOT NULL").distinct().withColumn("_d", F.lit(True))
    up = parent.select(F.col("fqn").alias("at"), F.col("parent").alias("_up")).where("_up IS NOT NULL")
    up = cut(up)
    start = calls.select(*key).distinct().select(*key, F.col("owner").alias("at"), F.array("owner").alias("seen"))
    walking, left, written = start, None, []
    while left is None or left:
        # many calls meet at the types above all others; each round is written once, with what it settled
        met = unique_join(walking.withColumn("_place", place), known, "_place", total=left).drop("_place")
        moved = unique_join(met, up, "at", total=left).withColumn("_d", F.coalesce("_d", F.lit(False)))
        dead = ~F.col("_d") & (F.col("_up").isNull() | F.array_contains("seen", F.col("_up")))
        path, counts = write_shared(moved.withColumn("_end", dead), left=F.count_if(~F.col("_d") & ~F.col("_end")))
        state = read_shared(moved.withColumn("_end", dead), path)
        written.append(path)
        left = counts["left"]
        walking = state.where("NOT _d AND NOT _end").select(*key, F.col("_up").alias("at"), F.concat("seen", F.array("_up")).alias("seen"))
    return read_shared(state, *written).where("_d OR _end").select(*key, F.when(F.col("_d"), F.col("at")).alias("declaring"))


def expand_edges(calls: DataFrame, closure: DataFrame, expand_interfaces: bool = False) -> DataFrame:
    """calls(caller, owner, name, desc, kind, confidence, line) with all targets a call may reach and a note.

    VIRTUAL calls reach every type of the owner's closure, CERTAIN becoming PROBABLE, noted CHA; STATIC, SPECIAL and
    INTERFACE calls stay one edge; DYNAMIC ones are noted dynamic; REFLECT and framework kinds give none.
    ``closure(root, subtype)`` need not hold roots without subtypes.
    """
    virtual = F.col("kind").isin(["VIRTUAL", "INTERFACE"] if expand_interfaces else ["VIRTUAL"])
    single = calls.where(~virtual & F.col("kind").isin("STATIC", "SPECIAL", "INTERFACE", "DYNAMIC")).select(
        "caller", F.col("owner").alias("target"), "name", "desc", "kind", "confidence", "line", F.when(F.col("kind") == "DYNAMIC", "dynamic").alias("note")
    )
    wide = calls.where(virtual)
    hot = heavy(wide, "owner")
    fan = salted(wide, "owner", hot).join(repeated(closure.select(F.col("root").alias("owner"), "subtype"), "owner", hot), ["owner", "_salt"], "left").drop("_salt")
    many = fan.select(
        "caller", F.coalesce("subtype", "owner").alias("target"), "name", "desc", "kind", F.when(F.col("confidence") == "CERTAIN", "PROBABLE").otherwise(F.col("confidence")).alias("confidence"), "line", F.lit("CHA").alias("note")
    )
    return single.unionByName(many)


def call_graph(invokes: DataFrame, methods: DataFrame, classes: DataFrame, expand_interfaces: bool = False) -> DataFrame:
    """Src, dst (dashed methods), kind, confidence, line, note; calls of unknown methods are dropped."""
    callers = method_index(methods, classes).toDF("caller_method_id", "caller")
    calls = invokes.join(callers, "caller_method_id").select("caller", F.col("callee_owner").alias("owner"), F.col("callee_name").alias("name"), F.col("callee_desc").alias("desc"), "kind", "confidence", "line")
    roots = calls.where(F.col("kind").isin("VIRTUAL", *(["INTERFACE"] if expand_interfaces else []))).select(F.col("owner").alias("root")).distinct()
    closure = subtype_closure(subtype_edges(classes, expand_interfaces), roots)
    return expand_edges(calls, closure, expand_interfaces).select(F.col("caller").alias("src"), dashed(F.col("target"), F.col("name"), F.col("desc")).alias("dst"), "kind", "confidence", "line", "note")


def method_index(methods: DataFrame, classes: DataFrame) -> DataFrame:
    """Method id with its dashed name."""
    return methods.join(classes.select(F.col("id").alias("class_id"), "fqn"), "class_id").select("id", dashed(F.col("fqn"), F.col("name"), F.col("desc")).alias("method"))


def out_edges(edges: DataFrame, vertex: str) -> DataFrame:
    """Parallel edges are kept."""
    return edges.where(F.col("src") == vertex)


def in_edges(edges: DataFrame, vertex: str) -> DataFrame:
    """O8."""
    return edges.where(F.col("dst") == vertex)


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("vertex")).union(edges.select("dst")).distinct()


def reach(edges: DataFrame, start: Column | str, max_depth: int, target: str | None = None) -> DataFrame:
    """Vertex, depth, prev, of everything within ``max_depth`` edges of ``start``; stops at the level that reaches ``target``.

    The way to a vertex comes from the predecessor found first: vertices of a level are in the order of their
    predecessors and of the edges, so the orders of the edges walked, as an array, rank them exactly.
    ``edges(src, dst)`` may have ``edge_ord``; without it edges are ordered by a hash of their ends.
    """
    spark = edges.sparkSession
    order = F.col("edge_ord").cast("bigint") if "edge_ord" in edges.columns else F.xxhash64("src", "dst")
    unique = cut(edges.groupBy("src", "dst").agg(F.min(order).alias("ord")))
    first = spark.range(1).select(
        (F.lit(start) if isinstance(start, str) else start).alias("vertex"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("prev"), F.array().cast("array<bigint>").alias("rank")
    )
    written = [write_shared(first)[0]]
    for level in range(1, max_depth + 1):
        step = read_shared(first, written[-1]).select(F.col("vertex").alias("src"), "rank").join(unique, "src")
        chosen = step.groupBy(F.col("dst").alias("vertex")).agg(F.min(F.struct(F.concat("rank", F.array("ord")).alias("rank"), "src")).alias("by"))
        new = chosen.join(read_shared(first, *written).select("vertex"), "vertex", "left_anti")
        here = F.col("vertex") == target if target is not None else F.lit(False)
        path, counts = write_shared(new.select("vertex", F.lit(level).alias("depth"), F.col("by.src").alias("prev"), F.col("by.rank").alias("rank")), n=F.count(F.lit(1)), hit=F.count_if(here))
        if not counts["n"]:
            break
        written.append(path)
        if counts["hit"]:
            break
    return read_shared(first, *written).drop("rank")


def find_path(edges: DataFrame, start: str, end: str, max_depth: int = 8) -> list[str] | None:
    """A shortest path of at most ``max_depth`` edges; ``[start]`` if both ends are the same, None without a way.

    At most ``max_depth`` + 1 rows come to the driver.
    """
    if max_depth < 0:
        return None
    if start == end:
        return [start]
    found = reach(edges, start, max_depth, end)
    path: list[str] = []
    at: str | None = end
    while at is not None:
        row = found.where(F.col("vertex") == at).first()
        if row is None:
            return None
        path.append(at)
        at = row.prev
    return path[::-1]
