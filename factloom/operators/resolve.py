"""Dependency graphs and classes outside the index. Rows S7 to S9 and O11 to O13 of the survey."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from factloom.session import cut, read_shared, write_shared

_GAV = ["group", "artifact", "version"]


def effective_versions(declared: DataFrame, managed: DataFrame) -> DataFrame:
    """declared(pom, group, artifact, version, ...) with missing versions from managed(pom, group, artifact, version, priority), the smallest priority first."""
    pick = managed.where(F.col("version").isNotNull()).groupBy("pom", "group", "artifact").agg(F.min_by("version", "priority").alias("_m"))
    return declared.join(pick, ["pom", "group", "artifact"], "left").withColumn("version", F.coalesce("version", "_m")).drop("_m")


def resolve_dependencies(edges: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """Group, artifact, version, scope, depth of everything within ``max_depth`` steps of ``roots(pom)``.

    edges(pom, group, artifact, version, scope, type): direct dependencies of each known POM, pom being its coordinate
    text. A dependency is expanded unless it is neither a jar nor of compile scope, and once, at its smallest depth:
    level by level, where a depth-first walk would cut a node it first meets on a long branch.
    """
    coordinate = F.concat_ws(":", *_GAV)
    edges = cut(edges.where(F.col("version").isNotNull()).withColumn("gav", coordinate))
    top = cut(roots.select(F.col("pom").alias("gav")).distinct())
    frontier, written, like = top, [], None
    for depth in range(1, max_depth + 1):
        step = edges.join(frontier.select(F.col("gav").alias("pom")), "pom").join(top, "gav", "left_anti")
        if like is not None:
            step = step.join(read_shared(like, *written).select("gav"), "gav", "left_anti")
        found = step.groupBy("gav", *_GAV).agg(F.min("scope").alias("scope"), F.bool_or((F.col("type") == "jar") | (F.col("scope") == "compile")).alias("_go")).withColumn("depth", F.lit(depth))
        path, counts = write_shared(found, n=F.count(F.lit(1)))
        if not counts["n"]:
            break
        # each level is written once
        written.append(path)
        like = found
        frontier = read_shared(like, path).where("_go").select("gav")
    if like is None:
        return edges.limit(0).select(*_GAV, "scope", F.lit(0).alias("depth"))
    return read_shared(like, *written).select(*_GAV, "scope", "depth")


def external_classes(jars: DataFrame) -> DataFrame:
    """The header of each class from the first jar (by order) that holds it: jars(jar_order, jar_path, fqn, super_fqn, ...)."""
    rest = [c for c in jars.columns if c not in ("fqn", "jar_order")]
    return jars.groupBy("fqn").agg(F.min_by(F.struct(*rest), F.struct("jar_order", "jar_path")).alias("_x")).select("fqn", "_x.*")


def resolve_external(wanted: DataFrame, external: DataFrame) -> DataFrame:
    """wanted(fqn) with found, true or false: misses are kept too, so they are not looked for again."""
    return wanted.select("fqn").distinct().join(external, "fqn", "left").withColumn("found", F.col("jar_path").isNotNull())


def missing_classes(wanted: DataFrame, classes: DataFrame) -> DataFrame:
    """Names that are not indexed yet."""
    return wanted.select("fqn").distinct().join(classes.select("fqn"), "fqn", "left_anti")


def implementation_of(interfaces: DataFrame, subtypes: DataFrame) -> DataFrame:
    """Interface, implementation: the first known subtype by name of each, null without one; subtypes(parent, child)."""
    first = subtypes.groupBy(F.col("parent").alias("interface")).agg(F.min("child").alias("implementation"))
    return interfaces.select("interface").distinct().join(first, "interface", "left")
