"""Queries of the scale-out operators over the whole tables, with the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.functions.names import class_ref, class_ref_sql
from factloom.operators import dangling, hierarchy as H, nested, skewed_counts as S
from factloom.session import cut, loaded, table
from factloom.sources.store import read_tagged, write_tagged


# 1. a few keys hold most rows
def p1_callees(spark: SparkSession, root: str) -> DataFrame:
    """Rows and distinct calling classes of every callee."""
    calls = table(spark, root, "m2_invokes")
    return S.skewed_counts(
        calls,
        class_ref(F.col("callee_class_fqn")),
        F.col("callee_method_name"),
        class_ref(F.col("caller_class_fqn")),
        ("callee_class_fqn", "callee_method_name"),
    ).withColumnsRenamed({"n_distinct": "n_callers"})


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Callees that hold at least one in a hundred of all rows."""
    total = table(spark, root, "m2_invokes").count()
    return S.heavy_keys(p1_callees(spark, root), total).select("callee_class_fqn", "callee_method_name")


P1_CALLEES_SQL = f"""
SELECT callee_class_fqn, callee_method_name, count(*) AS n_rows, count(DISTINCT caller) AS n_callers
FROM (SELECT {class_ref_sql('callee_class_fqn')} AS callee_class_fqn, callee_method_name, {class_ref_sql('caller_class_fqn')} AS caller FROM m2_invokes)
WHERE callee_class_fqn IS NOT NULL AND callee_method_name <> ''
GROUP BY 1, 2
"""
P1_FOUND_SQL = f"""
SELECT callee_class_fqn, callee_method_name FROM ({P1_CALLEES_SQL}) WHERE n_rows * 100 >= (SELECT count(*) FROM m2_invokes)
"""


# 3. parent links to whole hierarchies
def class_edges(spark: SparkSession, root: str) -> DataFrame:
    """node, parent, named (whether classes or m2_classes has the name)."""
    def rows(name: str, at: str) -> DataFrame:
        return table(spark, root, name).select(
            F.col("fqn").alias("node"), F.lit(name).alias("src"), class_ref(F.col("super_fqn")).alias("super"), F.expr(at).alias("at"), F.expr("CAST(NULL AS BIGINT)" if name == "platform_classes" else "id").alias("id")
        )

    no_time = "CAST(NULL AS TIMESTAMP_NTZ)"
    every = rows("classes", "indexed_at").unionByName(rows("m2_classes", no_time)).unionByName(rows("platform_classes", no_time))
    return every.where(F.col("node").isNotNull()).groupBy("node").agg(
        F.expr(
            "coalesce(max_by(super, struct(at, id)) FILTER (WHERE src = 'classes'),"
            " min_by(super, id) FILTER (WHERE src = 'm2_classes' AND super IS NOT NULL),"
            " min(super) FILTER (WHERE src = 'platform_classes'))"
        ).alias("parent"),
        F.expr("bool_or(src <> 'platform_classes')").alias("named"),
    )


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Root and depth of every class; -1 on a cycle, -2 below one."""
    tree = H.hierarchy(class_edges(spark, root), False, ["named"], unique=True).where("named")
    return tree.select(F.col("node").alias("fqn"), F.col("root").alias("root_fqn"), F.col("depth").cast("int").alias("depth"))


def p3_hierarchy(spark: SparkSession, root: str) -> DataFrame:
    """Root, depth, path from the root and number of descendants of every class. Paths are cut where a cycle is entered, so
    a class on a cycle counts only what enters at itself, not the rest of its cycle nor what hangs there."""
    tree = cut(H.hierarchy(class_edges(spark, root), True, ["named"], unique=True))
    counts = H.descendant_counts(tree)
    return (
        tree.where("named")
        .join(counts, "node", "left")
        .select(
            F.col("node").alias("fqn"),
            F.col("root").alias("root_fqn"),
            F.col("depth").cast("int").alias("depth"),
            F.array_join("path", " > ").alias("path"),
            F.coalesce("n_descendants", F.lit(0)).alias("n_descendants"),
            F.coalesce("n_children", F.lit(0)).alias("n_children"),
        )
    )


def p3_closure(spark: SparkSession, root: str) -> DataFrame:
    """Every class with each of its descendants and the distance between them; as in p3_hierarchy, paths are cut where a
    cycle is entered: the other classes of a cycle and what hangs on them are left out."""
    return H.closure(H.hierarchy(class_edges(spark, root), True, unique=True))


_EDGES_SQL = f"""
names AS (SELECT fqn FROM classes UNION SELECT fqn FROM m2_classes UNION SELECT fqn FROM platform_classes),
c AS (SELECT fqn, sup FROM (SELECT fqn, {class_ref_sql('super_fqn')} AS sup, row_number() OVER (PARTITION BY fqn ORDER BY indexed_at DESC NULLS LAST, id DESC) AS k FROM classes) WHERE k = 1),
m AS (SELECT fqn, arg_min(sup, id) AS sup FROM (SELECT fqn, {class_ref_sql('super_fqn')} AS sup, id FROM m2_classes) WHERE sup IS NOT NULL GROUP BY fqn),
p AS (SELECT fqn, min({class_ref_sql('super_fqn')}) AS sup FROM platform_classes GROUP BY fqn),
edges AS (SELECT n.fqn, coalesce(c.sup, m.sup, p.sup) AS sup FROM names n LEFT JOIN c USING (fqn) LEFT JOIN m USING (fqn) LEFT JOIN p USING (fqn)),
walk AS (
  SELECT fqn, fqn AS cur, [fqn] AS path, false AS closed FROM edges
  UNION ALL
  SELECT w.fqn, e.sup, list_append(w.path, e.sup), list_contains(w.path, e.sup)
  FROM walk w JOIN edges e ON e.fqn = w.cur WHERE NOT w.closed AND e.sup IS NOT NULL
),
ends AS (SELECT fqn, arg_max(cur, len(path)) AS cur, arg_max(path, len(path)) AS path, bool_or(closed) AS closed FROM walk GROUP BY fqn)
"""
P3_FOUND_SQL = f"""
WITH RECURSIVE {_EDGES_SQL}
SELECT fqn,
  CASE WHEN closed THEN list_min(path[list_position(path, cur):]) ELSE cur END AS root_fqn,
  CAST(CASE WHEN NOT closed THEN len(path) - 1 WHEN list_position(path, cur) = 1 THEN -1 ELSE -2 END AS INTEGER) AS depth
FROM ends WHERE fqn IN (SELECT fqn FROM classes UNION SELECT fqn FROM m2_classes)
"""
#: with the path cut where a cycle is entered
_PATHS_SQL = """
trees AS (SELECT fqn, CASE WHEN closed THEN list_min(path[list_position(path, cur):]) ELSE cur END AS root_fqn,
  CASE WHEN NOT closed THEN len(path) - 1 WHEN list_position(path, cur) = 1 THEN -1 ELSE -2 END AS depth,
  list_reverse(CASE WHEN closed THEN path[1:list_position(path, cur)] ELSE path END) AS path FROM ends),
links AS (SELECT path[k] AS ancestor, fqn AS descendant, len(path) - k AS distance
  FROM (SELECT fqn, path, unnest(range(1, len(path))) AS k FROM trees))
"""
P3_CLOSURE_SQL = f"WITH RECURSIVE {_EDGES_SQL}, {_PATHS_SQL} SELECT ancestor, descendant, CAST(distance AS INTEGER) AS distance FROM links"
P3_HIERARCHY_SQL = f"""
WITH RECURSIVE {_EDGES_SQL}, {_PATHS_SQL},
n AS (SELECT ancestor, count(*) AS n_descendants, count(*) FILTER (WHERE distance = 1) AS n_children FROM links GROUP BY 1)
SELECT fqn, root_fqn, CAST(depth AS INTEGER) AS depth, array_to_string(path, ' > ') AS path,
  coalesce(n_descendants, 0) AS n_descendants, coalesce(n_children, 0) AS n_children
FROM trees LEFT JOIN n ON n.ancestor = fqn WHERE fqn IN (SELECT fqn FROM classes UNION SELECT fqn FROM m2_classes)
"""


# 4. nested records
def _tagged(spark: SparkSession, root: str, with_columns: bool) -> DataFrame:
    return nested.emit_tagged(table(spark, root, "raw_configs"), F.col("record_id"), F.col("payload"), with_columns)


def _flat_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The flat tables of all configurations: one pass writes them partitioned by tag, whichever is asked for first; as long
    as the configurations stay the same all queries of a session read what it wrote."""
    path = loaded(spark, root, "raw_configs", "flat", lambda: write_tagged(_tagged(spark, root, True)))
    return nested.split_tables(lambda tag: read_tagged(spark, path, tag, nested.TAGGED))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Every object of the known fields with its path."""
    return _tagged(spark, root, False).select("record_id", "node_path", "node_name")


def p4_result_maps(spark: SparkSession, root: str) -> DataFrame:
    """Flat table of result maps with what they extend."""
    return _flat_tables(spark, root)["result_maps"].drop("own_fields")


def p4_associations(spark: SparkSession, root: str) -> DataFrame:
    """Flat table of associations, linked to their parents."""
    return _flat_tables(spark, root)["associations"].drop("own_fields")


def p4_collections(spark: SparkSession, root: str) -> DataFrame:
    """Flat table of collections, linked to their parents."""
    return _flat_tables(spark, root)["collections"].drop("own_fields")


def p4_cases(spark: SparkSession, root: str) -> DataFrame:
    """Flat table of discriminator cases, linked to their parents."""
    return _flat_tables(spark, root)["cases"].drop("own_fields")


def p4_fallbacks(spark: SparkSession, root: str) -> DataFrame:
    """Flat table of fallback registries, linked to their parents."""
    return _flat_tables(spark, root)["fallbacks"].drop("own_fields")


def p4_registries(spark: SparkSession, root: str) -> DataFrame:
    """Flat table of registries."""
    return _flat_tables(spark, root)["registries"].drop("own_fields")


def p4_own_fields(spark: SparkSession, root: str) -> DataFrame:
    """What every object of the six tables holds beside their columns, as JSON."""
    tables = _flat_tables(spark, root)
    every = [df.select("record_id", "node_path", F.lit(tag).alias("tag"), "own_fields") for tag, df in tables.items()]
    return reduce(DataFrame.unionByName, every)


def p4_child_counts(spark: SparkSession, root: str) -> DataFrame:
    """Associations, collections and cases below each result map."""
    return nested.child_counts(_tagged(spark, root, False))


_FIELDS = "|".join(nested.FIELDS)
P4_FOUND_SQL = rf"""
WITH RECURSIVE texts AS (
  SELECT record_id, '' AS prefix, CAST(payload AS JSON) AS j FROM raw_configs WHERE payload IS NOT NULL AND json_valid(payload)
  UNION ALL
  SELECT record_id, prefix || substr(fullkey, 2), CAST(value ->> '$' AS JSON)
  FROM (SELECT t.record_id, t.prefix, x.fullkey, x.value, x.type FROM texts t, json_tree(t.j) x)
  WHERE type = 'VARCHAR' AND left(ltrim(value ->> '$'), 1) IN ('{{', '[') AND json_valid(value ->> '$')
), nodes AS (
  SELECT t.record_id, string_split(substr(t.prefix || substr(x.fullkey, 2), 2), '.') AS parts, x.value AS v FROM texts t, json_tree(t.j) x WHERE x.type = 'OBJECT'
), steps AS (
  SELECT record_id, v, list_transform(list_filter(parts, lambda x: regexp_full_match(x, '(?:{_FIELDS})(?:\[\d+\])?')),
    lambda x: replace(CASE WHEN x LIKE '%]' THEN x ELSE x || '[0]' END, 'resultMaps', 'result_maps')) AS steps
  FROM nodes WHERE regexp_full_match(parts[-1], '(?:{_FIELDS})(?:\[\d+\])?')
)
SELECT record_id, array_to_string(steps, '/') AS node_path, coalesce(CASE split_part(steps[-1], '[', 1)
  WHEN 'result_maps' THEN coalesce(v ->> 'map_id', v ->> 'mapId') WHEN 'cases' THEN v ->> 'value'
  WHEN 'registries' THEN coalesce(v ->> 'registry_id', v ->> 'registryId') WHEN 'fallbacks' THEN coalesce(v ->> 'registry_id', v ->> 'registryId')
  ELSE v ->> 'property' END, '') AS node_name FROM steps
"""
_REGISTRY_COLUMNS = {"registry_id": ("registry_id", "registryId"), "address": ("address",), "protocol": ("protocol",), "port": ("port",), "parameters": ("parameters",), "source_file": ()}
_P4_NODES_SQL = P4_FOUND_SQL[: P4_FOUND_SQL.index("SELECT record_id, array_to_string(steps, '/')")]


def _flat_sql(tag: str, columns: dict[str, tuple[str, ...]], name: tuple[str, ...]) -> str:
    """A flat table; the source file is that of the nearest object on the way up that names one."""
    value = lambda names: "coalesce(" + ", ".join(f"v ->> '{n}'" for n in names) + ", NULL)"
    picked = "".join(f", sources.source AS source_file" if c == "source_file" else f", {value(n)} AS {c}" for c, n in columns.items())
    nodes = _P4_NODES_SQL.replace("x.value AS v FROM", "x.value AS v, t.prefix || substr(x.fullkey, 2) AS place FROM").replace("SELECT record_id, v, list_transform", "SELECT record_id, v, place, list_transform")
    return f"""
{nodes}, named AS (
  SELECT record_id, place, coalesce(v ->> 'source_file', v ->> 'sourceFile') AS source FROM nodes WHERE coalesce(v ->> 'source_file', v ->> 'sourceFile') IS NOT NULL
), mine AS (SELECT DISTINCT record_id, place FROM steps WHERE split_part(steps[-1], '[', 1) = '{tag}'
), sources AS (
  SELECT m.record_id, m.place, arg_max(n.source, length(n.place)) AS source FROM mine m JOIN named n ON n.record_id = m.record_id
    AND (n.place = m.place OR n.place = '' OR starts_with(m.place, n.place || '.') OR starts_with(m.place, n.place || '[')) GROUP BY 1, 2
)
SELECT s.record_id, array_to_string(steps, '/') AS node_path, nullif(array_to_string(steps[:-2], '/'), '') AS parent_path,
  CAST(regexp_extract(steps[-1], '\\[(\\d+)\\]', 1) AS INTEGER) AS position, coalesce({value(name)}, '') AS node_name{picked}
FROM steps s LEFT JOIN sources ON sources.record_id = s.record_id AND sources.place = s.place WHERE split_part(steps[-1], '[', 1) = '{tag}'
"""


P4_CHILD_COUNTS_SQL = rf"""
SELECT record_id, map_path AS node_path, max(CASE WHEN node_path = map_path THEN node_name END) AS node_name,
  count(*) FILTER (WHERE last = 'associations') AS n_associations, count(*) FILTER (WHERE last = 'collections') AS n_collections, count(*) FILTER (WHERE last = 'cases') AS n_cases
FROM (SELECT *, regexp_extract(node_path, '^((?:[^/]*/)*?result_maps\[\d+\])(?:/|$)', 1) AS map_path, regexp_extract(node_path, '([a-z_]+)\[\d+\]$', 1) AS last FROM ({P4_FOUND_SQL}))
WHERE map_path <> '' GROUP BY 1, 2
"""


# 5. dangling references
def references(spark: SparkSession, root: str) -> DataFrame:
    def of(name: str, field: str, kind: str, key, at: str) -> DataFrame:
        return table(spark, root, name).select(
            F.lit(name).alias("ref_table"), F.lit(field).alias("ref_field"), F.lit(kind).alias("kind"), F.col("id").alias("row_id"), key.alias("key"), F.col(at).alias("at")
        )

    def number(field: str):
        return F.nullif(F.col(field), F.lit(0)).cast("string")

    return (
        of("m2_invokes", "callee_class_fqn", "class", class_ref(F.col("callee_class_fqn")), "extracted_at")
        .unionByName(of("dubbo_method_configs", "service_id", "service", number("service_id"), "recorded_at"))
        .unionByName(of("dubbo_method_configs", "reference_id", "reference", number("reference_id"), "recorded_at"))
        .unionByName(of("classes", "file_id", "file", number("file_id"), "indexed_at"))
    )


def reference_targets(spark: SparkSession, root: str) -> DataFrame:
    def of(name: str, kind: str, key: str, at: str, live: str) -> DataFrame:
        return table(spark, root, name).select(
            F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), F.expr(at).alias("at"), F.expr(live).alias("live")
        )

    return (
        of("classes", "class", "fqn", "indexed_at", "true")
        .unionByName(of("m2_classes", "class", "fqn", "extracted_at", "deleted_at IS NULL"))
        .unionByName(of("platform_classes", "class", "fqn", "CAST(NULL AS TIMESTAMP_NTZ)", "true"))
        .unionByName(of("dubbo_services", "service", "id", "recorded_at", "deleted_at IS NULL"))
        .unionByName(of("dubbo_references", "reference", "id", "recorded_at", "deleted_at IS NULL"))
        .unionByName(of("files", "file", "id", "indexed_at", "deleted_at IS NULL"))
    )


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """Every dangling reference with its month and cause."""
    return dangling.dangling_references(references(spark, root), reference_targets(spark, root))


def p5_report(spark: SparkSession, root: str) -> DataFrame:
    """Dangling references for each table, field, month and cause."""
    return dangling.dangling_report(p5_found(spark, root))


P5_FOUND_SQL = f"""
WITH refs AS (
  SELECT 'm2_invokes' AS ref_table, 'callee_class_fqn' AS ref_field, 'class' AS kind, id AS row_id, {class_ref_sql('callee_class_fqn')} AS key, extracted_at AS ts FROM m2_invokes
  UNION ALL SELECT 'dubbo_method_configs', 'service_id', 'service', id, CAST(nullif(service_id, 0) AS VARCHAR), recorded_at FROM dubbo_method_configs
  UNION ALL SELECT 'dubbo_method_configs', 'reference_id', 'reference', id, CAST(nullif(reference_id, 0) AS VARCHAR), recorded_at FROM dubbo_method_configs
  UNION ALL SELECT 'classes', 'file_id', 'file', id, CAST(nullif(file_id, 0) AS VARCHAR), indexed_at FROM classes
), targets AS (
  SELECT 'class' AS kind, fqn AS key, indexed_at AS ts, true AS live FROM classes
  UNION ALL SELECT 'class', fqn, extracted_at, deleted_at IS NULL FROM m2_classes
  UNION ALL SELECT 'class', fqn, TIMESTAMP '1000-01-01', true FROM platform_classes
  UNION ALL SELECT 'service', CAST(id AS VARCHAR), recorded_at, deleted_at IS NULL FROM dubbo_services
  UNION ALL SELECT 'reference', CAST(id AS VARCHAR), recorded_at, deleted_at IS NULL FROM dubbo_references
  UNION ALL SELECT 'file', CAST(id AS VARCHAR), indexed_at, deleted_at IS NULL FROM files
), states AS (
  SELECT kind, key, min(CASE WHEN live THEN coalesce(ts, TIMESTAMP '1000-01-01') END) AS first_live, true AS found FROM targets GROUP BY 1, 2
)
SELECT ref_table, ref_field, row_id, strftime(ts, '%Y-%m') AS period,
  CASE WHEN found IS NULL THEN 'missing' WHEN first_live IS NULL THEN 'deleted' ELSE 'late' END AS cause
FROM refs LEFT JOIN states USING (kind, key)
WHERE key IS NOT NULL AND (found IS NULL OR first_live IS NULL OR first_live > ts)
"""
P5_REPORT_SQL = f"SELECT ref_table, ref_field, period, cause, count(*) AS n_orphans FROM ({P5_FOUND_SQL}) GROUP BY 1, 2, 3, 4"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_callees, p3_found, p3_hierarchy, p3_closure, p4_found, p4_result_maps, p4_associations, p4_collections, p4_cases, p4_registries, p4_fallbacks, p4_own_fields, p4_child_counts, p5_found, p5_report)
}
SQL: dict[str, str] = {
    "p1_found": P1_FOUND_SQL,
    "p1_callees": P1_CALLEES_SQL,
    "p3_found": P3_FOUND_SQL,
    "p3_hierarchy": P3_HIERARCHY_SQL,
    "p3_closure": P3_CLOSURE_SQL,
    "p4_found": P4_FOUND_SQL,
    "p4_child_counts": P4_CHILD_COUNTS_SQL,
    "p4_result_maps": _flat_sql("result_maps", {"map_id": ("map_id", "mapId"), "namespace": ("namespace",), "type_fqn": ("type_fqn", "typeFqn"), "extends_": ("extends_", "extends"), "auto_mapping": ("auto_mapping", "autoMapping"), "association_count": ("association_count", "associationCount")}, ("map_id", "mapId")),
    "p4_associations": _flat_sql("associations", {"property": ("property",), "java_type": ("java_type", "javaType"), "extends_": ("extends_", "extends")}, ("property",)),
    "p4_collections": _flat_sql("collections", {"property": ("property",), "of_type": ("of_type", "ofType"), "extends_": ("extends_", "extends")}, ("property",)),
    "p4_cases": _flat_sql("cases", {"value": ("value",), "result_type": ("result_type", "resultType")}, ("value",)),
    "p4_registries": _flat_sql("registries", _REGISTRY_COLUMNS, ("registry_id", "registryId")),
    "p4_fallbacks": _flat_sql("fallbacks", _REGISTRY_COLUMNS, ("registry_id", "registryId")),
    "p5_found": P5_FOUND_SQL,
    "p5_report": P5_REPORT_SQL,
}
