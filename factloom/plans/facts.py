"""Queries of the fact operators over tables derived from the whole call and class tables, with the SQL each is checked against.

Methods, fields and cached archives are derived by plain rules (smallest id of a natural key), the same in both
languages; what is checked is the operator that reads them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.functions import coordinates as C
from factloom.functions import symbols as S
from factloom.functions import text as X
from factloom.functions.names import class_ref, class_ref_sql
from factloom.operators import graph, lookup, maintain, resolve, search, wiring
from factloom.plans.catalog import CALLS_SQL, SUPER, _BEANS_SQL, _bean_rows, _catalogue, calls
from factloom.session import table

QUERIES, SQL, query = _catalogue()

# ---- derived tables ------------------------------------------------------------------------------------------------


def classes(spark: SparkSession, root: str) -> DataFrame:
    """One row for each external class: id, fqn, super_fqn, interfaces, access."""
    rows = table(spark, root, "m2_classes").select("fqn", "id", class_ref(F.col("super_fqn")).alias("super_fqn"), "access_flags", "interfaces")
    one = maintain.keep_first(rows, ["fqn"])
    return one.select("id", "fqn", "super_fqn", S.decode_interfaces(F.col("interfaces")).alias("interfaces"), F.col("access_flags").alias("access"))


def methods(spark: SparkSession, root: str) -> DataFrame:
    """Called methods of external classes, and the calling ones by id: id, class_id, name, desc."""
    known = classes(spark, root).select(F.col("id").alias("class_id"), "fqn")
    c = calls(spark, root)
    callers = c.where("caller_method_id IS NOT NULL").join(known, F.col("caller") == F.col("fqn")).groupBy(F.col("caller_method_id").alias("id")).agg(F.min("class_id").alias("class_id"))
    called = c.where("callee_name IS NOT NULL AND callee_desc IS NOT NULL").join(known, F.col("callee_owner") == F.col("fqn")).groupBy("class_id", "callee_name", "callee_desc").agg(F.min("id").alias("first"))
    own = callers.select("id", "class_id", F.concat(F.lit("m"), F.col("id")).alias("name"), F.lit("()V").alias("desc"))
    return own.unionByName(called.select((F.col("first") + 10**12).alias("id"), "class_id", F.col("callee_name").alias("name"), F.col("callee_desc").alias("desc")))


def invokes(spark: SparkSession, root: str) -> DataFrame:
    """Calls in the shape of the fact tables: reflective ones are uncertain, some of the others are static or interface calls."""
    kind = F.when(F.col("call_kind") == "invoke_dynamic", "DYNAMIC").when(F.col("call_kind") == "reflection", "REFLECT").otherwise(F.element_at(F.array(*map(F.lit, ("VIRTUAL", "STATIC", "INTERFACE", "SPECIAL"))), (F.col("id") % 4 + 1).cast("int")))
    sure = F.when(F.col("call_kind") == "reflection", "UNCERTAIN").when(F.col("call_kind") == "invoke_dynamic", "PROBABLE").otherwise("CERTAIN")
    return calls(spark, root).select("id", "caller_method_id", "callee_owner", "callee_name", "callee_desc", kind.alias("kind"), (F.col("id") % 97).cast("int").alias("line"), sure.alias("confidence"))


BASE_SQL = f"""
cls AS (SELECT fqn, min(id) AS id, arg_min({{sup}}, id) AS x, (arg_min([{SUPER}], id))[1] AS super_fqn, arg_min(access_flags, id) AS access, (arg_min([interfaces], id))[1] AS interfaces FROM m2_classes GROUP BY fqn),
calls AS (SELECT * FROM {CALLS_SQL}),
mth AS (
  SELECT caller_method_id AS id, min(k.id) AS class_id, 'm' || caller_method_id AS name, '()V' AS "desc" FROM calls JOIN cls k ON k.fqn = caller WHERE caller_method_id IS NOT NULL GROUP BY caller_method_id
  UNION ALL SELECT min(c.id) + 1000000000000, k.id, callee_name, callee_desc FROM calls c JOIN cls k ON k.fqn = callee_owner WHERE callee_name IS NOT NULL AND callee_desc IS NOT NULL GROUP BY k.id, callee_name, callee_desc),
inv AS (SELECT id, caller_method_id, callee_owner, callee_name, callee_desc,
  CASE call_kind WHEN 'invoke_dynamic' THEN 'DYNAMIC' WHEN 'reflection' THEN 'REFLECT' ELSE (['VIRTUAL', 'STATIC', 'INTERFACE', 'SPECIAL'])[CAST(id % 4 + 1 AS INTEGER)] END AS kind,
  CAST(id % 97 AS INTEGER) AS line, CASE call_kind WHEN 'reflection' THEN 'UNCERTAIN' WHEN 'invoke_dynamic' THEN 'PROBABLE' ELSE 'CERTAIN' END AS confidence FROM calls)
""".replace("arg_min({sup}, id) AS x, ", "")
FACTS_SQL = f"WITH {BASE_SQL}"


# ---- lookups -------------------------------------------------------------------------------------------------------


@query(f"{FACTS_SQL} SELECT i.* FROM inv i WHERE callee_owner = (SELECT min(k.fqn) FROM mth m JOIN cls k ON k.id = m.class_id JOIN calls c ON c.callee_owner = k.fqn) AND confidence <> 'UNCERTAIN' AND EXISTS (SELECT 1 FROM mth m JOIN cls k ON k.id = m.class_id WHERE k.fqn = i.callee_owner AND m.name = i.callee_name AND m.\"desc\" = i.callee_desc)")
def callers_of_declared(spark, root):
    """Certain calls of each method of a class, through both joins."""
    known, m, i = classes(spark, root), methods(spark, root), invokes(spark, root)
    called = known.join(i.select(F.col("callee_owner").alias("fqn")), "fqn", "left_semi").join(m.select(F.col("class_id").alias("id")), "id", "left_semi")
    owner = called.agg(F.min("fqn")).first()[0] or ""
    names = [r.name for r in lookup.members(m, known, owner).select("name").distinct().collect()]  # the methods of one class
    found = reduce(DataFrame.unionByName, [lookup.callers(i, owner.replace("/", "."), n) for n in names or [""]])
    return lookup.declared_only(found, m, known)


@query(f"{FACTS_SQL} SELECT i.* FROM inv i WHERE EXISTS (SELECT 1 FROM mth m JOIN cls k ON k.id = m.class_id WHERE k.fqn = i.callee_owner AND m.name = i.callee_name AND m.\"desc\" = i.callee_desc)")
def declared_calls(spark, root):
    """All calls whose target is a known method."""
    return lookup.declared_only(invokes(spark, root), methods(spark, root), classes(spark, root))


@query(f"{FACTS_SQL} SELECT * FROM inv WHERE confidence <> 'UNCERTAIN'")
def certain_calls(spark, root):
    """F16."""
    return lookup.without_uncertain(invokes(spark, root))


_FIRST_CLASS = "(SELECT min(k.fqn) FROM cls k JOIN mth m ON m.class_id = k.id)"


def _first_class(spark, root) -> str:
    return classes(spark, root).join(methods(spark, root).select(F.col("class_id").alias("id")), "id", "left_semi").agg(F.min("fqn")).first()[0] or ""


@query(f"{FACTS_SQL} SELECT m.id, m.class_id, m.name, m.\"desc\", k.fqn AS owner FROM mth m JOIN cls k ON k.id = m.class_id WHERE k.fqn = {_FIRST_CLASS}")
def methods_of_class(spark, root):
    """Methods of one class by id."""
    return lookup.members(methods(spark, root), classes(spark, root), _first_class(spark, root)).select("id", "class_id", "name", "desc", "owner")


@query(f"{FACTS_SQL}, one AS (SELECT m.* FROM mth m JOIN cls k ON k.id = m.class_id WHERE k.fqn = {_FIRST_CLASS} ORDER BY m.id LIMIT 1) SELECT m.id, m.class_id, m.name, m.\"desc\", k.fqn AS owner FROM one o JOIN mth m ON m.class_id = o.class_id AND m.name = o.name AND m.\"desc\" = o.\"desc\" JOIN cls k ON k.id = m.class_id")
def describe_method(spark, root):
    """One method by owner, name and descriptor."""
    owner, m = _first_class(spark, root), methods(spark, root)
    one = lookup.members(m, classes(spark, root), owner).first()
    return lookup.members(m, classes(spark, root), owner.replace("/", "."), one.name if one else "", one.desc if one else "").select("id", "class_id", "name", "desc", "owner")


def _fields(spark, root) -> DataFrame:
    return methods(spark, root).where("desc = '()V'").select("id", "class_id", F.concat(F.lit("f"), F.col("id") % 3).alias("name"), F.lit("I").alias("desc"))


@query(f"{FACTS_SQL}, fld AS (SELECT id, class_id, 'f' || (id % 3) AS name, 'I' AS \"desc\" FROM mth WHERE \"desc\" = '()V') SELECT f.id, f.name, k.fqn AS owner FROM fld f JOIN cls k ON k.id = f.class_id WHERE k.fqn = (SELECT min(k.fqn) FROM cls k JOIN fld f ON f.class_id = k.id) AND f.name = 'f1'")
def fields_of_class(spark, root):
    """A field by its owner."""
    f = _fields(spark, root)
    owner = classes(spark, root).join(f.select(F.col("class_id").alias("id")), "id", "left_semi").agg(F.min("fqn")).first()[0] or ""
    return lookup.members(f, classes(spark, root), owner, "f1").select("id", "name", "owner")


@query(f"{FACTS_SQL} SELECT i.id, m.class_id AS m2_class_id, m.name AS caller_name FROM inv i JOIN mth m ON m.id = i.caller_method_id")
def outgoing_calls(spark, root):
    """Calls with the method that makes them."""
    m = methods(spark, root).withColumnRenamed("class_id", "m2_class_id")
    return lookup.outgoing(invokes(spark, root).withColumnRenamed("caller_method_id", "caller_m2_method_id"), m).select("id", "m2_class_id", "caller_name")


@query(f"{FACTS_SQL} SELECT m.id, k.fqn || '#' || m.name || m.\"desc\" AS method FROM mth m JOIN cls k ON k.id = m.class_id")
def method_index(spark, root):
    """J6, O10, C6."""
    return graph.method_index(methods(spark, root), classes(spark, root))


@query(f"WITH b AS {_BEANS_SQL} SELECT * FROM b WHERE type_fqn = (SELECT min(type_fqn) FROM b)")
def beans_of_type(spark, root):
    """the type wins over the name."""
    b = _bean_rows(spark, root)
    first = b.agg(F.min("type_fqn")).first()[0] or ""
    return lookup.first_given(b, ("type_fqn", first.replace("/", "."), True), ("name", "none", False))


@query(f"WITH b AS {_BEANS_SQL} SELECT * FROM b WHERE name = (SELECT max(name) FROM b)")
def beans_of_name(spark, root):
    """the name where no type is given."""
    b = _bean_rows(spark, root)
    return lookup.first_given(b, ("type_fqn", None, True), ("name", b.agg(F.max("name")).first()[0], False))


@query(f"WITH b AS {_BEANS_SQL}, o AS (SELECT name, type_fqn FROM b ORDER BY name, id LIMIT 1) SELECT b.* FROM b JOIN o USING (name, type_fqn) ORDER BY id LIMIT 1")
def bean_by_name_and_type(spark, root):
    """F3."""
    b = _bean_rows(spark, root)
    one = b.orderBy("name", "id").first()
    return lookup.bean_of(b, one.name if one else "", one.type_fqn if one else "")


_SITES_SQL = f"(SELECT r.id, c.id AS owner_class_id, {class_ref_sql('r.interface_fqn')} AS type_fqn FROM dubbo_references r JOIN (SELECT fqn, min(id) AS id FROM classes GROUP BY 1) c ON c.fqn = {class_ref_sql('r.interface_fqn')})"


@query(f"WITH s AS {_SITES_SQL} SELECT s.* FROM s WHERE owner_class_id IN (SELECT id FROM classes WHERE fqn = (SELECT min(type_fqn) FROM s))")
def injects_of_class(spark, root):
    """through the class's id."""
    c = table(spark, root, "classes").groupBy("fqn").agg(F.min("id").alias("id"))
    sites = table(spark, root, "dubbo_references").select("id", class_ref(F.col("interface_fqn")).alias("type_fqn")).join(c.select(F.col("id").alias("owner_class_id"), F.col("fqn").alias("type_fqn")), "type_fqn")
    return lookup.injects_of(sites, table(spark, root, "classes"), sites.agg(F.min("type_fqn")).first()[0] or "none").select("id", "owner_class_id", "type_fqn")


def _service_rows(spark, root) -> DataFrame:
    return table(spark, root, "dubbo_services").select("id", class_ref(F.col("interface_fqn")).alias("interface_fqn"), "impl_class_id", "protocol")


_SERVICES_SQL = f"(SELECT id, {class_ref_sql('interface_fqn')} AS interface_fqn, impl_class_id, protocol FROM dubbo_services)"


@query(f"WITH s AS {_SERVICES_SQL} SELECT * FROM s WHERE interface_fqn = (SELECT min(interface_fqn) FROM s)")
def services_of_interface(spark, root):
    """F5."""
    s = _service_rows(spark, root)
    return lookup.services_of(s, (s.agg(F.min("interface_fqn")).first()[0] or "none").replace("/", "."))


_REFS_SQL = f"(SELECT id, {class_ref_sql('interface_fqn')} AS interface_fqn, ref_id, 'c/' || (field_id % 5) AS consumer_class_fqn FROM dubbo_references)"


@query(f"WITH r AS {_REFS_SQL} SELECT * FROM r WHERE consumer_class_fqn = 'c/0' AND interface_fqn = (SELECT max(interface_fqn) FROM r WHERE consumer_class_fqn = 'c/0')")
def references_of_consumer(spark, root):
    """consumer and interface together."""
    r = table(spark, root, "dubbo_references").select("id", class_ref(F.col("interface_fqn")).alias("interface_fqn"), "ref_id", F.concat(F.lit("c/"), F.col("field_id") % 5).alias("consumer_class_fqn"))
    last = r.where("consumer_class_fqn = 'c/0'").agg(F.max("interface_fqn")).first()[0] or "none"
    return lookup.references_of(r, last.replace("/", "."), "c.0")


_CONFIGS = ["id", "service_id", "reference_id", "method_name"]


@query("SELECT id, service_id, reference_id, method_name FROM dubbo_method_configs WHERE service_id = (SELECT max(service_id) FROM dubbo_method_configs)")
def method_configs_of_service(spark, root):
    """the service wins over the reference."""
    c = table(spark, root, "dubbo_method_configs").select(*_CONFIGS)
    return lookup.method_configs_of(c, c.agg(F.max("service_id")).first()[0] or -1, 1)


@query("SELECT id, service_id, reference_id, method_name FROM dubbo_method_configs WHERE reference_id = (SELECT max(reference_id) FROM dubbo_method_configs)")
def method_configs_of_reference(spark, root):
    """by reference."""
    c = table(spark, root, "dubbo_method_configs").select(*_CONFIGS)
    return lookup.method_configs_of(c, 0, c.agg(F.max("reference_id")).first()[0] or -1)


@query("WITH o AS (SELECT service_id, method_name FROM dubbo_method_configs WHERE service_id > 0 ORDER BY service_id, method_name LIMIT 1) SELECT c.id, c.service_id, c.reference_id, c.method_name FROM dubbo_method_configs c JOIN o USING (service_id, method_name) ORDER BY id LIMIT 1")
def method_config_by_name(spark, root):
    """F8."""
    c = table(spark, root, "dubbo_method_configs").select(*_CONFIGS)
    one = c.where("service_id > 0").orderBy("service_id", "method_name").first()
    return lookup.method_config_of(c, one.service_id if one else -1, one.method_name if one else "")


@query("WITH r AS (SELECT min(id) AS id, registry_id, min(protocol) AS protocol FROM dubbo_services WHERE registry_id <> '' GROUP BY registry_id) SELECT * FROM r WHERE registry_id = (SELECT max(registry_id) FROM r) UNION ALL SELECT * FROM r WHERE protocol = 'tri'")
def registries(spark, root):
    """by id, then by protocol."""
    r = table(spark, root, "dubbo_services").where("registry_id <> ''").groupBy("registry_id").agg(F.min("id").alias("id"), F.min("protocol").alias("protocol")).select("id", "registry_id", "protocol")
    last = r.agg(F.max("registry_id")).first()[0] or "none"
    of = lambda name, protocol: lookup.first_given(r, ("registry_id", name, False), ("protocol", protocol, False))
    return of(last, "tri").unionByName(of("", "tri"))


@query("SELECT DISTINCT mapper_namespace, replace(mapper_namespace, '.', '/') AS type_fqn FROM mybatis_statements WHERE replace(mapper_namespace, '.', '/') = (SELECT max(replace(mapper_namespace, '.', '/')) FROM mybatis_statements)")
def result_maps_of_type(spark, root):
    """by row type where no mapper is given."""
    m = table(spark, root, "mybatis_statements").select("mapper_namespace", F.translate("mapper_namespace", ".", "/").alias("type_fqn")).distinct()
    return lookup.result_maps_of(m, None, (m.agg(F.max("type_fqn")).first()[0] or "none").replace("/", "."))


_CONDITIONS_SQL = "(SELECT id, fqn AS autoconfig_class, CASE WHEN id % 2 = 0 THEN 'on_class' ELSE 'on_property' END AS condition_type, coalesce(super_fqn, '') AS required_class FROM classes)"


def _conditions(spark, root) -> DataFrame:
    return table(spark, root, "classes").select("id", F.col("fqn").alias("autoconfig_class"), F.when(F.col("id") % 2 == 0, "on_class").otherwise("on_property").alias("condition_type"), F.coalesce("super_fqn", F.lit("")).alias("required_class"))


@query(f"WITH c AS {_CONDITIONS_SQL} SELECT * FROM c WHERE autoconfig_class = (SELECT min(autoconfig_class) FROM c) UNION ALL SELECT * FROM c WHERE condition_type = 'on_property'")
def conditions_of(spark, root):
    """by class, then by type."""
    c = _conditions(spark, root)
    first = c.agg(F.min("autoconfig_class")).first()[0] or "none"
    of = lambda name, kind: lookup.first_given(c, ("autoconfig_class", name, True), ("required_class", "", False), ("condition_type", kind, False))
    return of(first.replace("/", "."), "x").unionByName(of(None, "on_property"))


def _issues(spark, root) -> DataFrame:
    return table(spark, root, "classes").where("file_id IS NULL").select("id", F.when(F.col("id") % 3 == 0, "").otherwise("missing_source").alias("kind"), F.col("fqn").alias("target"))


@query("SELECT id, 'missing_source' AS kind, fqn AS target FROM classes WHERE file_id IS NULL AND id % 3 <> 0")
def issues_of_kind(spark, root):
    """an empty kind finds nothing."""
    i = _issues(spark, root)
    return lookup.issues_of(i, "missing_source").unionByName(lookup.issues_of(i, "")).unionByName(lookup.issues_of(i, None))


@query("SELECT id, rel_path FROM files WHERE rel_path = (SELECT min(rel_path) FROM files) UNION ALL SELECT id, rel_path FROM files WHERE id = (SELECT max(id) FROM files)")
def files_by_path_and_id(spark, root):
    """F17."""
    f = table(spark, root, "files").select("id", "rel_path")
    ends = f.agg(F.min("rel_path"), F.max("id")).first()
    return lookup.equal_to(f, rel_path=ends[0]).unionByName(lookup.equal_to(f, id=ends[1]))


@query("WITH o AS (SELECT fqn, jar_path FROM m2_classes ORDER BY fqn, jar_path LIMIT 1) SELECT id, fqn, jar_path FROM m2_classes JOIN o USING (fqn, jar_path) UNION ALL SELECT id, fqn, jar_path FROM m2_classes WHERE jar_path = (SELECT max(jar_path) FROM m2_classes)")
def external_by_name_and_archive(spark, root):
    """a class by name and archive, all classes of an archive."""
    m = table(spark, root, "m2_classes").select("id", "fqn", "jar_path")
    one = m.orderBy("fqn", "jar_path").first()
    return lookup.equal_to(m, fqn=one.fqn if one else "", jar_path=one.jar_path if one else "").unionByName(lookup.equal_to(m, jar_path=m.agg(F.max("jar_path")).first()[0]))


@query(f"SELECT id, caller FROM {CALLS_SQL} WHERE callee_owner = 'vireo/rt/Checks'")
def incoming_calls(spark, root):
    """calls that come in to a class."""
    return lookup.equal_to(calls(spark, root), callee_owner="vireo/rt/Checks").select("id", "caller")


@query("SELECT id, fqn FROM classes ORDER BY id LIMIT 1000")
def first_page(spark, root):
    """L4: a page in a defined order."""
    return lookup.stable_limit(table(spark, root, "classes").select("id", "fqn"), 1000)


@query("SELECT 'classes' AS table_name, max(indexed_at) AS last_indexed FROM classes UNION ALL SELECT 'files', max(indexed_at) FROM files UNION ALL SELECT 'mybatis_statements', max(indexed_at) FROM mybatis_statements")
def last_indexed(spark, root):
    """A3."""
    return lookup.last_indexed({t: table(spark, root, t) for t in ("classes", "files", "mybatis_statements", "m2_classes")})


@query("WITH g AS (SELECT DISTINCT 'g' AS gav_group, regexp_extract(jar_path, '([^/]*)-(\\d[^/]*)\\.jar$', 1) AS gav_artifact, regexp_extract(jar_path, '([^/]*)-(\\d[^/]*)\\.jar$', 2) AS gav_version FROM m2_classes WHERE regexp_matches(jar_path, '-\\d[^/]*\\.jar$')) SELECT gav_group, gav_artifact, max_by(gav_version, (coalesce(try_cast(split_part(gav_version, '.', 1) AS INTEGER), 0), coalesce(try_cast(split_part(gav_version, '.', 2) AS INTEGER), 0), coalesce(try_cast(split_part(split_part(gav_version, '-', 1), '.', 3) AS INTEGER), 0))) AS gav_version FROM g GROUP BY 1, 2")
def artifact_versions(spark, root):
    """L2, C14."""
    made = table(spark, root, "m2_classes").where(F.col("jar_path").rlike(r"-\d[^/]*\.jar$")).select(F.lit("g").alias("gav_group"), F.regexp_extract("jar_path", r"([^/]*)-(\d[^/]*)\.jar$", 1).alias("gav_artifact"), F.regexp_extract("jar_path", r"([^/]*)-(\d[^/]*)\.jar$", 2).alias("gav_version")).distinct()
    return lookup.latest_version(made.withColumn("id", F.xxhash64("gav_artifact", "gav_version")))


@query("SELECT CAST(max_by(n_name, n_key) AS VARCHAR) AS version FROM (SELECT n_nationkey AS n_key, n_name FROM nation)")
def schema_version(spark, root):
    """L5, over any table with a rank."""
    return lookup.schema_version(table(spark, root, "nation").select(F.col("n_nationkey").alias("installed_rank"), F.col("n_name").alias("version")))


# ---- graphs --------------------------------------------------------------------------------------------------------

_CLOSURE_SQL = """
edges AS (SELECT DISTINCT super_fqn AS parent, fqn AS child FROM cls WHERE super_fqn IS NOT NULL AND super_fqn <> ''),
walk AS (SELECT DISTINCT callee_owner AS root, callee_owner AS subtype, 0 AS d FROM inv WHERE kind = 'VIRTUAL' AND callee_owner IS NOT NULL
  UNION ALL SELECT w.root, e.child, w.d + 1 FROM walk w JOIN edges e ON e.parent = w.subtype WHERE w.d < 70),
closure AS (SELECT DISTINCT root, subtype FROM walk),
src AS (SELECT m.id AS caller_method_id, k.fqn || '#' || m.name || m."desc" AS src FROM mth m JOIN cls k ON k.id = m.class_id)"""
_GRAPH_SQL = f"""{FACTS_SQL.replace('WITH', 'WITH RECURSIVE', 1)}, {_CLOSURE_SQL},
graph AS (
  SELECT src, subtype || '#' || callee_name || callee_desc AS dst, kind, CASE confidence WHEN 'CERTAIN' THEN 'PROBABLE' ELSE confidence END AS confidence, line, 'CHA' AS note FROM inv JOIN src USING (caller_method_id) JOIN closure ON root = callee_owner WHERE kind = 'VIRTUAL'
  UNION ALL SELECT src, callee_owner || '#' || callee_name || callee_desc, kind, confidence, line, CASE kind WHEN 'DYNAMIC' THEN 'dynamic' END FROM inv JOIN src USING (caller_method_id) WHERE kind IN ('STATIC', 'SPECIAL', 'INTERFACE', 'DYNAMIC'))"""


def _graph(spark, root) -> DataFrame:
    return graph.call_graph(invokes(spark, root), methods(spark, root), classes(spark, root))


@query(f"{_GRAPH_SQL} SELECT * FROM graph WHERE dst IS NOT NULL")
def call_graph(spark, root):
    """From whole tables without a cap, every edge after class hierarchy analysis, with confidence, line and note."""
    return _graph(spark, root).where("dst IS NOT NULL")


@query(f"{_GRAPH_SQL} SELECT src, dst, kind, 'out' AS side FROM graph WHERE src = (SELECT min(src) FROM graph) UNION ALL SELECT src, dst, kind, 'in' FROM graph WHERE dst = (SELECT max(dst) FROM graph)")
def edges_of_vertex(spark, root):
    """Both directions, parallel edges kept."""
    g = _graph(spark, root)
    ends = g.agg(F.min("src"), F.max("dst")).first()
    return graph.out_edges(g, ends[0]).select("src", "dst", "kind", F.lit("out").alias("side")).unionByName(graph.in_edges(g, ends[1]).select("src", "dst", "kind", F.lit("in").alias("side")))


@query(f"""{_GRAPH_SQL}, start AS (SELECT min(src) AS v FROM graph), reach AS (SELECT v AS vertex, 0 AS depth FROM start UNION SELECT g.dst, r.depth + 1 FROM reach r JOIN graph g ON g.src = r.vertex WHERE r.depth < 8 AND g.dst IS NOT NULL)
SELECT max(depth) AS length, true AS edges_exist FROM (SELECT vertex, min(depth) AS depth FROM reach GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)""")
def path_between(spark, root):
    """A shortest path to the farthest vertex; its length, and whether each step is an edge of the graph."""
    g = _graph(spark, root).where("dst IS NOT NULL").select("src", "dst").distinct()
    start = g.agg(F.min("src")).first()[0]
    far = graph.reach(g, start, 8).orderBy(F.desc("depth"), "vertex").first()
    path = graph.find_path(g, start, far.vertex, 8) or []
    steps = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(zip(path, path[1:]))], "k int, src string, dst string")
    known = steps.join(g, ["src", "dst"], "left_semi").count()
    return spark.createDataFrame([(len(path) - 1, known == len(path) - 1)], "length int, edges_exist boolean")


@query(f"WITH c AS (SELECT fqn, bit_or(access_flags) AS a FROM classes GROUP BY 1), n AS (SELECT DISTINCT callee_owner AS fqn FROM {CALLS_SQL} WHERE callee_owner IS NOT NULL) SELECT n.fqn, coalesce(a & 512 <> 0, false) AS is_interface, coalesce(a & 1024 <> 0, false) AS is_abstract FROM n LEFT JOIN c USING (fqn)")
def class_kinds(spark, root):
    """O3."""
    return graph.class_kinds(calls(spark, root).where("callee_owner IS NOT NULL").select(F.col("callee_owner").alias("fqn")), table(spark, root, "classes").select("fqn", F.col("access_flags").alias("access")))


@query("SELECT fqn, (arg_min([super_fqn], jar_path))[1] AS super_fqn, min(jar_path) AS jar_path FROM m2_classes GROUP BY fqn")
def external_headers(spark, root):
    """The first archive that holds a class."""
    jars = table(spark, root, "m2_classes").groupBy("fqn", "jar_path").agg(F.min("id").alias("id"), F.min_by("super_fqn", "id").alias("super_fqn"))
    return resolve.external_classes(jars.select(F.lit(0).alias("jar_order"), "jar_path", "fqn", "super_fqn"))


@query(f"WITH x AS (SELECT fqn, min(jar_path) AS jar_path FROM m2_classes GROUP BY 1) SELECT DISTINCT callee_owner AS fqn, x.jar_path, x.fqn IS NOT NULL AS found FROM {CALLS_SQL} LEFT JOIN x ON x.fqn = callee_owner WHERE callee_owner IS NOT NULL")
def external_of_calls(spark, root):
    """What is found and what isn't."""
    wanted = calls(spark, root).where("callee_owner IS NOT NULL").select(F.col("callee_owner").alias("fqn"))
    external = resolve.external_classes(table(spark, root, "m2_classes").select(F.lit(0).alias("jar_order"), "jar_path", "fqn"))
    return resolve.resolve_external(wanted, external).select("fqn", "jar_path", "found")


@query(f"SELECT DISTINCT callee_owner AS fqn FROM {CALLS_SQL} WHERE callee_owner IS NOT NULL AND callee_owner NOT IN (SELECT fqn FROM classes)")
def missing_classes(spark, root):
    """Classes a call asks for that are not indexed."""
    return resolve.missing_classes(calls(spark, root).where("callee_owner IS NOT NULL").select(F.col("callee_owner").alias("fqn")), table(spark, root, "classes"))


@query(f"WITH i AS (SELECT DISTINCT {class_ref_sql('interface_fqn')} AS interface FROM dubbo_services), s AS (SELECT super_fqn AS parent, fqn AS child FROM classes WHERE super_fqn <> '' UNION ALL SELECT unnest(list_filter(string_split(interfaces, ','), lambda x: x <> '')), fqn FROM classes) SELECT interface, min(child) AS implementation FROM i LEFT JOIN s ON s.parent = i.interface GROUP BY 1")
def implementations(spark, root):
    """The first known subtype of each interface."""
    c = table(spark, root, "classes").select("fqn", "super_fqn", S.decode_interfaces(F.col("interfaces")).alias("interfaces"))
    asked = table(spark, root, "dubbo_services").select(class_ref(F.col("interface_fqn")).alias("interface"))
    return resolve.implementation_of(asked, graph.subtype_edges(c, True))


_CACHE = "SELECT jar_path, count(*) AS n, max(extracted_at) AS at FROM m2_classes GROUP BY 1"


@query(f"WITH c AS ({_CACHE}) SELECT jar_path, CASE WHEN n % 3 = 0 THEN 'gone' WHEN n % 3 = 1 AND n % 2 = 0 THEN 'touched' ELSE 'changed' END AS reason FROM c WHERE NOT (n % 3 = 2 AND n % 2 = 0)")
def stale_archives(spark, root):
    """Cached archives that are gone, touched or changed."""
    c = table(spark, root, "m2_classes").groupBy("jar_path").agg(F.count(F.lit(1)).alias("n"))
    cache = c.select("jar_path", F.lit(1).cast("bigint").alias("jar_mtime_ms"), F.lit("a").alias("jar_sha256"))
    same = (F.col("n") % 3 == 2) & (F.col("n") % 2 == 0)
    now = c.where("n % 3 <> 0").select("jar_path", F.when(same, 1).otherwise(2).cast("bigint").alias("jar_mtime_ms"), F.when(F.col("n") % 2 == 0, "a").otherwise("b").alias("jar_sha256"))
    return maintain.stale(cache, now)


# ---- maintenance ---------------------------------------------------------------------------------------------------


def _merged(spark, root, name: str, rows: DataFrame, old_where: str) -> DataFrame:
    """Rows before and after, upserted by the table's own rules."""
    old = rows.where(old_where).drop("at")
    first = maintain.upsert(old.limit(0), rows.where(old_where), name, "at")
    return maintain.upsert(first, rows.where(f"NOT ({old_where})"), name, "at")


def _merge_sql(source: str, key: str, columns: dict[str, str], keep: tuple[str, ...] = (), at: str = "id") -> str:
    """The same in SQL: rows of the first half come before those of the second, each in the order of ids."""
    order = f"(late, {at})"
    picked = ", ".join(f"max_by({c}, {order}) FILTER (WHERE {c} IS NOT NULL) AS {c}" if c in keep else f"(max_by([{c}], {order}))[1] AS {c}" for c in columns)
    return f"SELECT {key}, min_by(id, {order}) AS id, {picked} FROM (SELECT *, id % 2 = 1 AS late FROM {source}) GROUP BY {key}"


_METHOD_ROWS = "(SELECT id, caller_method_id % 500 AS class_id, callee_method_name AS name, coalesce(callee_method_desc, '') AS \"desc\", CAST(id % 7 AS INTEGER) AS access, nullif(call_kind, 'reflection') AS signature_raw, CASE WHEN id % 5 > 0 THEN CAST(id % 900 AS INTEGER) END AS start_line, CASE WHEN id % 3 > 0 THEN CAST(id % 950 AS INTEGER) END AS end_line, id % 2 = 0 AS virtual_lines FROM m2_invokes WHERE callee_method_name IS NOT NULL AND caller_method_id IS NOT NULL)"


@query(_merge_sql(_METHOD_ROWS, 'class_id, name, "desc"', dict.fromkeys(("access", "signature_raw", "start_line", "end_line", "virtual_lines"), ""), ("signature_raw", "start_line", "end_line")))
def upsert_methods(spark, root):
    """K2: signature and lines keep what is known, the flag is overwritten."""
    i = F.col("id")
    rows = table(spark, root, "m2_invokes").where("callee_method_name IS NOT NULL AND caller_method_id IS NOT NULL").select(
        "id", (F.col("caller_method_id") % 500).alias("class_id"), F.col("callee_method_name").alias("name"), F.coalesce("callee_method_desc", F.lit("")).alias("desc"), (i % 7).cast("int").alias("access"), F.nullif("call_kind", F.lit("reflection")).alias("signature_raw"),
        F.when(i % 5 > 0, (i % 900).cast("int")).alias("start_line"), F.when(i % 3 > 0, (i % 950).cast("int")).alias("end_line"), (i % 2 == 0).alias("virtual_lines"), i.alias("at"),
    )
    return _merged(spark, root, "methods", rows, "id % 2 = 0")


_FIELD_ROWS = "(SELECT id, caller_method_id % 500 AS class_id, callee_method_name AS name, 'I' AS \"desc\", CAST(id % 7 AS INTEGER) AS access, nullif(call_kind, 'reflection') AS signature_raw, CASE WHEN id % 5 > 0 THEN CAST(id % 900 AS INTEGER) END AS line FROM m2_invokes WHERE callee_method_name IS NOT NULL AND caller_method_id IS NOT NULL)"


@query(_merge_sql(_FIELD_ROWS, 'class_id, name, "desc"', dict.fromkeys(("access", "signature_raw", "line"), ""), ("signature_raw", "line")))
def upsert_fields(spark, root):
    """K3."""
    i = F.col("id")
    rows = table(spark, root, "m2_invokes").where("callee_method_name IS NOT NULL AND caller_method_id IS NOT NULL").select(
        "id", (F.col("caller_method_id") % 500).alias("class_id"), F.col("callee_method_name").alias("name"), F.lit("I").alias("desc"), (i % 7).cast("int").alias("access"), F.nullif("call_kind", F.lit("reflection")).alias("signature_raw"), F.when(i % 5 > 0, (i % 900).cast("int")).alias("line"), i.alias("at")
    )
    return _merged(spark, root, "fields", rows, "id % 2 = 0")


@query(_merge_sql("(SELECT id, lang AS name, rel_path AS url, sha256 AS kind, CAST(mtime AS VARCHAR) AS indexed_at FROM files)", "name", dict.fromkeys(("kind", "url", "indexed_at"), "")))
def upsert_repos(spark, root):
    """K5: the id of the first row stays."""
    rows = table(spark, root, "files").select("id", F.col("lang").alias("name"), F.col("sha256").alias("kind"), F.col("rel_path").alias("url"), F.col("mtime").cast("string").alias("indexed_at"), F.col("id").alias("at"))
    return _merged(spark, root, "repos", rows, "id % 2 = 0")


@query(_merge_sql("(SELECT id, lower(regexp_extract(fqn, '([^./$]*)$', 1)) AS name, 'x' AS type_fqn, origin AS source, id AS class_id, id AS method_id, source_jar AS scope, id % 3 = 0 AS primary_b FROM classes)", "name, type_fqn", dict.fromkeys(("source", "class_id", "method_id", "scope", "primary_b"), "")))
def upsert_beans(spark, root):
    """K6."""
    rows = table(spark, root, "classes").select("id", F.lower(F.regexp_extract("fqn", r"([^./$]*)$", 1)).alias("name"), F.lit("x").alias("type_fqn"), F.col("origin").alias("source"), F.col("id").alias("class_id"), F.col("id").alias("method_id"), F.col("source_jar").alias("scope"), (F.col("id") % 3 == 0).alias("primary_b"), F.col("id").alias("at"))
    return _merged(spark, root, "spring_beans", rows, "id % 2 = 0")


@query(_merge_sql("(SELECT id, interface_fqn, group_name, service_version, '' AS ref_bean_name, impl_class_id % 3 AS impl_class_id, registry_id, protocol, found_in AS source FROM dubbo_services)", "interface_fqn, group_name, service_version, ref_bean_name, impl_class_id, registry_id", dict.fromkeys(("protocol", "source"), "")))
def upsert_services(spark, root):
    """K7."""
    rows = table(spark, root, "dubbo_services").select("id", "interface_fqn", (F.col("impl_class_id") % 3).alias("impl_class_id"), "group_name", "service_version", "protocol", F.col("found_in").alias("source"), F.lit("").alias("ref_bean_name"), "registry_id", F.col("id").alias("at"))
    return _merged(spark, root, "dubbo_services", rows, "id % 2 = 0")


@query(_merge_sql("(SELECT id, interface_fqn, group_name, service_version, '' AS ref_id, CAST(0 AS BIGINT) AS field_id, registry_id, '' AS consumer_class_fqn, confidence FROM dubbo_references)", "interface_fqn, group_name, service_version, ref_id, field_id, registry_id, consumer_class_fqn", {"confidence": ""}))
def upsert_references(spark, root):
    """K8."""
    rows = table(spark, root, "dubbo_references").select("id", "interface_fqn", F.lit(0).cast("bigint").alias("field_id"), "group_name", "service_version", "confidence", F.lit("").alias("ref_id"), "registry_id", F.lit("").alias("consumer_class_fqn"), F.col("id").alias("at"))
    return _merged(spark, root, "dubbo_references", rows, "id % 2 = 0")


@query(_merge_sql("(SELECT id, registry_id, found_in AS source_file, interface_fqn AS address, protocol, CAST(id % 9 AS INTEGER) AS port FROM dubbo_services)", "source_file, registry_id", dict.fromkeys(("address", "protocol", "port"), "")))
def upsert_registries(spark, root):
    """K9."""
    rows = table(spark, root, "dubbo_services").select("id", "registry_id", F.col("interface_fqn").alias("address"), "protocol", (F.col("id") % 9).cast("int").alias("port"), F.col("found_in").alias("source_file"), F.col("id").alias("at"))
    return _merged(spark, root, "dubbo_registries", rows, "id % 2 = 0")


@query(_merge_sql("(SELECT id, mapper_namespace, lower(kind) AS map_id, defined_in_file AS type_fqn, statement_id AS extends_, id % 2 = 0 AS auto_mapping, CAST(line_no AS INTEGER) AS property_count FROM mybatis_statements)", "mapper_namespace, map_id", dict.fromkeys(("type_fqn", "extends_", "auto_mapping", "property_count"), "")))
def upsert_result_maps(spark, root):
    """K12."""
    rows = table(spark, root, "mybatis_statements").select("id", "mapper_namespace", F.lower("kind").alias("map_id"), F.col("defined_in_file").alias("type_fqn"), F.col("statement_id").alias("extends_"), (F.col("id") % 2 == 0).alias("auto_mapping"), F.col("line_no").cast("int").alias("property_count"), F.col("id").alias("at"))
    return _merged(spark, root, "mybatis_result_maps", rows, "id % 2 = 0")


@query("SELECT id, fqn AS target, 'NEW' AS kind FROM classes UNION ALL SELECT id, fqn, 'NEW' FROM m2_classes")
def appended_rows(spark, root):
    """Tables without a key keep every row."""
    rows = lambda name: table(spark, root, name).select("id", F.lit("NEW").alias("kind"), F.col("fqn").alias("target"))
    return maintain.upsert(rows("classes"), rows("m2_classes"), "issues")


@query("SELECT id, fqn FROM classes WHERE fqn NOT IN (SELECT fqn FROM m2_classes) UNION ALL SELECT id, fqn FROM m2_classes")
def replaced_rows(spark, root):
    """Rows of owners that were read again are replaced."""
    return maintain.replace_owned(table(spark, root, "classes").select("id", "fqn"), table(spark, root, "m2_classes").select("id", "fqn"), "fqn")


@query("""
WITH gone AS (SELECT id FROM files WHERE deleted_at IS NOT NULL), c AS (SELECT id, file_id FROM classes), m AS (SELECT id, caller_method_id % 3000 AS class_id FROM m2_invokes), i AS (SELECT id + 1000000 AS id, id AS caller_method_id FROM m2_invokes),
dc AS (SELECT c.id FROM c JOIN gone g ON g.id = c.file_id), dm AS (SELECT id FROM m WHERE class_id IN (SELECT id FROM dc))
SELECT 'classes' AS table_name, count(*) AS n_left, CAST(sum(id) AS BIGINT) AS id_sum FROM c WHERE id NOT IN (SELECT id FROM dc)
UNION ALL SELECT 'methods', count(*), CAST(sum(id) AS BIGINT) FROM m WHERE class_id IS NULL OR class_id NOT IN (SELECT id FROM dc)
UNION ALL SELECT 'invokes', count(*), CAST(sum(id) AS BIGINT) FROM i WHERE caller_method_id NOT IN (SELECT id FROM dm)
""")
def cascaded_deletes(spark, root):
    """Classes of deleted files, their methods and the calls of these are gone."""
    c = table(spark, root, "classes").select("id", "file_id")
    i = table(spark, root, "m2_invokes")
    tables = {"classes": c, "methods": i.select("id", (F.col("caller_method_id") % 3000).alias("class_id")), "invokes": i.select((F.col("id") + 1000000).alias("id"), F.col("id").alias("caller_method_id"))}
    dead = c.join(table(spark, root, "files").where("deleted_at IS NOT NULL").select(F.col("id").alias("file_id")), "file_id", "left_semi")
    left = maintain.cascade(tables, "classes", dead)
    parts = [left[n].agg(F.count(F.lit(1)).alias("n_left"), F.sum("id").alias("id_sum")).select(F.lit(n).alias("table_name"), "n_left", "id_sum") for n in ("classes", "methods", "invokes")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT id, artifact_id FROM files WHERE artifact_id IS DISTINCT FROM (SELECT mode(artifact_id) FROM (SELECT artifact_id FROM files WHERE artifact_id = (SELECT min(artifact_id) FROM files)))")
def scoped_delete(spark, root):
    """Everything of one owner goes."""
    f = table(spark, root, "files").select("id", "artifact_id")
    return maintain.delete_scope(f, "artifact_id", f.agg(F.min("artifact_id")).first()[0])


_KEY = ["caller_class_fqn", "callee_class_fqn", "callee_method_name"]


@query("SELECT caller_class_fqn, callee_class_fqn, callee_method_name, min(id) AS id, arg_min([call_kind], id)[1] AS call_kind FROM m2_invokes GROUP BY 1, 2, 3")
def first_of_each_call(spark, root):
    """The row with the smallest id of each natural key."""
    return maintain.keep_first(table(spark, root, "m2_invokes").select("id", *_KEY, "call_kind"), _KEY).select(*_KEY, "id", "call_kind")


@query("""
WITH r AS (SELECT jar_path, id, extracted_at AS last_access_at, CAST(access_flags AS BIGINT) AS jar_mtime_ms, id % 2 = 1 AS late FROM m2_classes)
SELECT jar_path, min_by(id, (late, id)) AS id, min_by(last_access_at, (late, id)) AS last_access_at, (max_by([jar_mtime_ms], (late, id)))[1] AS jar_mtime_ms FROM (
  SELECT jar_path, late, CASE WHEN late THEN max(id) ELSE min(id) END AS id, min_by(last_access_at, id) AS last_access_at, (max_by([jar_mtime_ms], id))[1] AS jar_mtime_ms FROM r GROUP BY 1, 2) GROUP BY 1
""")
def cache_upserted(spark, root):
    """A conflict replaces all but the id and the time of last access."""
    r = table(spark, root, "m2_classes").select("jar_path", "id", F.col("extracted_at").alias("last_access_at"), F.col("access_flags").cast("bigint").alias("jar_mtime_ms"))
    half = lambda odd: r.where(f"id % 2 = {odd}").groupBy("jar_path").agg((F.max if odd else F.min)("id").alias("id"), F.min_by("last_access_at", "id").alias("last_access_at"), F.max_by(F.struct("jar_mtime_ms"), "id")["jar_mtime_ms"].alias("jar_mtime_ms"))
    return maintain.cache_upsert(half(0), half(1))


# ---- wiring --------------------------------------------------------------------------------------------------------


@query(f"""{FACTS_SQL}, fld AS (SELECT min(id) AS id, class_id, name FROM (SELECT id, class_id, 'f' || (id % 3) AS name FROM mth WHERE "desc" = '()V') GROUP BY 2, 3),
r AS (SELECT id, {class_ref_sql('interface_fqn')} AS owner, 'f' || (id % 3) AS name FROM dubbo_references)
SELECT r.id, coalesce(f.id, 0) AS field_id, CASE WHEN f.id IS NULL THEN 'UNCERTAIN' ELSE 'CERTAIN' END AS confidence FROM r LEFT JOIN (SELECT f.*, k.fqn FROM fld f JOIN cls k ON k.id = f.class_id) f ON f.fqn = r.owner AND f.name = r.name""")
def resolved_fields(spark, root):
    """J9."""
    fields = _fields(spark, root).groupBy("class_id", "name", "desc").agg(F.min("id").alias("id"))
    refs = table(spark, root, "dubbo_references").select("id", class_ref(F.col("interface_fqn")).alias("owner"), F.concat(F.lit("f"), F.col("id") % 3).alias("name"), F.lit("I").alias("desc"))
    return wiring.resolve_fields(refs, fields, classes(spark, root)).select("id", "field_id", "confidence")


_REF_KEY = ["interface_fqn", "group_name", "service_version", "ref_id"]


@query("WITH r AS (SELECT interface_fqn, coalesce(group_name, '') AS g, coalesce(service_version, '') AS v, coalesce(ref_id, '') AS ref, min(id) AS reference_id FROM dubbo_references WHERE trim(coalesce(ref_id, '')) <> '' GROUP BY 1, 2, 3, 4) SELECT w.id, coalesce(r.reference_id, 0) AS reference_id FROM dubbo_references w LEFT JOIN r ON r.interface_fqn = w.interface_fqn AND r.g = coalesce(w.group_name, '') AND r.v = coalesce(w.service_version, '') AND r.ref = coalesce(w.ref_id, '')")
def reference_ids(spark, root):
    """The first reference with the same interface, group, version and id."""
    r = table(spark, root, "dubbo_references")
    return wiring.reference_ids(r.select(F.col("id").alias("w"), *_REF_KEY), r.select("id", *_REF_KEY)).select(F.col("w").alias("id"), "reference_id")


@query("WITH a AS (SELECT DISTINCT fqn FROM classes WHERE id % 2 = 0), p AS (SELECT id, artifact_id, rel_path FROM files) SELECT c.fqn, p.rel_path, p.artifact_id, 'jar-' || p.artifact_id AS jar_path FROM a JOIN classes c USING (fqn) JOIN p ON p.id = c.file_id UNION ALL SELECT c.fqn, p.rel_path, p.artifact_id, 'jar-' || p.artifact_id FROM a JOIN classes c USING (fqn) JOIN p ON c.file_id IS NULL AND p.rel_path = c.fqn || '.class'")
def condition_sources(spark, root):
    """Class, file, artifact."""
    c, f = table(spark, root, "classes"), table(spark, root, "files")
    auto = c.where("id % 2 = 0").select(F.translate("fqn", "/", ".").alias("class_fqn"))
    artifacts = f.select(F.col("artifact_id").alias("id")).distinct().select("id", F.concat(F.lit("jar-"), F.col("id")).alias("path"))
    return wiring.condition_sources(auto, c.select("fqn", "file_id"), f.select("id", "artifact_id", "rel_path"), artifacts)


@query(f"WITH b AS {_BEANS_SQL} SELECT s.id, b.type_fqn AS bean_type FROM (SELECT id, lower(substr(regexp_extract(interface_fqn, '([^./$]*)$', 1), 1, 1)) || substr(regexp_extract(interface_fqn, '([^./$]*)$', 1), 2) AS ref FROM dubbo_services) s LEFT JOIN b ON b.name = s.ref")
def services_with_beans(spark, root):
    """Service.ref = bean.name."""
    s = table(spark, root, "dubbo_services").select("id", X.default_bean_name(F.col("interface_fqn")).alias("ref_bean_name"))
    return wiring.services_with_beans(s, _bean_rows(spark, root)).select("id", "bean_type")


@query("WITH s AS (SELECT id, mapper_namespace, nullif(regexp_extract(regexp_extract(sql_template, '\\bresultMap\\s*=\\s*[\"'']([^\"'']+)[\"'']', 1), '([^.]*)$', 1), '') AS map_id FROM mybatis_statements), m AS (SELECT mapper_namespace, map_id, min(id) AS first_id FROM s WHERE map_id IS NOT NULL AND id % 2 = 0 GROUP BY 1, 2) SELECT s.id, s.map_id, CAST(m.first_id AS DOUBLE) AS first_id FROM s LEFT JOIN m ON m.mapper_namespace = s.mapper_namespace AND m.map_id = s.map_id")
def statements_with_maps(spark, root):
    """Statement.resultMap = map_id."""
    s = table(spark, root, "mybatis_statements").select("id", "mapper_namespace", "sql_template")
    named = wiring.statements_with_maps(s, spark.createDataFrame([], "mapper_namespace string, map_id string"))
    maps = named.where("map_id IS NOT NULL AND id % 2 = 0").groupBy("mapper_namespace", "map_id").agg(F.min("id").cast("double").alias("first_id"))
    return wiring.statements_with_maps(s, maps).select("id", "map_id", "first_id")


# ---- kernels -------------------------------------------------------------------------------------------------------


@query(f"SELECT id, caller || '#' || callee_name || callee_desc AS dashed, callee_name || callee_desc AS key, caller AS class_form, caller || '.' || callee_name AS field_form, 'pkg:' || caller AS package_form FROM {CALLS_SQL}")
def symbol_forms(spark, root):
    """C6, O10."""
    c = calls(spark, root)
    form = lambda kind: S.symbol_text(F.lit(kind), F.col("caller"), F.col("callee_name"), F.col("callee_desc"))
    return c.select("id", S.dashed(F.col("caller"), F.col("callee_name"), F.col("callee_desc")).alias("dashed"), S.method_key(F.col("callee_name"), F.col("callee_desc")).alias("key"), form("CLASS").alias("class_form"), form("FIELD").alias("field_form"), form("PACKAGE").alias("package_form"))


@query("SELECT id, replace(CASE WHEN callee_class_fqn LIKE 'L%;' THEN substr(callee_class_fqn, 2, length(callee_class_fqn) - 2) ELSE callee_class_fqn END, '/', '.') AS dotted FROM m2_invokes")
def dotted_names(spark, root):
    """C9."""
    return table(spark, root, "m2_invokes").select("id", S.internal_to_dotted(F.col("callee_class_fqn")).alias("dotted"))


@query("SELECT id, regexp_extract(r, '^([^#]*)#', 1) AS owner, regexp_extract(r, '#([^(]*)', 1) AS name, regexp_extract(r, '(\\(.*)$', 1) AS \"desc\", len(string_split(r, ':')) >= 3 AS gav FROM (SELECT id, caller_class_fqn || '#' || callee_method_name || callee_method_desc AS r FROM m2_invokes WHERE callee_method_desc LIKE '(%') WHERE r IS NOT NULL")
def method_references(spark, root):
    """C16."""
    r = table(spark, root, "m2_invokes").where("callee_method_desc LIKE '(%'").select("id", F.concat("caller_class_fqn", F.lit("#"), "callee_method_name", "callee_method_desc").alias("r")).where("r IS NOT NULL")
    return r.select("id", C.method_reference(F.col("r")).alias("m"), C.looks_like_coordinate(F.col("r")).alias("gav")).select("id", "m.owner", "m.name", "m.desc", "gav")


@query("SELECT id, CASE WHEN rel_path IS NULL THEN 'jdbc:sqlite::memory:' WHEN u LIKE 'sqlite:%' OR u LIKE 'postgres:%' THEN 'jdbc:' || u ELSE u END AS url FROM (SELECT id, rel_path, CASE WHEN id % 3 = 0 THEN 'sqlite:' ELSE '' END || rel_path AS u FROM files)")
def database_urls(spark, root):
    """C16."""
    u = F.concat(F.when(F.col("id") % 3 == 0, "sqlite:").otherwise(""), F.col("rel_path"))
    return table(spark, root, "files").select("id", C.database_url(u).alias("url"))


@query("SELECT id, callee_class_fqn = 'java/lang/invoke/LambdaMetafactory' AND callee_method_name IN ('metafactory', 'altMetafactory') AS lambda_site, caller_class_fqn || '.' || callee_method_name AS synthetic, caller_class_fqn || '#' || callee_method_name || callee_method_desc || ':' || CASE id % 10 WHEN 6 THEN 'invokeStatic' WHEN 5 THEN 'invokeVirtual' ELSE 'tag=' || (id % 10) END AS handle FROM m2_invokes WHERE id % 10 IN (0, 5, 6)")
def lambda_texts(spark, root):
    """C20."""
    f = {c: F.col(c) for c in ("caller_class_fqn", "callee_class_fqn", "callee_method_name", "callee_method_desc")}
    t = table(spark, root, "m2_invokes").where("id % 10 IN (0, 5, 6)")
    return t.select("id", S.is_lambda_site(f["callee_class_fqn"], f["callee_method_name"]).alias("lambda_site"), S.synthetic_name(f["caller_class_fqn"], f["callee_method_name"]).alias("synthetic"), S.describe_handle(f["caller_class_fqn"], f["callee_method_name"], f["callee_method_desc"], (F.col("id") % 10).cast("int")).alias("handle"))


@query("SELECT id, name IN ('Service', 'org.x.Service') OR name LIKE '%.Service' AS matched FROM (SELECT id, CASE id % 4 WHEN 0 THEN 'Service' WHEN 1 THEN 'org.x.Service' WHEN 2 THEN 'a.b.Service' ELSE fqn END AS name FROM classes)")
def annotation_matches(spark, root):
    """C18."""
    name = F.when(F.col("id") % 4 == 0, "Service").when(F.col("id") % 4 == 1, "org.x.Service").when(F.col("id") % 4 == 2, "a.b.Service").otherwise(F.col("fqn"))
    return table(spark, root, "classes").select("id", X.annotation_matches(name, ["org.x.Service"]).alias("matched"))


@query("SELECT id, replace(CASE WHEN id % 3 = 0 THEN replace(fqn, '/', '.') WHEN id % 3 = 1 THEN 'imp.' || s ELSE CASE WHEN p = '' THEN s ELSE replace(p, '/', '.') || '.' || s END END, '.', '/') AS resolved FROM (SELECT id, fqn, regexp_extract(fqn, '([^/]*)$', 1) AS s, regexp_extract(fqn, '^(.*)/[^/]*$', 1) AS p FROM classes) WHERE s <> ''")
def resolved_types(spark, root):
    """Dotted as it is, else the import, else the package."""
    simple, package = S.binary_name(F.col("fqn")), S.package_name(F.col("fqn"))
    name = F.when(F.col("id") % 3 == 0, S.dotted(F.col("fqn"))).otherwise(simple)
    imported = F.when(F.col("id") % 3 == 1, F.concat(F.lit("imp."), simple))
    return table(spark, root, "classes").where(simple != "").select("id", X.resolve_type(name, imported, package).alias("resolved"))


@query("SELECT id, CASE WHEN wa >= wb THEN a ELSE b END AS surer FROM (SELECT id, a, b, CASE a WHEN 'CERTAIN' THEN 3 WHEN 'PROBABLE' THEN 2 ELSE 1 END AS wa, CASE b WHEN 'CERTAIN' THEN 3 WHEN 'PROBABLE' THEN 2 ELSE 1 END AS wb FROM (SELECT id, confidence AS a, CASE id % 3 WHEN 0 THEN 'CERTAIN' WHEN 1 THEN 'PROBABLE' ELSE 'UNCERTAIN' END AS b FROM dubbo_references WHERE confidence IN ('CERTAIN', 'PROBABLE', 'UNCERTAIN')))")
def surer_confidence(spark, root):
    """Weighted confidence of section 2.9."""
    b = F.when(F.col("id") % 3 == 0, "CERTAIN").when(F.col("id") % 3 == 1, "PROBABLE").otherwise("UNCERTAIN")
    return table(spark, root, "dubbo_references").where("confidence IN ('CERTAIN', 'PROBABLE', 'UNCERTAIN')").select("id", S.heavier(F.col("confidence"), b).alias("surer"))


@query("SELECT DISTINCT jar_path, replace(g, '.', '/') || '/' || a || '/' || v || '/' || a || '-' || v || '.jar' AS relative FROM (SELECT jar_path, 'org.x' AS g, regexp_extract(jar_path, '([^/]*)-(\\d[^/]*)\\.jar$', 1) AS a, regexp_extract(jar_path, '([^/]*)-(\\d[^/]*)\\.jar$', 2) AS v FROM m2_classes)")
def remote_paths(spark, root):
    """Place of a file in a remote repository."""
    t = table(spark, root, "m2_classes").select("jar_path").distinct()
    part = lambda k: F.regexp_extract("jar_path", r"([^/]*)-(\d[^/]*)\.jar$", k)
    return t.select("jar_path", C.relative_path(F.lit("org.x"), part(1), part(2)).alias("relative"))


@query("SELECT fqn, access_flags AS access, access_flags & 512 <> 0 AS is_interface, access_flags & 8192 <> 0 AS is_annotation, access_flags & 16384 <> 0 AS is_enum, super_fqn IS NOT DISTINCT FROM 'java/lang/Record' AS is_record, id FROM classes")
def discovered_kinds(spark, root):
    """S5."""
    from factloom.sources.archives import discovered

    rows = table(spark, root, "classes")
    return discovered(rows.select("fqn", "super_fqn", F.col("access_flags").alias("access"))).drop("super_fqn", "is_sealed").join(rows.select("fqn", "id", F.col("access_flags").alias("access"), F.col("super_fqn").eqNullSafe("java/lang/Record").alias("is_record")).distinct(), ["fqn", "access", "is_record"]).distinct()


# ---- search --------------------------------------------------------------------------------------------------------


@query(f"{FACTS_SQL} SELECT DISTINCT k.fqn || '#' || name || \"desc\" AS fqn, name, regexp_replace(k.fqn, '[/$.]', ' ', 'g') || ' ' || name || ' ' || regexp_replace(\"desc\", '[^A-Za-z0-9_]', ' ', 'g') AS content FROM mth JOIN cls k ON k.id = class_id")
def method_documents(spark, root):
    """Documents of methods."""
    m = methods(spark, root).join(classes(spark, root).select(F.col("id").alias("class_id"), F.col("fqn").alias("owner")), "class_id")
    return search.method_documents(m).select("fqn", "name", "content").distinct()
