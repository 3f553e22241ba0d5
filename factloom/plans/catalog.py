"""Queries of the core operators over the whole tables, with the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from factloom.functions import coordinates as C
from factloom.functions import symbols as S
from factloom.functions import text as X
from factloom.functions.names import class_ref, class_ref_sql
from factloom.operators import graph, lookup, maintain, resolve, search, wiring
from factloom.session import loaded, parallelism, read_shared, table, write_shared

def _catalogue():
    """Queries and SQL of a module, and the decorator that registers a query with the SQL it is checked against."""
    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    sqls: dict[str, str] = {}

    def query(sql: str | None = None):
        def register(f: Callable[[SparkSession, str], DataFrame]):
            queries[f.__name__] = f
            if sql is not None:
                sqls[f.__name__] = sql
            return f

        return register

    return queries, sqls, query


QUERIES, SQL, query = _catalogue()

CALLEE, CALLER, SUPER = class_ref_sql("callee_class_fqn"), class_ref_sql("caller_class_fqn"), class_ref_sql("super_fqn")

#: arguments of the point lookups
OWNER, METHOD, TERMS = "vireo.rt.TextBuf", "append", "harbor glacier survey timetable"


def calls(spark: SparkSession, root: str) -> DataFrame:
    """Call edges with normalised class names."""
    return table(spark, root, "m2_invokes").select(
        "id", "caller_method_id", class_ref(F.col("caller_class_fqn")).alias("caller"), class_ref(F.col("callee_class_fqn")).alias("callee_owner"), F.col("callee_method_name").alias("callee_name"), F.col("callee_method_desc").alias("callee_desc"), "call_kind", "extracted_at"
    )


def stored_calls(spark: SparkSession, root: str) -> DataFrame:
    """The same, stored once with plain names and in the order of what is called, so that filters on names reach the scan and
    row groups are skipped."""
    every = calls(spark, root)
    parts = parallelism(spark)
    path = loaded(spark, root, "m2_invokes", "calls", lambda: write_shared(every.repartitionByRange(parts, "callee_owner", "callee_name", "id").sortWithinPartitions("callee_owner", "callee_name"))[0])
    return read_shared(every, path)


CALLS_SQL = f"(SELECT id, caller_method_id, {CALLER} AS caller, {CALLEE} AS callee_owner, callee_method_name AS callee_name, callee_method_desc AS callee_desc, call_kind, extracted_at FROM m2_invokes)"


# ---- lookups (F, J, A) ---------------------------------------------------------------------------------------------


@query("SELECT id, fqn, super_fqn, access_flags FROM classes WHERE fqn = (SELECT min(fqn) FROM classes)")
def find_symbol(spark, root):
    """F1."""
    classes = table(spark, root, "classes")
    first = classes.agg(F.min("fqn")).first()[0] or ""
    return lookup.find_symbol(classes, first.replace("/", ".")).select("id", "fqn", "super_fqn", "access_flags")


@query("SELECT fqn, super_fqn, interfaces FROM m2_classes WHERE super_fqn = 'java/lang/Object' OR list_contains(string_split(interfaces, ','), 'java/lang/Object')")
def direct_subtypes(spark, root):
    """F19."""
    return lookup.direct_subtypes(table(spark, root, "m2_classes"), "java.lang.Object").select("fqn", "super_fqn", "interfaces")


@query(f"SELECT count(*) AS n_calls, count(DISTINCT callee_owner) AS n_owners FROM {CALLS_SQL}")
def load_calls(spark, root):
    """Stores the calls of a session with plain names; what it costs is what later lookups save."""
    return stored_calls(spark, root).agg(F.count(F.lit(1)).alias("n_calls"), F.countDistinct("callee_owner").alias("n_owners"))


@query(f"SELECT * EXCLUDE (extracted_at) FROM {CALLS_SQL} WHERE callee_owner = '{OWNER.replace('.', '/')}' AND callee_name = '{METHOD}'")
def callers_of(spark, root):
    """J1."""
    return lookup.callers(stored_calls(spark, root), OWNER, METHOD).drop("extracted_at")


@query(f"SELECT id, caller, callee_owner, callee_name FROM {CALLS_SQL} c WHERE EXISTS (SELECT 1 FROM classes k WHERE k.fqn = c.callee_owner)")
def callers_of_known(spark, root):
    """Calls whose target is an indexed class."""
    known = table(spark, root, "classes").select(F.col("fqn").alias("callee_owner"))
    return stored_calls(spark, root).join(known, "callee_owner", "left_semi").select("id", "caller", "callee_owner", "callee_name")


@query("SELECT id, caller_class_fqn, callee_class_fqn, callee_method_name FROM m2_invokes WHERE caller_method_id = (SELECT min(caller_method_id) FROM m2_invokes)")
def callees_of(spark, root):
    """F15, J5."""
    t = table(spark, root, "m2_invokes")
    return lookup.callees(t, t.agg(F.min("caller_method_id")).first()[0]).select("id", "caller_class_fqn", "callee_class_fqn", "callee_method_name")


@query("SELECT s.id, s.interface_fqn, c.fqn AS impl_fqn, s.impl_class_id = 0 AS unknown_impl FROM dubbo_services s LEFT JOIN classes c ON c.id = s.impl_class_id")
def services_with_implementations(spark, root):
    """Services with the class that implements them, by a plain join."""
    c = table(spark, root, "classes").select(F.col("id").alias("impl_class_id"), F.col("fqn").alias("impl_fqn"))
    return table(spark, root, "dubbo_services").join(c, "impl_class_id", "left").select("id", "interface_fqn", "impl_fqn", (F.col("impl_class_id") == 0).alias("unknown_impl"))


@query(f"SELECT r.id AS reference_id, s.id AS service_id FROM (SELECT *, {class_ref_sql('interface_fqn')} AS i FROM dubbo_references) r JOIN (SELECT *, {class_ref_sql('interface_fqn')} AS i FROM dubbo_services) s ON r.i = s.i AND coalesce(r.group_name, '') = coalesce(s.group_name, '') AND coalesce(r.service_version, '') = coalesce(s.service_version, '')")
def references_to_services(spark, root):
    """Consumers with the providers of the same interface, group and version."""
    def keyed(name: str, as_: str) -> DataFrame:
        return table(spark, root, name).select(F.col("id").alias(as_), class_ref(F.col("interface_fqn")).alias("i"), F.coalesce("group_name", F.lit("")).alias("g"), F.coalesce("service_version", F.lit("")).alias("v"))

    return keyed("dubbo_references", "reference_id").join(keyed("dubbo_services", "service_id"), ["i", "g", "v"]).select("reference_id", "service_id")


@query("SELECT m.id, m.service_id, s.interface_fqn, m.method_name, CAST(m.timeout_ms AS DOUBLE) AS timeout_ms, CAST(m.retries AS DOUBLE) AS retries, m.loadbalance FROM dubbo_method_configs m JOIN dubbo_services s ON s.id = m.service_id")
def method_configs_of_services(spark, root):
    """Method settings with the interface of their service, by a plain join."""
    s = table(spark, root, "dubbo_services").select(F.col("id").alias("service_id"), "interface_fqn")
    return table(spark, root, "dubbo_method_configs").join(s, "service_id").select("id", "service_id", "interface_fqn", "method_name", F.col("timeout_ms").cast("double").alias("timeout_ms"), F.col("retries").cast("double").alias("retries"), "loadbalance")


@query("SELECT id, statement_id, kind FROM mybatis_statements WHERE mapper_namespace = (SELECT min(mapper_namespace) FROM mybatis_statements)")
def statements_of_mapper(spark, root):
    """F10."""
    t = table(spark, root, "mybatis_statements")
    return lookup.statements_of(t, t.agg(F.min("mapper_namespace")).first()[0], None).select("id", "statement_id", "kind")


@query("SELECT id, rel_path, sha256 FROM files WHERE lower(lang) = 'kotlin' AND deleted_at IS NULL")
def files_by_language(spark, root):
    """F17."""
    f = table(spark, root, "files").withColumn("lang", F.lower("lang"))
    return lookup.equal_to(f, lang="kotlin", deleted_at=None).select("id", "rel_path", "sha256")


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_path(spark, root):
    """F20."""
    return table(spark, root, "events").select("event_id", X.json_extract(F.col("props"), "$.k").try_cast("bigint").alias("k"))


_COUNTED = ["classes", "m2_classes", "m2_invokes", "files", "dubbo_services", "dubbo_references", "dubbo_method_configs", "mybatis_statements", "raw_configs", "platform_classes"]


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in _COUNTED))
def index_status(spark, root):
    """A1, A2."""
    return lookup.table_counts({t: table(spark, root, t) for t in _COUNTED})


_CONDITIONS = [
    ("dubbo_services_from_annotation", "dubbo_services", "found_in = 'annotation'"), ("dubbo_services_from_xml", "dubbo_services", "found_in = 'xml'"),
    ("dubbo_references_from_annotation", "dubbo_references", "ref_id = ''"), ("dubbo_references_from_xml", "dubbo_references", "ref_id <> ''"), ("dubbo_references_uncertain", "dubbo_references", "confidence = 'UNCERTAIN'"),
    ("mybatis_statements_from_annotation", "mybatis_statements", "defined_in_file LIKE '%.java'"), ("mybatis_statements_from_xml", "mybatis_statements", "defined_in_file LIKE '%.xml'"),
    ("classes_without_file", "classes", "file_id IS NULL"), ("files_without_hash", "files", "sha256 IS NULL"),
]
_STAT_TABLES = ["dubbo_services", "dubbo_references", "mybatis_statements", "classes", "files"]


@query(" UNION ALL ".join([f"SELECT '{t}' AS name, count(*) AS value FROM {t}" for t in _STAT_TABLES] + [f"SELECT '{n}', count(*) FROM {t} WHERE {c}" for n, t, c in _CONDITIONS]))
def stats(spark, root):
    """A3."""
    return lookup.stats({t: table(spark, root, t) for t in _STAT_TABLES}, _CONDITIONS)


@query("SELECT artifact_id, count(*) AS n_files, count(*) FILTER (WHERE deleted_at IS NOT NULL) AS n_deleted, max(indexed_at) AS last_indexed FROM files GROUP BY 1")
def artifact_report(spark, root):
    """Files of each artifact, by a plain aggregate."""
    return table(spark, root, "files").groupBy("artifact_id").agg(F.count(F.lit(1)).alias("n_files"), F.count_if(F.col("deleted_at").isNotNull()).alias("n_deleted"), F.max("indexed_at").alias("last_indexed"))


@query(f"SELECT call_kind, count(*) AS n_calls, count(DISTINCT callee_owner) AS n_owners FROM {CALLS_SQL} GROUP BY 1")
def call_kinds(spark, root):
    """A2."""
    return calls(spark, root).groupBy("call_kind").agg(F.count(F.lit(1)).alias("n_calls"), F.countDistinct("callee_owner").alias("n_owners"))


# ---- maintenance (K, L) --------------------------------------------------------------------------------------------


@query("""
SELECT fqn, min_by(id, (indexed_at, id)) AS id, (max_by([super_fqn], (indexed_at, id)))[1] AS super_fqn,
  CAST(max_by(file_id, (indexed_at, id)) FILTER (WHERE file_id IS NOT NULL) AS DOUBLE) AS file_id,
  max_by(signature_raw, (indexed_at, id)) FILTER (WHERE signature_raw IS NOT NULL) AS signature_raw
FROM classes GROUP BY fqn
""")
def upsert_classes(spark, root):
    """K1: rows in the order they were indexed, nulls never overwriting file and signature."""
    rows = table(spark, root, "classes").select("id", "fqn", "super_fqn", F.col("file_id").cast("double").alias("file_id"), "signature_raw", F.struct("indexed_at", "id").alias("at"))
    old = rows.where("false").drop("at")
    return maintain.merge(old, rows, ["fqn"], keep=["file_id", "signature_raw"], order="at")


@query("SELECT artifact_id, rel_path, min_by(id, (indexed_at, id)) AS id, (max_by([sha256], (indexed_at, id)))[1] AS sha256, (max_by([mtime], (indexed_at, id)))[1] AS mtime FROM files GROUP BY 1, 2")
def upsert_files(spark, root):
    """K4: last write wins, the id of the first stays."""
    rows = table(spark, root, "files").select("id", "artifact_id", "rel_path", "sha256", "mtime", F.struct("indexed_at", "id").alias("at"))
    return maintain.merge(rows.where("false").drop("at"), rows, ["artifact_id", "rel_path"], order="at")


@query("SELECT coalesce(service_id, 0) AS service_id, coalesce(reference_id, 0) AS reference_id, method_name, CAST((max_by([timeout_ms], (recorded_at, id)))[1] AS DOUBLE) AS timeout_ms, CAST((max_by([retries], (recorded_at, id)))[1] AS DOUBLE) AS retries, (max_by([loadbalance], (recorded_at, id)))[1] AS loadbalance FROM dubbo_method_configs GROUP BY 1, 2, 3")
def upsert_method_configs(spark, root):
    """K10."""
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = table(spark, root, "dubbo_method_configs").select(zero("service_id"), zero("reference_id"), "method_name", F.col("timeout_ms").cast("double").alias("timeout_ms"), F.col("retries").cast("double").alias("retries"), "loadbalance", F.struct("recorded_at", "id").alias("at"))
    return maintain.merge(rows.where("false").drop("at"), rows, ["service_id", "reference_id", "method_name"], stable=[], order="at")


@query("SELECT mapper_namespace, statement_id, (max_by([sql_normalized], (defined_in_file LIKE '%.xml', indexed_at, id)))[1] AS sql_normalized, (max_by([kind], (defined_in_file LIKE '%.xml', indexed_at, id)))[1] AS kind FROM mybatis_statements GROUP BY 1, 2")
def upsert_statements(spark, root):
    """Statements of XML files win over annotations."""
    xml = F.endswith("defined_in_file", F.lit(".xml")).alias("xml")
    rows = table(spark, root, "mybatis_statements").select("mapper_namespace", "statement_id", "sql_normalized", "kind", F.struct(xml, "indexed_at", "id").alias("at"))
    return maintain.merge(rows.where("false").drop("at"), rows, ["mapper_namespace", "statement_id"], stable=[], order="at")


_SERVICE_KEY = "interface_fqn, group_name, service_version, impl_class_id, registry_id"


@query(f"SELECT {_SERVICE_KEY}, (min_by([protocol], (recorded_at, id)))[1] AS protocol FROM dubbo_services GROUP BY ALL")
def first_services(spark, root):
    """The first row of a key stays."""
    key = _SERVICE_KEY.split(", ")
    rows = table(spark, root, "dubbo_services").select(*key, "protocol", F.struct("recorded_at", "id").alias("at"))
    return maintain.merge(rows.where("false").drop("at"), rows, key, first_wins=True, stable=[], order="at")


_INVOKE_KEY = ["caller_class_fqn", "caller_method_id", "callee_class_fqn", "callee_method_name", "callee_method_desc", "call_kind", "extracted_at"]


@query(f"SELECT min(id) AS id, {', '.join(_INVOKE_KEY)} FROM m2_invokes GROUP BY ALL")
def deduplicate_invokes(spark, root):
    """The smallest id of each natural key."""
    return maintain.keep_first(table(spark, root, "m2_invokes").select("id", *_INVOKE_KEY), _INVOKE_KEY)


@query("""
SELECT doc_id, CASE WHEN text IS NULL THEN 'NEW' WHEN tgt_text IS NULL THEN 'GONE' WHEN sha256(text) = sha256(tgt_text) THEN 'UNCHANGED' ELSE 'CHANGED' END AS change
FROM documents WHERE text IS NOT NULL OR tgt_text IS NOT NULL
""")
def changed_texts(spark, root):
    """The source side as the old snapshot, the target side as the new one."""
    docs = table(spark, root, "documents")
    old = docs.where(F.col("text").isNotNull()).select("doc_id", X.content_hash(F.col("text")).alias("sha256"))
    new = docs.where(F.col("tgt_text").isNotNull()).select("doc_id", X.content_hash(F.col("tgt_text")).alias("sha256"))
    return maintain.classify_changes(old, new, ["doc_id"])


@query("SELECT user_id, max(ts) AS last_access_at FROM events GROUP BY 1 ORDER BY 2 DESC, 1 DESC LIMIT 50")
def lru_kept(spark, root):
    """The 50 most recent entries stay."""
    cache = table(spark, root, "events").groupBy("user_id").agg(F.max("ts").alias("last_access_at"))
    return maintain.evict(cache, 50, tie="user_id")


@query("SELECT user_id, max(ts) AS last_access_at FROM events GROUP BY 1 ORDER BY 2, 1 LIMIT 10")
def lru_oldest(spark, root):
    """L1."""
    cache = table(spark, root, "events").groupBy("user_id").agg(F.max("ts").alias("last_access_at"))
    return maintain.oldest(cache, 10, tie="user_id")


@query("SELECT c.id, c.fqn FROM classes c WHERE c.file_id IS NULL OR c.file_id NOT IN (SELECT id FROM files WHERE deleted_at IS NOT NULL)")
def classes_after_deletes(spark, root):
    """Classes that stay once deleted files and all that hangs on them are gone."""
    gone = table(spark, root, "files").where("deleted_at IS NOT NULL").select(F.col("id").alias("file_id"))
    return table(spark, root, "classes").join(gone, "file_id", "left_anti").select("id", "fqn")


@query("SELECT user_id, greatest(min(ts), max(ts) FILTER (WHERE event_type = 'click')) AS last_access_at FROM events GROUP BY 1")
def lru_touched(spark, root):
    """Entries as first seen, moved forward by clicks."""
    events = table(spark, root, "events")
    cache = events.groupBy(F.col("user_id").alias("jar_path")).agg(F.min("ts").alias("last_access_at"))
    touched = events.where("event_type = 'click'").select(F.col("user_id").alias("jar_path"), F.col("ts").alias("at"))
    return maintain.cache_touch(cache, touched).withColumnRenamed("jar_path", "user_id")


_JAR = "regexp_extract(jar_path, '([^/]*?)(\\.jar)?$', 1)"
_NUM = "coalesce(try_cast(nullif(split_part(split_part(v, '-', 1), '.', {k}), '') AS INTEGER), 0)"


@query(f"""
SELECT artifact, max_by(v, ({_NUM.format(k=1)}, {_NUM.format(k=2)}, {_NUM.format(k=3)})) AS version
FROM (SELECT DISTINCT regexp_extract({_JAR}, '^(.*)-(\\d+(?:\\.\\d+)*(?:[.-].*)?)$', 1) AS artifact, regexp_extract({_JAR}, '^(.*)-(\\d+(?:\\.\\d+)*(?:[.-].*)?)$', 2) AS v FROM m2_classes)
WHERE v <> '' GROUP BY 1
""")
def latest_versions(spark, root):
    """The highest version of each artifact, by number."""
    gav = C.coordinate(C.coordinate_from_path(F.col("jar_path")))
    jars = table(spark, root, "m2_classes").select("jar_path").distinct().select(gav.alias("g")).select("g.artifact", "g.version").where("version <> '0.0.0'").distinct()
    return jars.groupBy("artifact").agg(F.max_by("version", C.version_key(F.col("version"))).alias("version"))


# ---- graphs (O) ----------------------------------------------------------------------------------------------------


def _classes(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "m2_classes").select("fqn", class_ref(F.col("super_fqn")).alias("super_fqn"), S.decode_interfaces(F.col("interfaces")).alias("interfaces"))


@query(f"""
WITH RECURSIVE edges AS (SELECT DISTINCT {SUPER} AS parent, fqn AS child FROM m2_classes WHERE {SUPER} IS NOT NULL),
walk AS (SELECT fqn AS root, fqn AS subtype, 0 AS distance FROM platform_classes
  UNION ALL SELECT w.root, e.child, w.distance + 1 FROM walk w JOIN edges e ON e.parent = w.subtype WHERE w.distance < 60)
SELECT root, subtype, min(distance) AS distance FROM walk GROUP BY 1, 2
""")
def subtype_closure(spark, root):
    """O1, O3: all subtypes of each platform class."""
    roots = table(spark, root, "platform_classes").select(F.col("fqn").alias("root"))
    return graph.subtype_closure(graph.subtype_edges(_classes(spark, root)), roots)


@query(f"""
SELECT coalesce(a.fqn, b.fqn) AS fqn, coalesce(a.p, b.p) AS parent, CASE WHEN a.fqn IS NOT NULL THEN 'index' ELSE 'external' END AS origin
FROM (SELECT fqn, min({SUPER}) AS p FROM classes WHERE {SUPER} IS NOT NULL GROUP BY 1) a
FULL JOIN (SELECT fqn, min({SUPER}) AS p FROM m2_classes WHERE {SUPER} IS NOT NULL GROUP BY 1) b ON a.fqn = b.fqn
""")
def parents(spark, root):
    """O2: the own super class, else that of the external classes."""
    own = table(spark, root, "classes").select("fqn", class_ref(F.col("super_fqn")).alias("super_fqn"))
    return graph.parents(own, _classes(spark, root))


@query(f"""
WITH RECURSIVE p AS (SELECT fqn, min({SUPER}) AS parent FROM m2_classes WHERE {SUPER} IS NOT NULL GROUP BY 1),
d AS (SELECT DISTINCT callee_owner, callee_name, callee_desc FROM {CALLS_SQL} WHERE callee_owner IS NOT NULL AND length(callee_owner) % 3 <> 0),
q AS (SELECT DISTINCT callee_owner AS owner, callee_name AS name, callee_desc AS "desc" FROM {CALLS_SQL} WHERE callee_owner IS NOT NULL),
walk AS (SELECT owner, name, "desc", owner AS cur, [owner] AS seen FROM q
  UNION ALL SELECT w.owner, w.name, w."desc", p.parent, list_append(w.seen, p.parent) FROM walk w JOIN p ON p.fqn = w.cur WHERE NOT list_contains(w.seen, p.parent)),
hits AS (SELECT w.owner, w.name, w."desc", arg_min(w.cur, len(w.seen)) AS declaring FROM walk w JOIN d ON d.callee_owner = w.cur AND d.callee_name = w.name AND d.callee_desc = w."desc" GROUP BY 1, 2, 3)
SELECT q.owner, q.name, q."desc", declaring FROM q LEFT JOIN hits USING (owner, name, "desc")
""")
def declaring_types(spark, root):
    """For all calls the nearest type on the way up that declares the method. There is no table of declarations: those
    methods count as declared whose type has a name of certain lengths, so that some are and some aren't."""
    every = calls(spark, root).where("callee_owner IS NOT NULL").select(F.col("callee_owner").alias("owner"), F.col("callee_name").alias("name"), F.col("callee_desc").alias("desc"), (F.length("callee_owner") % 3 != 0).alias("declares"))
    parent = _classes(spark, root).where("super_fqn IS NOT NULL").groupBy("fqn").agg(F.min("super_fqn").alias("parent"))
    return graph.declaring_types(every, parent, every.where("declares").withColumnRenamed("owner", "fqn"))


_GAV_SQL = f"CASE WHEN regexp_extract({_JAR}, '^(.*)-(\\d+(?:\\.\\d+)*(?:[.-].*)?)$', 2) <> '' THEN regexp_extract({_JAR}, '^(.*)-(\\d+(?:\\.\\d+)*(?:[.-].*)?)$', 1) || ':' || regexp_extract({_JAR}, '^(.*)-(\\d+(?:\\.\\d+)*(?:[.-].*)?)$', 1) || ':' || regexp_extract({_JAR}, '^(.*)-(\\d+(?:\\.\\d+)*(?:[.-].*)?)$', 2) END"


@query(f"""
WITH RECURSIVE c AS (SELECT fqn, {SUPER} AS super, {_GAV_SQL} AS gav FROM m2_classes),
e AS (SELECT DISTINCT a.gav AS src, b.gav AS dst FROM c a JOIN c b ON b.fqn = a.super WHERE a.gav IS NOT NULL AND b.gav IS NOT NULL AND a.gav <> b.gav),
walk AS (SELECT min(src) AS gav, 0 AS depth FROM e UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN e ON e.src = w.gav WHERE w.depth < 12)
SELECT gav, min(depth) AS depth FROM walk GROUP BY 1 HAVING min(depth) > 0
""")
def artifact_dependencies(spark, root):
    """Artifacts that hold super classes of one artifact's classes, and of these in turn."""
    c = table(spark, root, "m2_classes").select("fqn", class_ref(F.col("super_fqn")).alias("super"), C.coordinate_from_path(F.col("jar_path")).alias("gav")).where("NOT startswith(gav, 'local:')")
    above = c.select(F.col("fqn").alias("super"), F.col("gav").alias("dep"))
    links = c.select("super", F.col("gav").alias("pom")).join(above, "super").where("pom <> dep").select("pom", C.coordinate(F.col("dep")).alias("g")).distinct()
    edges = links.select("pom", "g.*", F.lit("compile").alias("scope"), F.lit("jar").alias("type"))
    first = edges.agg(F.min("pom").alias("pom"))
    return resolve.resolve_dependencies(edges, first, 12).select(C.coordinate_text(F.col("group"), F.col("artifact"), F.col("version")).alias("gav"), "depth")


def call_edges(spark: SparkSession, root: str) -> DataFrame:
    return calls(spark, root).where("caller IS NOT NULL AND callee_owner IS NOT NULL").select(F.col("caller").alias("src"), F.col("callee_owner").alias("dst"), F.col("id").alias("edge_ord"))


@query(f"""
WITH RECURSIVE e AS (SELECT DISTINCT caller AS src, callee_owner AS dst FROM {CALLS_SQL} WHERE caller IS NOT NULL AND callee_owner IS NOT NULL),
walk AS (SELECT min(src) AS vertex, 0 AS depth FROM e UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN e ON e.src = w.vertex WHERE w.depth < 8)
SELECT vertex, min(depth) AS depth FROM walk GROUP BY 1
""")
def reachable(spark, root):
    """Classes within eight calls of one class, the depth find_path has unless asked."""
    edges = call_edges(spark, root)
    return graph.reach(edges, edges.agg(F.min("src")).first()[0], 8).select("vertex", "depth")


@query(f"""
WITH RECURSIVE edges AS (SELECT DISTINCT {SUPER} AS parent, fqn AS child FROM m2_classes WHERE {SUPER} IS NOT NULL),
c AS (SELECT * FROM {CALLS_SQL} WHERE callee_owner IS NOT NULL AND caller IS NOT NULL),
walk AS (SELECT DISTINCT callee_owner AS root, callee_owner AS subtype, 0 AS d FROM c
  UNION ALL SELECT w.root, e.child, w.d + 1 FROM walk w JOIN edges e ON e.parent = w.subtype WHERE w.d < 60),
closure AS (SELECT DISTINCT root, subtype FROM walk)
SELECT target, note, count(*) AS n_edges FROM (
  SELECT subtype AS target, 'CHA' AS note FROM c JOIN closure ON root = callee_owner WHERE call_kind = 'invoke'
  UNION ALL SELECT callee_owner, 'dynamic' FROM c WHERE call_kind = 'invoke_dynamic') GROUP BY 1, 2
""")
def expanded_edges(spark, root):
    """Edges after class hierarchy analysis, counted by target; ``call_graph`` has them one by one."""
    kind = F.when(F.col("call_kind") == "invoke", "VIRTUAL").when(F.col("call_kind") == "invoke_dynamic", "DYNAMIC").otherwise("REFLECT")
    edges = calls(spark, root).where("callee_owner IS NOT NULL AND caller IS NOT NULL").select(
        "caller", F.col("callee_owner").alias("owner"), F.col("callee_name").alias("name"), F.col("callee_desc").alias("desc"), kind.alias("kind"), F.lit("CERTAIN").alias("confidence"), F.lit(0).alias("line")
    )
    # calls are combined by owner before they fan out over the subtypes
    few = edges.groupBy("owner", "kind").agg(F.count(F.lit(1)).alias("line")).select(F.lit("").alias("caller"), "owner", F.lit("").alias("name"), F.lit("").alias("desc"), "kind", F.lit("CERTAIN").alias("confidence"), "line")
    closure = graph.subtype_closure(graph.subtype_edges(_classes(spark, root)), few.where("kind = 'VIRTUAL'").select(F.col("owner").alias("root")))
    return graph.expand_edges(few, closure).groupBy("target", "note").agg(F.sum("line").alias("n_edges"))


@query(f"SELECT src, count(*) AS n_out, count(DISTINCT dst) AS n_targets FROM (SELECT caller AS src, callee_owner AS dst FROM {CALLS_SQL} WHERE caller IS NOT NULL AND callee_owner IS NOT NULL) GROUP BY 1")
def out_degrees(spark, root):
    """Calls that go out of each class, by a plain aggregate."""
    return call_edges(spark, root).groupBy("src").agg(F.count(F.lit(1)).alias("n_out"), F.countDistinct("dst").alias("n_targets"))


# ---- kernels (C, X) ------------------------------------------------------------------------------------------------

_READ = "concat(CASE WHEN base LIKE 'L%;' THEN replace(substr(base, 2, length(base) - 2), '/', '.') ELSE " + "CASE base " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.PRIMITIVES.items()) + " END END, repeat('[]', length(d) - length(base)))"


@query(f"""
SELECT id, ({_READ}) AS returns, n AS n_arguments FROM (
  SELECT id, d, ltrim(d, '[') AS base, n FROM (SELECT id, regexp_extract(callee_method_desc, '\\)(.*)$', 1) AS d,
    CAST(len(regexp_extract_all(regexp_extract(callee_method_desc, '^\\((.*)\\)', 1), '\\[*(?:L[^;]+;|[ZBCSIJFD])')) AS INTEGER) AS n FROM m2_invokes WHERE callee_method_desc LIKE '(%)_%'))
""")
def descriptors(spark, root):
    """C7, C8, C10."""
    d = F.col("callee_method_desc")
    return table(spark, root, "m2_invokes").where(d.like("(%)_%")).select("id", S.return_type(d).alias("returns"), S.argument_count(d).alias("n_arguments"))


@query("""
SELECT id, replace(fqn, '/', '.') AS dotted, regexp_extract(fqn, '([^/]*)$', 1) AS binary_name, replace(regexp_extract(fqn, '^(.*)/[^/]*$', 1), '/', '.') AS package,
  lower(substr(regexp_extract(fqn, '([^./$]*)$', 1), 1, 1)) || substr(regexp_extract(fqn, '([^./$]*)$', 1), 2) AS bean, fqn = 'net' OR fqn LIKE 'net/%' AS in_net FROM classes
""")
def class_names(spark, root):
    """C1 to C5, C17."""
    f = F.col("fqn")
    return table(spark, root, "classes").select("id", S.dotted(f).alias("dotted"), S.binary_name(f).alias("binary_name"), S.package_name(f).alias("package"), X.default_bean_name(f).alias("bean"), S.in_package(f, F.lit("net")).alias("in_net"))


@query("SELECT id, unnest(list_filter(string_split(interfaces, ','), lambda x: x <> '')) AS interface FROM classes")
def implemented_interfaces(spark, root):
    """C12."""
    return table(spark, root, "classes").select("id", F.explode(S.decode_interfaces(F.col("interfaces"))).alias("interface"))


@query("""
SELECT id, CASE WHEN signature_raw LIKE '<T:%' THEN 'T,' ELSE '' END || 'super=' || replace(regexp_extract(signature_raw, 'L([^;<>]*);$', 1), '/', '.') AS decoded FROM classes WHERE signature_raw IS NOT NULL
""")
def decoded_signatures(spark, root):
    """C11."""
    return table(spark, root, "classes").where("signature_raw IS NOT NULL").select("id", S.signature_decoder("class")(F.col("signature_raw")).alias("decoded"))


@query("""
SELECT id, CASE WHEN s LIKE '%;' THEN left(s, length(s) - 1) ELSE s END AS sql FROM (SELECT id,
  trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(sql_template, '<!--.*?-->', ' ', 'g'), '--.*?(\\r?\\n|$)', ' ', 'g'), '/\\*.*?\\*/', ' ', 'g'), '\\s+', ' ', 'g')) AS s
FROM mybatis_statements WHERE sql_template IS NOT NULL)
""")
def normalised_sql(spark, root):
    """X8."""
    return table(spark, root, "mybatis_statements").where("sql_template IS NOT NULL").select("id", X.normalise_sql(F.col("sql_template")).alias("sql"))


@query("""
SELECT id, array_to_string(list_filter(n, lambda x, i: i = 1 OR x <> n[i - 1]), ',') AS names, CAST(len(from_json(parameter_names, '["VARCHAR"]')) AS INTEGER) AS n_recorded
FROM (SELECT id, parameter_names, list_transform(regexp_extract_all(coalesce(sql_template, ''), '[#$]\\{([^}]+)\\}', 1), lambda x: trim(x)) AS n FROM mybatis_statements)
""")
def statement_parameters(spark, root):
    """X9, X11."""
    return table(spark, root, "mybatis_statements").select("id", F.array_join(X.parameter_names(F.col("sql_template")), ",").alias("names"), F.size(X.json_list(F.col("parameter_names"))).alias("n_recorded"))


# ---- search (T) ----------------------------------------------------------------------------------------------------

_BM = "tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / mean))"


@query(f"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
n AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM w),
p AS (SELECT term, doc_id, count(*) AS tf, any_value(doc_len) AS doc_len FROM (SELECT doc_id, len(w) AS doc_len, unnest(w) AS term FROM w) WHERE term IN ({', '.join(f"'{t}'" for t in TERMS.split())}) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM p GROUP BY 1)
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * {_BM}), 6) AS score FROM p JOIN df USING (term), n GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 20
""")
def text_search(spark, root):
    """T1, T2, L6."""
    return search.search(table(spark, root, "documents"), TERMS, 20, content="text")


@query("""
WITH d AS (SELECT fqn, list_filter(regexp_split_to_array(lower(regexp_replace(fqn, '[/$.]', ' ', 'g')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM (SELECT DISTINCT fqn FROM classes))
SELECT term, count(*) AS n_classes FROM (SELECT DISTINCT fqn, unnest(w) AS term FROM d) GROUP BY 1
""")
def name_terms(spark, root):
    """Terms of class names with the number of classes that hold them."""
    documents = search.class_documents(table(spark, root, "classes").select("fqn").distinct())
    return search.postings(documents, "fqn").groupBy("term").agg(F.count(F.lit(1)).alias("n_classes"))


# ---- wiring (X2, J) ------------------------------------------------------------------------------------------------


def _bean_rows(spark: SparkSession, root: str) -> DataFrame:
    one = table(spark, root, "classes").groupBy("fqn").agg(F.min("id").alias("id"))
    return one.select("id", X.default_bean_name(F.col("fqn")).alias("name"), F.col("fqn").alias("type_fqn"))


_BEANS_SQL = "(SELECT min(id) AS id, lower(substr(regexp_extract(fqn, '([^./$]*)$', 1), 1, 1)) || substr(regexp_extract(fqn, '([^./$]*)$', 1), 2) AS name, fqn AS type_fqn FROM classes GROUP BY fqn)"


@query(f"""
WITH b AS {_BEANS_SQL}, s AS (SELECT id AS site_id, {class_ref_sql('interface_fqn')} AS type_fqn, nullif(ref_id, '') AS qualifier FROM dubbo_references),
q AS (SELECT name, min(id) AS id FROM b GROUP BY 1), t AS (SELECT type_fqn, list_sort(list(DISTINCT id)) AS ids FROM b GROUP BY 1),
sub AS (SELECT DISTINCT parent, child FROM (SELECT super_fqn AS parent, fqn AS child FROM classes WHERE super_fqn <> '' UNION ALL SELECT unnest(list_filter(string_split(interfaces, ','), lambda x: x <> '')), fqn FROM classes)),
u AS (SELECT parent, list_sort(list(DISTINCT b.id)) AS ids FROM sub JOIN b ON b.type_fqn = sub.child GROUP BY 1)
SELECT site_id, CASE WHEN qualifier IS NOT NULL THEN 'QUALIFIER' ELSE 'TYPE' END AS by_axis,
  CASE WHEN qualifier IS NOT NULL THEN CASE WHEN q.id IS NULL THEN 'UNCERTAIN' ELSE 'CERTAIN' END WHEN len(t.ids) = 1 THEN 'CERTAIN' WHEN t.ids IS NOT NULL OR u.ids IS NOT NULL THEN 'PROBABLE' ELSE 'UNCERTAIN' END AS confidence,
  CASE WHEN qualifier IS NOT NULL THEN coalesce(CAST(q.id AS VARCHAR), '') ELSE coalesce(array_to_string(coalesce(t.ids, u.ids), ','), '') END AS candidates
FROM s LEFT JOIN q ON q.name = s.qualifier LEFT JOIN t ON t.type_fqn = s.type_fqn LEFT JOIN u ON u.parent = s.type_fqn
""")
def resolved_injects(spark, root):
    """X2, J7."""
    classes = table(spark, root, "classes").select("fqn", "super_fqn", S.decode_interfaces(F.col("interfaces")).alias("interfaces"))
    sites = table(spark, root, "dubbo_references").select(F.col("id").alias("site_id"), class_ref(F.col("interface_fqn")).alias("type_fqn"), F.nullif("ref_id", F.lit("")).alias("qualifier"))
    out = wiring.resolve_injects(sites, _bean_rows(spark, root), classes)
    return out.select("site_id", "by_axis", "confidence", F.array_join("candidate_bean_ids", ",").alias("candidates"))


@query(f"""
WITH b AS {_BEANS_SQL}, q AS (SELECT name, min_by(type_fqn, id) AS type_fqn FROM b GROUP BY 1), c AS (SELECT fqn, min(id) AS id FROM classes GROUP BY 1),
s AS (SELECT id, lower(substr(regexp_extract(interface_fqn, '([^./$]*)$', 1), 1, 1)) || substr(regexp_extract(interface_fqn, '([^./$]*)$', 1), 2) AS ref FROM dubbo_services)
SELECT s.id, coalesce(k.id, 0) AS impl_class_id FROM s LEFT JOIN q ON q.name = s.ref LEFT JOIN c k ON k.fqn = q.type_fqn
""")
def resolved_implementations(spark, root):
    """Services whose interface names a bean."""
    services = table(spark, root, "dubbo_services").select("id", X.default_bean_name(F.col("interface_fqn")).alias("ref"))
    return wiring.resolve_implementations(services, _bean_rows(spark, root), table(spark, root, "classes")).select("id", "impl_class_id")


@query(f"SELECT r.id, EXISTS (SELECT 1 FROM classes c WHERE c.fqn = {class_ref_sql('r.interface_fqn')}) AS class_known FROM dubbo_references r")
def conditions_met(spark, root):
    """Whether the class a record asks for is indexed."""
    asked = table(spark, root, "dubbo_references").select("id", class_ref(F.col("interface_fqn")).alias("required_class"))
    return wiring.conditions_met(asked, table(spark, root, "classes")).select("id", "class_known")
