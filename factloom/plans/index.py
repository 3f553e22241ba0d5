"""Indexing as a graph of stages. Section 3.2 of the survey, K18, A7, O12.

archives -> class bytes -> skip by hash -> class facts -> tables; beans before injection sites, bean XML before service
XML, annotations before XML. A stage is a few DataFrames over all archives at once; a broken class becomes an issue.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from factloom import schema
from factloom.functions import coordinates as C
from factloom.functions import symbols as S
from factloom.operators import maintain, wiring
from factloom.session import cut, scratch
from factloom.sources import archives as A
from factloom.sources import classfile, java, xml
from factloom.sources.store import Store


@dataclass
class Report:
    """What one run did, by artifact and in total."""

    classes_indexed: int = 0
    classes_skipped: int = 0
    classes_gone: int = 0
    issues: int = 0
    by_artifact: dict[str, int] = field(default_factory=dict)


def index_archives(store: Store, *paths: str, sources: tuple[str, ...] = (), repo: str = "local") -> Report:
    """Indexes archives into the store; unchanged classes are skipped by content."""
    spark = store.spark
    with scratch(spark):
        return index_files(store, A.archives(spark, *paths), A.archives(spark, *sources) if sources else None, repo)


def index_files(store: Store, files: DataFrame, sources: DataFrame | None = None, repo: str = "local") -> Report:
    """The same for archives as rows (path, content)."""
    spark = store.spark
    gav = C.coordinate(C.coordinate_from_path(F.col("path")))
    store.upsert("repos", spark.createDataFrame([(repo, "local", "")], "name string, kind string, url string"))
    repo_id = store.read("repos").where(F.col("name") == repo).first().id
    artifacts = files.select(gav.alias("g"), "path").select(F.lit(repo_id).alias("repo_id"), F.col("g.group").alias("gav_group"), F.col("g.artifact").alias("gav_artifact"), F.col("g.version").alias("gav_version"), "path", F.lit(sources is not None).alias("has_sources"), F.lit(100).alias("score"))
    store.upsert("artifacts", artifacts)
    artifact = store.read("artifacts").select(F.col("path").alias("archive"), F.col("id").alias("artifact_id"))

    read = A.class_bytes(files)
    listed = cut(
        read.select("archive", "fqn", F.sha2("content", 256).alias("sha256")).join(artifact, "archive").select("archive", "fqn", "artifact_id", F.concat("fqn", F.lit(".class")).alias("rel_path"), "sha256", F.lit("class").alias("lang"))
    )
    scope = store.read("files").join(listed.select("artifact_id").distinct(), "artifact_id", "left_semi").where("lang = 'class'")
    changes = cut(maintain.classify_changes(scope, listed, ["artifact_id", "rel_path"]))
    counts = {r.change: r.n for r in changes.groupBy("change").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most four rows
    fresh = cut(listed.join(changes.where("change IN ('NEW', 'CHANGED')").select("artifact_id", "rel_path"), ["artifact_id", "rel_path"], "left_semi"))
    report = Report(counts.get("NEW", 0) + counts.get("CHANGED", 0), counts.get("UNCHANGED", 0), counts.get("GONE", 0))

    # what changed or went is taken out with all that hangs on it, then written anew
    stale = changes.where("change IN ('CHANGED', 'GONE')").select(F.regexp_replace("rel_path", r"\.class$", "").alias("fqn"))
    if counts.keys() & {"CHANGED", "GONE"}:
        store.delete_classes(cut(store.read("classes").join(stale, "fqn", "left_semi").select("id")))
        gone = changes.where("change = 'GONE'").select("artifact_id", "rel_path")
        store.write("files", cut(store.read("files").join(gone, ["artifact_id", "rel_path"], "left_anti")))
    if report.classes_indexed:
        store.upsert("files", fresh)
        _store_facts(store, cut(classfile.extract(read.join(fresh.select("archive", "fqn"), ["archive", "fqn"], "left_semi"))), fresh)
    report.by_artifact = {r.gav: r.n for r in fresh.join(artifact.withColumnRenamed("archive", "_a"), "artifact_id").groupBy(F.col("_a").alias("gav")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row an archive
    _store_frameworks(store, files, sources)
    unread = A.missing_bytes(listed, read)
    if sources is not None:
        texts = A.sources(sources).select("fqn")
        without = fresh.select("fqn").where("NOT contains(fqn, '$')").join(texts, "fqn", "left_anti").select(F.lit("missing_source").alias("kind"), F.col("fqn").alias("target"), F.lit("no source text").alias("message"), F.lit("INFO").alias("severity"))
        unread = unread.unionByName(without)
    # issues of other kinds with the same target stay
    old = store.read("issues").join(unread.select("kind", "target"), ["kind", "target"], "left_anti")
    store.write("issues", cut(schema.conform(old.unionByName(unread, allowMissingColumns=True), "issues")))
    report.issues = store.read("issues").count()
    return report


def _store_facts(store: Store, facts: DataFrame, fresh: DataFrame) -> None:
    t = classfile.fact_tables(facts)
    class_id = schema.stable_id(F.col("fqn"))
    method_id = schema.stable_id(F.col("fqn"), F.col("name"), F.col("desc"))
    file_ids = store.read("files").select(F.col("id").alias("file_id"), "artifact_id", "rel_path")
    place = fresh.join(file_ids, ["artifact_id", "rel_path"]).select("archive", "fqn", "file_id")
    # of equal names in several archives the first by path counts
    first = t["classes"].join(place, ["archive", "fqn"], "left").groupBy("fqn").agg(F.min_by(F.struct("super_fqn", "access", "interfaces", "signature_raw", "file_id", "archive"), "archive").alias("c"))
    chosen = first.select("fqn", F.col("c.archive").alias("archive"))
    store.upsert("classes", first.select("fqn", "c.*").select(class_id.alias("id"), "fqn", "access", "super_fqn", "file_id", "signature_raw", F.lit("jar").alias("source"), "interfaces", F.col("archive").alias("source_jar")))
    of = lambda name: t[name].join(chosen, ["archive", "fqn"], "left_semi")
    store.upsert("methods", of("methods").select(method_id.alias("id"), class_id.alias("class_id"), "name", "desc", "access", "signature_raw", "start_line", "end_line", F.lit(False).alias("virtual_lines")))
    store.upsert("fields", of("fields").select(schema.stable_id(F.col("fqn"), F.col("name"), F.col("desc")).alias("id"), class_id.alias("class_id"), "name", "desc", "access", "signature_raw"))
    store.replace("invokes", of("invokes").select(method_id.alias("caller_method_id"), "callee_owner", "callee_name", "callee_desc", "kind", "line", "confidence"), "caller_method_id")
    store.replace("lambdas", of("lambdas").select(method_id.alias("enclosing_method_id"), "synthetic_fqn", "bsm_target", "line"), "enclosing_method_id")
    store.upsert("spring_autoconfig_conditions", t["conditions"])
    reflect = of("invokes").where("confidence = 'UNCERTAIN'").select(F.lit("uncertain_reflect").alias("kind"), F.concat("fqn", F.lit("#"), "name", "desc").alias("target"), F.lit("target of a reflective call is unknown").alias("message"), F.lit("INFO").alias("severity"))
    store.replace("issues", t["issues"].unionByName(reflect), "target")


def _store_frameworks(store: Store, files: DataFrame, sources: DataFrame | None) -> None:
    store.upsert("spring_boot_autoconfigs", A.autoconfigs(files))
    rows = cut(xml.extract(xml.documents_of(A.entries(files, r"\.xml$"))))
    x = xml.tables(rows)
    j = None
    if sources is not None:
        units = A.entries(sources, r"\.java$").where("content IS NOT NULL")
        j = java.tables(cut(java.extract(units.select(F.concat("archive", F.lit("!"), F.col("entry")).alias("source_file"), F.decode("content", "UTF-8").alias("text")))))
    classes = store.read("classes")
    ids = classes.select(F.col("fqn").alias("type_fqn"), F.col("id").alias("class_id"))
    # beans of annotations, then of XML, so that XML wins
    beans = x["spring_beans"].select("name", "type_fqn", "source", "scope", "primary_b", F.lit(1).alias("rank"))
    if j:
        beans = beans.unionByName(j["spring_beans"].select("name", "type_fqn", "source", "scope", F.lit(False).alias("primary_b"), F.lit(0).alias("rank")))
    store.upsert("spring_beans", cut(beans.join(ids, "type_fqn", "left").groupBy("name", "type_fqn").agg(F.max_by(F.struct("source", "scope", "primary_b", "class_id"), "rank").alias("b")).select("name", "type_fqn", "b.*")))
    stored = store.read("spring_beans")
    if j:
        named = store.read("methods").join(classes.select(F.col("id").alias("class_id"), "fqn"), "class_id").withColumn("parameter_types", S.parameter_types(F.col("desc")))
        store.write("methods", cut(java.attribute_lines(named, j["method_lines"])))
        found = wiring.resolve_injects(j["sites"].withColumn("site_id", F.xxhash64("owner", "field_or_param")), stored, classes)
        owned = found.join(classes.select(F.col("fqn").alias("owner"), F.col("id").alias("owner_class_id")), "owner")
        store.replace("spring_injects", cut(owned), "owner_class_id")
    services = wiring.resolve_implementations(x["dubbo_services"].withColumn("ref", F.col("ref_bean_name")), stored, classes)
    references = x["dubbo_references"]
    if j:
        impl = classes.select(F.col("fqn").alias("impl_fqn"), F.col("id").alias("impl_class_id"))
        services = services.drop("source_file", "ref").unionByName(j["dubbo_services"].join(impl, "impl_fqn", "left").drop("impl_fqn").withColumn("impl_class_id", F.coalesce("impl_class_id", F.lit(0))), allowMissingColumns=True)
        fields = store.read("fields").join(classes.select(F.col("id").alias("class_id"), F.col("fqn").alias("owner")), "class_id").select("owner", "name", F.col("id").alias("field_id"))
        held = j["dubbo_references"].join(fields, ["owner", "name"], "left").select("interface_fqn", "group_name", "service_version", F.lit("").alias("registry_id"), F.lit("").alias("ref_id"), F.when(F.col("field_id").isNull(), "UNCERTAIN").otherwise("CERTAIN").alias("confidence"), F.coalesce("field_id", F.lit(0)).alias("field_id"), F.col("owner").alias("consumer_class_fqn"))
        references = references.drop("source_file").unionByName(held)
    store.upsert("dubbo_registries", x["dubbo_registries"])
    store.upsert("dubbo_services", services)
    store.upsert("dubbo_references", references)
    key = ["interface_fqn", "group_name", "service_version", "registry_id"]
    parents = store.read("dubbo_services").groupBy(*key, F.col("ref_bean_name").alias("ref")).agg(F.min("id").alias("service_id"))
    consumers = store.read("dubbo_references").groupBy(*key, F.col("ref_id").alias("ref")).agg(F.min("id").alias("reference_id"))
    configs = x["dubbo_method_configs"]
    mine = configs.where("parent = 'service'").join(parents, [*key, "ref"]).withColumn("reference_id", F.lit(0).cast("bigint"))
    theirs = configs.where("parent = 'reference'").join(consumers, [*key, "ref"]).withColumn("service_id", F.lit(0).cast("bigint"))
    store.upsert("dubbo_method_configs", mine.unionByName(theirs))
    statements = x["mybatis_statements"].withColumn("line_no", F.lit(None).cast("int")).withColumn("rank", F.lit(1))
    if j:
        from factloom.functions import text as X

        annotated = j["mybatis_statements"].withColumn("sql_normalized", X.normalise_sql(F.col("sql_template"))).withColumn("parameter_names", X.parameter_names(F.col("sql_template"))).withColumn("rank", F.lit(0))
        statements = statements.unionByName(annotated)
    best = statements.groupBy("mapper_namespace", "statement_id").agg(F.max_by(F.struct(*(c for c in statements.columns if c not in ("mapper_namespace", "statement_id"))), "rank").alias("s"))
    store.upsert("mybatis_statements", best.select("mapper_namespace", "statement_id", "s.*"))
    store.upsert("mybatis_result_maps", x["mybatis_result_maps"])
    store.replace("issues", x["issues"], "target")


def index_missing(store: Store, fqn: str, *roots: str) -> bool:
    """Indexes the first archive below ``roots`` that holds a class; false if none does."""
    listed = A.archives(store.spark, *(f"{r.rstrip('/')}/*.jar" if not r.endswith(".jar") else r for r in roots))
    hit = A.class_list(listed).where(F.col("fqn") == fqn).agg(F.min("archive")).first()[0]
    if hit is None:
        return False
    index_archives(store, hit)
    return True


def warm(store: Store, *paths: str, cap: int = 50) -> DataFrame:
    """Archives read ahead into the cache tables with their classes, methods and calls, least recently used ones leaving;
    unchanged ones are not read again. Returns the cache."""
    files = A.archives(store.spark, *paths)
    counts = A.class_list(files).groupBy(F.col("archive").alias("jar_path")).agg(F.count(F.lit(1)).cast("int").alias("classes_count"))
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    seen = cut(files.select(F.col("path").alias("jar_path"), F.sha2("content", 256).alias("jar_sha256"), F.unix_millis("modificationTime").alias("jar_mtime_ms")))
    cached = store.read("m2_caches")
    # what is cached and unchanged is only touched; what is new or changed is read anew
    kept = seen.join(cached.select("jar_path", "jar_sha256"), ["jar_path", "jar_sha256"], "left_semi").select("jar_path")
    wanted = cut(seen.join(kept, "jar_path", "left_anti").select("jar_path"))
    t = classfile.fact_tables(cut(classfile.extract(A.class_bytes(files.join(wanted.withColumnRenamed("jar_path", "path"), "path", "left_semi")))))
    jar = F.col("archive").alias("jar_path")
    class_id, method_id = schema.stable_id(F.col("fqn"), F.col("archive")), schema.stable_id(F.col("fqn"), F.col("archive"), F.col("name"), F.col("desc"))
    store.replace("m2_classes", cut(t["classes"].select(class_id.alias("id"), "fqn", "super_fqn", "access", "interfaces", jar)), "jar_path")
    store.replace("m2_methods", cut(t["methods"].select(method_id.alias("id"), class_id.alias("m2_class_id"), "name", "desc", "access")), "m2_class_id")
    store.replace("m2_invokes", cut(t["invokes"].select(method_id.alias("caller_m2_method_id"), F.col("callee_owner").alias("callee_class_fqn"), F.col("callee_name").alias("callee_method_name"), F.col("callee_desc").alias("callee_method_desc"), F.col("kind").alias("call_kind"))), "caller_m2_method_id")
    n = lambda name, as_: t[name].groupBy(F.col("archive").alias("jar_path")).agg(F.count(F.lit(1)).cast("int").alias(as_))
    fresh = seen.join(wanted, "jar_path", "left_semi").join(counts, "jar_path", "left").join(n("methods", "methods_count"), "jar_path", "left").join(n("invokes", "invokes_count"), "jar_path", "left")
    rows = schema.conform(fresh.withColumn("extracted_at", now).withColumn("last_access_at", now), "m2_caches").withColumn("id", schema.stable_id(F.col("jar_path")))
    touched = seen.select("jar_path", now.alias("at"))
    store.write("m2_caches", cut(maintain.evict(maintain.cache_touch(maintain.cache_upsert(cached, rows), touched), cap)))
    # archives that had to leave take their facts along
    left = store.read("m2_caches").select("jar_path")
    store.write("m2_classes", cut(store.read("m2_classes").join(left, "jar_path", "left_semi")))
    store.write("m2_methods", cut(store.read("m2_methods").join(store.read("m2_classes").select(F.col("id").alias("m2_class_id")), "m2_class_id", "left_semi")))
    store.write("m2_invokes", cut(store.read("m2_invokes").join(store.read("m2_methods").select(F.col("id").alias("caller_m2_method_id")), "caller_m2_method_id", "left_semi")))
    return store.read("m2_caches")
