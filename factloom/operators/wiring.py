"""Resolution of beans, references and conditions by ranked joins. Rows X2, J7 to J10, J12, J14 of the survey."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from factloom.functions.symbols import from_dotted
from factloom.operators.graph import subtype_edges
from factloom.operators.skew_join import heavy, repeated, salted, unique_join


def inject_candidates(sites: DataFrame, beans: DataFrame, classes: DataFrame) -> DataFrame:
    """A row for each site(site_id, type_fqn, qualifier) and candidate bean: the site's columns, by_axis, confidence,
    bean_id (null where there is none).

    A qualifier decides alone: the first bean of that name is CERTAIN, none is UNCERTAIN. Else beans of exactly the
    type: one is CERTAIN, several PROBABLE. Else beans of direct subtypes, always PROBABLE. Else UNCERTAIN and none.
    """
    qualified = F.col("qualifier").isNotNull()
    by_name = beans.groupBy(F.col("name").alias("qualifier")).agg(F.min("id").alias("bean_id"))
    named = unique_join(sites.where(qualified), by_name, "qualifier").select(*sites.columns, F.lit("QUALIFIER").alias("by_axis"), F.when(F.col("bean_id").isNull(), "UNCERTAIN").otherwise("CERTAIN").alias("confidence"), "bean_id")
    own = beans.select("type_fqn", F.col("id").alias("bean_id")).distinct()
    below = subtype_edges(classes, interfaces=True).join(own.withColumnRenamed("type_fqn", "child"), "child").select(F.col("parent").alias("type_fqn"), "bean_id").distinct()
    counts = own.groupBy("type_fqn").agg(F.count(F.lit(1)).alias("_n")).withColumn("_exact", F.lit(True))
    # subtypes count only where no bean is of the type itself
    below = below.join(counts.select("type_fqn"), "type_fqn", "left_anti")
    pool = own.join(counts, "type_fqn").select("type_fqn", "bean_id", F.when(F.col("_n") == 1, "CERTAIN").otherwise("PROBABLE").alias("confidence")).unionByName(below.withColumn("confidence", F.lit("PROBABLE")))
    typed = sites.where(~qualified)
    hot = heavy(typed, "type_fqn")
    found = salted(typed, "type_fqn", hot).join(repeated(pool, "type_fqn", hot), ["type_fqn", "_salt"], "left")
    return named.unionByName(found.select(*sites.columns, F.lit("TYPE").alias("by_axis"), F.coalesce("confidence", F.lit("UNCERTAIN")).alias("confidence"), "bean_id"))


def resolve_injects(sites: DataFrame, beans: DataFrame, classes: DataFrame) -> DataFrame:
    """The same as one row for each site with candidate_bean_ids, ascending."""
    rows = inject_candidates(sites, beans, classes)
    return rows.groupBy(*sites.columns, "by_axis", "confidence").agg(F.array_sort(F.collect_list("bean_id")).alias("candidate_bean_ids"))


def resolve_implementations(services: DataFrame, beans: DataFrame, classes: DataFrame) -> DataFrame:
    """services(ref, ...) with impl_class_id: the class of the first bean of that name, else the class the ref names, else 0."""
    ids = classes.select(F.col("fqn").alias("_fqn"), F.col("id").alias("_id")).groupBy("_fqn").agg(F.min("_id").alias("_id"))
    named = beans.groupBy(F.col("name").alias("ref")).agg(F.min_by("type_fqn", "id").alias("_bean"))
    a = services.drop("impl_class_id").join(named, "ref", "left").join(ids.toDF("_bean", "_by_bean"), "_bean", "left")
    named_class = F.when(F.contains("ref", F.lit(".")), from_dotted(F.trim("ref")))
    b = a.withColumn("_ref", named_class).join(ids.toDF("_ref", "_by_ref"), "_ref", "left")
    return b.withColumn("impl_class_id", F.coalesce("_by_bean", "_by_ref", F.lit(0))).drop("_bean", "_ref", "_by_bean", "_by_ref")


def resolve_fields(references: DataFrame, fields: DataFrame, classes: DataFrame) -> DataFrame:
    """references(owner, name, desc, ...) with field_id; one that is not found is 0 and UNCERTAIN."""
    known = fields.join(classes.select(F.col("id").alias("class_id"), F.col("fqn").alias("owner")), "class_id").select("owner", "name", "desc", F.col("id").alias("_f"))
    joined = references.drop("field_id", "confidence").join(known, ["owner", "name", "desc"], "left")
    return joined.withColumn("field_id", F.coalesce("_f", F.lit(0))).withColumn("confidence", F.when(F.col("_f").isNull(), "UNCERTAIN").otherwise("CERTAIN")).drop("_f")


def reference_ids(wanted: DataFrame, references: DataFrame) -> DataFrame:
    """wanted(interface_fqn, group_name, service_version, ref_id) with reference_id, the first match or 0; blank ref ids find none."""
    key = ["interface_fqn", "group_name", "service_version", "ref_id"]
    blank = lambda df: df.withColumns({c: F.coalesce(c, F.lit("")) for c in key[1:]})
    first = blank(references).where(F.trim("ref_id") != "").groupBy(*key).agg(F.min("id").alias("_r"))
    return blank(wanted).join(first, key, "left").withColumn("reference_id", F.coalesce("_r", F.lit(0))).drop("_r")


def condition_sources(autoconfigs: DataFrame, classes: DataFrame, files: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Auto-configuration classes with the file and artifact their bytes are in; classes without a file are found by path."""
    named = autoconfigs.select(from_dotted(F.col("class_fqn")).alias("fqn")).distinct().join(classes.select("fqn", "file_id"), "fqn")
    place = files.select(F.col("id").alias("_f"), "artifact_id", "rel_path")
    by_id = named.where(F.col("file_id").isNotNull()).join(place, F.col("file_id") == F.col("_f"))
    by_path = named.where(F.col("file_id").isNull()).withColumn("rel_path", F.concat("fqn", F.lit(".class"))).join(place, "rel_path")
    both = by_id.select("fqn", "artifact_id", "rel_path").unionByName(by_path.select("fqn", "artifact_id", "rel_path"))
    return both.join(artifacts.select(F.col("id").alias("artifact_id"), F.col("path").alias("jar_path")), "artifact_id").select("fqn", "rel_path", "artifact_id", "jar_path")


# ---- J14: joined views ---------------------------------------------------------------------------------------------


def services_with_beans(services: DataFrame, beans: DataFrame) -> DataFrame:
    """service.ref = bean.name."""
    return services.join(beans.select(F.col("name").alias("ref_bean_name"), F.col("type_fqn").alias("bean_type")), "ref_bean_name", "left")


def conditions_met(conditions: DataFrame, classes: DataFrame) -> DataFrame:
    """condition.required_class = classes.fqn: every condition with whether its class is known."""
    known = classes.select(F.col("fqn").alias("_r"), F.lit(True).alias("_k")).distinct()
    return conditions.withColumn("_r", from_dotted(F.col("required_class"))).join(known, "_r", "left").withColumn("class_known", F.coalesce("_k", F.lit(False))).drop("_r", "_k")


def statements_with_maps(statements: DataFrame, maps: DataFrame) -> DataFrame:
    """statement.resultMap = map_id within the namespace."""
    named = F.regexp_extract("sql_template", r"""\bresultMap\s*=\s*["']([^"']+)["']""", 1)
    return statements.withColumn("map_id", F.nullif(F.substring_index(named, ".", -1), F.lit(""))).join(maps, ["mapper_namespace", "map_id"], "left")
