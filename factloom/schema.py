"""Tables with typed columns and natural keys, versioned by ordered migrations (K21 of the survey).

Unknown text is ``''`` and unknown ids are ``0`` where the column is part of a natural key, as the identity of rows
depends on it; ``presentable`` turns them into nulls.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Table:
    columns: str
    key: tuple[str, ...] = ()
    #: columns that keep the old value when the new one is null (K1 to K3)
    keep: tuple[str, ...] = ()
    #: the first row of a key stays
    first_wins: bool = False
    #: where rows come from: (column, table)
    parent: tuple[str, str] | None = None
    since: int = 1
    purpose: str = field(default="", compare=False)

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.columns)


TABLES: dict[str, Table] = {
    "repos": Table("id bigint, name string, kind string, url string, indexed_at string", ("name",), purpose="Indexed repositories"),
    "artifacts": Table("id bigint, repo_id bigint, gav_group string, gav_artifact string, gav_version string, path string, has_sources boolean, score int, indexed_at string", ("repo_id", "gav_group", "gav_artifact", "gav_version"), purpose="Artifacts of a repository by coordinate"),
    "files": Table("id bigint, artifact_id bigint, rel_path string, lang string, mtime bigint, sha256 string", ("artifact_id", "rel_path"), parent=("artifact_id", "artifacts"), purpose="Files of an artifact with the hash that drives re-indexing"),
    "classes": Table("id bigint, fqn string, access int, super_fqn string, file_id bigint, signature_raw string, source string, interfaces array<string>, source_jar string", ("fqn",), keep=("file_id", "signature_raw"), purpose="Class declarations"),
    "methods": Table("id bigint, class_id bigint, name string, desc string, access int, signature_raw string, start_line int, end_line int, virtual_lines boolean", ("class_id", "name", "desc"), keep=("signature_raw", "start_line", "end_line"), parent=("class_id", "classes"), purpose="Method declarations with lines"),
    "fields": Table("id bigint, class_id bigint, name string, desc string, access int, signature_raw string, line int", ("class_id", "name", "desc"), keep=("signature_raw", "line"), parent=("class_id", "classes"), purpose="Field declarations"),
    "invokes": Table("id bigint, caller_method_id bigint, callee_owner string, callee_name string, callee_desc string, kind string, line int, confidence string", parent=("caller_method_id", "methods"), purpose="Call edges with kind and confidence"),
    "lambdas": Table("id bigint, enclosing_method_id bigint, synthetic_fqn string, bsm_target string, line int", parent=("enclosing_method_id", "methods"), purpose="Lambdas with the method that holds them"),
    "issues": Table("id bigint, kind string, target string, message string, severity string, detected_at string", purpose="Anomalies found while indexing"),
    "spring_beans": Table("id bigint, name string, type_fqn string, source string, class_id bigint, method_id bigint, scope string, primary_b boolean", ("name", "type_fqn"), purpose="Beans from annotations, XML and aliases"),
    "spring_injects": Table("id bigint, owner_class_id bigint, field_or_param string, by_axis string, confidence string, candidate_bean_ids array<bigint>", parent=("owner_class_id", "classes"), purpose="Injection sites with candidate beans"),
    "dubbo_services": Table("id bigint, interface_fqn string, impl_class_id bigint, group_name string, service_version string, protocol string, source string, ref_bean_name string, registry_id string", ("interface_fqn", "group_name", "service_version", "ref_bean_name", "impl_class_id", "registry_id"), purpose="Service providers"),
    "dubbo_references": Table("id bigint, interface_fqn string, field_id bigint, group_name string, service_version string, confidence string, ref_id string, registry_id string, consumer_class_fqn string", ("interface_fqn", "group_name", "service_version", "ref_id", "field_id", "registry_id", "consumer_class_fqn"), purpose="Service consumers"),
    "dubbo_method_configs": Table("id bigint, service_id bigint, reference_id bigint, method_name string, timeout_ms bigint, retries int, loadbalance string, async boolean, sent boolean", ("service_id", "reference_id", "method_name"), since=4, purpose="Per-method tuning"),
    "dubbo_registries": Table("id bigint, registry_id string, address string, protocol string, port int, username string, parameters map<string,string>, source_file string", ("source_file", "registry_id"), since=7, purpose="Registries"),
    "mybatis_statements": Table("id bigint, mapper_namespace string, statement_id string, kind string, sql_template string, sql_normalized string, parameter_names array<string>, defined_in_file string, line_no int, provider_class string, provider_method string", ("mapper_namespace", "statement_id"), purpose="Mapped statements as template and normalised text"),
    "mybatis_result_maps": Table("id bigint, mapper_namespace string, map_id string, type_fqn string, extends_ string, auto_mapping boolean, property_count int, association_count int, collection_count int", ("mapper_namespace", "map_id"), since=4, purpose="Row shapes of result maps"),
    "spring_boot_autoconfigs": Table("id bigint, class_fqn string, source_file string, source_format string, key string", ("class_fqn", "source_file", "source_format", "key"), first_wins=True, since=5, purpose="Auto-configurations from factories and imports files"),
    "spring_autoconfig_conditions": Table("id bigint, autoconfig_class string, condition_type string, required_class string, required_bean_type string, required_property string, applied_to string", ("autoconfig_class", "condition_type", "required_class", "required_bean_type", "required_property", "applied_to"), first_wins=True, since=6, purpose="Conditions of auto-configurations"),
    "m2_caches": Table("id bigint, jar_path string, jar_sha256 string, jar_mtime_ms bigint, classes_count int, methods_count int, invokes_count int, extracted_at string, last_access_at string", ("jar_path",), since=10, purpose="Jars extracted on demand"),
    "m2_classes": Table("id bigint, fqn string, super_fqn string, access int, interfaces array<string>, jar_path string", ("fqn", "jar_path"), since=10, purpose="Classes of jars extracted on demand"),
    "m2_methods": Table("id bigint, m2_class_id bigint, name string, desc string, access int", ("m2_class_id", "name", "desc"), parent=("m2_class_id", "m2_classes"), since=10, purpose="Methods of such classes"),
    "m2_invokes": Table("id bigint, caller_m2_method_id bigint, callee_class_fqn string, callee_method_name string, callee_method_desc string, call_kind string", parent=("caller_m2_method_id", "m2_methods"), since=10, purpose="Calls of such methods"),
    "schema_history": Table("installed_rank int, version string, description string", ("version",), purpose="Migrations applied"),
}

VERSION = 11

SENTINELS = {"group_name": "", "service_version": "", "ref_bean_name": "", "registry_id": "", "ref_id": "", "consumer_class_fqn": "", "provider_class": "", "provider_method": "", "impl_class_id": 0, "field_id": 0, "service_id": 0, "reference_id": 0}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name].schema)


def conform(df: DataFrame, name: str) -> DataFrame:
    """The table's columns in order, absent ones null, others dropped, sentinels where identity needs them."""
    have = {c.lower() for c in df.columns}

    def column(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`").cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)
        return (F.coalesce(c, F.lit(SENTINELS[f.name]).cast(f.dataType)) if f.name in SENTINELS else c).alias(f.name)

    return df.select(*map(column, TABLES[name].schema))


def presentable(df: DataFrame) -> DataFrame:
    """Sentinels as nulls."""
    return df.select(*(F.nullif(F.col(c), F.lit(SENTINELS[c])).alias(c) if c in SENTINELS else F.col(c) for c in df.columns))


def stable_id(*key: Column) -> Column:
    """The same id for the same natural key in every run."""
    return F.xxhash64(*(F.coalesce(k.cast("string"), F.lit("\0")) for k in key)).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))


def history(spark: SparkSession) -> DataFrame:
    steps = sorted({t.since for t in TABLES.values()} | {2, 3, 8, 9, 11})
    return spark.createDataFrame([(k + 1, str(v), f"version {v}") for k, v in enumerate(steps)], TABLES["schema_history"].schema)
