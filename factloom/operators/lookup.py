"""Point lookups, joins and counts. Rows F1 to F20, J1 to J5, A1 to A3, L2 to L4 of the survey.

Names are always normalised (dotted or slashed), filters are plain predicates on stored columns so they reach the
scan, and precedence of arguments is resolved before a plan exists.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from factloom.functions import coordinates as C
from factloom.functions import symbols as S


def norm(name: str) -> str:
    """C1 for an argument."""
    return name if "/" in name else name.replace(".", "/")


def by_name(df: DataFrame, column: str, value: str) -> DataFrame:
    return df.where(F.col(column) == norm(value))


def first_given(df: DataFrame, *choices: tuple[str, object, bool]) -> DataFrame:
    """The filter of the first argument that is given (column, value, is a class name); all rows without any."""
    for column, value, is_name in choices:
        if value not in (None, ""):
            return df.where(F.col(column) == (norm(str(value)) if is_name else value))
    return df


def stable_limit(df: DataFrame, n: int | None, by: str = "id") -> DataFrame:
    """L4 with a defined order; no cap unless asked for."""
    return df if n is None else df.orderBy(by).limit(n)


def find_symbol(classes: DataFrame, name: str) -> DataFrame:
    """exact."""
    return by_name(classes, "fqn", name)


def direct_subtypes(classes: DataFrame, name: str, supers: str = "super_fqn", interfaces: str = "interfaces") -> DataFrame:
    """by super class or by interface; ``interfaces`` may be an array or the bracketed text."""
    held = F.col(interfaces) if classes.schema[interfaces].dataType.typeName() == "array" else S.decode_interfaces(F.col(interfaces))
    return classes.where((F.col(supers) == norm(name)) | F.array_contains(held, norm(name)))


def callers(invokes: DataFrame, owner: str, name: str, desc: str | None = None, include_reflect: bool = False, columns: tuple[str, str, str] = ("callee_owner", "callee_name", "callee_desc")) -> DataFrame:
    """J1 with F16."""
    found = invokes.where((F.col(columns[0]) == norm(owner)) & (F.col(columns[1]) == name))
    if desc is not None:
        found = found.where(F.col(columns[2]) == desc)
    return without_uncertain(found, include_reflect)


def without_uncertain(invokes: DataFrame, include_reflect: bool = False) -> DataFrame:
    """F16."""
    return invokes if include_reflect or "confidence" not in invokes.columns else invokes.where(F.col("confidence").isNull() | (F.col("confidence") != "UNCERTAIN"))


def declared_only(invokes: DataFrame, methods: DataFrame, classes: DataFrame) -> DataFrame:
    """Calls whose target is a known method; both joins only test existence."""
    known = methods.join(classes.select(F.col("id").alias("class_id"), F.col("fqn").alias("callee_owner")), "class_id").select(
        "callee_owner", F.col("name").alias("callee_name"), F.col("desc").alias("callee_desc")
    )
    return invokes.join(known, ["callee_owner", "callee_name", "callee_desc"], "left_semi")


def callees(invokes: DataFrame, method_id: int, column: str = "caller_method_id") -> DataFrame:
    """all kinds, uncertain ones too."""
    return invokes.where(F.col(column) == method_id)


def members(children: DataFrame, classes: DataFrame, owner: str, name: str | None = None, desc: str | None = None) -> DataFrame:
    """Methods or fields of a class, by id; or one of them."""
    found = children.join(find_symbol(classes, owner).select(F.col("id").alias("class_id"), F.col("fqn").alias("owner")), "class_id")
    if name is not None:
        found = found.where(F.col("name") == name)
    if desc is not None:
        found = found.where(F.col("desc") == desc)
    return found.orderBy("id")


def injects_of(injects: DataFrame, classes: DataFrame, owner: str | None) -> DataFrame:
    """F4."""
    return injects if not owner else injects.join(find_symbol(classes, owner).select(F.col("id").alias("owner_class_id")), "owner_class_id", "left_semi")


def services_of(services: DataFrame, interface: str | None) -> DataFrame:
    """with the number of services whose implementation is unknown."""
    return first_given(services, ("interface_fqn", interface, True))


def references_of(references: DataFrame, interface: str | None, consumer: str | None) -> DataFrame:
    """both arguments hold together, on normalised names."""
    found = first_given(references, ("consumer_class_fqn", consumer, True))
    return found if not interface else by_name(found, "interface_fqn", interface)


def method_configs_of(configs: DataFrame, service_id: int = 0, reference_id: int = 0) -> DataFrame | None:
    """the service wins; None without either."""
    if not service_id and not reference_id:
        return None
    return configs.where(F.col("service_id") == service_id) if service_id else configs.where(F.col("reference_id") == reference_id)


def bean_of(beans: DataFrame, name: str, type_name: str) -> DataFrame:
    """both together, the first by id."""
    return by_name(beans.where(F.col("name") == name), "type_fqn", type_name).orderBy("id").limit(1)


def method_config_of(configs: DataFrame, service_id: int, method: str) -> DataFrame:
    """F8: both together, the first by id."""
    return configs.where((F.col("service_id") == service_id) & (F.col("method_name") == method)).orderBy("id").limit(1)


def equal_to(df: DataFrame, **wanted: object) -> DataFrame:
    """rows whose columns equal all that is given: a file by path or id, an artifact by coordinate, a repository by
    name, a cached archive by path or content, an external class by name and archive, its methods, calls that come in."""
    for column, value in wanted.items():
        df = df.where(F.col(column).eqNullSafe(F.lit(value)))
    return df


def outgoing(invokes: DataFrame, methods: DataFrame, class_id: int | None = None) -> DataFrame:
    """Calls of external methods with the class and name of the method that makes them."""
    mine = methods if class_id is None else methods.where(F.col("m2_class_id") == class_id)
    return invokes.join(mine.select(F.col("id").alias("caller_m2_method_id"), "m2_class_id", F.col("name").alias("caller_name")), "caller_m2_method_id")


def statements_of(statements: DataFrame, namespace: str | None, statement_id: str | None) -> DataFrame:
    """a statement id alone is ignored."""
    if not namespace:
        return statements
    found = statements.where(F.col("mapper_namespace") == namespace)
    return found if not statement_id else found.where(F.col("statement_id") == statement_id)


def result_maps_of(maps: DataFrame, namespace: str | None, type_fqn: str | None) -> DataFrame | None:
    """None without either."""
    if namespace:
        return maps.where(F.col("mapper_namespace") == namespace)
    return maps.where(F.col("type_fqn").isin(type_fqn, norm(type_fqn), type_fqn.replace("/", "."))) if type_fqn else None


def issues_of(issues: DataFrame, kind: str | None) -> DataFrame:
    """an empty kind finds nothing."""
    return issues.where(F.col("kind") == (kind or "")).where(F.col("kind") != "")


def latest_version(artifacts: DataFrame, group: str | None = None, artifact: str | None = None) -> DataFrame:
    """L2: the highest version of each artifact, compared by number."""
    found = artifacts if group is None else artifacts.where((F.col("gav_group") == group) & (F.col("gav_artifact") == artifact))
    return found.groupBy("gav_group", "gav_artifact").agg(F.max_by("gav_version", F.struct(C.version_key(F.col("gav_version")), F.negative("id"))).alias("gav_version"))


def schema_version(history: DataFrame) -> DataFrame:
    """L5."""
    return history.agg(F.max_by("version", "installed_rank").alias("version"))


# ---- counts --------------------------------------------------------------------------------------------------------


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """A1, A2: one row for each table."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: A3: (name, table, condition)
STATS: list[tuple[str, str, str]] = [
    ("dubbo_services_from_annotation", "dubbo_services", "source = 'annotation'"),
    ("dubbo_services_from_xml", "dubbo_services", "source = 'xml'"),
    ("dubbo_references_from_annotation", "dubbo_references", "ref_id = ''"),
    ("dubbo_references_from_xml", "dubbo_references", "ref_id <> ''"),
    ("mybatis_statements_from_annotation", "mybatis_statements", "defined_in_file LIKE '%.java'"),
    ("mybatis_statements_from_xml", "mybatis_statements", "defined_in_file LIKE '%.xml'"),
    ("autoconfigs_from_factories", "spring_boot_autoconfigs", "source_format = 'factories'"),
    ("autoconfigs_from_imports", "spring_boot_autoconfigs", "source_format = 'imports'"),
    ("conditions_on_class", "spring_autoconfig_conditions", "condition_type = 'on_class'"),
    ("conditions_on_property", "spring_autoconfig_conditions", "condition_type = 'on_property'"),
    ("uncertain_reflections", "issues", "kind = 'uncertain_reflect'"),
    ("missing_source", "issues", "kind = 'missing_source'"),
]


def last_indexed(tables: Mapping[str, DataFrame], column: str = "indexed_at") -> DataFrame:
    """A3: table_name, last_indexed of each table that says when its rows were indexed, null without rows."""
    parts = [df.agg(F.max(column).alias("last_indexed")).select(F.lit(name).alias("table_name"), "last_indexed") for name, df in tables.items() if column in df.columns]
    return reduce(DataFrame.unionByName, parts)


def stats(tables: Mapping[str, DataFrame], conditions: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """A3: name, value; one pass over each table for its total and all its conditional counts."""
    wanted: dict[str, list[tuple[str, Column]]] = {t: [(t, F.lit(True))] for t in tables}
    for name, t, condition in STATS if conditions is None else conditions:
        if t in tables:
            wanted[t].append((name, F.expr(condition)))
    out = None
    for t, counts in wanted.items():
        row = tables[t].agg(*(F.count_if(c).alias(n) for n, c in counts))
        part = row.select(F.explode(F.create_map(*(x for n, _ in counts for x in (F.lit(n), F.col(n)))))).toDF("name", "value")
        out = part if out is None else out.unionByName(part)
    return out


def stats_json(counts: DataFrame) -> DataFrame:
    """A3 as one line of JSON; a few dozen names, whatever the data."""
    return counts.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value"))))).alias("stats"))
