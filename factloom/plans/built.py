"""Queries of the sources and their kernels: archives, class files, XML, Java sources and project files are built from the
whole tables, then read back, so that the SQL over the same tables says what has to come out.

An archive holds the rows of two thousand ids at most, so archives grow in number and not in size.
"""

from __future__ import annotations

import io
import struct
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from factloom.functions import coordinates as C
from factloom.functions.names import class_ref
from factloom.plans import index
from factloom.plans.catalog import CALLS_SQL, _catalogue, calls
from factloom.session import cut, scratch, shared_dir, table
from factloom.sources import archives as A
from factloom.sources import classfile, java, maven, xml
from factloom.sources.store import Store

QUERIES, SQL, query = _catalogue()

ROWS = 2_000
ARCHIVE_SQL = f"'a' || (id // {ROWS})"


def archive_of(c: Column) -> Column:
    return F.concat(F.lit("a"), F.floor(c / ROWS))


def _zip(rows: pa.Table) -> pa.Table:
    held = rows.sort_by("position").to_pydict()
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in zip(held["entry"], held["content"]):
            z.writestr(zipfile.ZipInfo(name), content or b"")
    return pa.table({"path": [held["archive"][0]], "content": pa.array([out.getvalue()], pa.binary())})


def archives(rows: DataFrame) -> DataFrame:
    """rows(archive, position, entry, content) to path, content; positions and names of an archive are its own."""
    return rows.groupBy("archive").applyInArrow(_zip, "path string, content binary")


def _entries(rows: DataFrame, entry: Column, text: Column) -> DataFrame:
    return rows.select(archive_of(F.col("id")).alias("archive"), F.col("id").alias("position"), entry.alias("entry"), text.cast("binary").alias("content"))


# ---- archives ------------------------------------------------------------------------------------------------------


def _class_archives(spark: SparkSession, root: str) -> DataFrame:
    c = table(spark, root, "classes").select("id", "fqn")
    rows = _entries(c, F.concat("fqn", F.lit(".class")), F.col("fqn"))
    each = rows.select("archive").distinct()
    extra = lambda at, name: each.select("archive", F.lit(at).cast("bigint").alias("position"), F.lit(name).alias("entry"), F.lit("").cast("binary").alias("content"))
    return archives(rows.unionByName(extra(-2, "META-INF/")).unionByName(extra(-1, "module-info.class")))


@query(f"SELECT {ARCHIVE_SQL} AS archive, fqn, CAST(1 + row_number() OVER (PARTITION BY id // {ROWS} ORDER BY id) AS INTEGER) AS position FROM classes")
def class_list(spark, root):
    """Classes in the order of the archive."""
    return A.class_list(_class_archives(spark, root))


@query(f"SELECT {ARCHIVE_SQL} AS archive, fqn, sha256(fqn) AS sha256 FROM classes")
def class_bytes(spark, root):
    """Bytes of every class."""
    return A.class_bytes(_class_archives(spark, root)).select("archive", "fqn", F.sha2("content", 256).alias("sha256"))


@query(f"SELECT DISTINCT 'class_read' AS kind, 'x/None' || (id // {ROWS}) AS target, 'WARN' AS severity FROM classes")
def unreadable_classes(spark, root):
    """An issue for each class that is not in its archive."""
    read = A.class_bytes(_class_archives(spark, root))
    c = table(spark, root, "classes")
    wanted = c.select(archive_of(F.col("id")).alias("archive"), "fqn").unionByName(c.select(archive_of(F.col("id")).alias("archive"), F.concat(F.lit("x/None"), F.floor(F.col("id") / ROWS)).alias("fqn")).distinct())
    return A.missing_bytes(wanted, read).select("kind", "target", "severity")


@query(f"SELECT fqn, arg_min('class in ' || ({ARCHIVE_SQL}), {ARCHIVE_SQL}) AS text FROM classes GROUP BY fqn")
def archived_sources(spark, root):
    """S3: the source of each class, from the first archive that has one."""
    c = table(spark, root, "classes").select("id", "fqn")
    return A.sources(archives(_entries(c, F.concat("fqn", F.lit(".java")), F.concat(F.lit("class in "), archive_of(F.col("id"))))))


def _provider_archives(spark, root) -> DataFrame:
    s = table(spark, root, "dubbo_services").select("id", class_ref(F.col("interface_fqn")).alias("i")).where("i IS NOT NULL")
    name = F.concat(F.lit("META-INF/services/"), F.translate("i", "/", "."))
    return archives(_entries(s, name, F.concat(F.lit("a.Impl"), F.col("id"), F.lit(" # first\n\n# none\n b.Impl"), F.col("id"), F.lit("\n"))).withColumn("archive", F.concat(F.lit("s"), F.col("position"))))


_INTERFACE = "CASE WHEN ltrim(rtrim(interface_fqn)) IN ('', '?') THEN NULL ELSE replace(CASE WHEN trim(interface_fqn) LIKE 'L%;' THEN substr(trim(interface_fqn), 2, length(trim(interface_fqn)) - 2) ELSE trim(interface_fqn) END, '/', '.') END"


@query(f"SELECT service, unnest(['a.Impl' || id, 'b.Impl' || id]) AS provider FROM (SELECT id, {_INTERFACE} AS service FROM dubbo_services) WHERE service IS NOT NULL")
def service_providers(spark, root):
    """S4."""
    return A.service_providers(_provider_archives(spark, root)).select("service", "provider")


@query(f"SELECT 's' || id AS archive, 'META-INF/services/' || service AS entry FROM (SELECT id, {_INTERFACE} AS service FROM dubbo_services) WHERE service IS NOT NULL")
def meta_inf_entries(spark, root):
    """All entries below META-INF."""
    return A.meta_inf(_provider_archives(spark, root))


@query("""
SELECT replace(fqn, '/', '.') AS class_fqn, 'c' || id || '!META-INF/spring.factories' AS source_file, 'factories' AS source_format, 'org.springframework.boot.autoconfigure.EnableAutoConfiguration' AS key FROM classes WHERE id % 2 = 0
UNION SELECT 'x.Y' || id, 'c' || id || '!META-INF/spring.factories', 'factories', 'org.springframework.boot.autoconfigure.EnableAutoConfiguration' FROM classes WHERE id % 2 = 0
UNION SELECT replace(fqn, '/', '.'), 'c' || id || '!META-INF/spring/org.x.Auto.imports', 'imports', 'org.x.Auto' FROM classes WHERE id % 2 = 1
""")
def autoconfigs(spark, root):
    """Factories with continued lines and unknown keys, and imports with notes."""
    c, even = table(spark, root, "classes").select("id", F.translate("fqn", "/", ".").alias("n")), F.col("id") % 2 == 0
    factories = F.concat(F.lit("# note\norg.springframework.boot.autoconfigure.EnableAutoConfiguration=\\\n "), F.col("n"), F.lit(",\\\n  x.Y"), F.col("id"), F.lit("\nother.Key=a.D\n"))
    text = F.when(even, factories).otherwise(F.concat(F.lit("\n# note\n"), F.col("n"), F.lit(" # why\n")))
    name = F.when(even, "META-INF/spring.factories").otherwise("META-INF/spring/org.x.Auto.imports")
    return A.autoconfigs(archives(_entries(c, name, text).withColumn("archive", F.concat(F.lit("c"), F.col("position")))))


@query("SELECT id, sha256(rel_path) AS sha256, '/cache/jars/' || sha256(rel_path) || '.jar' AS cached_path FROM files WHERE rel_path IS NOT NULL")
def content_addressed(spark, root):
    """K20."""
    f = table(spark, root, "files").where("rel_path IS NOT NULL").select(F.col("id").cast("string").alias("path"), F.col("rel_path").cast("binary").alias("content"), F.length("rel_path").alias("length"))
    return A.content_addressed(f, "/cache/jars").select(F.col("path").cast("bigint").alias("id"), "sha256", "cached_path")


# ---- class files ---------------------------------------------------------------------------------------------------


class _Pool:
    """A constant pool that grows."""

    def __init__(self) -> None:
        self.items: dict[bytes, int] = {}

    def add(self, tag: int, data: bytes) -> int:
        return self.items.setdefault(bytes([tag]) + data, len(self.items) + 1)

    def utf(self, text: str) -> int:
        raw = text.encode()
        return self.add(1, struct.pack(">H", len(raw)) + raw)

    def cls(self, name: str) -> int:
        return self.add(7, struct.pack(">H", self.utf(name)))

    def pair(self, tag: int, a: int, b: int) -> int:
        return self.add(tag, struct.pack(">HH", a, b))

    def member(self, owner: str, name: str, desc: str, interface: bool = False) -> int:
        return self.pair(11 if interface else 10, self.cls(owner), self.pair(12, self.utf(name), self.utf(desc)))


def _attribute(pool: _Pool, name: str, data: bytes) -> bytes:
    return struct.pack(">HI", pool.utf(name), len(data)) + data


#: opcodes by id modulo four
_OPS = (0xB6, 0xB8, 0xB9, 0xB7)


def class_file(n: int, name: str, parent: str, interface: str, owner: str, callee: str, desc: str) -> bytes:
    """A class with a field and a method that makes one plain call, and reflective calls, a lambda and a condition by its number."""
    p = _Pool()
    op = _OPS[n % 4]
    code = bytes([op]) + struct.pack(">H", p.member(owner, callee, desc, op == 0xB9)) + (b"\x01\x00" if op == 0xB9 else b"")
    second = len(code)
    if n % 5 == 0:
        code += b"\x13" + struct.pack(">H", p.add(8, struct.pack(">H", p.utf("a.b.Named"))))
        code += b"\xb8" + struct.pack(">H", p.member("java/lang/Class", "forName", "(Ljava/lang/String;)Ljava/lang/Class;"))
    if n % 7 == 0:
        code += b"\xb6" + struct.pack(">H", p.member("java/lang/reflect/Method", "invoke", "(Ljava/lang/Object;[Ljava/lang/Object;)Ljava/lang/Object;"))
    bootstraps = b""
    if n % 13 == 0:
        factory = p.add(15, struct.pack(">BH", 6, p.member("java/lang/invoke/LambdaMetafactory", "metafactory", "()V")))
        target = p.add(15, struct.pack(">BH", 6, p.member(name, "lambda$0", "()V")))
        kind = p.add(16, struct.pack(">H", p.utf("()V")))
        code += b"\xba" + struct.pack(">H", p.pair(18, 0, p.pair(12, p.utf("run"), p.utf("()Ljava/lang/Runnable;")))) + b"\0\0"
        bootstraps = struct.pack(">HHHHHH", 1, factory, 3, kind, target, kind)
    code += b"\xb1"
    first = n % 900 + 1
    lines = struct.pack(">HHHHH", 2, 0, first, second, first + 5)
    body = struct.pack(">HHI", 8, 8, len(code)) + code + struct.pack(">HH", 0, 1) + _attribute(p, "LineNumberTable", lines)
    field = struct.pack(">HHHH", 2, p.utf("f"), p.utf("I"), 0)
    method = struct.pack(">HHHH", 1, p.utf("m"), p.utf("()V"), 1) + _attribute(p, "Code", body)
    attributes = [_attribute(p, "BootstrapMethods", bootstraps)] if bootstraps else []
    if n % 11 == 0:
        condition = p.utf("Lorg/springframework/boot/autoconfigure/condition/ConditionalOnClass;")
        value = struct.pack(">BHBH", 0x5B, 1, 0x63, p.utf("Lx/Needed;"))
        attributes.append(_attribute(p, "RuntimeVisibleAnnotations", struct.pack(">HHHH", 1, condition, 1, p.utf("value")) + value))
    head = struct.pack(">HHH", 0x21, p.cls(name), p.cls(parent)) + struct.pack(">HH", 1, p.cls(interface))
    rest = struct.pack(">H", 1) + field + struct.pack(">H", 1) + method + struct.pack(">H", len(attributes)) + b"".join(attributes)
    pool = b"".join(p.items)
    return struct.pack(">IHHH", 0xCAFEBABE, 0, 52, len(p.items) + 1) + pool + head + rest


def _class_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [b.column(c).to_pylist() for c in ("id", "caller", "callee_owner", "callee_name", "callee_desc")]
        names = [f"t/C{n}" for n in rows[0]]
        made = [class_file(n, name, caller, owner, owner, callee, desc) for name, n, caller, owner, callee, desc in zip(names, *rows)]
        yield pa.RecordBatch.from_arrays([pa.array(["x"] * len(names)), pa.array(names), pa.array(made, pa.binary())], names=["archive", "fqn", "content"])


_WHOLE = "caller IS NOT NULL AND callee_owner IS NOT NULL AND callee_name <> '' AND callee_desc LIKE '(%'"


def _facts(spark, root) -> dict[str, DataFrame]:
    files = calls(spark, root).where(_WHOLE).mapInArrow(_class_files, "archive string, fqn string, content binary")
    return classfile.fact_tables(classfile.extract(files))


_CALLS = f"(SELECT * FROM {CALLS_SQL} WHERE {_WHOLE})"


@query(f"SELECT 't/C' || id AS fqn, caller AS super_fqn, 33 AS access, callee_owner AS interface FROM {_CALLS}")
def class_facts(spark, root):
    """B1: one class for every call, read from its class file."""
    return _facts(spark, root)["classes"].select("fqn", "super_fqn", "access", F.element_at("interfaces", 1).alias("interface"))


@query(f"SELECT 't/C' || id AS fqn, 'm' AS name, '()V' AS \"desc\", 1 AS access, CAST(id % 900 + 1 AS INTEGER) AS start_line, CAST(id % 900 + 6 AS INTEGER) AS end_line FROM {_CALLS}")
def method_facts(spark, root):
    """Methods with the first and the greatest line."""
    return _facts(spark, root)["methods"].select("fqn", "name", "desc", "access", "start_line", "end_line")


@query(f"SELECT 't/C' || id AS fqn, 'f' AS name, 'I' AS \"desc\", 2 AS access FROM {_CALLS}")
def field_facts(spark, root):
    """B1."""
    return _facts(spark, root)["fields"].select("fqn", "name", "desc", "access")


@query(f"""
SELECT 't/C' || id AS fqn, callee_owner, callee_name, callee_desc, (['VIRTUAL', 'STATIC', 'INTERFACE', 'SPECIAL'])[CAST(id % 4 + 1 AS INTEGER)] AS kind, CAST(id % 900 + 1 AS INTEGER) AS line, 'CERTAIN' AS confidence FROM {_CALLS}
UNION ALL SELECT 't/C' || id, 'a/b/Named', '<reflected>', '()V', 'REFLECT', CAST(id % 900 + 6 AS INTEGER), 'PROBABLE' FROM {_CALLS} WHERE id % 5 = 0
UNION ALL SELECT 't/C' || id, '?', '?', '?', 'REFLECT', CAST(id % 900 + 6 AS INTEGER), 'UNCERTAIN' FROM {_CALLS} WHERE id % 7 = 0
UNION ALL SELECT 't/C' || id, 't/C' || id, 'lambda$0', '()V', 'DYNAMIC', CAST(id % 900 + 6 AS INTEGER), 'CERTAIN' FROM {_CALLS} WHERE id % 13 = 0
""")
def invoke_facts(spark, root):
    """Calls by opcode, lambdas, reflection."""
    return _facts(spark, root)["invokes"].select("fqn", "callee_owner", "callee_name", "callee_desc", "kind", "line", "confidence")


@query(f"SELECT 't/C' || id AS fqn, 't/C' || id || '.lambda$0' AS synthetic_fqn, 't/C' || id || '#lambda$0()V:invokeStatic' AS bsm_target, CAST(id % 900 + 6 AS INTEGER) AS line FROM {_CALLS} WHERE id % 13 = 0")
def lambda_facts(spark, root):
    """B3, C20."""
    return _facts(spark, root)["lambdas"].select("fqn", "synthetic_fqn", "bsm_target", "line")


@query(f"SELECT 't/C' || id AS autoconfig_class, 'on_class' AS condition_type, 'x.Needed' AS required_class, 'class' AS applied_to FROM {_CALLS} WHERE id % 11 = 0")
def condition_facts(spark, root):
    """B7."""
    return _facts(spark, root)["conditions"].select("autoconfig_class", "condition_type", "required_class", "applied_to")


@query(f"""SELECT {ARCHIVE_SQL} AS artifact, 'first' AS run, count(*) AS n FROM {_CALLS} GROUP BY 1
UNION ALL SELECT 'skipped', 'second', count(*) FROM {_CALLS} UNION ALL SELECT 'indexed', 'second', 0 UNION ALL SELECT 'stored', 'classes', count(*) FROM {_CALLS} UNION ALL SELECT 'uncertain', 'issues', count(*) FROM {_CALLS} WHERE id % 7 = 0""")
def indexed_report(spark, root):
    """Archives of a class file for every call, indexed twice: classes by archive, then all skipped."""
    made = calls(spark, root).where(_WHOLE).mapInArrow(_class_files, "archive string, fqn string, content binary")
    number = F.regexp_extract("fqn", r"(\d+)$", 1).cast("bigint")
    files = cut(archives(made.select(archive_of(number).alias("archive"), number.alias("position"), F.concat("fqn", F.lit(".class")).alias("entry"), "content")))
    store = Store(spark, f"{shared_dir(spark)}/factloom-{uuid.uuid4().hex}")
    store.migrate()
    with scratch(spark):
        first, second = index.index_files(store, files), index.index_files(store, files)
    rows = [(a, "first", n) for a, n in first.by_artifact.items()] + [("skipped", "second", second.classes_skipped), ("indexed", "second", second.classes_indexed)]
    rows += [("stored", "classes", store.read("classes").count()), ("uncertain", "issues", store.read("issues").where("kind = 'uncertain_reflect'").count())]
    out = spark.createDataFrame(rows, "artifact string, run string, n bigint")
    store.drop()
    return out


# ---- Java sources --------------------------------------------------------------------------------------------------

_SOURCE = """package {package};
import org.springframework.stereotype.Service;
import org.springframework.beans.factory.annotation.*;
import org.apache.dubbo.config.annotation.DubboService;
import org.apache.dubbo.config.annotation.DubboReference;
import org.apache.ibatis.annotations.*;
import lib.Port;
/* @Service class Ghost {{}} */
@Service{name} // note
@DubboService(group = "g", version = "1")
public class {simple} implements Port, Runnable {{
    @Autowired @Qualifier("q{id}") private Port first;
    @DubboReference(version = "2") Api api;
    private String text = "@Autowired Port no;";
    @Select("SELECT {id}") Object one(int a, String b) {{
        return null;
    }}
    @UpdateProvider(type = Sql.class, method = "up") int two(String[] s);
}}
"""


def _filled(template: str, **parts: Column) -> Column:
    """The template with columns in its places."""
    out: list[Column] = []
    rest = template
    while "{" in rest.replace("{{", "\0").replace("}}", "\1"):
        masked = rest.replace("{{", "\0\0").replace("}}", "\1\1")
        at, end = masked.index("{"), masked.index("}")
        out += [F.lit(rest[:at].replace("{{", "{").replace("}}", "}")), parts[rest[at + 1 : end]].cast("string")]
        rest = rest[end + 1 :]
    return F.concat(*out, F.lit(rest.replace("{{", "{").replace("}}", "}")))


def _java(spark, root) -> dict[str, DataFrame]:
    c = table(spark, root, "classes").where("fqn LIKE '%/%'").select("id", F.translate("fqn", "$", "_").alias("fqn"))
    package, simple = F.translate(F.regexp_extract("fqn", "^(.*)/[^/]*$", 1), "/", "."), F.substring_index("fqn", "/", -1)
    name = F.when(F.col("id") % 2 == 0, F.concat(F.lit('("b'), F.col("id"), F.lit('")'))).otherwise("")
    text = _filled(_SOURCE, package=package, simple=simple, name=name, id=F.col("id"))
    return java.tables(java.extract(c.select(F.col("id").cast("string").alias("source_file"), text.alias("text"))))


_J = "(SELECT id, fqn, regexp_extract(fqn, '^(.*)/[^/]*$', 1) AS package, regexp_extract(fqn, '([^/]*)$', 1) AS simple FROM (SELECT id, replace(fqn, '$', '_') AS fqn FROM classes WHERE fqn LIKE '%/%'))"


@query(f"SELECT CASE WHEN id % 2 = 0 THEN 'b' || id ELSE lower(left(simple, 1)) || substr(simple, 2) END AS name, fqn AS type_fqn, 'annotation' AS source FROM {_J}")
def annotated_beans(spark, root):
    """X1, C17, C18."""
    return _java(spark, root)["spring_beans"].select("name", "type_fqn", "source")


@query(f"SELECT fqn AS owner, 'first' AS field_or_param, 'lib/Port' AS type_fqn, 'q' || id AS qualifier FROM {_J}")
def inject_sites(spark, root):
    """Sites with the imported type and the qualifier."""
    return _java(spark, root)["sites"]


@query(f"SELECT 'lib/Port' AS interface_fqn, fqn AS impl_fqn, 'g' AS group_name, '1' AS service_version FROM {_J}")
def annotated_services(spark, root):
    """The first interface."""
    return _java(spark, root)["dubbo_services"].drop("source")


@query(f"SELECT package || '/Api' AS interface_fqn, fqn AS owner, 'api' AS name, '' AS group_name, '2' AS service_version FROM {_J}")
def annotated_references(spark, root):
    """X4, C19."""
    return _java(spark, root)["dubbo_references"]


@query(f"SELECT replace(fqn, '/', '.') AS mapper_namespace, unnest(['one', 'two']) AS statement_id, unnest(['SELECT', 'UPDATE']) AS kind, unnest(['SELECT ' || id, '']) AS sql_template, unnest(['', package || '/Sql']) AS provider_class, unnest(['', 'up']) AS provider_method, unnest([15, 18]) AS line_no FROM {_J}")
def annotated_statements(spark, root):
    """X6."""
    return _java(spark, root)["mybatis_statements"].drop("defined_in_file")


@query(f"SELECT DISTINCT fqn, 'one' AS name, 15 AS start_line, 17 AS end_line FROM {_J} UNION ALL SELECT DISTINCT fqn, 'none', 1, 2 FROM {_J}")
def source_lines(spark, root):
    """Methods of the class files with the lines of their sources, by name and erased parameter types."""
    lines = _java(spark, root)["method_lines"].where("name = 'one'")
    own = lines.select("fqn").distinct()
    known = lambda name: own.select("fqn", F.lit(name).alias("name"), F.array(F.lit("int"), F.lit("java/lang/String")).alias("parameter_types"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"))
    return java.attribute_lines(known("one").unionByName(known("none")), lines).select("fqn", "name", "start_line", "end_line")


# ---- XML -----------------------------------------------------------------------------------------------------------

_BEANS = """<beans xmlns="http://www.springframework.org/schema/beans" xmlns:context="c"><bean id="b{id}" class="{dotted}" scope="prototype"/>
<bean name="n{id}, m{id}" class="{dotted}" primary="true"/><bean id="none"/><alias name="b{id}" alias="x{id}"/><context:component-scan base-package="p{id} , q"/></beans>"""
_DUBBO = """<beans xmlns:dubbo="d"><dubbo:registry id="r{id}" address="zk://{id}" protocol="{protocol}" port="21x"/>
<dubbo:service interface="{interface}" ref="impl{id}" group="g" version="1"><dubbo:method name="save" timeout="{id}" retries="x" async="true"/></dubbo:service>
<dubbo:reference id="c{id}" interface="{interface}"><dubbo:method name="get" loadbalance="random" sent="false"/></dubbo:reference></beans>"""
_MAPPER = """<mapper namespace="{namespace}"><sql id="cols">a, b{id}</sql><select id="s{id}">SELECT <include refid="cols"/> FROM t WHERE x = #{{x}} -- end
;</select><resultMap id="m{id}" type=" a.T " extends="base" autoMapping="false"><id property="i"/><result property="n"/>{associations}<collection property="c"/><discriminator/></resultMap></mapper>"""


def _documents(spark, root) -> DataFrame:
    """Archives with framework files and one of no framework for each row."""
    c = table(spark, root, "classes").select("id", _filled(_BEANS, id=F.col("id"), dotted=F.translate("fqn", "/", ".")).alias("text"), F.concat(F.lit("spring/beans-"), F.col("id"), F.lit(".xml")).alias("entry"))
    s = table(spark, root, "dubbo_services").select("id", "protocol", class_ref(F.col("interface_fqn")).alias("i")).where("i IS NOT NULL")
    d = s.select("id", _filled(_DUBBO, id=F.col("id"), protocol=F.coalesce("protocol", F.lit("")), interface=F.translate("i", "/", ".")).alias("text"), F.concat(F.lit("META-INF/Dubbo-"), F.col("id"), F.lit(".xml")).alias("entry"))
    m = table(spark, root, "mybatis_statements").where("mapper_namespace <> ''").select(
        "id", _filled(_MAPPER, id=F.col("id"), namespace=F.col("mapper_namespace"), associations=F.repeat(F.lit('<association property="a"/>'), (F.col("id") % 4).cast("int"))).alias("text"), F.concat(F.lit("sql/mapper/M"), F.col("id"), F.lit(".xml")).alias("entry")
    )
    other = c.select("id", F.lit("<pom/>").alias("text"), F.concat(F.lit("other/pom"), F.col("id"), F.lit(".xml")).alias("entry"))
    rows = c.unionByName(d).unionByName(m).unionByName(other)
    return xml.documents_of(A.entries(archives(_entries(rows, F.col("entry"), F.col("text"))), r"\.xml$"))


def _xml(spark, root) -> dict[str, DataFrame]:
    return xml.tables(xml.extract(_documents(spark, root)))


@query(f"SELECT {ARCHIVE_SQL} || '!spring/beans-' || id || '.xml' AS source_file FROM classes UNION ALL SELECT {ARCHIVE_SQL} || '!META-INF/Dubbo-' || id || '.xml' FROM dubbo_services WHERE {_INTERFACE} IS NOT NULL UNION ALL SELECT {ARCHIVE_SQL} || '!sql/mapper/M' || id || '.xml' FROM mybatis_statements WHERE mapper_namespace <> ''")
def framework_documents(spark, root):
    """Files whose names say what they hold."""
    return _documents(spark, root).select("source_file")


@query("""
SELECT unnest(['b' || id, 'n' || id, 'm' || id, 'x' || id]) AS name, fqn AS type_fqn, unnest(['xml', 'xml', 'xml-alias', 'xml-alias']) AS source,
  unnest(['prototype', 'singleton', 'singleton', 'prototype']) AS scope, unnest([false, true, true, false]) AS primary_b FROM classes
""")
def xml_beans(spark, root):
    """Ids, further names, aliases."""
    return _xml(spark, root)["spring_beans"].drop("source_file", "position")


@query("SELECT unnest(['p' || id, 'q']) AS package FROM classes")
def component_scans(spark, root):
    """X3."""
    return _xml(spark, root)["component_scans"].select("package")


_D = f"(SELECT id, protocol, replace({_INTERFACE}, '.', '/') AS i FROM dubbo_services WHERE {_INTERFACE} IS NOT NULL)"


@query(f"SELECT 'r' || id AS registry_id, 'zk://' || id AS address, coalesce(protocol, '') AS protocol FROM {_D}")
def xml_registries(spark, root):
    """X5."""
    return _xml(spark, root)["dubbo_registries"].select("registry_id", "address", "protocol")


@query(f"SELECT i AS interface_fqn, 'g' AS group_name, '1' AS service_version, 'dubbo' AS protocol, 'impl' || id AS ref_bean_name FROM {_D}")
def xml_services(spark, root):
    """X5."""
    return _xml(spark, root)["dubbo_services"].select("interface_fqn", "group_name", "service_version", "protocol", "ref_bean_name")


@query(f"SELECT i AS interface_fqn, 'c' || id AS ref_id, 'UNCERTAIN' AS confidence FROM {_D}")
def xml_references(spark, root):
    """X5."""
    return _xml(spark, root)["dubbo_references"].select("interface_fqn", "ref_id", "confidence")


@query(f"SELECT 'service' AS parent, i AS interface_fqn, 'save' AS method_name, CAST(id AS DOUBLE) AS timeout_ms, NULL AS loadbalance FROM {_D} UNION ALL SELECT 'reference', i, 'get', NULL, 'random' FROM {_D}")
def xml_method_configs(spark, root):
    """Numbers that are none are null."""
    return _xml(spark, root)["dubbo_method_configs"].select("parent", "interface_fqn", "method_name", F.col("timeout_ms").cast("double").alias("timeout_ms"), "loadbalance")


@query("SELECT mapper_namespace, 's' || id AS statement_id, 'SELECT' AS kind, 'SELECT a, b' || id || ' FROM t WHERE x = #{x} ' AS sql_normalized FROM mybatis_statements WHERE mapper_namespace <> ''")
def xml_statements(spark, root):
    """Fragments in place, the closing note and semicolon gone."""
    return _xml(spark, root)["mybatis_statements"].select("mapper_namespace", "statement_id", "kind", "sql_normalized")


@query("SELECT mapper_namespace, 'm' || id AS map_id, 'a.T' AS type_fqn, 'base' AS extends_, false AS auto_mapping, 3 AS property_count, CAST(id % 4 AS INTEGER) AS association_count, 1 AS collection_count FROM mybatis_statements WHERE mapper_namespace <> ''")
def xml_result_maps(spark, root):
    """Children counted by kind, unknown ones as properties."""
    return _xml(spark, root)["mybatis_result_maps"]


# ---- project files -------------------------------------------------------------------------------------------------

_POM = """<project xmlns="http://maven.apache.org/POM/4.0.0"><parent><groupId>g</groupId><artifactId>parent</artifactId><version>{id}</version></parent><artifactId>p{id}</artifactId>
<properties><v>7.{id}</v></properties><dependencies><dependency><groupId>g</groupId><artifactId>own</artifactId><version>1</version><scope>test</scope></dependency>
<dependency><groupId>g</groupId><artifactId>prop</artifactId><version>${{v}}</version></dependency><dependency><groupId>g</groupId><artifactId>managed</artifactId></dependency>
<dependency><groupId>g</groupId><artifactId>p{next}</artifactId><version>{next}</version></dependency></dependencies>
<dependencyManagement><dependencies><dependency><groupId>g</groupId><artifactId>managed</artifactId><version>3</version></dependency></dependencies></dependencyManagement></project>"""


def _poms(spark, root) -> DataFrame:
    """A project for every eight ids, which depends on that of half its number."""
    f = table(spark, root, "files").select(F.floor(F.col("id") / 8).alias("id")).distinct()
    text = _filled(_POM, id=F.col("id"), next=F.floor(F.col("id") / 2))
    return maven.extract(f.select(F.col("id").cast("string").alias("path"), text.cast("binary").alias("content")))


@query("SELECT 'g:p' || id || ':' || id AS pom, 'g' AS \"group\", 'p' || id AS artifact, CAST(id AS VARCHAR) AS version FROM (SELECT DISTINCT id // 8 AS id FROM files)")
def project_coordinates(spark, root):
    """Group and version from the parent."""
    return _poms(spark, root).where("tag = 'project'").select("pom", "group", "artifact", "version")


@query("SELECT 'g:p' || id || ':' || id AS pom, unnest(['own', 'prop', 'managed', 'p' || (id // 2)]) AS artifact, unnest(['1', '7.' || id, '3', '' || (id // 2)]) AS version, unnest(['test', 'compile', 'compile', 'compile']) AS scope FROM (SELECT DISTINCT id // 8 AS id FROM files)")
def direct_dependencies(spark, root):
    """Properties, defaults and managed versions."""
    return maven.direct_dependencies(_poms(spark, root)).select("pom", "artifact", "version", "scope")


@query("""
WITH RECURSIVE f AS (SELECT DISTINCT id // 8 AS id FROM files), e AS (SELECT id, unnest(['own', 'prop', 'managed', 'p' || (id // 2)]) AS artifact, unnest(['1', '7.' || id, '3', '' || (id // 2)]) AS version, id // 2 AS next FROM f),
walk AS (SELECT max(id) AS id, 0 AS depth FROM f UNION SELECT w.id // 2, w.depth + 1 FROM walk w JOIN f ON f.id = w.id WHERE w.depth < 40)
SELECT artifact, version, CAST(min(w.depth) + 1 AS INTEGER) AS depth FROM walk w JOIN e ON e.id = w.id WHERE w.depth < 40 GROUP BY 1, 2
""")
def resolved_graph(spark, root):
    """Everything below the project with the greatest number, whole depth."""
    poms = _poms(spark, root)
    last = table(spark, root, "files").agg(F.floor(F.max("id") / 8).alias("id")).select(F.concat(F.lit("g:p"), "id", F.lit(":"), "id").alias("pom"))
    return maven.resolved_graph(poms, last, 40).select("artifact", "version", "depth")


@query("SELECT DISTINCT a AS artifact, v AS version, CASE WHEN h THEN jar_path END AS jar, CASE WHEN h THEN 'local' ELSE 'remote' END AS status FROM (SELECT jar_path, regexp_extract(jar_path, '([^/]*)/[^/]*/[^/]*$', 1) AS a, regexp_extract(jar_path, '([^/]*)/[^/]*$', 1) AS v, length(jar_path) % 2 = 0 AS h FROM m2_classes WHERE jar_path LIKE '/cache/m2/%')")
def fetch_plan(spark, root):
    """What the local repository has, and what has to be asked for."""
    jars = table(spark, root, "m2_classes").where("jar_path LIKE '/cache/m2/%'").select("jar_path").distinct()
    part = lambda p, k=1: F.regexp_extract("jar_path", p, k)
    wanted = jars.select(F.translate(part(r"^/cache/m2/(.*)/[^/]*/[^/]*/[^/]*$"), "/", ".").alias("group"), part(r"([^/]*)/[^/]*/[^/]*$").alias("artifact"), part(r"([^/]*)/[^/]*$").alias("version"))
    plan = maven.plan_fetch(wanted, jars.where("length(jar_path) % 2 = 0").select(F.col("jar_path").alias("path")))
    return plan.select("artifact", "version", "jar", "status")


_SETTINGS = """<settings><localRepository>${user.home}/r</localRepository><mirrors><mirror><id>m</id><url>http://m</url><mirrorOf>*,!own</mirrorOf></mirror></mirrors>
<servers><server><id>m</id><username>u</username></server></servers><profiles><profile><id>a</id><repositories><repository><id>own</id><url>http://own</url></repository></repositories></profile></profiles><activeProfiles><activeProfile>a</activeProfile></activeProfiles></settings>"""


@query("SELECT unnest([0, 1, 2]) AS k, unnest(['local', 'own', 'm']) AS id, unnest(['/h/r', 'http://own', 'http://m']) AS url, unnest([false, false, true]) AS auth")
def settings_read(spark, root):
    """Settings with mirrors and servers; one small file, read where it is written."""
    with tempfile.NamedTemporaryFile("w", suffix=".xml") as f:
        f.write(_SETTINGS)
        f.flush()
        s = maven.settings(f.name, {"HOME": "/h"})
    rows = [(0, "local", s["local_repository"], False), *((k + 1, r["id"], r["url"], bool(r["auth"])) for k, r in enumerate(maven.remotes(s)))]
    return spark.createDataFrame(rows, "k int, id string, url string, auth boolean")


@query("SELECT jar_path, regexp_extract(n, '^(.*)-(\\d+(?:\\.\\d+)*(?:[.-].*)?)$', 2) AS version FROM (SELECT DISTINCT jar_path, regexp_extract(jar_path, '([^/]*?)(\\.jar)?$', 1) AS n FROM m2_classes) WHERE version NOT IN ('', '0.0.0')")
def versions_of_paths(spark, root):
    """C13, C15."""
    g = C.coordinate(C.coordinate_from_path(F.col("jar_path")))
    return table(spark, root, "m2_classes").select("jar_path").distinct().select("jar_path", g["version"].alias("version")).where("version <> '0.0.0'")
