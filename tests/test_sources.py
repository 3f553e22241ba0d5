import io
import os
import shutil
import subprocess
import zipfile

import pytest
from pyspark.sql import functions as F

from factloom.sources import archives as A
from factloom.sources import classfile as K
from factloom.sources import java as J
from factloom.sources import xml as X

JAVA = {
    "shop/Store.java": """package shop;
import java.util.*;
public class Store<T extends Number> extends Base implements Port, Runnable {
    private List<String> names = new ArrayList<>();
    static final int LIMIT = 3;
    public void run() {
        names.add("x");
        Runnable r = () -> System.out.println(names.size());
        r.run();
    }
    public static Object make(String n, int[][] dims, long k) throws Exception {
        Class.forName("shop.Base");
        Class.forName(n);
        switch (dims.length) { case 1: return k; case 2: return n; case 900: return null; default: }
        return Store.class.getMethod("run").invoke(null);
    }
}
""",
    "shop/Base.java": "package shop;\npublic abstract class Base {\n  protected int size;\n  abstract void run();\n}\n",
    "shop/Port.java": "package shop;\npublic interface Port {\n  default int port() { return 1; }\n}\n",
}


@pytest.fixture(scope="module")
def jar(tmp_path_factory):
    if not shutil.which("javac"):
        pytest.skip("no compiler")
    root = tmp_path_factory.mktemp("java")
    for name, text in JAVA.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(text)
    subprocess.run(["javac", "-g", "-d", str(root / "out"), *(str(root / n) for n in JAVA)], check=True, timeout=120)
    path = root / "jars" / "shop-1.2.0.jar"
    path.parent.mkdir()
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("META-INF/spring.factories", "# note\norg.springframework.boot.autoconfigure.EnableAutoConfiguration=\\\n a.B,\\\n a.C\nother.Key=a.D\n")
        z.writestr("META-INF/spring/org.x.AutoConfiguration.imports", "a.E # why\n\n#a.F\na.G\n")
        z.writestr("META-INF/services/java.lang.Runnable", "shop.Store # main\n\n")
        z.writestr("module-info.class", b"x")
        for d, _, names in sorted(os.walk(root / "out")):
            for n in sorted(names):
                z.write(os.path.join(d, n), os.path.relpath(os.path.join(d, n), root / "out"))
        z.writestr("shop/Broken.class", b"\xca\xfe\xba\xbe\0\0")
        z.writestr("shop/Wrong.class", (root / "out/shop/Base.class").read_bytes())
    (path.parent / "bad.jar").write_bytes(b"no archive")
    return path


def test_archives(spark, rows, jar):
    files = A.archives(spark, str(jar.parent / "*.jar"))
    names = [r.fqn for r in A.class_list(files).orderBy("position").collect()]
    assert names == ["shop/Base", "shop/Port", "shop/Store", "shop/Broken", "shop/Wrong"]
    assert rows(A.service_providers(files).select("service", "provider")) == [("java.lang.Runnable", "shop.Store")]
    found = rows(A.autoconfigs(files).select("class_fqn", "source_format", "key"))
    assert found == [("a.B", "factories", A.FACTORY_KEYS[0]), ("a.C", "factories", A.FACTORY_KEYS[0]), ("a.E", "imports", "org.x.AutoConfiguration"), ("a.G", "imports", "org.x.AutoConfiguration")]
    assert A.entries(files).where("entry IS NULL AND problem IS NOT NULL").count() == 1
    wanted = spark.createDataFrame([(r.archive, "shop/None") for r in A.class_list(files).limit(1).collect()], "archive string, fqn string")
    assert rows(A.missing_bytes(wanted, A.class_bytes(files)).select("kind", "target")) == [("class_read", "shop/None")]
    assert {r.cached_path[:7] for r in A.content_addressed(files, "/cache/").collect()} == {"/cache/"}


def test_class_files(spark, rows, jar):
    facts = K.fact_tables(K.extract(A.class_bytes(A.archives(spark, str(jar)))))
    store = facts["classes"].where("fqn = 'shop/Store'").first()
    assert (store.super_fqn, store.interfaces) == ("shop/Base", ["shop/Port", "java/lang/Runnable"])
    assert "T:Ljava/lang/Number;" in store.signature_raw
    assert rows(facts["fields"].where("fqn = 'shop/Store'").select("name", "desc")) == [("LIMIT", "I"), ("names", "Ljava/util/List;")]
    run = facts["methods"].where("fqn = 'shop/Store' AND name = 'run'").first()
    assert (run.desc, run.start_line, run.end_line) == ("()V", 7, 10)
    calls = facts["invokes"].where("fqn = 'shop/Store'").select("name", "callee_owner", "callee_name", "kind", "line", "confidence")
    assert set(map(tuple, calls.where("name = 'run'").collect())) == {
        ("run", "java/util/List", "add", "INTERFACE", 7, "CERTAIN"),
        ("run", "shop/Store", "lambda$run$0", "DYNAMIC", 8, "CERTAIN"),
        ("run", "java/lang/Runnable", "run", "INTERFACE", 9, "CERTAIN"),
    }
    made = set(map(tuple, calls.where("name = 'make'").collect()))
    assert ("make", "shop/Base", "<reflected>", "REFLECT", 12, "PROBABLE") in made
    assert ("make", "?", "?", "REFLECT", 13, "UNCERTAIN") in made and ("make", "?", "?", "REFLECT", 15, "UNCERTAIN") in made
    assert ("make", "java/lang/Long", "valueOf", "STATIC", 14, "CERTAIN") in made
    (lambda_,) = facts["lambdas"].collect()
    assert lambda_.synthetic_fqn == "shop/Store.lambda$run$0" and lambda_.bsm_target.startswith("shop/Store#lambda$run$0()V:invoke")
    assert rows(facts["issues"].select("target")) == [("shop/Broken",), ("shop/Wrong",)]


def test_loose_class_files(spark, rows, jar):
    found = A.loose_classes(spark, str(jar.parent.parent / "out"))
    assert rows(found.select("fqn")) == [("shop/Base",), ("shop/Port",), ("shop/Store",)]
    assert K.fact_tables(K.extract(found))["classes"].count() == 3


def test_every_class_of_a_large_archive_is_read():
    import pyspark

    jars = os.path.join(os.path.dirname(pyspark.__file__), "jars")
    name = next(n for n in sorted(os.listdir(jars)) if n.startswith("scala-reflect"))
    read = bad = 0
    with zipfile.ZipFile(os.path.join(jars, name)) as z:
        for info in z.infolist():
            if info.filename.endswith(".class") and read < 400:
                facts = K.parse(z.read(info))
                bad += facts.fqn != info.filename[:-6]
                read += 1
    assert read > 100 and not bad


def test_conditions():
    facts = K.ClassFacts("a/B", None, 0, [])
    on = "org/springframework/boot/autoconfigure/condition/ConditionalOn"
    facts.annotations = [(on + "Class", {"value": ("[", [("c", "La/X;"), ("c", "La/Y;")])}), (on + "WebApplication", {}), ("other/A", {"value": ("s", "z")})]
    facts.methods = [
        K.Method("bean", "()V", 0, annotations=[(K.BEAN, {}), (on + "Property", {"name": ("[", [("s", "p.q")])}), (on + "MissingBean", {"value": ("[", [("c", "La/Z;")])})]),
        K.Method("plain", "()V", 0, annotations=[(on + "Property", {"name": ("s", "no")})]),
    ]
    got = [(c["condition_type"], c["required_class"], c["required_bean_type"], c["required_property"], c["applied_to"]) for c in K.conditions(facts)]
    assert got == [("on_class", "a.X", "", "", "class"), ("on_class", "a.Y", "", "", "class"), ("on_web_app", "", "", "", "class"), ("on_property", "", "", "p.q", "bean:bean"), ("on_missing_bean", "", "a.Z", "", "bean:bean")]


BEANS = """<beans xmlns="http://www.springframework.org/schema/beans" xmlns:context="c">
<bean id="one" name="ignored" class="a.One" scope="prototype" primary="true"/><bean name="two, three" class="a.Two"/>
<bean id="noclass"/><bean class="a.NoName"/><alias name="one" alias="uno"/><alias name="gone" alias="x"/>
<context:component-scan base-package="a.b , c.d"/></beans>"""
DUBBO = """<beans xmlns:dubbo="d"><dubbo:registry id="r" address="zk://h" port="21x"><dubbo:parameter key="k" value='v"'/></dubbo:registry>
<dubbo:registry address="none"/><dubbo:service interface="a.Api" ref="impl" group="g" version="1"><dubbo:method name="save" timeout="500" retries="x" async="true"/></dubbo:service>
<dubbo:reference id="c" interface="a.Api"><dubbo:method name="get" loadbalance="random" sent="false"/></dubbo:reference></beans>"""
MAPPER = """<!DOCTYPE mapper PUBLIC "-//mybatis.org//DTD Mapper 3.0//EN" "http://mybatis.org/dtd/mybatis-3-mapper.dtd">
<mapper namespace="a.M"><sql id="cols">id, name</sql>
<select id="find" resultMap="m">SELECT <include refid="cols"/> FROM t <where><if test="id != null">AND id = #{id} AND id &lt;&gt; #{id}</if></where> -- end
;</select><select>no id</select><delete id="drop">DELETE FROM t<include refid="nope"/></delete>
<resultMap id="m" type=" a.T " extends="base"><id property="id"/><result property="n"/><association property="a"/><collection property="c"/><discriminator/></resultMap>
<resultMap id="n" type="a.U" autoMapping="false"/></mapper>"""


def documents(spark, *texts):
    return spark.createDataFrame([(f"f{k}.xml", t.encode() if t is not None else None) for k, t in enumerate(texts)], "source_file string, content binary")


def test_beans(spark, rows):
    t = X.tables(X.extract(documents(spark, BEANS, None, "<broken")))
    assert rows(t["spring_beans"].select("name", "type_fqn", "source", "scope", "primary_b")) == [
        ("one", "a/One", "xml", "prototype", True), ("three", "a/Two", "xml-alias", "singleton", False), ("two", "a/Two", "xml", "singleton", False), ("uno", "a/One", "xml-alias", "prototype", True)
    ]
    assert rows(t["component_scans"].select("package")) == [("a.b",), ("c.d",)]
    assert rows(t["issues"].select("target")) == [("f1.xml",), ("f2.xml",)]


def test_services(spark, rows):
    t = X.tables(X.extract(documents(spark, DUBBO)))
    assert rows(t["dubbo_registries"].select("registry_id", "address", "port", "parameters")) == [("r", "zk://h", None, {"k": 'v"'})]
    assert rows(t["dubbo_services"].select("interface_fqn", "group_name", "service_version", "protocol", "ref_bean_name")) == [("a/Api", "g", "1", "dubbo", "impl")]
    assert rows(t["dubbo_references"].select("interface_fqn", "ref_id", "confidence")) == [("a/Api", "c", "UNCERTAIN")]
    assert rows(t["dubbo_method_configs"].select("parent", "method_name", "timeout_ms", "retries", "loadbalance", "async", "sent")) == [
        ("reference", "get", None, None, "random", None, False), ("service", "save", 500, None, None, True, None)
    ]


def test_numbers_that_do_not_fit(spark, rows):
    text = """<b><registry id="r" port="{0}"/><service interface="a.A"><method name="m" timeout="{0}" retries="{0}"/></service></b>"""
    t = X.tables(X.extract(documents(spark, *(text.format(n) for n in (2**31 - 1, 2**31, -(2**31), 2**63 - 1, 2**63)))))
    assert rows(t["dubbo_method_configs"].select("source_file", "timeout_ms", "retries")) == [
        ("f0.xml", 2**31 - 1, 2**31 - 1), ("f1.xml", 2**31, None), ("f2.xml", -(2**31), -(2**31)), ("f3.xml", 2**63 - 1, None), ("f4.xml", None, None)
    ]
    assert rows(t["dubbo_registries"].select("source_file", "port")) == [("f0.xml", 2**31 - 1), ("f1.xml", None), ("f2.xml", -(2**31)), ("f3.xml", None), ("f4.xml", None)]


def test_mapper(spark, rows):
    t = X.tables(X.extract(documents(spark, MAPPER, "<mapper/>")))
    drop, find = t["mybatis_statements"].orderBy("statement_id").collect()
    assert (find.kind, find.sql_normalized) == ("SELECT", "SELECT id, name FROM t AND id = #{id} AND id <> #{id} ")
    assert "<include" not in find.sql_template and "id, name" in find.sql_template and '<if test="id != null">' in find.sql_template and "&lt;&gt;" in find.sql_template
    assert find.parameter_names == ["id"] and "missing nope" in drop.sql_template
    assert rows(t["mybatis_result_maps"].select("map_id", "type_fqn", "extends_", "auto_mapping", "property_count", "association_count", "collection_count")) == [
        ("m", "a.T", "base", True, 3, 1, 1), ("n", "a.U", "", False, 0, 0, 0)
    ]


SOURCE = '''package app;
import org.springframework.stereotype.Service;
import org.springframework.beans.factory.annotation.*;
import org.apache.dubbo.config.annotation.DubboReference;
import lib.Port;
/* @Service class Ghost {} */
@Service("orders") // comment
public class Orders implements Port, java.io.Serializable {
    @Autowired @Qualifier("main") private Port first;
    @Autowired private Map<String, Port> second;
    @DubboReference(group = "g", version = "2") Api api;
    private String text = "@Autowired Port no;";
    @Autowired
    public void wire(@Qualifier("q") Port a, List<Port> b) {
        int x = 1;
    }
    static class Inner { int y; }
}
@Configuration
class Config {
    @Bean Port port() { return null; }
    @Bean(name = "named") public lib.Other other(int k) { return null; }
}
interface Mapper {
    @Select("SELECT * FROM t WHERE a = #{a}") Object one(int a);
    @Select({"SELECT", "x"}) Object array();
    @UpdateProvider(type = Sql.class, method = "up") int two(String[] s);
}
'''


def test_java_sources(spark, rows):
    t = J.tables(J.extract(spark.createDataFrame([("Orders.java", SOURCE), ("none", None), ("odd", "class {{{ @A(")], "source_file string, text string")))
    assert rows(t["types"].select("fqn", "interfaces").where("fqn LIKE 'app/O%'")) == [("app/Orders$Inner", []), ("app/Orders", ["lib/Port", "java/io/Serializable"])]
    assert rows(t["spring_beans"].select("name", "type_fqn")) == [("config", "app/Config"), ("named", "lib/Other"), ("orders", "app/Orders"), ("port", "lib/Port")]
    assert rows(t["sites"].select("field_or_param", "type_fqn", "qualifier")) == [("a", "lib/Port", "q"), ("b", "app/List", None), ("first", "lib/Port", "main"), ("second", "app/Map", None)]
    assert rows(t["dubbo_services"]) == []  # a bare Service is no service provider
    assert rows(t["dubbo_references"].select("interface_fqn", "name", "group_name", "service_version")) == [("app/Api", "api", "g", "2")]
    assert rows(t["mybatis_statements"].select("statement_id", "kind", "sql_template", "provider_class", "provider_method")) == [
        ("one", "SELECT", "SELECT * FROM t WHERE a = #{a}", "", ""), ("two", "UPDATE", "", "app/Sql", "up")
    ]
    assert rows(t["method_lines"].where("name = 'wire'").select("parameter_types", "start_line", "end_line")) == [(["lib/Port", "app/List"], 14, 16)]


def test_lines_meet_methods(spark, rows):
    methods = spark.createDataFrame([("a/B", "m", ["java/lang/String", "int[]"], 1, 2), ("a/B", "m", ["int"], 3, 4)], "fqn string, name string, parameter_types array<string>, start_line int, end_line int")
    lines = spark.createDataFrame([("a/B", "m", ["String", "int[]"], 10, 12)], "fqn string, name string, parameter_types array<string>, start_line int, end_line int")
    assert rows(J.attribute_lines(methods, lines).select("parameter_types", "start_line", "end_line")) == [(["int"], 3, 4), (["java/lang/String", "int[]"], 10, 12)]


def test_kinds_of_classes(spark, rows):
    headers = spark.createDataFrame([("a/I", None, 0x601), ("a/A", None, 0x2601), ("a/E", "java/lang/Enum", 0x4031), ("a/R", "java/lang/Record", 0x31)], "fqn string, super_fqn string, access int")
    assert rows(A.discovered(headers).select("fqn", "is_interface", "is_annotation", "is_enum", "is_record")) == [
        ("a/A", True, True, False, False), ("a/E", False, False, True, False), ("a/I", True, False, False, False), ("a/R", False, False, False, True)
    ]


def test_managed_versions_of_far_parents(spark, rows):
    from factloom.sources import maven

    far = 15
    poms = [f"g:p{k}:1" for k in range(far)]
    data = [(x, "project", *x.split(":"), 0) for x in poms] + [(x, "parent", *y.split(":"), 0) for x, y in zip(poms, poms[1:])] + [(poms[-1], "parent", *poms[-2].split(":"), 0), (poms[-1], "managed", "g", "lib", "7", 0)]
    table = spark.createDataFrame(data, "pom string, tag string, group string, artifact string, version string, position int")
    assert rows(maven.managed_versions(table).where("artifact = 'lib'").select("pom", "version")) == sorted((x, "7") for x in poms)
