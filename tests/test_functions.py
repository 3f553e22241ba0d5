import pytest
from pyspark.sql import functions as F

from factloom.functions import coordinates as C
from factloom.functions import symbols as S
from factloom.functions import text as X


def values(spark, cases, column, kind="string"):
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], f"k int, c {kind}")
    return [r[0] for r in df.orderBy("k").select(column(F.col("c")).alias("v")).collect()]


def test_names(spark):
    assert values(spark, ["a.b.C", "a/b.C", "", None, "C"], S.from_dotted) == ["a/b/C", "a/b.C", None, None, "C"]
    assert values(spark, ["a/b/C", "C", None], S.binary_name) == ["C", "C", None]
    assert values(spark, ["a/b/C", "C", None], S.package_name) == ["a.b", "", None]
    assert values(spark, ["a/b/C", "a/bc/C", "a/b"], lambda c: S.in_package(c, F.lit("a.b"))) == [True, False, True]
    assert values(spark, ["x"], lambda c: S.in_package(c, F.lit(""))) == [True]
    assert values(spark, ["La/b/C;", "a/b/C"], S.internal_to_dotted) == ["a.b.C", "a.b.C"]


def test_descriptors(spark):
    assert values(spark, ["I", "[[J", "La/b/C;", "[La/B;", "V", "X", "", None, "La"], S.readable) == ["int", "long[][]", "a.b.C", "a.B[]", "void", None, None, None, None]
    desc = ["()V", "(I[[La/B;J)[I", "(La/B;La/C;)La/D;", "([Z)Z"]
    assert values(spark, desc, S.return_type) == ["void", "int[]", "a.D", "boolean"]
    assert values(spark, desc, S.parameter_types) == [[], ["int", "a.B[][]", "long"], ["a.B", "a.C"], ["boolean[]"]]
    assert values(spark, desc, S.argument_count) == [0, 3, 2, 1]
    with pytest.raises(Exception, match="not a descriptor"):
        values(spark, ["Q"], lambda c: S.readable(c, strict=True))


def test_forms(spark):
    df = spark.createDataFrame([("a/B", "m", "()V")], "o string, n string, d string")
    one = lambda c: df.select(c).first()[0]
    o, n, d = F.col("o"), F.col("n"), F.col("d")
    assert one(S.dashed(o, n, d)) == "a/B#m()V" and one(S.method_key(n, d)) == "m()V"
    assert [one(S.symbol_text(F.lit(k), o, n, d)) for k in ("CLASS", "METHOD", "FIELD", "PACKAGE")] == ["a/B", "a/B#m()V", "a/B.m", "pkg:a/B"]
    assert one(S.describe_handle(o, n, d, F.lit(6))) == "a/B#m()V:invokeStatic" and one(S.describe_handle(o, n, d, F.lit(77))) == "a/B#m()V:tag=77"
    assert one(S.synthetic_name(o, n)) == "a/B.m"
    assert one(S.is_lambda_site(F.lit("java/lang/invoke/LambdaMetafactory"), F.lit("altMetafactory"))) and not one(S.is_lambda_site(o, n))
    assert one(S.heavier(F.lit("PROBABLE"), F.lit("CERTAIN"))) == "CERTAIN" and one(S.heavier(F.lit("X"), F.lit("UNCERTAIN"))) == "UNCERTAIN"


def test_interfaces(spark):
    assert values(spark, [",a,b,", "", None, ",a,"], S.decode_interfaces) == [["a", "b"], [], [], ["a"]]
    assert values(spark, [["a", "b"], []], S.encode_interfaces, "array<string>") == [",a,b,", ""]


def test_signatures(spark):
    cases = {
        "Ljava/util/HashMap<TK;TV;>;": "super=java.util.HashMap",
        "<T:Ljava/lang/Object;>La/B<+La/C<-La/D;>;>;La/I<*[I>;": "T,super=a.B,[? extends a.C],[? extends a.D],interface=a.I",
        "broken": None,
        None: None,
    }
    assert values(spark, list(cases), S.signature_decoder("class")) == list(cases.values())
    assert S.decode_signature("<T:Ljava/lang/Object;>(Ljava/util/List<TT;>;I)Ljava/util/List<La/X;>;^La/E;", "method") == "T,param=java.util.List,returns=java.util.List,[a.X]"
    assert S.decode_signature("Ljava/util/Map<Ljava/lang/String;Ljava/util/List<*>;>.Entry<La/B;>;", "field") == "field=java.util.Map,[java.lang.String],[java.util.List],[a.B]"


def test_coordinates(spark):
    assert values(spark, ["g.h:a:1:x", "g:a", None], C.coordinate) == [("g.h", "a", "1:x"), None, None]
    assert values(spark, ["1.2.3-SNAPSHOT", "1.x.3", "2", "", "10.2.1.9"], C.version_key) == [(1, 2, 3), (1, 0, 3), (2, 0, 0), (0, 0, 0), (10, 2, 1)]
    df = spark.createDataFrame([("1.9.0", "1.10.0"), ("1.0", "1.0.0"), ("2.0-b", "2.0-a")], "a string, b string")
    assert [r[0] for r in df.select(C.higher_version(F.col("a"), F.col("b"))).collect()] == ["1.10.0", "1.0", "2.0-b"]
    paths = ["/x/name-1.0.0.jar", "a-b-2.1-rc1.jar", "plain.jar", "x-y.jar", "n-1-2.jar"]
    assert values(spark, paths, C.coordinate_from_path) == ["name:name:1.0.0", "a-b:a-b:2.1-rc1", "local:plain:0.0.0", "local:x-y:0.0.0", "n-1:n-1:2"]
    assert values(spark, ["a.B#m(I)V", "a.B", "a#b"], C.method_reference) == [("a.B", "m", "(I)V"), None, None]
    assert values(spark, ["a:b:c", "a:b"], C.looks_like_coordinate) == [True, False]
    assert values(spark, [None, "jdbc:x", "sqlite:f", "postgres:h", ":memory:", "f"], C.database_url) == ["jdbc:sqlite::memory:", "jdbc:x", "jdbc:sqlite:f", "jdbc:postgres:h", "jdbc:sqlite::memory:", "f"]
    df = spark.createDataFrame([("a.b", "c", "1")], "g string, a string, v string")
    assert df.select(C.relative_path(F.col("g"), F.col("a"), F.col("v"))).first()[0] == "a/b/c/1/c-1.jar"
    assert df.select(C.coordinate_path(F.lit("/m2"), F.col("g"), F.col("a"), F.col("v"))).first()[0] == "/m2/a/b/c/1"


def test_sql_text(spark):
    cases = ["SELECT 1 -- x\nFROM t ;", "/* a */ select\t#{id}", " <!-- c -->x;;", "", None]
    assert values(spark, cases, X.normalise_sql) == ["SELECT 1 FROM t ", "select #{id}", "x;", "", None]
    assert values(spark, ["#{a} ${a} #{b} #{a}", "#{ x }", None], X.parameter_names) == [["a", "b", "a"], ["x"], []]
    assert values(spark, [" Select 1", "merge x", None], X.statement_kind) == ["SELECT", "", ""]
    assert values(spark, ['["a","b"]', "[]", " ", "{", None], X.json_list) == [["a", "b"], [], [], [], []]
    assert values(spark, ['{"a": {"b": 1}}', "x"], lambda c: X.json_extract(c, "$.a.b")) == ["1", None]
    assert values(spark, ["abc"], X.content_hash) == ["ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"]


def test_annotations(spark):
    assert values(spark, ["a.b.OrderService", "a/b/C$Inner", "X"], X.default_bean_name) == ["orderService", "inner", "x"]
    names = ["org.x.Service", "Service", "foo.Service", "Other"]
    assert values(spark, names, lambda c: X.annotation_matches(c, ["org.x.Service"])) == [True, True, True, False]
    assert values(spark, names, lambda c: X.annotation_matches(c, ["org.x.Service"], False)) == [True, False, True, False]
    df = spark.createDataFrame([("a.B", None, "p"), ("B", "q.B", "p"), ("B", None, "p"), ("B", None, "")], "n string, i string, p string")
    assert [r[0] for r in df.select(X.resolve_type(F.col("n"), F.col("i"), F.col("p"))).collect()] == ["a/B", "q/B", "p/B", "B"]
