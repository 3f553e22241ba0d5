import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from factloom import schema
from factloom.operators import graph as G
from factloom.operators import lookup as L
from factloom.operators import maintain as M
from factloom.operators import resolve as R
from factloom.operators import search as Q
from factloom.operators import wiring as W
from factloom.sources import maven
from factloom.sources import store as St

EDGES = "src string, dst string, edge_ord bigint"


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, k) for k, (a, b) in enumerate(pairs)], EDGES)


@pytest.mark.parametrize(
    "pairs,start,end,depth,path",
    [
        (["AB", "BC", "CD"], "A", "D", 10, ["A", "B", "C", "D"]),
        (["AB", "BC"], "A", "C", 1, None),
        (["AB", "BC"], "A", "C", 2, ["A", "B", "C"]),
        (["AB"], "B", "A", 5, None),
        ([], "A", "A", 0, ["A"]),
        (["AB"], "A", "A", -1, None),
        (["AB", "BA"], "A", "B", 10, ["A", "B"]),
        (["AX", "AY", "YT", "XT"], "A", "T", 3, ["A", "X", "T"]),
        (["AY", "AX", "XT", "YT"], "A", "T", 3, ["A", "Y", "T"]),
        (["AX", "AY", "YP", "XP", "XQ", "PT", "QT"], "A", "T", 4, ["A", "X", "P", "T"]),
    ],
)
def test_shortest_path(spark, pairs, start, end, depth, path):
    assert G.find_path(edges(spark, pairs), start, end, depth) == path


def test_paths_follow_a_queue(spark):
    """The same path as a breadth-first search with a queue over edges in order."""
    rng = random.Random(1)
    pairs = [(f"v{rng.randrange(12)}", f"v{rng.randrange(12)}") for _ in range(30)]
    out = defaultdict(list)
    for a, b in pairs:
        out[a].append(b)
    queue, seen, ways = ["v0"], {"v0"}, {"v0": ["v0"]}
    while queue:
        at = queue.pop(0)
        for b in out[at]:
            if b not in seen:
                seen.add(b)
                ways[b] = ways[at] + [b]
                queue.append(b)
    for end in list(ways)[:4] + list(ways)[-2:]:
        assert G.find_path(edges(spark, pairs), "v0", end, 12) == ways[end]
    assert {r.vertex: r.depth for r in G.reach(edges(spark, pairs), "v0", 12).collect()} == {v: len(w) - 1 for v, w in ways.items()}


def classes(spark, links):
    return spark.createDataFrame(links, "fqn string, super_fqn string, interfaces array<string>")


def test_closure(spark, rows):
    c = classes(spark, [("B", "A", ["I"]), ("C", "B", []), ("D", "A", None), ("X", "Y", []), ("Y", "X", []), ("E", "", ["I"])])
    roots = spark.createDataFrame([("A",), ("X",), ("lone",), ("I",)], "root string")
    assert rows(G.subtype_closure(G.subtype_edges(c), roots)) == [
        ("A", "A", 0), ("A", "B", 1), ("A", "C", 2), ("A", "D", 1), ("I", "I", 0), ("X", "X", 0), ("X", "Y", 1), ("lone", "lone", 0)
    ]
    wide = G.subtype_closure(G.subtype_edges(c, interfaces=True), roots.where("root = 'I'"))
    assert {r.subtype for r in wide.collect()} == {"I", "B", "C", "E"}
    assert rows(L.direct_subtypes(c, "I").select("fqn")) == [("B",), ("E",)] and rows(L.direct_subtypes(c, "A").select("fqn")) == [("B",), ("D",)]


def test_expansion_by_kind(spark, rows):
    calls = spark.createDataFrame(
        [("c", "A", "m", "()V", k, conf, 1) for k, conf in (("VIRTUAL", "CERTAIN"), ("VIRTUAL", "UNCERTAIN"), ("STATIC", "CERTAIN"), ("SPECIAL", "PROBABLE"), ("INTERFACE", "CERTAIN"), ("DYNAMIC", "CERTAIN"), ("REFLECT", "CERTAIN"), ("SQL_BIND", "CERTAIN"))] + [("c", "Z", "m", "()V", "VIRTUAL", "CERTAIN", 1)],
        "caller string, owner string, name string, desc string, kind string, confidence string, line int",
    )
    closure = spark.createDataFrame([("A", "A"), ("A", "B"), ("A", "C")], "root string, subtype string")
    got = rows(G.expand_edges(calls, closure).select("target", "kind", "confidence", "note"))
    assert got == sorted(
        [(t, "VIRTUAL", c, "CHA") for t in "ABC" for c in ("PROBABLE", "UNCERTAIN")] + [("Z", "VIRTUAL", "PROBABLE", "CHA"), ("A", "STATIC", "CERTAIN", None), ("A", "SPECIAL", "PROBABLE", None), ("A", "INTERFACE", "CERTAIN", None), ("A", "DYNAMIC", "CERTAIN", "dynamic")], key=repr
    )
    assert G.expand_edges(calls, closure, True).where("kind = 'INTERFACE'").count() == 3


def test_declaring_type(spark, rows):
    calls = spark.createDataFrame([("C", "m", "()"), ("C", "n", "()"), ("C", "none", "()"), ("X", "m", "()"), ("A", "m", "()")], "owner string, name string, desc string")
    parent = spark.createDataFrame([("C", "B"), ("B", "A"), ("X", "Y"), ("Y", "X")], "fqn string, parent string")
    declared = spark.createDataFrame([("A", "m", "()"), ("B", "n", "()"), ("A", "n", "()")], "fqn string, name string, desc string")
    assert rows(G.declaring_types(calls, parent, declared)) == [("A", "m", "()", "A"), ("C", "m", "()", "A"), ("C", "n", "()", "B"), ("C", "none", "()", None), ("X", "m", "()", None)]
    own, ext = classes(spark, [("C", "B", []), ("D", "", [])]), classes(spark, [("C", "other", []), ("B", "A", [])])
    assert rows(G.parents(own, ext)) == [("B", "A", "external"), ("C", "B", "index")]


# ---- maintenance ---------------------------------------------------------------------------------------------------


def test_merge_rules(spark, rows):
    old = spark.createDataFrame([(1, "k", "f1", "a"), (2, "gone", None, "b")], "id bigint, key string, kept string, last string")
    new = spark.createDataFrame([(9, "k", None, None, 2), (8, "k", "f2", "x", 1), (7, "new", None, "n", 1)], "id bigint, key string, kept string, last string, at int")
    assert rows(M.merge(old, new, ["key"], keep=["kept"], order="at")) == [(1, "k", "f2", None), (2, "gone", None, "b"), (7, "new", None, "n")]
    assert rows(M.merge(old, new, ["key"], first_wins=True, order="at")) == [(1, "k", "f1", "a"), (2, "gone", None, "b"), (7, "new", None, "n")]
    plain = new.drop("at")
    once = M.merge(old, plain, ["key"], keep=["kept"])
    assert rows(M.merge(once, plain, ["key"], keep=["kept"])) == rows(once)
    assert rows(M.merge(old, plain.orderBy("id"), ["key"])) == rows(M.merge(old, plain.repartition(3), ["key"]))
    empty = old.where("false")
    assert rows(M.merge(empty, old, ["key"])) == rows(old) == rows(M.merge(old, empty, ["key"]))


def test_upsert_follows_the_table(spark, rows):
    def of(*values):
        return schema.conform(spark.createDataFrame([v for v in values], "id bigint, fqn string, super_fqn string, file_id bigint"), "classes")

    out = M.upsert(of((1, "A", "X", 5)), of((2, "A", "Y", None), (3, "B", None, None)), "classes")
    assert rows(out.select("id", "fqn", "super_fqn", "file_id")) == [(1, "A", "Y", 5), (3, "B", None, None)]
    issues = schema.conform(spark.createDataFrame([("k",)], "kind string"), "issues")
    assert M.upsert(issues, issues, "issues").count() == 2
    configs = schema.conform(spark.createDataFrame([(1, "A", "f", "factories", "k")], "id bigint, class_fqn string, source_file string, source_format string, key string"), "spring_boot_autoconfigs")
    assert M.upsert(configs, configs.withColumn("id", F.lit(2).cast("bigint")), "spring_boot_autoconfigs").first().id == 1


def test_deletes_and_duplicates(spark, rows):
    t = {
        "classes": spark.createDataFrame([(1, "A"), (2, "B")], "id bigint, fqn string"),
        "methods": spark.createDataFrame([(10, 1), (20, 2)], "id bigint, class_id bigint"),
        "fields": spark.createDataFrame([(5, 1)], "id bigint, class_id bigint"),
        "invokes": spark.createDataFrame([(100, 10), (200, 20), (201, None)], "id bigint, caller_method_id bigint"),
        "spring_injects": spark.createDataFrame([(7, 1)], "id bigint, owner_class_id bigint"),
    }
    left = M.cascade(t, "classes", t["classes"].where("id = 1").select("id"))
    assert {n: [r[0] for r in rows(df)] for n, df in left.items()} == {"classes": [2], "methods": [20], "fields": [], "invokes": [200, 201], "spring_injects": []}
    rep = spark.createDataFrame([(3, "a", None), (1, "a", None), (2, "b", 1), (2, "b", 1)], "id bigint, k string, n int")
    assert rows(M.keep_first(rep, ["k", "n"])) == [(1, "a", None), (2, "b", 1)]
    assert rows(M.delete_scope(rep, "k", "a").select("id")) == [(2,), (2,)]
    assert rows(M.replace_owned(rep, rep.where("k = 'a' AND id = 1"), "k").select("id", "k")) == [(1, "a"), (2, "b"), (2, "b")]


def test_changes(spark, rows):
    old = spark.createDataFrame([(1, "a", "h"), (1, "b", "h"), (1, "c", None), (1, "d", "h")], "artifact_id bigint, rel_path string, sha256 string")
    new = spark.createDataFrame([(1, "a", "h"), (1, "b", "i"), (1, "c", None), (1, "e", "h")], "artifact_id bigint, rel_path string, sha256 string")
    assert [r[2] for r in rows(M.classify_changes(old, new, ["artifact_id", "rel_path"]))] == ["UNCHANGED", "CHANGED", "CHANGED", "GONE", "NEW"]


def test_cache(spark, rows):
    c = schema.conform(spark.createDataFrame([(1, "a.jar", "s", 10, "2024-01-01"), (2, "b.jar", "s", 10, "2024-01-03")], "id bigint, jar_path string, jar_sha256 string, jar_mtime_ms bigint, last_access_at string"), "m2_caches")
    new = c.where("id = 1").withColumns({"jar_sha256": F.lit("t"), "last_access_at": F.lit("2030"), "id": F.lit(9).cast("bigint")})
    one = M.cache_upsert(c, new).where("jar_path = 'a.jar'").first()
    assert (one.id, one.jar_sha256, one.last_access_at) == (1, "t", "2024-01-01")
    touched = M.cache_touch(c, spark.createDataFrame([("a.jar", "2024-01-09"), ("a.jar", "2023")], "jar_path string, at string"))
    assert rows(M.evict(touched, 1).select("jar_path")) == [("a.jar",)] and rows(M.oldest(touched, 1).select("jar_path")) == [("b.jar",)]
    now = spark.createDataFrame([("a.jar", "s", 11), ("c.jar", "s", 1)], "jar_path string, jar_sha256 string, jar_mtime_ms bigint")
    assert rows(M.stale(c, now)) == [("a.jar", "touched"), ("b.jar", "gone")]


# ---- lookups -------------------------------------------------------------------------------------------------------


def test_lookups(spark, rows):
    t = spark.createDataFrame([(1, "a/B", "x"), (2, "a/C", "y"), (3, None, "x")], "id bigint, fqn string, name string")
    assert rows(L.find_symbol(t, "a.B").select("id")) == rows(L.find_symbol(t, "a/B").select("id")) == [(1,)]
    assert rows(L.first_given(t, ("fqn", "", True), ("name", "x", False)).select("id")) == [(1,), (3,)] and L.first_given(t, ("fqn", None, True)).count() == 3
    inv = spark.createDataFrame([("a/B", "m", "()V", "CERTAIN"), ("a/B", "m", "()V", "UNCERTAIN"), ("a/B", "m", "(I)V", None)], "callee_owner string, callee_name string, callee_desc string, confidence string")
    assert L.callers(inv, "a.B", "m", "()V").count() == 1 and L.callers(inv, "a.B", "m", "()V", True).count() == 2 and L.callers(inv, "a.B", "m").count() == 2
    art = spark.createDataFrame([(1, "g", "a", "1.9.0"), (2, "g", "a", "1.10.0"), (3, "g", "b", "1")], "id bigint, gav_group string, gav_artifact string, gav_version string")
    assert rows(L.latest_version(art)) == [("g", "a", "1.10.0"), ("g", "b", "1")]
    refs = spark.createDataFrame([(1, "a/I", "a/C"), (2, "a/J", "a/C")], "id bigint, interface_fqn string, consumer_class_fqn string")
    assert rows(L.references_of(refs, "a.I", "a.C").select("id")) == [(1,)]
    st = spark.createDataFrame([("n", "s"), ("n", "t")], "mapper_namespace string, statement_id string")
    assert L.statements_of(st, None, "s").count() == 2 and L.statements_of(st, "n", "s").count() == 1
    assert L.method_configs_of(st) is None and L.result_maps_of(st, None, None) is None
    assert L.issues_of(spark.createDataFrame([("",), ("k",)], "kind string"), "").count() == 0
    import json

    line = L.stats_json(L.stats({"issues": spark.createDataFrame([("missing_source",), ("z",)], "kind string")})).first()[0]
    assert json.loads(line) == {"issues": 2, "missing_source": 1, "uncertain_reflections": 0}


def test_point_lookups_reach_the_scan(spark, tmp_path):
    """Filters and columns are pushed into the files."""
    spark.createDataFrame([(1, "a/B", "m", "()V", 9)], "id bigint, callee_owner string, callee_name string, callee_desc string, other int").write.parquet(str(tmp_path / "t"))
    plan = L.callers(spark.read.parquet(str(tmp_path / "t")), "a.B", "m").select("id")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(callee_owner), IsNotNull(callee_name), EqualTo(callee_owner,a/B)" in plan and "other" not in plan.split("ReadSchema")[-1]


# ---- search --------------------------------------------------------------------------------------------------------


def test_search(spark, rows):
    docs = spark.createDataFrame([(1, "red fox red"), (2, "red hen"), (3, "blue"), (4, None), (5, "hen red")], "doc_id bigint, content string")
    hits = Q.search(docs, "RED, unknown", 3).collect()
    assert [r.doc_id for r in hits] == [1, 2, 5] and hits[1].score == hits[2].score < hits[0].score
    assert Q.search(docs, "  !", 5).count() == 0 and Q.search(docs.limit(0), "red", 5).count() == 0
    named = Q.class_documents(spark.createDataFrame([("a/b/Order$Item",)], "fqn string")).first()
    assert (named.name, named.content) == ("Order$Item", "a b Order Item")
    assert Q.method_documents(spark.createDataFrame([("a/B", "m", "(La/C;)V")], "owner string, name string, desc string")).first().content.split() == ["a", "B", "m", "La", "C", "V"]


# ---- wiring --------------------------------------------------------------------------------------------------------


def test_injects(spark, rows):
    beans = spark.createDataFrame([(1, "one", "a/A"), (2, "two", "a/A"), (3, "three", "a/C"), (4, "one", "a/D")], "id bigint, name string, type_fqn string")
    c = classes(spark, [("a/C", "a/Base", ["a/I"]), ("a/D", None, ["a/I"])])
    sites = spark.createDataFrame([(1, "a/A", None), (2, "a/C", None), (3, "a/I", None), (4, "a/Base", None), (5, "x", None), (6, "x", "one"), (7, "a/C", "no")], "site_id bigint, type_fqn string, qualifier string")
    got = rows(W.resolve_injects(sites, beans, c).select("site_id", "by_axis", "confidence", "candidate_bean_ids"))
    assert got == [
        (1, "TYPE", "PROBABLE", [1, 2]), (2, "TYPE", "CERTAIN", [3]), (3, "TYPE", "PROBABLE", [3, 4]), (4, "TYPE", "PROBABLE", [3]), (5, "TYPE", "UNCERTAIN", []), (6, "QUALIFIER", "CERTAIN", [1]), (7, "QUALIFIER", "UNCERTAIN", [])
    ]


def test_references(spark, rows):
    beans = spark.createDataFrame([(1, "impl", "a/Impl")], "id bigint, name string, type_fqn string")
    c = spark.createDataFrame([(10, "a/Impl"), (11, "a/Direct")], "id bigint, fqn string")
    s = spark.createDataFrame([(1, "impl"), (2, "a.Direct"), (3, "nothing"), (4, "")], "id bigint, ref string")
    assert rows(W.resolve_implementations(s, beans, c).select("id", "impl_class_id")) == [(1, 10), (2, 11), (3, 0), (4, 0)]
    fields = spark.createDataFrame([(5, 10, "f", "La/I;")], "id bigint, class_id bigint, name string, desc string")
    refs = spark.createDataFrame([("a/Impl", "f", "La/I;"), ("a/Impl", "g", "La/I;")], "owner string, name string, desc string")
    assert rows(W.resolve_fields(refs, fields, c).select("name", "field_id", "confidence")) == [("f", 5, "CERTAIN"), ("g", 0, "UNCERTAIN")]
    known = spark.createDataFrame([(7, "a/I", "", "", "r"), (8, "a/I", "", "", "r"), (9, "a/I", "", "", "")], "id bigint, interface_fqn string, group_name string, service_version string, ref_id string")
    wanted = spark.createDataFrame([("a/I", None, None, "r"), ("a/I", "", "", ""), ("a/J", "", "", "r")], "interface_fqn string, group_name string, service_version string, ref_id string")
    assert rows(W.reference_ids(wanted, known).select("interface_fqn", "ref_id", "reference_id")) == [("a/I", "", 0), ("a/I", "r", 7), ("a/J", "r", 0)]


def test_joined_views(spark, rows):
    conditions = spark.createDataFrame([("a.B",), ("no.Such",), (None,)], "required_class string")
    c = spark.createDataFrame([("a/B",)], "fqn string")
    assert rows(W.conditions_met(conditions, c).select("required_class", "class_known")) == [("a.B", True), ("no.Such", False), (None, False)]
    st = spark.createDataFrame([("n", "s", '<select id="s" resultMap="m">'), ("n", "t", "x")], "mapper_namespace string, statement_id string, sql_template string")
    maps = spark.createDataFrame([("n", "m", 3)], "mapper_namespace string, map_id string, property_count int")
    assert rows(W.statements_with_maps(st, maps).select("statement_id", "property_count")) == [("s", 3), ("t", None)]
    services = spark.createDataFrame([(1, "b")], "id bigint, ref_bean_name string")
    assert W.services_with_beans(services, spark.createDataFrame([("b", "a/B")], "name string, type_fqn string")).first().bean_type == "a/B"
    files = spark.createDataFrame([(1, 5, "x"), (2, 5, "a/C.class")], "id bigint, artifact_id bigint, rel_path string")
    known = spark.createDataFrame([("a/B", 1), ("a/C", None)], "fqn string, file_id bigint")
    auto = spark.createDataFrame([("a.B",), ("a.C",), ("a.D",)], "class_fqn string")
    artifacts = spark.createDataFrame([(5, "p.jar")], "id bigint, path string")
    assert rows(W.condition_sources(auto, known, files, artifacts)) == [("a/B", "x", 5, "p.jar"), ("a/C", "a/C.class", 5, "p.jar")]


# ---- dependencies --------------------------------------------------------------------------------------------------


def pom(group, artifact, version, body="", parent=None):
    p = "<parent><groupId>{}</groupId><artifactId>{}</artifactId><version>{}</version></parent>".format(*parent) if parent else ""
    g = f"<groupId>{group}</groupId>" if group else ""
    v = f"<version>{version}</version>" if version else ""
    return f'<project xmlns="http://maven.apache.org/POM/4.0.0">{p}{g}<artifactId>{artifact}</artifactId>{v}{body}</project>'


def dep(g, a, v=None, **more):
    return f"<dependency><groupId>{g}</groupId><artifactId>{a}</artifactId>" + (f"<version>{v}</version>" if v else "") + "".join(f"<{k}>{x}</{k}>" for k, x in more.items()) + "</dependency>"


def test_poms(spark, rows):
    managed = lambda *d: f"<dependencyManagement><dependencies>{''.join(d)}</dependencies></dependencyManagement>"
    texts = [
        pom(None, "app", None, "<properties><p.v>7</p.v></properties><dependencies>" + dep("g", "plain", "1") + dep("g", "prop", "${p.v}") + dep("g", "open", "${no}") + dep("g", "own") + dep("g", "bom") + dep("g", "parent") + dep("g", "none", scope="test") + "</dependencies>" + managed(dep("g", "own", "2"), dep("b", "bom", "1", type="pom", scope="import"), dep("g", "x", "${p.v}")), ("p", "parent", "3")),
        pom("p", "parent", "3", managed(dep("g", "parent", "9"), dep("g", "own", "99"), dep("g", "bom", "98"))),
        pom("b", "bom", "1", managed(dep("g", "bom", "4"), dep("g", "own", "97"))),
        pom("g", "plain", "1", "<dependencies>" + dep("g", "deep", "1") + "</dependencies>"),
        pom("g", "deep", "1", "<dependencies>" + dep("g", "deeper", "1") + dep("p", "app", "3") + "</dependencies>"),
    ]
    files = spark.createDataFrame([(f"{k}.pom", t.encode()) for k, t in enumerate([*texts, "<broken", "<other/>"])], "path string, content binary")
    read = maven.extract(files).cache()
    assert read.where("tag = 'project' AND artifact = 'app'").first().pom == "p:app:3"
    got = {r.artifact: (r.version, r.scope, r.type) for r in maven.direct_dependencies(read).where("pom = 'p:app:3'").collect()}
    assert got == {"plain": ("1", "compile", "jar"), "prop": ("7", "compile", "jar"), "open": ("${no}", "compile", "jar"), "own": ("2", "compile", "jar"), "bom": ("4", "compile", "jar"), "parent": ("9", "compile", "jar"), "none": (None, "test", "jar")}
    root = spark.createDataFrame([("p:app:3",)], "pom string")
    assert {r.artifact: r.depth for r in maven.resolved_graph(read, root, 3).collect()} == {"plain": 1, "prop": 1, "open": 1, "own": 1, "bom": 1, "parent": 1, "deep": 2, "deeper": 3}
    assert maven.resolved_graph(read, root, 1).count() == 6 and maven.resolved_graph(read, root, 0).count() == 0


def test_settings(tmp_path):
    f = tmp_path / "settings.xml"
    f.write_text("<settings><localRepository>${user.home}/r</localRepository><mirrors><mirror><id>m</id><url>http://m</url><mirrorOf>*,!own</mirrorOf></mirror></mirrors><servers><server><id>m</id><username>u</username><password>${env.PW}</password></server></servers><profiles><profile><id>a</id><repositories><repository><id>own</id><url>http://own</url></repository></repositories></profile><profile><id>b</id><repositories><repository><id>no</id><url>x</url></repository></repositories></profile></profiles><activeProfiles><activeProfile>a</activeProfile></activeProfiles></settings>")
    s = maven.settings(str(f), {"HOME": "/h", "PW": "p"})
    assert s["local_repository"] == "/h/r" and s["servers"]["m"]["password"] == "p"
    assert [(r["id"], r["auth"]) for r in maven.remotes(s)] == [("own", False), ("m", True)]
    assert maven.settings(str(tmp_path / "none"), {"HOME": "/h"})["local_repository"] == "/h/.m2/repository"
    assert [r["id"] for r in maven.remotes(maven.settings(str(tmp_path / "none"), {"HOME": "/h"}))] == ["central"]


def test_fetch_and_external(spark, rows):
    wanted = spark.createDataFrame([("a.b", "c", "1"), ("a.b", "d", "1")], "group string, artifact string, version string")
    files = spark.createDataFrame([("/m2/a/b/c/1/c-1.jar",), ("/other/d-1.jar",)], "path string")
    assert rows(maven.plan_fetch(wanted, files).select("artifact", "jar", "status")) == [("c", "/m2/a/b/c/1/c-1.jar", "local"), ("d", None, "remote")]
    jars = spark.createDataFrame([(2, "y.jar", "a/B", "late"), (1, "x.jar", "a/B", "first")], "jar_order int, jar_path string, fqn string, super_fqn string")
    ext = R.external_classes(jars)
    asked = spark.createDataFrame([("a/B",), ("a/B",), ("no",)], "fqn string")
    assert rows(R.resolve_external(asked, ext).select("fqn", "super_fqn", "found")) == [("a/B", "first", True), ("no", None, False)]
    assert rows(R.missing_classes(asked, ext)) == [("no",)]
    subs = spark.createDataFrame([("I", "Z"), ("I", "A")], "parent string, child string")
    assert rows(R.implementation_of(spark.createDataFrame([("I",), ("J",)], "interface string"), subs)) == [("I", "A"), ("J", None)]


def test_tagged_rows_and_database(spark, rows, tmp_path):
    tagged = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "tag string, n int")
    path = St.write_tagged(tagged)
    assert rows(St.read_tagged(spark, path, "a", "n int")) == [(1,), (3,)] and St.read_tagged(spark, path, "none", "n int").columns == ["n"]
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    St.write_jdbc(spark.createDataFrame([(k, f"v{k}") for k in range(20)], "id bigint, v string"), url, "facts")
    assert St.read_jdbc(spark, url, "facts", "ID", (0, 20, 3)).count() == 20 and St.read_jdbc(spark, url, "facts").where("ID = 3").count() == 1


def test_store_never_loses_a_table(spark, tmp_path, monkeypatch):
    store = St.Store(spark, str(tmp_path))
    rows_of = lambda k: spark.createDataFrame([(k, f"r{k}")], "id bigint, name string")
    names = lambda: [r.name for r in store.read("repos").collect()]
    assert names() == []
    store.write("repos", rows_of(1))
    held = store.read("repos")
    # a writer that dies before its pointer, or while it writes the pointer, leaves the table as it was
    for step in ("_point", "_sweep"):
        with monkeypatch.context() as m:
            m.setattr(St.Store, step, lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
            with pytest.raises(KeyboardInterrupt):
                store.write("repos", rows_of(2))
        assert names() == (["r1"] if step == "_point" else ["r2"])
    (tmp_path / "repos" / "v0000000009.tmp").write_text("half")
    assert names() == ["r2"]
    store.write("repos", rows_of(3))
    assert names() == ["r3"]
    # a reader that has begun on the version before still ends
    assert held.schema == store.read("repos").schema
    # data without any pointer is damage, not an empty table
    for f in (tmp_path / "repos").glob("v*"):
        f.unlink()
    with pytest.raises(RuntimeError):
        store.read("repos")


def test_two_writers_do_not_overwrite_each_other(spark, tmp_path):
    a, b = St.Store(spark, str(tmp_path)), St.Store(spark, str(tmp_path))
    one = spark.createDataFrame([(1, "r1")], "id bigint, name string")
    a.write("repos", one)
    before = b.version("repos")
    a.write("repos", one)
    with pytest.raises(RuntimeError):
        b.write("repos", one, expected=before)


def test_readers_see_a_whole_table_while_it_is_replaced(spark, tmp_path):
    import threading

    store = St.Store(spark, str(tmp_path))
    store.write("repos", spark.createDataFrame([(k, f"r{k}") for k in range(4)], "id bigint, name string"))
    seen, stop = [], threading.Event()

    def read():
        while not stop.is_set():
            seen.append(store.read("repos").count())

    reader = threading.Thread(target=read)
    reader.start()
    for _ in range(3):
        store.write("repos", spark.createDataFrame([(k, f"r{k}") for k in range(4)], "id bigint, name string"))
    stop.set()
    reader.join()
    assert set(seen) == {4}
