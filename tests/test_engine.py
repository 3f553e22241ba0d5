"""From archives to answers: index, skip, cascade, tools, server, commands, stream."""

import io
import json
import os
import shutil
import subprocess
import zipfile

import pytest

from factloom.plans import cli, index
from factloom.plans.server import SCHEMA, Server, serve_stdio
from factloom.plans.tools import CATALOGUE, Tools
from factloom.sources.store import Store
from factloom.streaming import incremental
from factloom.streaming.notify import Bus

JAVA = {
    "yard/Crane.java": "package yard;\npublic class Crane { String name; public String name() { return name; } }\n",
    "yard/CraneLedger.java": "package yard;\npublic interface CraneLedger { void save(Crane o); }\n",
    "yard/Base.java": "package yard;\npublic class Base { public void log(String s) { } }\n",
    "yard/JdbcCraneLedger.java": "package yard;\npublic class JdbcCraneLedger extends Base implements CraneLedger {\n  public void save(Crane o) { log(o.name()); }\n}\n",
    "yard/CraneWorks.java": "package yard;\n@org.springframework.stereotype.Service public class CraneWorks {\n  @org.springframework.beans.factory.annotation.Autowired CraneLedger repository;\n  public void save(Crane o) { repository.save(o); Base b = new Base(); b.log(\"x\"); }\n}\n",
    "yard/CraneDesk.java": "package yard;\npublic class CraneDesk {\n  CraneWorks service = new CraneWorks();\n  public void show(Crane o) {\n    service.save(o);\n  }\n}\n",
    "yard/Main.java": "package yard;\npublic class Main { public static void main(String[] a) { new CraneDesk().show(new Crane()); } }\n",
}
STUBS = {
    "org/springframework/stereotype/Service.java": "package org.springframework.stereotype;\nimport java.lang.annotation.*;\n@Retention(RetentionPolicy.RUNTIME) public @interface Service { String value() default \"\"; }\n",
    "org/springframework/beans/factory/annotation/Autowired.java": "package org.springframework.beans.factory.annotation;\nimport java.lang.annotation.*;\n@Retention(RetentionPolicy.RUNTIME) public @interface Autowired { }\n",
}
XML = {
    "applicationContext.xml": '<beans><bean id="jdbc" class="yard.JdbcCraneLedger"/></beans>',
    "dubbo-service.xml": '<beans xmlns:dubbo="d"><dubbo:registry id="r" address="zk://h"/><dubbo:service interface="yard.CraneLedger" ref="jdbc" group="g1" version="1.0.0"><dubbo:method name="save" timeout="5000" retries="3"/></dubbo:service><dubbo:reference id="c" interface="yard.CraneLedger"/></beans>',
    "CraneMapper.xml": '<mapper namespace="yard.CraneMapper"><select id="one">SELECT * FROM o WHERE id = #{id}</select><resultMap id="m" type="yard.Crane"><id/></resultMap></mapper>',
}


def build(root, changed=False):
    src = root / ("b" if changed else "a")
    for name, text in (JAVA | STUBS).items():
        (src / name).parent.mkdir(parents=True, exist_ok=True)
        (src / name).write_text(text.replace('b.log("x");', 'b.log("y"); b.log("z");') if changed else text)
    subprocess.run(["javac", "-g", "-d", str(src / "out"), *(str(src / n) for n in JAVA | STUBS)], check=True, timeout=120)
    jar = root / "yard-1.0.0.jar"
    with zipfile.ZipFile(jar, "w") as z:
        for name in sorted(JAVA):
            z.write(src / "out" / name.replace(".java", ".class"), name.replace(".java", ".class"))
        for name, text in XML.items():
            z.writestr(name, text)
    sources = root / "yard-1.0.0-sources.zip"
    with zipfile.ZipFile(sources, "w") as z:
        for name, text in JAVA.items():
            z.writestr(name, text)
    return str(jar), str(sources)


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    if not shutil.which("javac"):
        pytest.skip("no compiler")
    root = tmp_path_factory.mktemp("engine")
    jar, sources = build(root)
    s = Store(spark, str(root / "facts"))
    s.migrate()
    first = index.index_archives(s, jar, sources=(sources,))
    assert (first.classes_indexed, first.classes_skipped) == (7, 0)
    again = index.index_archives(s, jar, sources=(sources,))
    assert (again.classes_indexed, again.classes_skipped) == (0, 7)
    before = s.read("invokes").count()
    build(root, changed=True)
    third = index.index_archives(s, jar, sources=(sources,))
    assert (third.classes_indexed, third.classes_skipped) == (1, 6)
    assert s.read("invokes").count() == before + 1 and s.read("classes").count() == 7
    return s


@pytest.fixture(scope="module")
def server(store):
    s = Server(Tools(store.tables))
    assert s.handle({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": "index_status"}})["error"]["code"] == -32002
    s.handle({"jsonrpc": "2.0", "id": 1, "method": "initialize"})
    return s


def ask(server, tool, **arguments):
    answer = server.handle({"jsonrpc": "2.0", "id": 7, "method": "tools/call", "params": {"name": tool, "arguments": arguments}})
    return json.loads(answer["result"]["content"][0]["text"])


def test_status_and_symbols(server):
    n = ask(server, "index_status")
    assert n["classes"] == 7 and n["methods"] == 13 and n["invokes"] >= 8
    assert ask(server, "find_symbol", prefix="yard.Crane")["class"]["fqn"] == "yard/Crane"
    assert ask(server, "find_symbol", prefix="yard.Own") == {"matched": False, "prefix": "yard.Own"}
    found = ask(server, "describe_method", owner="yard.CraneDesk", name="show", desc="(Lyard/Crane;)V")
    assert found["method"]["start_line"] == 4 and found["method"]["virtual_lines"] is False
    assert ask(server, "describe_method", owner="yard.CraneDesk", name="show", desc="()V") == {"found": False}


def test_calls_and_paths(server):
    callers = ask(server, "callers_of", owner="yard.CraneWorks", name="save", desc="(Lyard/Crane;)V")
    assert callers["count"] == 1
    assert ask(server, "callees_of", callerMethodId=callers["callers"][0]["caller_method_id"])["count"] == 1
    path = ask(server, "find_path", fromOwner="yard.Main", fromName="main", fromDesc="([Ljava/lang/String;)V", toOwner="yard.Base", toName="log", toDesc="(Ljava/lang/String;)V", maxDepth=10)
    assert path["path"] == ["yard/Main#main([Ljava/lang/String;)V", "yard/CraneDesk#show(Lyard/Crane;)V", "yard/CraneWorks#save(Lyard/Crane;)V", "yard/Base#log(Ljava/lang/String;)V"]
    assert ask(server, "find_path", fromOwner="yard.None", fromName="x", fromDesc="()V", toOwner="a", toName="b", toDesc="()V") == {"found": False, "reason": "method not found in DB"}


def test_frameworks(server):
    assert {b["name"] for b in ask(server, "find_spring_beans")["beans"]} == {"jdbc", "craneWorks"}
    (inject,) = ask(server, "find_spring_injects", **{"class": "yard.CraneWorks"})["injects"]
    assert inject["confidence"] == "PROBABLE" and len(inject["candidate_bean_ids"]) == 1
    assert "error" in ask(server, "find_spring_injects", **{"class": "no.Such"})
    (service,) = ask(server, "find_dubbo_services", interface="yard.CraneLedger")["services"]
    assert service["impl_class_id"] and service["group_name"] == "g1"
    (config,) = ask(server, "find_dubbo_method_configs", serviceId=service["id"])["methodConfigs"]
    assert (config["method_name"], config["timeout_ms"], config["retries"], config["async"]) == ("save", 5000, 3, None)
    assert "error" in ask(server, "find_dubbo_method_configs")
    assert ask(server, "find_dubbo_references", interface="yard.CraneLedger")["count"] == 1
    assert ask(server, "find_dubbo_registries", registryId="r")["count"] == 1
    assert ask(server, "find_mybatis_statements", namespace="yard.CraneMapper", statementId="one")["statements"][0]["parameter_names"] == ["id"]
    assert ask(server, "find_mybatis_result_maps", typeFqn="yard.Crane")["count"] == 1 and "error" in ask(server, "find_mybatis_result_maps")
    assert ask(server, "list_issues", kind="")["count"] == 0
    assert ask(server, "find_spring_autoconfigs")["count"] == 0 and ask(server, "find_spring_autoconfig_conditions", type="on_class")["count"] == 0


def test_protocol(server):
    def call(method, **params):
        return server.handle({"jsonrpc": "2.0", "id": 1, "method": method, "params": params})

    assert len(call("tools/list")["result"]["tools"]) == len(CATALOGUE) == 17
    assert call("nope")["error"]["code"] == -32601 and call("tools/call", name="nope")["error"]["code"] == -32602
    assert call("resources/read", uri="x")["error"]["code"] == -32602
    assert len(json.loads(call("resources/read", uri=SCHEMA)["result"]["contents"][0]["text"])["toolNames"]) == 17
    assert len(call("prompts/list")["result"]["prompts"]) == 6
    assert "a.B#c()V" in call("prompts/get", name="find_path", arguments={"fromOwner": "a.B", "fromName": "c", "fromDesc": "()V"})["result"]["messages"][0]["content"]["text"]
    assert server.handle({"jsonrpc": "2.0", "method": "tools/list"}) is None and server.handle([]) is None
    sink = io.StringIO()
    lines = [{"jsonrpc": "2.0", "id": 1, "method": "resources/subscribe", "params": {"uri": incremental.STATS}}, {"jsonrpc": "2.0", "id": 2, "method": "resources/read", "params": {"uri": incremental.STATS}}, {"jsonrpc": "2.0", "id": 3, "method": "resources/unsubscribe", "params": {"uri": incremental.STATS}}]
    serve_stdio(server, io.StringIO("\n".join(map(json.dumps, lines)) + "\n\nbroken\n"), sink)
    sent = [json.loads(x) for x in sink.getvalue().splitlines()]
    assert [x.get("method", x.get("id")) for x in sent] == [1, "notifications/resources/updated", 2, 3, None] and sent[3]["result"] == {"removed": 1}


def test_commands(spark, store, tmp_path):
    def run(*argv):
        out = io.StringIO()
        return cli.main(["--db", store.root, *argv], spark, out), out.getvalue()

    assert json.loads(run("query", "find_symbol", "prefix=yard.Base")[1])["matched"]
    assert json.loads(run("stats", "--json")[1])["classes"] == 7 and "classes" in run("stats")[1]
    assert json.loads(run("doctor")[1])["ok"]


def test_missing_classes_are_looked_for_and_archives_read_ahead(spark, tmp_path):
    if not shutil.which("javac"):
        pytest.skip("no compiler")
    jar, _ = build(tmp_path)
    s = Store(spark, str(tmp_path / "facts"))
    s.migrate()
    t = cli.tools(s, [os.path.dirname(jar)])
    assert t.call("find_symbol", {"prefix": "yard.Crane"})["matched"] is False
    assert t.call("callers_of", {"owner": "yard.CraneWorks", "name": "save", "desc": "(Lyard/Crane;)V"})["count"] == 1
    assert not index.index_missing(s, "no/Such", jar)
    (cached,) = index.warm(s, jar).collect()
    assert cached.classes_count == 7 and cached.methods_count == s.read("m2_methods").count() and cached.invokes_count == s.read("m2_invokes").count() > 0
    (again,) = index.warm(s, jar).collect()
    assert (again.id, again.extracted_at) == (cached.id, cached.extracted_at) and s.read("m2_classes").count() == 7
    assert index.warm(s, jar, cap=0).count() == 0 and s.read("m2_invokes").count() == 0


def test_rebuild_leaves_nothing(spark, tmp_path):
    s = Store(spark, str(tmp_path / "facts"))
    s.migrate()
    s.upsert("issues", spark.createDataFrame([("k", "t")], "kind string, target string"))
    assert s.read("issues").count() == 1
    s.rebuild()
    assert s.read("issues").count() == 0 and s.read("schema_history").count() > 5


def test_stream_merges_only_what_changed(spark, tmp_path):
    s, bus, heard, seen = Store(spark, str(tmp_path / "facts")), Bus(), [], []
    s.migrate()
    bus.subscribe(incremental.STATS, heard.append)
    schema = "artifact_id bigint, rel_path string, sha256 string, lang string, id bigint, mtime bigint"

    def arrive(n, rows):
        spark.createDataFrame(rows, schema).write.json(str(tmp_path / "in" / str(n)))
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in" / "*"))
        incremental.watch_files(stream, s, str(tmp_path / "checkpoint"), bus, lambda df: seen.append(df.count())).awaitTermination(120)

    arrive(1, [(1, "a", "h1", "java", None, 1), (1, "b", "h1", "java", None, 1)])
    arrive(2, [(1, "a", "h1", "java", None, 1), (1, "b", "h2", "java", None, 1), (1, "c", None, "java", None, 1)])
    assert sorted((r.rel_path, r.sha256) for r in s.read("files").collect()) == [("a", "h1"), ("b", "h2"), ("c", None)]
    assert seen == [2, 2] and len(heard) == 2


def test_bus_drops_what_fails():
    bus, heard = Bus(), []
    bus.subscribe("u", lambda u: 1 / 0)
    kept = bus.subscribe("u", heard.append)
    assert bus.publish("u") == 1 and bus.count("u") == 1 and bus.count() == 1 and bus.publish("none") == 0
    assert bus.unsubscribe(kept) and not bus.unsubscribe(kept) and not bus.remove_first("u")
