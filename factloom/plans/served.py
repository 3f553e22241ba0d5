"""Queries of the tools, the server, the store and the incremental stream over whole tables, with the SQL each is checked
against. What these give is answers; a row holds what an answer says.
"""

from __future__ import annotations

import io
import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom import schema
from factloom.operators import lookup
from factloom.plans import cli
from factloom.plans.catalog import _catalogue
from factloom.plans.facts import FACTS_SQL, classes, invokes, methods
from factloom.plans.server import Server, serve_stdio
from factloom.plans.tools import CATALOGUE, Tools
from factloom.session import cut, shared_dir, table
from factloom.sources.store import Store
from factloom.streaming.incremental import STATS, merge_files
from factloom.streaming.notify import Bus

QUERIES, SQL, query = _catalogue()


def _tools(spark: SparkSession, root: str, page: int = 5) -> Tools:
    """The tools over the derived fact tables, written once; tables nothing is derived for are empty."""
    facts = {"classes": classes(spark, root), "methods": methods(spark, root), "invokes": invokes(spark, root)}
    services = table(spark, root, "dubbo_services").select("id", "interface_fqn", "impl_class_id", "protocol", F.col("found_in").alias("source"))
    configs = table(spark, root, "dubbo_method_configs").select("id", "service_id", "reference_id", "method_name")
    statements = table(spark, root, "mybatis_statements").select("id", "mapper_namespace", "statement_id", "kind")
    facts |= {"dubbo_services": services, "dubbo_method_configs": configs, "mybatis_statements": statements}
    held = {name: cut(schema.conform(facts[name], name)) if name in facts else schema.empty(spark, name) for name in schema.TABLES}
    return Tools(lambda: held, page=page)


@query(f"""{FACTS_SQL}, one AS (SELECT k.fqn, m.name, m."desc" FROM mth m JOIN cls k ON k.id = m.class_id JOIN calls c ON c.callee_owner = k.fqn AND c.callee_name = m.name AND c.callee_desc = m."desc" ORDER BY 1, 2, 3 LIMIT 1)
SELECT 'index_status' AS tool, (SELECT count(*) FROM cls) + (SELECT count(*) FROM mth) + (SELECT count(*) FROM inv) AS n
UNION ALL SELECT 'find_symbol', 1 UNION ALL SELECT 'describe_method', 1
UNION ALL SELECT 'callers_of', count(*) FROM inv i JOIN one o ON i.callee_owner = o.fqn AND i.callee_name = o.name AND i.callee_desc = o."desc" WHERE confidence <> 'UNCERTAIN'
UNION ALL SELECT 'callees_of', count(*) FROM inv WHERE caller_method_id = (SELECT min(caller_method_id) FROM inv)
UNION ALL SELECT 'find_dubbo_services', count(*) FROM dubbo_services UNION ALL SELECT 'find_dubbo_method_configs', count(*) FROM dubbo_method_configs WHERE service_id = (SELECT max(service_id) FROM dubbo_method_configs)
UNION ALL SELECT 'find_mybatis_statements', count(*) FROM mybatis_statements WHERE mapper_namespace = (SELECT min(mapper_namespace) FROM mybatis_statements)
UNION ALL SELECT 'find_spring_beans', 0 UNION ALL SELECT 'list_issues', 0 UNION ALL SELECT 'find_path', -1 UNION ALL SELECT 'find_mybatis_result_maps', 0""")
def tool_answers(spark, root):
    """The tools of section 2.13, A1, O9: exact counts, also where a page is shorter."""
    t = _tools(spark, root)
    held = t.tables()
    called = held["invokes"].select(F.col("callee_owner").alias("owner"), F.col("callee_name").alias("name"), F.col("callee_desc").alias("desc"))
    known = held["methods"].join(held["classes"].select(F.col("id").alias("class_id"), F.col("fqn").alias("owner")), "class_id")
    one = known.join(called, ["owner", "name", "desc"], "left_semi").orderBy("owner", "name", "desc").first()
    method = {"owner": one.owner.replace("/", "."), "name": one.name, "desc": one.desc}
    status = t.call("index_status", {})
    first = held["invokes"].agg(F.min("caller_method_id")).first()[0]
    service = held["dubbo_method_configs"].agg(F.max("service_id")).first()[0]
    mapper = held["mybatis_statements"].agg(F.min("mapper_namespace")).first()[0]
    missing = {f"{end}{part}": "none" for end in ("from", "to") for part in ("Owner", "Name", "Desc")}
    rows = [
        ("index_status", status["classes"] + status["methods"] + status["invokes"]), ("find_symbol", int(t.call("find_symbol", {"prefix": method["owner"]})["matched"])), ("describe_method", int(t.call("describe_method", method)["found"])),
        ("callers_of", t.call("callers_of", method)["count"]), ("callees_of", t.call("callees_of", {"callerMethodId": first})["count"]), ("find_dubbo_services", t.call("find_dubbo_services", {})["count"]),
        ("find_dubbo_method_configs", t.call("find_dubbo_method_configs", {"serviceId": service})["count"]), ("find_mybatis_statements", t.call("find_mybatis_statements", {"namespace": mapper})["count"]),
        ("find_spring_beans", t.call("find_spring_beans", {})["count"]), ("list_issues", t.call("list_issues", {"kind": ""})["count"]), ("find_path", -1 if t.call("find_path", missing).get("reason") else 0), ("find_mybatis_result_maps", t.call("find_mybatis_result_maps", {})["count"]),
    ]
    return spark.createDataFrame(rows, "tool string, n bigint")


@query(f"""SELECT unnest(['before', 'no method', 'initialize', 'no tool', 'failed', 'tools', 'resources', 'prompts', 'subscribed', 'heard', 'removed', 'notification']) AS request,
  unnest([-32002, -32601, 0, -32602, -32603, {len(CATALOGUE)}, 2, 6, 1, 1, 1, 0]) AS answer""")
def server_answers(spark, root):
    """Methods, error codes, resources and prompts of section 2.13, subscriptions of 2.12 (R1), A8."""
    tables = {name: schema.empty(spark, name) for name in schema.TABLES}
    heard: list[str] = []
    server = Server(Tools(lambda: tables), Bus())

    def ask(method: str, **params) -> dict:
        return server.handle({"jsonrpc": "2.0", "id": 1, "method": method, "params": params}, heard.append)

    code = lambda answer: answer["error"]["code"] if "error" in answer else 0
    rows = [("before", code(ask("tools/call", name="index_status"))), ("no method", code(ask("none"))), ("initialize", code(ask("initialize"))), ("no tool", code(ask("tools/call", name="none")))]
    rows.append(("failed", code(ask("tools/call", name="callees_of", arguments={"callerMethodId": "x"}))))
    rows += [(k, len(ask(f"{k}/list")["result"][k])) for k in ("tools", "resources", "prompts")]
    ask("resources/subscribe", uri=STATS)
    rows.append(("subscribed", server.bus.count()))
    json.loads(ask("resources/read", uri=STATS)["result"]["contents"][0]["text"])
    rows += [("heard", len(heard)), ("removed", ask("resources/unsubscribe", uri=STATS)["result"]["removed"]), ("notification", int(server.handle({"jsonrpc": "2.0", "method": "x"}) is not None))]
    return spark.createDataFrame(rows, "request string, answer int")


def _store(spark: SparkSession) -> Store:
    return Store(spark, f"{shared_dir(spark)}/factloom-{uuid.uuid4().hex}")


@query("""SELECT 'first' AS batch, 'NEW' AS change, count(*) AS n FROM files WHERE id % 2 = 0
UNION ALL SELECT 'second', CASE WHEN id % 2 = 1 THEN 'NEW' WHEN sha256 IS NULL OR id % 10 = 0 THEN 'CHANGED' ELSE 'UNCHANGED' END, count(*) FROM files GROUP BY 1, 2
UNION ALL SELECT 'stored', 'rows', count(*) FROM files UNION ALL SELECT 'told', 'times', 2""")
def merged_batches(spark, root):
    """Two batches of files into a store; only what is new or changed is merged, subscribers hear after it."""
    store, bus, heard = _store(spark), Bus(), []
    store.migrate()
    bus.subscribe(STATS, heard.append)
    every = table(spark, root, "files").select(F.col("id").alias("n"), "artifact_id", F.concat_ws("#", "rel_path", "id").alias("rel_path"), "sha256")
    batch = lambda df, sha: schema.conform(df.withColumn("sha256", sha), "files")
    first = merge_files(store, batch(every.where("n % 2 = 0"), F.col("sha256")), bus)
    second = merge_files(store, batch(every, F.when(F.col("n") % 10 == 0, F.concat("sha256", F.lit("x"))).otherwise(F.col("sha256"))), bus)
    rows = [("first", k, v) for k, v in first.items() if v] + [("second", k, v) for k, v in second.items() if v]
    rows += [("stored", "rows", store.read("files").count()), ("told", "times", len(heard))]
    out = spark.createDataFrame(rows, "batch string, change string, n bigint")
    store.drop()
    return out


@query(f"SELECT {len(schema.TABLES)} AS n_tables, {schema.VERSION} AS version, (SELECT count(*) FROM classes) AS n_before, 0 AS n_after")
def store_rebuilt(spark, root):
    """Every table made, filled, and made anew."""
    store = _store(spark)
    store.migrate()
    made = sum(store.version(name) > 0 for name in schema.TABLES)
    store.write("issues", table(spark, root, "classes").select("id", F.col("fqn").alias("target")))
    before = store.read("issues").count()
    store.rebuild()
    version = int(lookup.schema_version(store.read("schema_history")).first().version)
    out = spark.createDataFrame([(made, version, before, store.read("issues").count())], "n_tables int, version int, n_before bigint, n_after int")
    store.drop()
    return out


@query("SELECT unnest([1, 2, 3]) AS line, unnest(['answer', 'answer', 'error -32601']) AS said")
def stdio_answers(spark, root):
    """Transports of section 2.13: a request a line, an answer a line; notifications and what is no request get none."""
    tables = {name: schema.empty(spark, name) for name in schema.TABLES}
    requests = [{"jsonrpc": "2.0", "id": 1, "method": "initialize"}, {"jsonrpc": "2.0", "method": "tools/list"}, {"jsonrpc": "2.0", "id": 2, "method": "tools/list"}, {"jsonrpc": "2.0", "id": 3, "method": "none"}]
    sink = io.StringIO()
    serve_stdio(Server(Tools(lambda: tables), Bus()), io.StringIO("\n".join(map(json.dumps, requests)) + "\n"), sink)
    said = [json.loads(line) for line in sink.getvalue().splitlines()]
    return spark.createDataFrame([(x["id"], f"error {x['error']['code']}" if "error" in x else "answer") for x in said], "line int, said string")


@query("SELECT unnest(['rebuild', 'doctor', 'stats', 'query']) AS command, unnest([1, (SELECT count(*) FROM classes), (SELECT count(*) FROM classes), (SELECT count(*) FROM classes WHERE id % 2 = 0)]) AS answer")
def command_answers(spark, root):
    """Commands of section 2.13 over a store with a row for each class: made anew, counted twice, asked for one kind of issue."""
    store = _store(spark)

    def run(*argv: str) -> dict:
        out = io.StringIO()
        cli.main(["--db", store.root, *argv], spark, out)
        return json.loads(out.getvalue())

    made = int(run("rebuild")["rebuilt"])
    c = table(spark, root, "classes")
    store.write("classes", c.select("id", "fqn"))
    store.write("issues", c.select("id", F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("kind"), F.col("fqn").alias("target")))
    rows = [("rebuild", made), ("doctor", run("doctor")["classes"]), ("stats", run("stats", "--json")["classes"]), ("query", run("query", "list_issues", "kind=even")["count"])]
    out = spark.createDataFrame(rows, "command string, answer bigint")
    store.drop()
    return out
