"""Commands: init, index, serve, query, rebuild, doctor, stats, m2-warm. Section 2.13 of the survey."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from factloom.operators import lookup
from factloom.plans import index
from factloom.plans.server import Server, serve_http, serve_stdio
from factloom.plans.tools import CATALOGUE, Tools
from factloom.sources import maven
from factloom.sources.store import Store
from factloom.streaming.incremental import STATS
from factloom.streaming.notify import Bus


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("factloom")
    p.add_argument("--db", default="facts", help="folder of the tables")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("init", help="index a project's dependencies, and its own archive if given")
    c.add_argument("pom")
    c.add_argument("--depth", type=int, default=1)
    c.add_argument("--repository", help="local repository")
    c.add_argument("--jar", action="append", default=[])
    c = sub.add_parser("index", help="index archives")
    c.add_argument("archives", nargs="+")
    c.add_argument("--sources", action="append", default=[])
    c = sub.add_parser("serve")
    c.add_argument("--http", type=int)
    c.add_argument("--root", action="append", default=[], help="archives in which missing classes are looked for")
    c = sub.add_parser("query", help="one tool; arguments as name=value")
    c.add_argument("tool", choices=list(CATALOGUE))
    c.add_argument("arguments", nargs="*")
    c.add_argument("--root", action="append", default=[])
    sub.add_parser("rebuild")
    sub.add_parser("doctor")
    c = sub.add_parser("stats")
    c.add_argument("--json", action="store_true")
    c = sub.add_parser("m2-warm", help="read archives ahead")
    c.add_argument("archives", nargs="+")
    c.add_argument("--cap", type=int, default=50)
    return p


def dependencies(spark: SparkSession, pom: str, depth: int, repository: str) -> list[str]:
    """Archives of a project's dependencies that are in the local repository; test scope and open versions are left out."""
    poms = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pom").load(repository).select("path", "content")
    own = spark.read.format("binaryFile").load(pom).select("path", "content")
    rows = maven.extract(poms.unionByName(own).dropDuplicates(["path"]))
    root = maven.extract(own).where("tag = 'project'").select("pom")
    wanted = maven.resolved_graph(rows, root, depth).where("scope <> 'test' AND NOT startswith(version, '${')")
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jar").load(repository).select("path")
    plan = maven.plan_fetch(wanted.select("group", "artifact", "version").distinct(), there)
    return [r.jar for r in plan.where("status = 'local'").select("jar").collect()]  # a project's dependencies, a few hundred


def tools(store: Store, roots: list[str]) -> Tools:
    """The tools over a store; with ``roots`` classes that are asked for and not indexed are looked for in their archives."""
    on_miss = (lambda fqn: index.index_missing(store, fqn, *roots)) if roots else None
    return Tools(store.tables, on_miss=on_miss, version=lambda: tuple(store.version(n) for n in ("classes", "methods", "invokes")))


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    a, out = parser().parse_args(argv), out or sys.stdout
    spark = spark or SparkSession.builder.appName("factloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store = Store(spark, a.db)
    say = lambda x: print(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False, default=str), file=out)
    if a.command == "rebuild":
        store.rebuild()
        say({"rebuilt": True})
        return 0
    store.migrate()
    if a.command == "init":
        repository = a.repository or maven.settings()["local_repository"]
        found = [*a.jar, *dependencies(spark, a.pom, a.depth, repository)]
        if not found:
            say({"indexed": 0, "error": "no archive of the dependencies is in the local repository"})
            return 2
        say(vars(index.index_archives(store, *found)))
    elif a.command == "index":
        say(vars(index.index_archives(store, *a.archives, sources=tuple(a.sources))))
    elif a.command == "serve":
        server = Server(tools(store, a.root), Bus())
        if a.http:
            serve_http(server, a.http).serve_forever()
        else:
            serve_stdio(server)
    elif a.command == "query":
        arguments = dict(x.split("=", 1) for x in a.arguments)
        say(tools(store, a.root).call(a.tool, {k: json.loads(v) if v in ("true", "false") or v.lstrip("-").isdigit() else v for k, v in arguments.items()}))
    elif a.command in ("doctor", "stats"):
        counts = {r["name"]: r["value"] for r in lookup.stats(store.tables()).collect()}  # a few dozen names
        version = lookup.schema_version(store.read("schema_history")).first().version
        if a.command == "doctor":
            say({"schema": version, "db": a.db, "classes": counts["classes"], "methods": counts["methods"], "invokes": counts["invokes"], "issues": counts["issues"], "ok": counts["classes"] > 0})
        elif a.json:
            say(counts | {"schema": version})
        else:
            say("\n".join(f"{k:<40}{v:>12}" for k, v in sorted(counts.items())))
    else:
        say({"cached": index.warm(store, *a.archives, cap=a.cap).count(), "notified": STATS})
    return 0


if __name__ == "__main__":
    sys.exit(main())
