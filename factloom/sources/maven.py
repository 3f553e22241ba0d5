"""Project files and settings. Rows S6 to S11 of the survey.

POMs are rows (path, content). Each is parsed once; properties, parents, managed versions and imports become relations,
and inheritance is a short walk of joins over them (a chain of parents and imports is a few steps long).
"""

from __future__ import annotations

import os
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factloom.operators import resolve
from factloom.session import cut
from factloom.sources.xml import document, local

CENTRAL = "https://repo1.maven.org/maven2"

_ROW = "tag string, path string, pom string, position int, group string, artifact string, version string, scope string, optional boolean, type string"
_ROW_ARROW = pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}[t]) for n, t in (c.split() for c in _ROW.split(", "))])


def _children(e: ET.Element | None, name: str) -> list[ET.Element]:
    return [] if e is None else [c for c in e if local(c.tag) == name]


def _text(e: ET.Element | None, name: str) -> str | None:
    for c in _children(e, name):
        return (c.text or "").strip() or None
    return None


def project(root: ET.Element) -> tuple[str | None, str | None, str | None]:
    """Own coordinate, from the parent where it is missing."""
    parent = next(iter(_children(root, "parent")), None)
    return _text(root, "groupId") or _text(parent, "groupId"), _text(root, "artifactId"), _text(root, "version") or _text(parent, "version")


def substitute(raw: str | None, properties: dict[str, str]) -> str | None:
    """``${name}`` from the properties; project values and unknown names stay as they are."""
    m = re.fullmatch(r"\$\{(.+)\}", raw or "")
    return raw if not m or m[1].startswith("project.") else properties.get(m[1], raw)


def pom_rows(root: ET.Element) -> Iterator[dict]:
    """project, parent, dependency, managed and import rows of one POM."""
    group, artifact, version = project(root)
    pom = ":".join(x or "" for x in (group, artifact, version))
    properties = {local(p.tag): (p.text or "").strip() for block in _children(root, "properties") for p in block if isinstance(p.tag, str)}
    yield {"tag": "project", "pom": pom, "position": 0, "group": group, "artifact": artifact, "version": version}
    for p in _children(root, "parent")[:1]:
        yield {"tag": "parent", "pom": pom, "position": 0, "group": _text(p, "groupId"), "artifact": _text(p, "artifactId"), "version": _text(p, "version")}
    position = 0
    for block in _children(root, "dependencies"):
        for d in _children(block, "dependency"):
            if _text(d, "groupId") and _text(d, "artifactId"):
                position += 1
                yield {
                    "tag": "dependency", "pom": pom, "position": position, "group": _text(d, "groupId"), "artifact": _text(d, "artifactId"), "version": substitute(_text(d, "version"), properties),
                    "scope": _text(d, "scope") or "compile", "type": _text(d, "type") or "jar", "optional": (_text(d, "optional") or "").lower() == "true",
                }
    for management in _children(root, "dependencyManagement"):
        for block in _children(management, "dependencies"):
            for d in _children(block, "dependency"):
                version = _text(d, "version")
                # managed versions are taken as written, placeholders are not
                if _text(d, "groupId") and _text(d, "artifactId") and version and not version.startswith("${"):
                    position += 1
                    imported = _text(d, "type") == "pom" and _text(d, "scope") == "import"
                    yield {"tag": "import" if imported else "managed", "pom": pom, "position": position, "group": _text(d, "groupId"), "artifact": _text(d, "artifactId"), "version": version}


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for path, content in zip(b.column("path").to_pylist(), b.column("content")):
            root = document(content.as_py())
            if root is not None and local(root.tag) == "project":
                rows += ({"path": path, **r} for r in pom_rows(root))
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ROW_ARROW)


def extract(poms: DataFrame) -> DataFrame:
    return poms.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(_run, _ROW)


def managed_versions(rows: DataFrame) -> DataFrame:
    """pom, group, artifact, version, priority: managed versions a POM has of its own, from imports, then from its parent; own first.

    The walk goes over (pom, source) pairs; a source's place is the path of steps that led to it, so order is exact.
    """
    gav = F.concat_ws(":", "group", "artifact", "version")
    # a POM's entries come before its parent's, in the order they are written
    links = rows.where(F.col("tag").isin("import", "parent") & ~F.startswith(F.coalesce("version", F.lit("${")), F.lit("${"))).select(
        F.col("pom").alias("source"), gav.alias("next"), F.when(F.col("tag") == "parent", 1_000_000).otherwise(F.col("position")).alias("step")
    )
    links = cut(links.distinct())
    managed = rows.where("tag = 'managed'").select(F.col("pom").alias("source"), "group", "artifact", "version", "position")
    frontier = cut(rows.where("tag = 'project'").select("pom", F.col("pom").alias("source"), F.array().cast("array<int>").alias("way")).distinct())
    reached = frontier
    while True:
        step = frontier.join(links, "source").select("pom", F.col("next").alias("source"), F.concat("way", F.array("step")).alias("way"))
        step = step.groupBy("pom", "source").agg(F.min("way").alias("way"))
        frontier = cut(step.join(reached.select("pom", "source"), ["pom", "source"], "left_anti"))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached.join(managed, "source").select("pom", "group", "artifact", "version", F.concat("way", F.array("position")).alias("priority"))


def direct_dependencies(rows: DataFrame) -> DataFrame:
    """Pom, position, group, artifact, version, scope, type, optional."""
    declared = rows.where("tag = 'dependency'").select("pom", "position", "group", "artifact", "version", "scope", "type", "optional")
    return resolve.effective_versions(declared, managed_versions(rows))


def resolved_graph(rows: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """S9 over all POMs known: roots(pom)."""
    return resolve.resolve_dependencies(direct_dependencies(rows), roots, max_depth)


# ---- settings (driver side: one small file) ------------------------------------------------------------------------


def settings(path: str | None = None, env: dict[str, str] | None = None) -> dict:
    """Local repository, mirrors, servers and repositories of active profiles; defaults where there is no file."""
    env = dict(os.environ) if env is None else env
    home = env.get("HOME", "~")
    path = path or env.get("MAVEN_SETTINGS") or os.path.join(home, ".m2", "settings.xml")
    out = {"local_repository": os.path.join(home, ".m2", "repository"), "mirrors": [], "servers": {}, "repositories": [], "offline": False}
    try:
        with open(path, "rb") as f:
            root = document(f.read())
    except OSError:
        root = None
    if root is None:
        return out

    def fill(text: str | None) -> str | None:
        return None if text is None else re.sub(r"\$\{(?:env\.(\w+)|user\.home)\}", lambda m: env.get(m[1], m[0]) if m[1] else home, text)

    out["local_repository"] = fill(_text(root, "localRepository")) or out["local_repository"]
    out["offline"] = (_text(root, "offline") or "").lower() == "true"
    for m in (m for b in _children(root, "mirrors") for m in _children(b, "mirror")):
        out["mirrors"].append({"id": _text(m, "id"), "url": fill(_text(m, "url")), "mirror_of": _text(m, "mirrorOf") or "*"})
    for s in (s for b in _children(root, "servers") for s in _children(b, "server")):
        out["servers"][_text(s, "id")] = {"username": fill(_text(s, "username")), "password": fill(_text(s, "password"))}
    active = {(a.text or "").strip() for b in _children(root, "activeProfiles") for a in _children(b, "activeProfile")}
    for p in (p for b in _children(root, "profiles") for p in _children(b, "profile")):
        default = any((_text(a, "activeByDefault") or "").lower() == "true" for a in _children(p, "activation"))
        if _text(p, "id") in active or default:
            out["repositories"] += [{"id": _text(r, "id"), "url": fill(_text(r, "url"))} for b in _children(p, "repositories") for r in _children(b, "repository")]
    return out


def remotes(found: dict) -> list[dict]:
    """Repositories in order with mirrors applied; central is the last resort."""
    listed = [*found["repositories"]] or []
    if not any(r["id"] == "central" for r in listed):
        listed.append({"id": "central", "url": CENTRAL})

    def mirrored(r: dict) -> dict:
        for m in found["mirrors"]:
            of = [x.strip() for x in m["mirror_of"].split(",")]
            if f"!{r['id']}" not in of and ("*" in of or r["id"] in of or ("external:*" in of and "localhost" not in (r["url"] or ""))):
                return {"id": m["id"], "url": m["url"]}
        return r

    out = []
    for r in map(mirrored, listed):
        if r not in out:
            out.append(r)
    return [r | {"auth": r["id"] in found["servers"]} for r in out]


def plan_fetch(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """wanted(group, artifact, version) with the jar of the local repository, or the path to ask remotes for: files(path) lists what is there."""
    rel = F.concat(F.translate("group", ".", "/"), F.lit("/"), F.col("artifact"), F.lit("/"), F.col("version"), F.lit("/"), F.col("artifact"), F.lit("-"), F.col("version"))
    have = files.select("path", F.regexp_extract("path", r"((?:[^/]+/)*[^/]+)$", 1).alias("tail"))
    asked = wanted.withColumn("relative_path", F.concat(rel, F.lit(".jar"))).withColumn("sources_path", F.concat(rel, F.lit("-sources.jar"))).withColumn("name", F.substring_index("relative_path", "/", -1))
    named = have.select("path", F.substring_index("tail", "/", -1).alias("name"))
    local_ = asked.join(named, "name", "left").withColumn("jar", F.when(F.endswith("path", F.col("relative_path")), F.col("path")))
    return local_.groupBy("group", "artifact", "version", "relative_path", "sources_path").agg(F.min("jar").alias("jar")).withColumn("status", F.when(F.col("jar").isNotNull(), "local").otherwise("remote"))
