"""Framework XML to facts. Rows S12 to S14, X3, X5, X7, A5 of the survey.

Documents are rows (source_file, content); each is parsed once inside a task, external entities are never resolved,
and gives tagged rows. What needs other tables (class ids, bean names) is left to joins in ``operators.wiring``.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factloom.functions import text as X
from factloom.functions.symbols import from_dotted

#: depth to which fragments are followed
INCLUDE_DEPTH = 4
_STATEMENTS = {"select", "insert", "update", "delete"}

BEAN_FILES = r"(?i)(?:^beans|.*(?:spring|applicationcontext|dubbo-provider|dubbo-consumer|/beans/)).*\.xml$|(?i)beans\.xml$"
SERVICE_FILES = r"(?i)dubbo[^!]*\.xml$"
MAPPER_FILES = r"(?i)(?:mapper\.xml$|/mappers?/[^!]*\.xml$)"


def local(tag: object) -> str:
    return tag.rsplit("}", 1)[-1] if isinstance(tag, str) else ""


def document(content: bytes | str | None) -> ET.Element | None:
    """The root with comments kept; None for what is no XML."""
    if not content:
        return None
    try:
        return ET.fromstring(content, ET.XMLParser(target=ET.TreeBuilder(insert_comments=True)))
    except (ET.ParseError, ValueError, LookupError):
        return None


def named(root: ET.Element, name: str) -> Iterator[ET.Element]:
    return (e for e in root.iter() if local(e.tag) == name)


def _int(text: str | None, bits: int = 32) -> int | None:
    """The number; None for what is none or doesn't fit the column."""
    try:
        n = int(text) if text else None
    except ValueError:
        return None
    return n if n is not None and -1 << bits - 1 <= n < 1 << bits - 1 else None


def _bool(text: str | None) -> bool | None:
    return None if not text else text.strip().lower() == "true"


# ---- beans ---------------------------------------------------------------------------------------------------------


def beans(root: ET.Element) -> Iterator[dict]:
    """Beans, further names, aliases and scanned packages."""
    for k, e in enumerate(named(root, "bean")):
        names = [e.get("id", "").strip()] if e.get("id", "").strip() else [x for x in re.split(r"\s*,\s*", e.get("name", "").strip()) if x]
        kind = e.get("class", "").strip()
        if not names or not kind:
            continue
        for n, name in enumerate(names):
            yield {"tag": "bean", "position": k, "name": name, "type": kind, "source": "xml-alias" if n else "xml", "scope": e.get("scope", "").strip() or "singleton", "primary": e.get("primary", "").lower() == "true"}
    for k, e in enumerate(named(root, "alias")):
        if e.get("name", "").strip() and e.get("alias", "").strip():
            yield {"tag": "alias", "position": k, "name": e.get("alias"), "ref": e.get("name")}
    for e in named(root, "component-scan"):
        for k, package in enumerate(re.split(r"\s*,\s*", e.get("base-package", "").strip())):
            if package:
                yield {"tag": "scan", "position": k, "name": package}


# ---- services ------------------------------------------------------------------------------------------------------


def services(root: ET.Element) -> Iterator[dict]:
    """Registries, services, references and their methods."""
    for k, e in enumerate(named(root, "registry")):
        if e.get("id", "").strip():
            parameters = {p.get("key", ""): p.get("value", "") for p in e if local(p.tag) == "parameter"}
            yield {"tag": "registry", "position": k, "name": e.get("id"), "address": e.get("address", ""), "protocol": e.get("protocol", ""), "port": _int(e.get("port")), "username": e.get("username", ""), "parameters": json.dumps(parameters, ensure_ascii=False, separators=(",", ":"))}
    for kind in ("service", "reference"):
        for k, e in enumerate(named(root, kind)):
            interface = e.get("interface", "").strip()
            if not interface:
                continue
            own = {"tag": kind, "position": k, "type": interface, "group": e.get("group", ""), "version": e.get("version", ""), "registry": e.get("registry", "")}
            if kind == "service":
                yield own | {"ref": e.get("ref", ""), "protocol": e.get("protocol", "").strip() or "dubbo"}
            else:
                yield own | {"ref": e.get("id", "")}
            for m in e:
                if local(m.tag) == "method" and m.get("name", "").strip():
                    yield {
                        "tag": "method", "position": k, "source": kind, "name": m.get("name"), "type": interface, "group": e.get("group", ""), "version": e.get("version", ""), "ref": e.get("ref" if kind == "service" else "id", ""), "registry": e.get("registry", ""),
                        "timeout": _int(m.get("timeout"), 64), "retries": _int(m.get("retries")), "loadbalance": m.get("loadbalance") or None, "async": _bool(m.get("async")), "sent": _bool(m.get("sent")),
                    }


# ---- mappers -------------------------------------------------------------------------------------------------------


def _own_text(e: ET.Element) -> str:
    return (e.text or "") + "".join(c.tail or "" for c in e)


def _serialise(e: ET.Element, fragments: dict[str, str], depth: int = 0) -> str:
    """The element with fragments in place; what is missing becomes a comment."""
    if e.tag is ET.Comment:
        return f"<!--{e.text or ''}-->"
    out = [escape(e.text or "")]
    for c in e:
        if local(c.tag) == "include" and depth <= INCLUDE_DEPTH:
            ref = c.get("refid", "")
            out.append(f" {escape(fragments[ref])} <!-- included {ref} -->" if ref in fragments else f"<!-- missing {ref} -->")
        else:
            out.append(_serialise(c, fragments, depth + 1))
        out.append(escape(c.tail or ""))
    inner = "".join(out)
    head = local(e.tag) + "".join(f" {local(k)}={quoteattr(v)}" for k, v in e.attrib.items())
    return f"<{head}>{inner}</{local(e.tag)}>" if inner else f"<{head}/>"


def _plain(e: ET.Element, fragments: dict[str, str]) -> str:
    """The text with fragments in place and the marks of dynamic parts left out."""
    out = [e.text or ""] if e.tag is not ET.Comment else []
    for c in e:
        if local(c.tag) == "include":
            out.append(f" {fragments[c.get('refid', '')]} " if c.get("refid", "") in fragments else "")
        elif c.tag is not ET.Comment:
            out.append(_plain(c, fragments))
        out.append(c.tail or "")
    return "".join(out)


def mapper(root: ET.Element) -> Iterator[dict]:
    """Statements and result maps of one mapper."""
    namespace = root.get("namespace", "")
    if local(root.tag) != "mapper" or not namespace.strip():
        return
    fragments = {e.get("id"): _own_text(e) for e in root if local(e.tag) == "sql" and e.get("id", "").strip()}
    for k, e in enumerate(root):
        kind, own = local(e.tag), e.get("id", "")
        if not own.strip():
            continue
        if kind in _STATEMENTS:
            yield {"tag": "statement", "position": k, "namespace": namespace, "name": own, "source": kind.upper(), "template": _serialise(e, fragments).strip(), "plain": _plain(e, fragments)}
        elif kind == "resultMap":
            children = [local(c.tag) for c in e if isinstance(c.tag, str)]
            yield {
                "tag": "result_map", "position": k, "namespace": namespace, "name": own, "type": e.get("type", "").strip(), "ref": e.get("extends", "").strip(), "primary": e.get("autoMapping", "").lower() != "false",
                "associations": children.count("association"), "collections": children.count("collection"), "properties": sum(c not in ("association", "collection") for c in children),
            }


# ---- tables --------------------------------------------------------------------------------------------------------

_ROW = "tag string, source_file string, position int, namespace string, name string, type string, ref string, source string, scope string, primary boolean, group string, version string, registry string, protocol string, address string, port int, username string, parameters string, timeout bigint, retries int, loadbalance string, async boolean, sent boolean, template string, plain string, properties int, associations int, collections int"
_ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}
_ROW_ARROW = pa.schema([(n, _ARROW[t]) for n, t in (c.split() for c in _ROW.split(", "))])


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows: list[dict] = []
        for source, content in zip(b.column("source_file").to_pylist(), b.column("content")):
            root = document(content.as_py())
            if root is None:
                rows.append({"tag": "issue", "source_file": source})
                continue
            for read in (beans, services, mapper):
                rows += ({"source_file": source, **r} for r in read(root))
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ROW_ARROW)


def extract(documents: DataFrame) -> DataFrame:
    """documents(source_file, content) to tagged rows."""
    return documents.select("source_file", F.col("content").cast("binary").alias("content")).mapInArrow(_run, _ROW)


def documents_of(entries: DataFrame) -> DataFrame:
    """XML entries of archives whose names say what they are."""
    wanted = F.col("entry").rlike(BEAN_FILES) | F.col("entry").rlike(SERVICE_FILES) | F.col("entry").rlike(MAPPER_FILES)
    return entries.where(F.endswith("entry", F.lit(".xml")) & wanted & F.col("content").isNotNull()).select(F.concat("archive", F.lit("!"), F.col("entry")).alias("source_file"), "content")


def tables(rows: DataFrame) -> dict[str, DataFrame]:
    """The tagged rows as tables with the names of the schema; ids and class ids are for later joins."""
    of = lambda tag: rows.where(F.col("tag") == tag)
    found = of("bean").select("source_file", "position", "name", from_dotted(F.col("type")).alias("type_fqn"), "source", "scope", F.col("primary").alias("primary_b"))
    # an alias takes over what its bean is; the first bean of that name counts
    first = found.groupBy(F.col("name").alias("ref")).agg(F.min_by(F.struct("type_fqn", "scope", "primary_b"), F.struct("source_file", "position")).alias("b"))
    aliased = of("alias").join(first, "ref").select("source_file", "position", "name", "b.type_fqn", F.lit("xml-alias").alias("source"), "b.scope", "b.primary_b")
    key = [from_dotted(F.col("type")).alias("interface_fqn"), F.col("group").alias("group_name"), F.col("version").alias("service_version"), F.col("registry").alias("registry_id")]
    return {
        "spring_beans": found.unionByName(aliased),
        "component_scans": of("scan").select("source_file", F.col("name").alias("package")),
        "dubbo_registries": of("registry").select("source_file", F.col("name").alias("registry_id"), "address", "protocol", "port", "username", F.from_json("parameters", "map<string,string>").alias("parameters")),
        "dubbo_services": of("service").select("source_file", *key, F.lit("xml").alias("source"), "protocol", F.col("ref").alias("ref_bean_name")),
        "dubbo_references": of("reference").select("source_file", *key, F.col("ref").alias("ref_id"), F.lit("UNCERTAIN").alias("confidence"), F.lit(0).cast("bigint").alias("field_id"), F.lit("").alias("consumer_class_fqn")),
        "dubbo_method_configs": of("method").select("source_file", F.col("source").alias("parent"), *key, "ref", F.col("name").alias("method_name"), F.col("timeout").alias("timeout_ms"), "retries", "loadbalance", "async", "sent"),
        "mybatis_statements": of("statement").select(F.col("namespace").alias("mapper_namespace"), F.col("name").alias("statement_id"), F.col("source").alias("kind"), F.col("template").alias("sql_template"), X.normalise_sql(F.col("plain")).alias("sql_normalized"), X.parameter_names(F.col("template")).alias("parameter_names"), F.col("source_file").alias("defined_in_file"), F.lit("").alias("provider_class"), F.lit("").alias("provider_method")),
        "mybatis_result_maps": of("result_map").select(F.col("namespace").alias("mapper_namespace"), F.col("name").alias("map_id"), F.col("type").alias("type_fqn"), F.col("ref").alias("extends_"), F.col("primary").alias("auto_mapping"), F.col("properties").alias("property_count"), F.col("associations").alias("association_count"), F.col("collections").alias("collection_count")),
        "issues": of("issue").select(F.lit("xml_read").alias("kind"), F.col("source_file").alias("target"), F.lit("no readable XML").alias("message"), F.lit("WARN").alias("severity")),
    }
