"""Deeply nested records to flat tables, in one pass.

A depth-first visitor walks each JSON text once and emits rows tagged with their table: record id, own path, parent
path, position, name, the columns of all schemas and the object's other own fields as JSON. ``split_tables`` applies a
schema to each tag; ``sources.store.write_tagged`` writes all of them in one pass, a folder for each tag. The visitor keeps
its own stack, and texts nested too deep for the platform's parser are read and written iteratively, so depth is bounded
by memory only.

Defined cases: null, empty, unreadable and truncated payloads give no rows; a lone object counts as position 0; nulls
and scalars in a list keep their position and give no row; a field holding JSON text stands for what it holds; a field
present in both spellings gives rows for both; repeated records give rows each; the source file of a registry is its own
or else that of the nearest object around it that names one, null if none does.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from json.decoder import scanstring
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: fixed values: table of each field (snake_case and camelCase) and the field that names its objects
FIELDS = {
    "result_maps": ("result_maps", "map_id"),
    "resultMaps": ("result_maps", "map_id"),
    "associations": ("associations", "property"),
    "collections": ("collections", "property"),
    "cases": ("cases", "value"),
    "registries": ("registries", "registry_id"),
    "fallbacks": ("fallbacks", "registry_id"),
}
NAMES = {
    "map_id": ("map_id", "mapId"),
    "property": ("property",),
    "value": ("value",),
    "registry_id": ("registry_id", "registryId"),
}
SOURCE = ("source_file", "sourceFile")
TABLES = ("result_maps", "associations", "collections", "cases", "registries", "fallbacks")

_SPACE = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null", re.ASCII)


def _no_constant(name: str) -> Any:
    raise ValueError(name)


_WRITE = json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode
_READ = json.JSONDecoder(parse_constant=_no_constant).decode


def _read_iteratively(text: str) -> Any:
    """JSON of any depth, with an explicit stack."""

    def space(at: int) -> int:
        return _SPACE.match(text, at).end()

    def key(at: int) -> tuple[str, int]:
        if text[at : at + 1] != '"':
            raise ValueError("key expected")
        name, at = scanstring(text, at + 1, True)
        at = space(at)
        if text[at : at + 1] != ":":
            raise ValueError("colon expected")
        return name, space(at + 1)

    stack: list[list] = []  # [container, key of the value being read]
    at = space(0)
    while True:
        c = text[at : at + 1]
        if c in ("{", "["):
            new: Any = {} if c == "{" else []
            at = space(at + 1)
            if text[at : at + 1] == ("}" if c == "{" else "]"):
                value, at = new, at + 1
            else:
                stack.append([new, None])
                if c == "{":
                    stack[-1][1], at = key(at)
                continue
        elif c == '"':
            value, at = scanstring(text, at + 1, True)
        elif m := _SCALAR.match(text, at):
            value, at = json.loads(m[0]), m.end()
        else:
            raise ValueError("value expected")
        while True:
            at = space(at)
            if not stack:
                if at != len(text):
                    raise ValueError("text after the value")
                return value
            container, name = stack[-1]
            if isinstance(container, dict):
                container[name] = value
            else:
                container.append(value)
            c = text[at : at + 1]
            if c == ",":
                at = space(at + 1)
                if isinstance(container, dict):
                    stack[-1][1], at = key(at)
                break
            if c != ("}" if isinstance(container, dict) else "]"):
                raise ValueError("end expected")
            value, at = stack.pop()[0], at + 1


def read_json(text: str | None) -> Any:
    """The value of a complete JSON text, else None."""
    if not text:
        return None
    try:
        return _READ(text)
    except RecursionError:
        pass
    except ValueError:
        return None
    try:
        return _read_iteratively(text)
    except ValueError:
        return None


def _held(value: Any) -> Any:
    """What a field stands for: JSON text stands for the list or object it holds, also when wrapped repeatedly."""
    while isinstance(value, str) and value.lstrip(" \t\n\r")[:1] in ("{", "[", '"'):
        inner = read_json(value)
        if inner is None:
            break
        value = inner
    return value


def _text(value: Any) -> str:
    if value is None:
        return ""
    if isinstance(value, str):
        return value
    return _dump(value)


def _dump(value: Any) -> str:
    try:
        return _WRITE(value)
    except RecursionError:
        return _dump_iteratively(value)


def _dump_iteratively(value: Any) -> str:
    """JSON text of any depth, with an explicit stack."""
    out: list[str] = []
    stack: list[tuple[Any, bool]] = [(value, False)]  # (value or finished text, whether it is text)
    while stack:
        value, done = stack.pop()
        if done:
            out.append(value)
        elif isinstance(value, dict):
            out.append("{")
            stack.append(("}", True))
            for n, (k, v) in reversed([*enumerate(value.items())]):
                stack += [(v, False), ("," * (n > 0) + _WRITE(k) + ":", True)]
        elif isinstance(value, list):
            out.append("[")
            stack.append(("]", True))
            for n, v in reversed([*enumerate(value)]):
                stack += [(v, False), ("," * (n > 0), True)]
        else:
            out.append(_WRITE(value))
    return "".join(out)


def _own_fields(node: dict, taken: set[str | None]) -> dict:
    """Fields of the node itself: all but those taken as columns and, at any depth, what goes into other tables."""
    top = {k: v for k, v in node.items() if k not in FIELDS and k not in taken}
    stack: list[Any] = [top]
    while stack:
        value = stack.pop()
        for k, v in value.items() if isinstance(value, dict) else enumerate(value):
            if isinstance(v, dict):
                value[k] = {n: x for n, x in v.items() if n not in FIELDS}
            elif isinstance(v, list):
                value[k] = v.copy()
            else:
                continue
            stack.append(value[k])
    return top


def _first(node: dict, names: tuple[str, ...]) -> Any:
    """The first of the fields that isn't null."""
    return next((node[n] for n in names if node.get(n) is not None), None)


def visit(payload: str | None) -> Iterator[tuple[str, str, str, int, str, dict]]:
    """Depth first: (table, node_path, parent_path, position, node_name, node) for each object of a known field."""
    for *row, _ in visit_sources(payload):
        yield tuple(row)


def visit_sources(payload: str | None) -> Iterator[tuple[str, str, str, int, str, dict, Any]]:
    """The same with the source file of each object."""
    top = read_json(payload)
    stack: list[tuple[Any, str, Any]] = [(top, "", None)]
    while stack:
        value, path, source = stack.pop()
        value = _held(value)
        if isinstance(value, list):
            stack.extend((x, path, source) for x in reversed(value) if isinstance(x, (dict, list, str)))
            continue
        if not isinstance(value, dict):
            continue
        if (named := _first(value, SOURCE)) is not None:
            source = named
        below: list[tuple[Any, str, Any]] = []
        for field, held in value.items():
            known = FIELDS.get(field)
            if known is None:
                if isinstance(held, (dict, list, str)):
                    below.append((held, path, source))
                continue
            table, names = known
            held = _held(held)
            for at, item in enumerate(held if isinstance(held, list) else [held]):
                item = _held(item)
                own = f"{path}/{table}[{at}]" if path else f"{table}[{at}]"
                if isinstance(item, dict):
                    named = _first(item, SOURCE)
                    yield table, own, path, at, _text(_first(item, NAMES[names])), item, source if named is None else named
                    below.append((item, own, source))
                elif isinstance(item, list):
                    below.append((item, path, source))
        stack.extend(reversed(below))


#: columns of each table beside record_id, node_path, parent_path, position, node_name
SCHEMAS = {
    "result_maps": {"map_id": ("map_id", "mapId"), "namespace": ("namespace",), "type_fqn": ("type_fqn", "typeFqn"), "extends_": ("extends_", "extends"), "auto_mapping": ("auto_mapping", "autoMapping"), "association_count": ("association_count", "associationCount")},
    "associations": {"property": ("property",), "java_type": ("java_type", "javaType"), "extends_": ("extends_", "extends")},
    "collections": {"property": ("property",), "of_type": ("of_type", "ofType"), "extends_": ("extends_", "extends")},
    "cases": {"value": ("value",), "result_type": ("result_type", "resultType")},
    "registries": {"registry_id": ("registry_id", "registryId"), "address": ("address",), "protocol": ("protocol",), "port": ("port",), "parameters": ("parameters",), "source_file": SOURCE},
    "fallbacks": {"registry_id": ("registry_id", "registryId"), "address": ("address",), "protocol": ("protocol",), "port": ("port",), "parameters": ("parameters",), "source_file": SOURCE},
}
_COLUMNS = tuple(dict.fromkeys(c for columns in SCHEMAS.values() for c in columns))
_LINK = [("record_id", pa.int64()), ("tag", pa.string()), ("node_path", pa.string()), ("parent_path", pa.string()), ("position", pa.int32()), ("node_name", pa.string())]


def _values(table: str, node: dict, source: Any) -> Iterator[str | None]:
    """The columns of all schemas, null where the table has none, and the other own fields."""
    schema = SCHEMAS[table]
    taken = set()
    for column in _COLUMNS:
        name = next((n for n in schema.get(column, ()) if node.get(n) is not None), None)
        taken.add(name)
        value = source if column == "source_file" and column in schema else node.get(name)
        yield None if value is None else _text(value)
    yield _dump(_own_fields(node, taken))


def _emit(with_columns: bool, rows_a_batch: int = 20_000):
    schema = pa.schema([*_LINK, *((c, pa.string()) for c in (*_COLUMNS, "own_fields") if with_columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for b in batches:
            for record, payload in zip(b.column("record_id").to_pylist(), b.column("payload")):
                for table, path, parent, at, name, node, source in visit_sources(payload.as_py()):
                    rows.append((record, table, path, parent, at, name, *(_values(table, node, source) if with_columns else ())))
                if len(rows) >= rows_a_batch:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), schema.types)], schema=schema)
                    rows.clear()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), schema.types)], schema=schema)

    return run


def emit_tagged(records: DataFrame, record_id: Column, payload: Column, with_columns: bool = True) -> DataFrame:
    """record_id, tag, node_path, parent_path (empty at the top), position, node_name; with_columns: the columns of all
    schemas and own_fields."""
    emitted = "record_id bigint, tag string, node_path string, parent_path string, position int, node_name string"
    return records.select(record_id.cast("bigint").alias("record_id"), payload.alias("payload")).where(F.col("payload").isNotNull()).mapInArrow(
        _emit(with_columns), emitted + "".join(f", {c} string" for c in (*_COLUMNS, "own_fields") if with_columns)
    )


#: the columns of written rows but for the tag, which is their folder
TAGGED = "record_id bigint, node_path string, parent_path string, position int, node_name string" + "".join(f", {c} string" for c in (*_COLUMNS, "own_fields"))


def split_tables(rows_of: Callable[[str], DataFrame]) -> dict[str, DataFrame]:
    """The flat table of each tag, linked by (record_id, parent_path), from what ``rows_of`` gives for it; own_fields has the
    node's fields that went into no column as JSON."""
    link = ["record_id", "node_path", F.nullif("parent_path", F.lit("")).alias("parent_path"), "position", "node_name"]
    return {tag: rows_of(tag).select(*link, *SCHEMAS[tag], "own_fields") for tag in TABLES}


def child_counts(tagged: DataFrame) -> DataFrame:
    """record_id, node_path, node_name, n_associations, n_collections, n_cases for each result map: direct and deeper
    children, those of result maps nested below it too."""
    steps = F.split("node_path", "/")
    maps = F.filter(F.sequence(F.lit(1), F.size(steps)), lambda k: F.startswith(F.element_at(steps, k), F.lit("result_maps[")))
    return (
        tagged.withColumn("map_path", F.explode(F.transform(maps, lambda k: F.array_join(F.slice(steps, F.lit(1), k), "/"))))
        .groupBy("record_id", F.col("map_path").alias("node_path"))
        .agg(
            F.max(F.when(F.col("node_path") == F.col("map_path"), F.col("node_name"))).alias("node_name"),
            *(F.sum((F.col("tag") == t).cast("bigint")).alias(f"n_{t}") for t in ("associations", "collections", "cases")),
        )
    )
