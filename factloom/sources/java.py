"""Annotated Java sources to facts. Rows X1, X4, X6, B5 and C17 to C19 of the survey.

There is no Java parser here, so a scanner reads what the facts need: package, imports, type declarations with their
annotations and interfaces, members with annotations, and the lines of methods. Comments and literals are blanked
before declarations are looked for; literal values are read from the original text at the same offsets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: fixed values: annotations by role
STEREOTYPES = ["org.springframework.stereotype.Component", "org.springframework.stereotype.Service", "org.springframework.stereotype.Repository", "org.springframework.stereotype.Controller", "org.springframework.web.bind.annotation.RestController", "org.springframework.context.annotation.Configuration"]
BEAN = "org.springframework.context.annotation.Bean"
WIRING = ["org.springframework.beans.factory.annotation.Autowired", "javax.annotation.Resource", "jakarta.annotation.Resource"]
QUALIFIER = "org.springframework.beans.factory.annotation.Qualifier"
SERVICES = ["org.apache.dubbo.config.annotation.DubboService", "org.apache.dubbo.config.annotation.Service", "com.alibaba.dubbo.config.annotation.Service"]
REFERENCES = ["org.apache.dubbo.config.annotation.DubboReference", "org.apache.dubbo.config.annotation.Reference", "com.alibaba.dubbo.config.annotation.Reference"]
STATEMENTS = {"Select": "SELECT", "Insert": "INSERT", "Update": "UPDATE", "Delete": "DELETE"}
PROVIDERS = {"SelectProvider": "SELECT", "InsertProvider": "INSERT", "UpdateProvider": "UPDATE", "DeleteProvider": "DELETE"}
AMBIGUOUS = {"Service", "Reference"}

_HIDDEN = re.compile(r"//[^\n]*|/\*.*?\*/|\"\"\".*?\"\"\"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S)
_PACKAGE = re.compile(r"^\s*package\s+([\w.]+)\s*;", re.M)
_IMPORT = re.compile(r"^\s*import\s+(static\s+)?([\w.]+)\s*;", re.M)
_ANNOTATION = re.compile(r"@(?!interface\b)([\w.]+)")
_TYPE = re.compile(r"\b(class|interface|enum|record)\s+(\w+)")
_MODIFIERS = re.compile(r"(?:public|protected|private|static|final|abstract|default|native|synchronized|transient|volatile|strictfp|sealed|non-sealed)\b\s*")
_GENERIC = re.compile(r"<[^<>]*>")
_STRING = re.compile(r'^\s*"((?:\\.|[^"\\])*)"\s*$', re.S)


def blank(text: str) -> str:
    """Comments and literals as blanks of the same length; quotes and line ends stay."""

    def hide(m: re.Match) -> str:
        body = re.sub(r"[^\n]", " ", m[0])
        return f'"{body[1:-1]}"' if m[0][0] == '"' and len(body) > 1 else body

    return _HIDDEN.sub(hide, text)


def _close(code: str, at: int, opening: str = "(", closing: str = ")") -> int:
    depth = 0
    for k in range(at, len(code)):
        depth += (code[k] == opening) - (code[k] == closing)
        if not depth:
            return k + 1
    return len(code)


def _annotations(text: str, code: str, at: int, end: int) -> tuple[list[tuple[str, dict[str, str]]], int]:
    """Annotations from ``at`` on and the place after them; attribute values as source text."""
    out = []
    while True:
        while at < end and code[at].isspace():
            at += 1
        if m := _ANNOTATION.match(code, at):
            at = m.end()
            stop = at
            k = at
            while k < end and code[k] in " \t\r\n":
                k += 1
            body = ""
            if k < end and code[k] == "(":
                stop = _close(code, k)
                body, hidden = text[k + 1 : stop - 1], code[k + 1 : stop - 1]
                out.append((m[1], _attributes(body, hidden)))
            else:
                out.append((m[1], {}))
            at = stop
        elif m := _MODIFIERS.match(code, at):
            at = m.end()
        else:
            return out, at


def _attributes(body: str, hidden: str) -> dict[str, str]:
    parts, depth, start = [], 0, 0
    for k, c in enumerate(hidden + ","):
        depth += (c in "({[") - (c in ")}]")
        if c == "," and depth <= 0:
            parts.append((start, k))
            start = k + 1
    out = {}
    for a, b in parts:
        if m := re.match(r"\s*(\w+)\s*=(?!=)", hidden[a:b]):
            out[m[1]] = body[a + m.end() : b].strip()
        elif body[a:b].strip():
            out["value"] = body[a:b].strip()
    return out


def literal(source: str | None) -> str | None:
    """The value of a single string literal; None for anything else."""
    m = _STRING.match(source or "")
    return None if not m else re.sub(r"\\(.)", lambda x: {"n": "\n", "t": "\t", "r": "\r"}.get(x[1], x[1]), m[1])


def matches(name: str, full: list[str], guarded: bool = False) -> bool:
    """C18."""
    for f in full:
        short = f.rsplit(".", 1)[-1]
        if name == f or name.endswith("." + short) or (name == short and not (guarded and short in AMBIGUOUS)):
            return True
    return False


def resolve(name: str, imports: dict[str, str], package: str) -> str:
    """C19, slashed."""
    plain = _strip(name)
    return (plain if "." in plain else imports.get(plain) or (f"{package}.{plain}" if package else plain)).replace(".", "/")


def _strip(kind: str) -> str:
    while (fewer := _GENERIC.sub("", kind)) != kind:
        kind = fewer
    return kind.replace("[]", "").replace("...", "").strip().split()[-1] if kind.strip() else ""


def _members(text: str, code: str, at: int, end: int) -> Iterator[tuple[list, str, int, int]]:
    """(annotations, header, start, end) of each member between braces."""
    while at < end:
        annotations, at = _annotations(text, code, at, end)
        start = at
        while at < end and code[at] not in ";{}=":
            at = _close(code, at) if code[at] == "(" else at + 1
        header = code[start:at].strip()
        if at < end and code[at] == "=":
            while at < end and code[at] != ";":
                at = _close(code, at, code[at], {"(": ")", "{": "}"}[code[at]]) if code[at] in "({" else at + 1
        stop = _close(code, at, "{", "}") if at < end and code[at] == "{" else at + 1
        if header:
            yield annotations, header, start, stop
        at = max(stop, at + 1)


def scan(text: str) -> Iterator[dict]:
    """Tagged rows of one compilation unit."""
    code = blank(text)
    package = (_PACKAGE.search(code) or [None, ""])[1]
    imports = {m[2].rsplit(".", 1)[-1]: m[2] for m in _IMPORT.finditer(code) if not m[1]}
    yield from _types(text, code, 0, len(code), package, imports, "")


def _types(text: str, code: str, at: int, end: int, package: str, imports: dict[str, str], outer: str) -> Iterator[dict]:
    line = lambda k: code.count("\n", 0, k) + 1
    for annotations, header, start, stop in _members(text, code, at, end):
        m = _TYPE.search(header)
        if not m or "(" in header[: m.start()]:
            continue
        simple = f"{outer}${m[2]}" if outer else m[2]
        fqn = f"{package.replace('.', '/')}/{simple}" if package else simple
        plain = header
        while (fewer := _GENERIC.sub("", plain)) != plain:
            plain = fewer
        above = re.search(r"\bextends\s+([\w.,\s]+?)(?=\bimplements\b|\bpermits\b|$)", plain)
        held = re.search(r"\bimplements\s+([\w.,\s]+?)(?=\bpermits\b|$)", plain)
        interfaces = [x.strip() for x in (held[1] if held else above[1] if above and m[1] == "interface" else "").split(",") if x.strip()]
        yield {"tag": "type", "fqn": fqn, "kind": m[1], "types": [resolve(x, imports, package) for x in interfaces], "line": line(start)}
        configuration = any(matches(n, [STEREOTYPES[-1]]) for n, _ in annotations)
        for n, a in annotations:
            if matches(n, STEREOTYPES):
                yield {"tag": "bean", "fqn": fqn, "name": literal(a.get("value")) or m[2][0].lower() + m[2][1:], "type": fqn, "line": line(start)}
            if matches(n, SERVICES, True):
                # the first interface as it is written; without one the class itself
                of = resolve(interfaces[0], imports, package) if interfaces else fqn
                yield {"tag": "service", "fqn": fqn, "type": of, "group": literal(a.get("group")) or "", "version": literal(a.get("version")) or ""}
        brace = code.find("{", start)
        if brace < 0 or brace >= stop:
            continue
        yield from _inside(text, code, brace + 1, stop - 1, fqn, package, imports, configuration)
        yield from _types(text, code, brace + 1, stop - 1, package, imports, simple)


def _inside(text: str, code: str, at: int, end: int, fqn: str, package: str, imports: dict[str, str], configuration: bool) -> Iterator[dict]:
    line = lambda k: code.count("\n", 0, k) + 1
    for annotations, header, start, stop in _members(text, code, at, end):
        if _TYPE.search(header.split("(")[0]):
            continue
        wired = any(matches(n, WIRING) for n, _ in annotations)
        qualifier = next((literal(a.get("value")) for n, a in annotations if matches(n, [QUALIFIER])), None)
        called = re.match(r"(?:<[^()]*?>\s*)?(?:([\w.<>\[\],?&\s]+?)\s+)?(\w+)\s*\((.*)\)", header, re.S)
        if called:
            kind, name, parameters = called[1], called[2], _parameters(text, code, start, header)
            erased = [resolve(t, imports, package) + "[]" * t.count("[]") for _, t, _ in parameters]
            yield {"tag": "method", "fqn": fqn, "name": name, "types": erased, "line": line(start), "end_line": line(stop - 1)}
            for n, a in annotations:
                short = n.rsplit(".", 1)[-1]
                if configuration and matches(n, [BEAN]) and kind:
                    given = literal(a.get("value")) or literal(a.get("name"))
                    yield {"tag": "bean", "fqn": fqn, "name": given or name, "type": resolve(kind, imports, package), "method": name, "line": line(start)}
                if short in STATEMENTS and (sql := literal(a.get("value"))) is not None:
                    yield {"tag": "statement", "fqn": fqn, "name": name, "kind": STATEMENTS[short], "template": sql, "line": line(start)}
                if short in PROVIDERS:
                    provider = re.sub(r"\.class\s*$", "", a.get("type") or a.get("value") or "")
                    yield {"tag": "statement", "fqn": fqn, "name": name, "kind": PROVIDERS[short], "template": "", "provider": resolve(provider, imports, package) if provider else "", "provider_method": literal(a.get("method")) or "", "line": line(start)}
            if wired and kind:
                for own, t, p in parameters:
                    mine = next((literal(a.get("value")) for n, a in own if matches(n, [QUALIFIER])), None)
                    yield {"tag": "inject", "fqn": fqn, "name": p, "type": resolve(t, imports, package), "qualifier": mine, "line": line(start)}
            continue
        parts = header.split()
        if len(parts) >= 2:
            kind, name = " ".join(parts[:-1]), parts[-1]
            if wired:
                yield {"tag": "inject", "fqn": fqn, "name": name, "type": resolve(kind, imports, package), "qualifier": qualifier, "line": line(start)}
            for n, a in annotations:
                if matches(n, REFERENCES, True):
                    yield {"tag": "reference", "fqn": fqn, "name": name, "type": resolve(kind, imports, package), "group": literal(a.get("group")) or "", "version": literal(a.get("version")) or "", "line": line(start)}


def _parameters(text: str, code: str, start: int, header: str) -> list[tuple[list, str, str]]:
    """(annotations, type, name) of each parameter."""
    open_ = code.index("(", start)
    close = _close(code, open_) - 1
    out, depth, at = [], 0, open_ + 1
    cuts = []
    for k in range(open_ + 1, close + 1):
        depth += (code[k] in "(<{") - (code[k] in ")>}" and k < close)
        if k == close or (code[k] == "," and not depth):
            cuts.append((at, k))
            at = k + 1
    for a, b in cuts:
        own, k = _annotations(text, code, a, b)
        words = code[k:b].split()
        if len(words) >= 2:
            out.append((own, " ".join(words[:-1]), words[-1]))
    return out


_ROW = "tag string, source_file string, fqn string, name string, kind string, type string, types array<string>, qualifier string, method string, group string, version string, template string, provider string, provider_method string, line int, end_line int"
_ROW_ARROW = pa.schema([(n, pa.list_(pa.string()) if t == "array<string>" else pa.int32() if t == "int" else pa.string()) for n, t in (c.split() for c in _ROW.split(", "))])


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows: list[dict] = []
        for source, text in zip(b.column("source_file").to_pylist(), b.column("text").to_pylist()):
            rows += ({"source_file": source, **r} for r in scan(text or ""))
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ROW_ARROW)


def extract(files: DataFrame) -> DataFrame:
    """files(source_file, text) to tagged rows."""
    return files.select("source_file", "text").mapInArrow(_run, _ROW)


def tables(rows: DataFrame) -> dict[str, DataFrame]:
    of = lambda tag: rows.where(F.col("tag") == tag)
    return {
        "types": of("type").select("fqn", "kind", F.col("types").alias("interfaces"), "line"),
        "spring_beans": of("bean").select("name", F.col("type").alias("type_fqn"), F.lit("annotation").alias("source"), F.col("fqn").alias("declared_in"), F.lit("singleton").alias("scope")),
        "sites": of("inject").select(F.col("fqn").alias("owner"), F.col("name").alias("field_or_param"), F.col("type").alias("type_fqn"), "qualifier"),
        "dubbo_services": of("service").select(F.col("type").alias("interface_fqn"), F.col("fqn").alias("impl_fqn"), F.col("group").alias("group_name"), F.col("version").alias("service_version"), F.lit("annotation").alias("source")),
        "dubbo_references": of("reference").select(F.col("type").alias("interface_fqn"), F.col("fqn").alias("owner"), "name", F.col("group").alias("group_name"), F.col("version").alias("service_version")),
        "mybatis_statements": of("statement").select(F.translate("fqn", "/", ".").alias("mapper_namespace"), F.col("name").alias("statement_id"), "kind", F.col("template").alias("sql_template"), F.col("source_file").alias("defined_in_file"), F.col("line").alias("line_no"), F.coalesce("provider", F.lit("")).alias("provider_class"), F.coalesce("provider_method", F.lit("")).alias("provider_method")),
        "method_lines": of("method").select("fqn", "name", F.col("types").alias("parameter_types"), F.col("line").alias("start_line"), "end_line"),
    }


def attribute_lines(methods: DataFrame, lines: DataFrame) -> DataFrame:
    """methods(fqn, name, parameter_types, ...) with the lines of their sources, matched by name and simple parameter types."""
    simple = lambda c: F.transform(c, lambda t: F.regexp_extract(F.translate(t, "/$", ".."), r"([^.]*)$", 1))
    found = lines.select("fqn", "name", simple(F.col("parameter_types")).alias("_p"), F.col("start_line").alias("_s"), F.col("end_line").alias("_e")).dropDuplicates(["fqn", "name", "_p"])
    joined = methods.withColumn("_p", simple(F.col("parameter_types"))).join(found, ["fqn", "name", "_p"], "left")
    return joined.withColumn("start_line", F.coalesce("_s", "start_line")).withColumn("end_line", F.coalesce("_e", "end_line")).drop("_p", "_s", "_e")
