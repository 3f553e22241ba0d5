"""Class files to facts. Rows B1 to B4, B7, A6 and O11 of the survey.

A reader of the class file format (JVM specification, chapter 4) written against the bytes: constant pool, members,
code with its line numbers, bootstrap methods and visible annotations. It runs inside tasks on Arrow batches; one
class gives a handful of rows, told apart by a tag.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factloom.functions.symbols import HANDLES

#: fixed values: size of the operands of each opcode that has any, by the JVM specification
_OPERANDS = {0x10: 1, 0x11: 2, 0x12: 1, 0x13: 2, 0x14: 2, 0x84: 2, 0xA9: 1, 0xBC: 1, 0xC5: 3, 0xB9: 4, 0xBA: 4, 0xC8: 4, 0xC9: 4}
_OPERANDS |= dict.fromkeys([*range(0x15, 0x1A), *range(0x36, 0x3B)], 1)
_OPERANDS |= dict.fromkeys([*range(0x99, 0xA9), *range(0xB2, 0xB9), 0xBB, 0xBD, 0xC0, 0xC1, 0xC6, 0xC7], 2)
KINDS = {0xB6: "VIRTUAL", 0xB7: "SPECIAL", 0xB8: "STATIC", 0xB9: "INTERFACE"}

#: fixed values: conditions of auto-configurations by annotation
CONDITIONS = {
    "org/springframework/boot/autoconfigure/condition/ConditionalOnClass": "on_class",
    "org/springframework/boot/autoconfigure/condition/ConditionalOnMissingClass": "on_missing_class",
    "org/springframework/boot/autoconfigure/condition/ConditionalOnBean": "on_bean",
    "org/springframework/boot/autoconfigure/condition/ConditionalOnMissingBean": "on_missing_bean",
    "org/springframework/boot/autoconfigure/condition/ConditionalOnSingleCandidate": "on_single_candidate",
    "org/springframework/boot/autoconfigure/condition/ConditionalOnWebApplication": "on_web_app",
    "org/springframework/boot/autoconfigure/condition/ConditionalOnNotWebApplication": "on_not_web_app",
    "org/springframework/boot/autoconfigure/condition/ConditionalOnProperty": "on_property",
    "org/springframework/boot/autoconfigure/condition/ConditionalOnResource": "on_resource",
    "org/springframework/boot/autoconfigure/condition/ConditionalOnJava": "on_java",
}
BEAN = "org/springframework/context/annotation/Bean"
_LAMBDA = ("java/lang/invoke/LambdaMetafactory", {"metafactory", "altMetafactory"})


class Reader:
    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data, at

    def take(self, form: str):
        size = struct.calcsize(form)
        if self.at + size > len(self.data):
            raise ValueError("class file ends early")
        out = struct.unpack_from(form, self.data, self.at)
        self.at += size
        return out[0] if len(out) == 1 else out

    def u1(self) -> int:
        return self.take(">B")

    def u2(self) -> int:
        return self.take(">H")

    def u4(self) -> int:
        return self.take(">I")

    def raw(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("class file ends early")
        self.at += n
        return self.data[self.at - n : self.at]


def _utf(raw: bytes) -> str:
    """Modified UTF-8: zero as two bytes, supplementary characters as surrogate pairs."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        text = raw.replace(b"\xc0\x80", b"\0").decode("utf-8", "surrogatepass")
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


class Pool:
    def __init__(self, r: Reader) -> None:
        self.items: list[tuple | None] = [None]
        n = r.u2()
        while len(self.items) < n:
            tag = r.u1()
            if tag == 1:
                self.items.append((tag, _utf(r.raw(r.u2()))))
            elif tag in (3, 4):
                self.items.append((tag, r.raw(4)))
            elif tag in (5, 6):
                self.items += [(tag, r.raw(8)), None]
            elif tag in (7, 8, 16, 19, 20):
                self.items.append((tag, r.u2()))
            elif tag in (9, 10, 11, 12, 17, 18):
                self.items.append((tag, r.u2(), r.u2()))
            elif tag == 15:
                self.items.append((tag, r.u1(), r.u2()))
            else:
                raise ValueError(f"constant {tag}")

    def __getitem__(self, k: int) -> tuple:
        item = self.items[k] if 0 < k < len(self.items) else None
        if item is None:
            raise ValueError(f"no constant {k}")
        return item

    def text(self, k: int) -> str:
        return self[k][1]

    def name(self, k: int) -> str | None:
        """Name of a class constant."""
        return self.text(self[k][1]) if k else None

    def pair(self, k: int) -> tuple[str, str]:
        _, a, b = self[k]
        return self.text(a), self.text(b)

    def member(self, k: int) -> tuple[str, str, str]:
        """Owner, name and descriptor."""
        _, owner, pair = self[k]
        return self.name(owner), *self.pair(pair)

    def handle(self, k: int) -> tuple[int, str, str, str]:
        _, kind, ref = self[k]
        return kind, *self.member(ref)

    def string(self, k: int) -> str | None:
        item = self[k]
        return self.text(item[1]) if item[0] == 8 else None


@dataclass
class Method:
    name: str
    desc: str
    access: int
    signature: str | None = None
    start_line: int | None = None
    end_line: int | None = None
    calls: list[dict] = field(default_factory=list)
    lambdas: list[dict] = field(default_factory=list)
    annotations: list[tuple[str, dict]] = field(default_factory=list)


@dataclass
class ClassFacts:
    fqn: str
    super_fqn: str | None
    access: int
    interfaces: list[str]
    signature: str | None = None
    fields: list[dict] = field(default_factory=list)
    methods: list[Method] = field(default_factory=list)
    annotations: list[tuple[str, dict]] = field(default_factory=list)


def _element(r: Reader, pool: Pool):
    tag = chr(r.u1())
    if tag in "BCDFIJSZ":
        r.u2()
        return None
    if tag == "s":
        return "s", pool.text(r.u2())
    if tag == "c":
        return "c", pool.text(r.u2())
    if tag == "e":
        return "e", pool.text(r.u2()), pool.text(r.u2())
    if tag == "@":
        return "@", *_annotation(r, pool)
    if tag == "[":
        return "[", [_element(r, pool) for _ in range(r.u2())]
    raise ValueError(f"annotation value {tag}")


def _annotation(r: Reader, pool: Pool) -> tuple[str, dict]:
    kind = pool.text(r.u2())
    return kind[1:-1] if kind.startswith("L") else kind, {pool.text(r.u2()): _element(r, pool) for _ in range(r.u2())}


def _attributes(r: Reader, pool: Pool) -> Iterator[tuple[str, Reader]]:
    for _ in range(r.u2()):
        name, size = pool.text(r.u2()), r.u4()
        yield name, Reader(r.raw(size))


def _instructions(code: bytes) -> Iterator[tuple[int, int]]:
    """(position, opcode) of each instruction."""
    at = 0
    while at < len(code):
        op = code[at]
        yield at, op
        if op == 0xAA:
            pad = (at + 4) & ~3
            low, high = struct.unpack_from(">ii", code, pad + 4)
            at = pad + 12 + 4 * (high - low + 1)
        elif op == 0xAB:
            pad = (at + 4) & ~3
            at = pad + 8 + 8 * struct.unpack_from(">i", code, pad + 4)[0]
        elif op == 0xC4:
            at += 6 if code[at + 1] == 0x84 else 4
        else:
            at += 1 + _OPERANDS.get(op, 0)


def _call(owner: str, name: str, desc: str, kind: str, line: int | None, confidence: str) -> dict:
    return {"owner": owner, "name": name, "desc": desc, "kind": kind, "line": line, "confidence": confidence}


def _reflective(owner: str, name: str, desc: str, constant: str | None, line: int | None) -> dict | None:
    """A reflective call takes the place of the plain one."""
    if (owner, name) in (("java/lang/Class", "forName"), ("java/lang/ClassLoader", "loadClass")):
        if constant is not None:
            return _call(constant.replace(".", "/"), "<reflected>", "()V", "REFLECT", line, "PROBABLE")
        return _call("?", "?", "?", "REFLECT", line, "UNCERTAIN")
    if (owner, name) in (("java/lang/reflect/Method", "invoke"), ("java/lang/reflect/Constructor", "newInstance")):
        return _call("?", "?", "?", "REFLECT", line, "UNCERTAIN")
    return None


def _code(r: Reader, pool: Pool, method: Method, bootstraps: list[tuple[int, list[int]]]) -> None:
    r.u2(), r.u2()
    code = r.raw(r.u4())
    r.raw(8 * r.u2())
    lines: dict[int, int] = {}
    for name, a in _attributes(r, pool):
        if name == "LineNumberTable":
            for _ in range(a.u2()):
                at, line = a.u2(), a.u2()
                lines[at] = line
                # the first one seen begins the method, the largest ends it
                method.start_line = line if method.start_line is None else method.start_line
                method.end_line = max(method.end_line or 0, line)
    line, constant = None, None
    for at, op in _instructions(code):
        line = lines.get(at, line)
        if op in KINDS:
            owner, name, desc = pool.member(struct.unpack_from(">H", code, at + 1)[0])
            method.calls.append(_reflective(owner, name, desc, constant, line) or _call(owner, name, desc, KINDS[op], line, "CERTAIN"))
        elif op == 0xBA:
            _, index, _ = pool[struct.unpack_from(">H", code, at + 1)[0]]
            handle, arguments = bootstraps[index]
            _, owner, name, desc = pool.handle(handle)
            if owner == _LAMBDA[0] and name in _LAMBDA[1] and len(arguments) > 1 and pool[arguments[1]][0] == 15:
                tag, o, n, d = pool.handle(arguments[1])
                method.calls.append(_call(o, n, d, "DYNAMIC", line, "CERTAIN"))
                method.lambdas.append({"synthetic": f"{o}.{n}", "target": f"{o}#{n}{d}:{HANDLES.get(tag, f'tag={tag}')}", "line": line})
            else:
                method.calls.append(_call(owner, name, desc, "DYNAMIC", line, "PROBABLE"))
        # a constant counts for the call that follows it directly
        constant = pool.string(code[at + 1]) if op == 0x12 else pool.string(struct.unpack_from(">H", code, at + 1)[0]) if op == 0x13 else None


def _member(r: Reader, pool: Pool, bootstraps: list) -> Method:
    access, name, desc = r.u2(), pool.text(r.u2()), pool.text(r.u2())
    m = Method(name, desc, access)
    for kind, a in _attributes(r, pool):
        if kind == "Signature":
            m.signature = pool.text(a.u2())
        elif kind == "Code":
            m.calls.clear()
            _code(a, pool, m, bootstraps)
        elif kind == "RuntimeVisibleAnnotations":
            m.annotations = [_annotation(a, pool) for _ in range(a.u2())]
    return m


def parse(data: bytes) -> ClassFacts:
    """B1. Raises ValueError for what is no readable class file."""
    try:
        r = Reader(data)
        if r.u4() != 0xCAFEBABE:
            raise ValueError("no class file")
        r.u2(), r.u2()
        pool = Pool(r)
        access, this, above = r.u2(), pool.name(r.u2()), pool.name(r.u2())
        out = ClassFacts(this, above, access, [pool.name(r.u2()) for _ in range(r.u2())])
        members_at = r.at
        # bootstrap methods stand behind the members that need them
        for _ in range(2):
            for _ in range(r.u2()):
                r.raw(6)
                for _ in _attributes(r, pool):
                    pass
        bootstraps: list[tuple[int, list[int]]] = []
        for name, a in _attributes(r, pool):
            if name == "BootstrapMethods":
                bootstraps = [(a.u2(), [a.u2() for _ in range(a.u2())]) for _ in range(a.u2())]
            elif name == "Signature":
                out.signature = pool.text(a.u2())
            elif name == "RuntimeVisibleAnnotations":
                out.annotations = [_annotation(a, pool) for _ in range(a.u2())]
        r.at = members_at
        for _ in range(r.u2()):
            f = _member(r, pool, [])
            out.fields.append({"name": f.name, "desc": f.desc, "access": f.access, "signature": f.signature})
        out.methods = [_member(r, pool, bootstraps) for _ in range(r.u2())]
        return out
    except (struct.error, IndexError, TypeError) as e:
        raise ValueError(f"unreadable class file: {e}") from e


def conditions(facts: ClassFacts) -> Iterator[dict]:
    """One row for each value of a known condition, of the class or of its bean methods."""

    def values(v) -> Iterator[tuple[str, str]]:
        if v is None:
            return
        if v[0] == "[":
            for x in v[1]:
                yield from values(x)
        elif v[0] in "sc":
            yield v[0], v[1]

    def rows(annotations: list[tuple[str, dict]], applied: str) -> Iterator[dict]:
        for name, elements in annotations:
            kind = CONDITIONS.get(name)
            if kind is None:
                continue
            empty = {"condition_type": kind, "required_class": "", "required_bean_type": "", "required_property": "", "applied_to": applied}
            found = [x for v in elements.values() for x in values(v)]
            if not found:
                yield empty
            for tag, text in found:
                bean = kind in ("on_bean", "on_missing_bean", "on_single_candidate")
                if tag == "c" or kind in ("on_class", "on_missing_class") or bean:
                    plain = text[1:-1].replace("/", ".") if tag == "c" and text.startswith("L") else text
                    yield empty | {"required_bean_type" if bean else "required_class": plain}
                else:
                    yield empty | {"required_property": text}

    yield from rows(facts.annotations, "class")
    for m in facts.methods:
        if any(n == BEAN for n, _ in m.annotations):
            yield from rows(m.annotations, f"bean:{m.name}")


_FACT = (
    "tag string, archive string, fqn string, super_fqn string, access int, interfaces array<string>, signature string, name string, desc string, start_line int, end_line int,"
    " owner string, callee string, callee_desc string, kind string, line int, confidence string, synthetic string, target string,"
    " condition_type string, required_class string, required_bean_type string, required_property string, applied_to string, problem string"
)
_STRINGS, _INTS = pa.string(), pa.int32()
_FACT_ARROW = pa.schema([(n, pa.list_(pa.string()) if t == "array<string>" else _INTS if t == "int" else _STRINGS) for n, t in (c.split() for c in _FACT.split(", ") for c in [c.strip()])])


def fact_rows(archive: str | None, fqn: str | None, data: bytes | None) -> Iterator[dict]:
    """All facts of one class as tagged rows; a class that can't be read, or holds another name, gives an issue."""
    base = {"archive": archive, "fqn": fqn}
    try:
        facts = parse(data or b"")
        if fqn is not None and facts.fqn != fqn:
            raise ValueError(f"holds {facts.fqn}")
    except ValueError as e:
        yield base | {"tag": "issue", "problem": str(e)}
        return
    base["fqn"] = facts.fqn
    yield base | {"tag": "class", "super_fqn": facts.super_fqn, "access": facts.access, "interfaces": facts.interfaces, "signature": facts.signature}
    for f in facts.fields:
        yield base | {"tag": "field", **f}
    for m in facts.methods:
        at = base | {"name": m.name, "desc": m.desc}
        yield at | {"tag": "method", "access": m.access, "signature": m.signature, "start_line": m.start_line, "end_line": m.end_line}
        for c in m.calls:
            yield at | {"tag": "invoke", "owner": c["owner"], "callee": c["name"], "callee_desc": c["desc"], "kind": c["kind"], "line": c["line"], "confidence": c["confidence"]}
        for x in m.lambdas:
            yield at | {"tag": "lambda", **x}
    for c in conditions(facts):
        yield base | {"tag": "condition", **c}


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows: list[dict] = []
        for archive, fqn, data in zip(b.column("archive").to_pylist(), b.column("fqn").to_pylist(), b.column("content")):
            rows += fact_rows(archive, fqn, data.as_py())
            if len(rows) > 20_000:
                yield pa.RecordBatch.from_pylist(rows, schema=_FACT_ARROW)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_FACT_ARROW)


def extract(classes: DataFrame) -> DataFrame:
    """classes(archive, fqn, content) to tagged facts."""
    return classes.select("archive", "fqn", "content").mapInArrow(_run, _FACT)


def fact_tables(facts: DataFrame) -> dict[str, DataFrame]:
    """classes, methods, fields, invokes, lambdas, conditions, issues; members carry the name of their class, calls that of their method."""
    method = ["archive", "fqn", "name", "desc"]
    of = lambda tag, *columns: facts.where(F.col("tag") == tag).select(*columns)
    return {
        "classes": of("class", "archive", "fqn", "super_fqn", "access", "interfaces", F.col("signature").alias("signature_raw")),
        "methods": of("method", *method, "access", F.col("signature").alias("signature_raw"), "start_line", "end_line"),
        "fields": of("field", *method, "access", F.col("signature").alias("signature_raw")),
        "invokes": of("invoke", *method, F.col("owner").alias("callee_owner"), F.col("callee").alias("callee_name"), "callee_desc", "kind", "line", "confidence"),
        "lambdas": of("lambda", *method, F.col("synthetic").alias("synthetic_fqn"), F.col("target").alias("bsm_target"), "line"),
        "conditions": of("condition", F.col("fqn").alias("autoconfig_class"), "condition_type", "required_class", "required_bean_type", "required_property", "applied_to"),
        "issues": of("issue", F.lit("class_process").alias("kind"), F.col("fqn").alias("target"), F.col("problem").alias("message"), F.lit("WARN").alias("severity")),
    }
