"""Symbols, descriptors and signatures as columns. Row ids C1 to C12 and C20 of the survey."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F

#: fixed values: descriptor letters and the types they stand for
PRIMITIVES = {"B": "byte", "C": "char", "D": "double", "F": "float", "I": "int", "J": "long", "S": "short", "Z": "boolean", "V": "void"}
#: fixed values: method handle kinds by their number
HANDLES = {1: "getField", 2: "getStatic", 3: "putField", 4: "putStatic", 5: "invokeVirtual", 6: "invokeStatic", 7: "invokeSpecial", 8: "newInvokeSpecial", 9: "invokeInterface"}
#: fixed values: confidence and its weight, heavier is surer
CONFIDENCE = {"CERTAIN": 3, "PROBABLE": 2, "UNCERTAIN": 1}


def from_dotted(c: Column) -> Column:
    """A name with a slash stays, else dots become slashes; empty gives null."""
    return F.when(F.contains(c, F.lit("/")), c).when(c != "", F.translate(c, ".", "/"))


def dotted(c: Column) -> Column:
    """C2."""
    return F.translate(c, "/", ".")


def slashed(c: Column) -> Column:
    """C2."""
    return F.translate(c, ".", "/")


def binary_name(c: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(c, "/", -1)


def package_name(c: Column) -> Column:
    """C4: what stands before the last slash, dotted; empty without one."""
    return F.translate(F.regexp_extract(c, "^(.*)/[^/]*$", 1), "/", ".")


def in_package(c: Column, package: Column) -> Column:
    """At a slash boundary or equal; the empty package holds all."""
    p = slashed(package)
    return (p == "") | (c == p) | F.startswith(c, F.concat(p, F.lit("/")))


def method_key(name: Column, desc: Column) -> Column:
    """C6."""
    return F.concat(name, desc)


def dashed(owner: Column, name: Column, desc: Column) -> Column:
    """C6, O10."""
    return F.concat(owner, F.lit("#"), name, desc)


def symbol_text(kind: Column, fqn: Column, member: Column, desc: Column) -> Column:
    """The four forms CLASS, METHOD, FIELD, PACKAGE."""
    return (
        F.when(kind == "CLASS", fqn)
        .when(kind == "METHOD", F.concat(fqn, F.lit("#"), member, desc))
        .when(kind == "FIELD", F.concat(fqn, F.lit("."), member))
        .when(kind == "PACKAGE", F.concat(F.lit("pkg:"), fqn))
    )


def readable(d: Column, strict: bool = False) -> Column:
    """A type descriptor as source text. What is no descriptor gives null, with ``strict`` an error."""
    dims = F.length(F.regexp_extract(d, r"^(\[*)", 1))
    base = F.substring(d, dims + 1, F.length(d))
    kind = F.create_map(*(F.lit(x) for kv in PRIMITIVES.items() for x in kv))
    name = F.when(F.startswith(base, F.lit("L")) & F.endswith(base, F.lit(";")), dotted(F.substring(base, F.lit(2), F.length(base) - 2))).when(F.length(base) == 1, kind[base])
    out = F.concat(name, F.repeat(F.lit("[]"), dims))
    return F.coalesce(out, F.raise_error(F.concat(F.lit("not a descriptor: "), d))) if strict else out


def return_type(desc: Column) -> Column:
    """C8."""
    return readable(F.substring_index(desc, ")", -1))


def parameter_types(desc: Column) -> Column:
    """Arrays of any dimension stay one parameter."""
    inner = F.regexp_extract(desc, r"^\((.*)\)", 1)
    return F.transform(F.regexp_extract_all(inner, F.lit(r"(\[*(?:L[^;]+;|[ZBCSIJFD]))"), 1), lambda x: readable(x))


def argument_count(desc: Column) -> Column:
    """C10."""
    return F.size(parameter_types(desc))


def internal_to_dotted(c: Column) -> Column:
    """C9."""
    return dotted(F.regexp_replace(c, "^L(.*);$", "$1"))


def encode_interfaces(names: Column) -> Column:
    """``,a,b,``; empty text for none."""
    return F.when(F.size(names) > 0, F.concat(F.lit(","), F.array_join(names, ","), F.lit(","))).otherwise(F.lit(""))


def decode_interfaces(text: Column) -> Column:
    """C12."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), ","), lambda x: x != "")


def confidence_weight(c: Column) -> Column:
    weights = F.create_map(*(F.lit(x) for kv in CONFIDENCE.items() for x in kv))
    return F.coalesce(weights[c], F.lit(0))


def heavier(a: Column, b: Column) -> Column:
    """The surer of two confidences; the first of equals."""
    return F.when(confidence_weight(a) >= confidence_weight(b), a).otherwise(b)


def is_lambda_site(owner: Column, name: Column) -> Column:
    """C20."""
    return (owner == "java/lang/invoke/LambdaMetafactory") & name.isin("metafactory", "altMetafactory")


def synthetic_name(owner: Column, name: Column) -> Column:
    """C20."""
    return F.concat(owner, F.lit("."), name)


def describe_handle(owner: Column, name: Column, desc: Column, tag: Column) -> Column:
    """C20."""
    kinds = F.create_map(*(F.lit(x) for kv in HANDLES.items() for x in kv))
    return F.concat(owner, F.lit("#"), name, desc, F.lit(":"), F.coalesce(kinds[tag], F.concat(F.lit("tag="), tag.cast("string"))))


# ---- C11: generic signatures ---------------------------------------------------------------------------------------


class _Signature:
    """Reads one generic signature and writes its class types flat: label=type, [wildcard argument]."""

    def __init__(self, text: str) -> None:
        self.text, self.at, self.out = text, 0, ""

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self, stop: str) -> str:
        start = self.at
        while self.peek() and self.peek() not in stop:
            self.at += 1
        if not self.peek():
            raise ValueError(self.text)
        return self.text[start : self.at]

    def formals(self) -> None:
        if self.peek() != "<":
            return
        self.at += 1
        while self.peek() != ">":
            self.out += self.take(":")
            while self.peek() == ":":
                self.at += 1
                if self.peek() != ":":
                    self.type(None)
        self.at += 1

    def type(self, label: str | None, wildcard: str | None = None) -> None:
        """label None writes nothing; a wildcard marks an argument."""
        while self.peek() == "[":
            self.at += 1
        c = self.peek()
        self.at += 1
        if c == "T":
            self.take(";")
            self.at += 1
        elif c == "L":
            name = self.take("<;.").replace("/", ".")
            if label is not None:
                mark = {"+": "? extends ", "-": "? super "}.get(wildcard or "", "")
                self.out += ("," if self.out else "") + (f"[{mark}{name}]" if wildcard else f"{label}={name}")
            while True:
                if self.peek() == "<":
                    self.at += 1
                    while self.peek() != ">":
                        if self.peek() == "*":
                            self.at += 1
                        elif self.peek() in "+-":
                            self.at += 1
                            # arguments of an argument keep the outer mark
                            self.type(label, wildcard or self.text[self.at - 1])
                        else:
                            self.type(label, wildcard or "=")
                    self.at += 1
                elif self.peek() == ".":
                    self.at += 1
                    self.take("<;.")
                else:
                    break
            if self.peek() != ";":
                raise ValueError(self.text)
            self.at += 1
        elif c not in PRIMITIVES:
            raise ValueError(self.text)


def decode_signature(text: str | None, kind: str) -> str | None:
    """kind: class, method or field. Null passes through; an unreadable signature gives null."""
    if text is None:
        return None
    s = _Signature(text)
    try:
        if kind == "field":
            s.type("field")
        elif kind == "class":
            s.formals()
            s.type("super")
            while s.peek():
                s.type("interface")
        else:
            s.formals()
            if s.peek() != "(":
                raise ValueError(text)
            s.at += 1
            while s.peek() != ")":
                s.type("param")
            s.at += 1
            s.type("returns")
    except ValueError:
        return None
    return s.out


def signature_decoder(kind: str):
    """C11 as a vectorised function of a column."""

    @F.pandas_udf("string")
    def decode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield t.map(lambda x: decode_signature(x, kind))

    return decode
