"""SQL text, hashes and JSON columns. Row ids X8 to X11, F20, C17 to C19 of the survey."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: fixed values: annotation names that are too common to be taken by their short form
AMBIGUOUS = ["Service", "Reference"]


def normalise_sql(c: Column) -> Column:
    """Comments to blanks, white space collapsed, one closing semicolon dropped; placeholders stay."""
    bare = c
    for pattern in (r"<!--.*?-->", r"--.*?(\r?\n|$)", r"/\*.*?\*/"):
        bare = F.regexp_replace(bare, pattern, " ")
    flat = F.trim(F.regexp_replace(bare, r"\s+", " "))
    return F.when(F.endswith(flat, F.lit(";")), F.substring(flat, F.lit(1), F.length(flat) - 1)).otherwise(flat)


def parameter_names(c: Column) -> Column:
    """Placeholders in order; repeats that follow each other count once."""
    names = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[#$]\{([^}]+)\}"), 1), lambda x: F.trim(x))
    return F.filter(names, lambda x, i: (i == 0) | (x != F.get(names, i - 1)))


def statement_kind(c: Column) -> Column:
    """First word of a statement in capitals, where it is one of the four kinds."""
    return F.upper(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?i)^\s*(select|insert|update|delete)\b", 1))


def content_hash(c: Column) -> Column:
    """X10."""
    return F.sha2(c, 256)


def json_list(c: Column, element: str = "string") -> Column:
    """X11: blank, empty and malformed lists give an empty one."""
    return F.coalesce(F.from_json(c, f"array<{element}>"), F.array().cast(f"array<{element}>"))


def json_extract(c: Column, path: str) -> Column:
    """F20."""
    return F.get_json_object(c, path)


def default_bean_name(type_name: Column) -> Column:
    """C17: the simple name with its first letter in lower case."""
    simple = F.regexp_extract(type_name, r"([^./$]*)$", 1)
    return F.concat(F.lower(F.substring(simple, 1, 1)), F.substring(simple, F.lit(2), F.length(simple)))


def annotation_matches(name: Column, candidates: list[str], by_short_name: bool = True) -> Column:
    """Full name, trailing ``.Short``, and the short name unless it is ambiguous where that is asked for."""
    found = name.isin(candidates)
    for c in candidates:
        short = c.replace("/", ".").rsplit(".", 1)[-1]
        found = found | F.endswith(name, F.lit(f".{short}"))
        if by_short_name or short not in AMBIGUOUS:
            found = found | (name == short)
    return found


def resolve_type(name: Column, imported: Column, package: Column) -> Column:
    """A dotted name stays, else the single-type import of that simple name, else the current package."""
    own = F.when(package == "", name).otherwise(F.concat(package, F.lit("."), name))
    return F.translate(F.when(F.contains(name, F.lit(".")), name).otherwise(F.coalesce(imported, own)), ".", "/")
