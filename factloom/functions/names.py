"""Class names as columns.

Stored names are slashed (``a/b/C$D``). ``class_ref`` reads a name as it occurs in referring columns: white
space trimmed, array marks dropped, the ``L...;`` wrapper removed, dots read as slashes. Null, empty text, ``?``
and primitive arrays refer to no class and give null.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: fixed values: white space that may surround a name, primitive descriptor letters, primitive type names
SPACES = " \t\n\r\f\x0b\u00a0"
PRIMITIVE_LETTERS = ["B", "C", "D", "F", "I", "J", "S", "Z"]
PRIMITIVE_NAMES = ["byte", "char", "double", "float", "int", "long", "short", "boolean"]


#: a name as it is stored; nearly all are, and these need no second look
PLAIN = r"^[^\s.\[\];?\u00a0]+$"


def class_ref(c: Column) -> Column:
    return F.when(c.rlike(PLAIN), c).otherwise(_respelled(c))


def _respelled(c: Column) -> Column:
    text = F.btrim(c, F.lit(SPACES))
    bare = F.rtrim(F.ltrim(text, F.lit("[")), F.lit("[]"))
    primitive = (F.startswith(text, F.lit("[")) & bare.isin(PRIMITIVE_LETTERS)) | (
        F.endswith(text, F.lit("]")) & bare.isin(PRIMITIVE_NAMES)
    )
    wrapped = F.startswith(bare, F.lit("L")) & F.endswith(bare, F.lit(";"))
    inner = F.when(wrapped, F.substring(bare, F.lit(2), F.length(bare) - 2)).otherwise(bare)
    name = F.translate(inner, ".", "/")
    return F.when(primitive | name.isin("", "?"), F.lit(None)).otherwise(name)


def class_ref_sql(c: str) -> str:
    """The same in DuckDB SQL."""
    spaces = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11) || chr(160)"
    text = f"trim({c}, {spaces})"
    bare = f"rtrim(ltrim({text}, '['), '[]')"
    letters = ", ".join(f"'{x}'" for x in PRIMITIVE_LETTERS)
    names = ", ".join(f"'{x}'" for x in PRIMITIVE_NAMES)
    inner = f"CASE WHEN {bare} LIKE 'L%;' THEN substr({bare}, 2, length({bare}) - 2) ELSE {bare} END"
    name = f"replace({inner}, '.', '/')"
    return (
        f"CASE WHEN ({text} LIKE '[%' AND {bare} IN ({letters})) OR ({text} LIKE '%]' AND {bare} IN ({names}))"
        f" OR {name} IN ('', '?') THEN NULL ELSE {name} END"
    )
