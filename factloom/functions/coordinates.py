"""Artifact coordinates and versions as columns. Row ids C13 to C16 of the survey, L2 and S11."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def coordinate(c: Column) -> Column:
    """Group, artifact, version of ``group:artifact:version``; the rest after the second colon is version, null without two colons."""
    parts = F.split(c, ":", 3)
    return F.when(F.size(parts) == 3, F.struct(parts[0].alias("group"), parts[1].alias("artifact"), parts[2].alias("version")))


def coordinate_text(group: Column, artifact: Column, version: Column) -> Column:
    return F.concat_ws(":", group, artifact, version)


def coordinate_path(root: Column, group: Column, artifact: Column, version: Column) -> Column:
    return F.concat_ws("/", root, F.translate(group, ".", "/"), artifact, version)


def relative_path(group: Column, artifact: Column, version: Column, extension: str = "jar") -> Column:
    """Place of a file in a remote repository."""
    return F.concat(F.translate(group, ".", "/"), F.lit("/"), artifact, F.lit("/"), version, F.lit("/"), artifact, F.lit("-"), version, F.lit(f".{extension}"))


def version_key(v: Column) -> Column:
    """C14: major, minor, patch as numbers; what follows a dash is dropped, what is no number counts as 0."""
    parts = F.split(F.substring_index(v, "-", 1), r"\.")
    number = lambda k: F.coalesce(F.get(parts, F.lit(k)).try_cast("int"), F.lit(0))
    return F.struct(number(0).alias("major"), number(1).alias("minor"), number(2).alias("patch"))


def higher_version(a: Column, b: Column) -> Column:
    """C14: the first of equals."""
    return F.when(version_key(a) >= version_key(b), a).otherwise(b)


def coordinate_from_path(path: Column) -> Column:
    """From a jar's file name; the last dash before a version parts name and version, else local:name:0.0.0."""
    name = F.regexp_replace(F.substring_index(path, "/", -1), r"\.jar$", "")
    # the greedy prefix finds the last dash whose rest is a version by itself
    before = F.regexp_extract(name, r"^(.*)-(\d+(?:\.\d+)*(?:[.-].*)?)$", 1)
    version = F.regexp_extract(name, r"^(.*)-(\d+(?:\.\d+)*(?:[.-].*)?)$", 2)
    return F.when(version == "", F.concat(F.lit("local:"), name, F.lit(":0.0.0"))).otherwise(F.concat_ws(":", before, before, version))


def method_reference(c: Column) -> Column:
    """Owner, name, desc of ``owner#name(desc)``, null where it is none."""
    owner, rest = F.regexp_extract(c, r"^([^#]*)#", 1), F.regexp_extract(c, r"^[^#]*#(.*)$", 1)
    name, desc = F.substring_index(rest, "(", 1), F.regexp_extract(rest, r"(\(.*)$", 1)
    return F.when(F.contains(c, F.lit("#")) & (desc != ""), F.struct(owner.alias("owner"), name.alias("name"), desc.alias("desc")))


def looks_like_coordinate(c: Column) -> Column:
    """C16."""
    return F.size(F.split(c, ":")) >= 3


def database_url(c: Column) -> Column:
    """C16."""
    memory = F.lit("jdbc:sqlite::memory:")
    prefixed = F.startswith(c, F.lit("sqlite:")) | F.startswith(c, F.lit("postgres:"))
    return F.when(c.isNull() | (c == ":memory:"), memory).when(prefixed, F.concat(F.lit("jdbc:"), c)).otherwise(c)
