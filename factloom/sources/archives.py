"""Archives as tables. Rows S1 to S5, S15, K20 of the survey.

Archives are listed by Spark's binary file source and opened inside tasks, one archive a row, so a corpus of archives
is read in parallel. Entries leave the task one by one; an unreadable archive gives an issue row instead of failing
the job.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: fixed values: keys of factories files that are read
FACTORY_KEYS = [
    "org.springframework.boot.autoconfigure.EnableAutoConfiguration",
    "org.springframework.context.ApplicationListener",
    "org.springframework.context.ApplicationContextInitializer",
    "org.springframework.web.servlet.HandlerAdapter",
    "org.springframework.web.servlet.HandlerResolver",
    "org.springframework.boot.env.EnvironmentPostProcessor",
    "org.springframework.boot.diagnostics.FailureAnalyzer",
    "org.springframework.boot.autoconfigure.template.TemplateAvailabilityProvider",
    "org.springframework.boot.actuate.autoconfigure.endpoint.EndpointAutoConfiguration",
]
FACTORIES = "META-INF/spring.factories"
IMPORTS = re.compile(r"^META-INF/spring/.*\.imports$")

_ENTRIES = "archive string, position int, entry string, content binary, problem string"
_ENTRIES_ARROW = pa.schema([("archive", pa.string()), ("position", pa.int32()), ("entry", pa.string()), ("content", pa.binary()), ("problem", pa.string())])


def archives(spark: SparkSession, *paths: str) -> DataFrame:
    """path, content of each archive file."""
    return spark.read.format("binaryFile").load(list(paths)).select("path", "modificationTime", "length", "content")


def _read(pattern: str, with_content: bool):
    wanted = re.compile(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content")):
                rows, size = [], 0
                try:
                    with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                        for k, info in enumerate(z.infolist()):
                            if info.is_dir() or not wanted.search(info.filename):
                                continue
                            try:
                                data, problem = (z.read(info) if with_content else None), None
                            except (zipfile.BadZipFile, OSError, NotImplementedError, RuntimeError, EOFError) as e:
                                data, problem = None, f"{type(e).__name__}: {e}"
                            rows.append((path, k, info.filename, data, problem))
                            size += len(data or b"")
                            if size > 8_000_000:
                                yield _batch(rows)
                                rows, size = [], 0
                except (zipfile.BadZipFile, OSError, ValueError) as e:
                    rows.append((path, -1, None, None, f"{type(e).__name__}: {e}"))
                if rows:
                    yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _ENTRIES_ARROW.types)], schema=_ENTRIES_ARROW)


def entries(files: DataFrame, pattern: str = "", with_content: bool = True) -> DataFrame:
    """archive, position, entry, content, problem of entries whose name matches; unreadable archives give a row with a problem."""
    return files.select("path", "content").mapInArrow(_read(pattern, with_content), _ENTRIES)


def class_list(files: DataFrame) -> DataFrame:
    """Archive, position, fqn (slashed) in archive order; no directories, no module-info."""
    listed = entries(files, r"\.class$", False).where("entry IS NOT NULL AND NOT endswith(entry, 'module-info.class')")
    return listed.select("archive", "position", F.expr("substring(entry, 1, length(entry) - 6)").alias("fqn"))


def class_bytes(files: DataFrame) -> DataFrame:
    """Archive, position, fqn, content."""
    read = entries(files, r"(?<!module-info)\.class$").where("entry IS NOT NULL")
    return read.select("archive", "position", F.expr("substring(entry, 1, length(entry) - 6)").alias("fqn"), "content", "problem")


def missing_bytes(wanted: DataFrame, read: DataFrame) -> DataFrame:
    """Issues of classes (archive, fqn) that can't be read."""
    gone = wanted.select("archive", "fqn").join(read.where("content IS NOT NULL").select("archive", "fqn"), ["archive", "fqn"], "left_anti")
    return gone.select(F.lit("class_read").alias("kind"), F.col("fqn").alias("target"), F.concat(F.lit("not readable in "), F.col("archive")).alias("message"), F.lit("WARN").alias("severity"))


def sources(files: DataFrame) -> DataFrame:
    """S3: fqn, text of the Java files of source archives; the first archive by path wins."""
    read = entries(files, r"\.java$").where("content IS NOT NULL")
    named = read.select("archive", F.regexp_replace("entry", r"\.java$", "").alias("fqn"), F.decode("content", "UTF-8").alias("text"))
    return named.groupBy("fqn").agg(F.min_by("text", "archive").alias("text"))


def loose_sources(spark: SparkSession, *paths: str) -> DataFrame:
    """S3: path, text of source files outside archives."""
    return spark.read.text(list(paths), wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def _lines(text: Column) -> Column:
    cut = F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"#.*$", "")))
    return F.filter(cut, lambda x: x != "")


def meta_inf(files: DataFrame) -> DataFrame:
    """Archive, entry of everything below META-INF."""
    return entries(files, r"^META-INF/.", False).where("entry IS NOT NULL").select("archive", "entry")


def service_providers(files: DataFrame) -> DataFrame:
    """Archive, service, provider."""
    read = entries(files, r"^META-INF/services/[^/]+$").where("content IS NOT NULL")
    return read.select("archive", F.substring_index("entry", "/", -1).alias("service"), F.explode(_lines(F.decode("content", "UTF-8"))).alias("provider"))


def factory_rows(text: Column) -> Column:
    """Pairs (key, value) of a factories text: continued lines joined, values parted by commas."""
    joined = F.regexp_replace(text, r"\\[ \t]*\r?\n[ \t]*", "")
    lines = F.filter(F.transform(F.split(joined, r"\r?\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~F.startswith(x, F.lit("#")) & ~F.startswith(x, F.lit("!")))
    # key and values are parted by the first = or :, escapes are rare enough in class names to be left
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([^=:]+)[=:]", 1)).alias("key"), F.split(F.regexp_extract(x, r"^[^=:]+[=:](.*)$", 1), ",").alias("values")))
    return F.flatten(F.transform(pairs, lambda p: F.transform(F.filter(F.transform(p["values"], lambda x: F.trim(x)), lambda v: v != ""), lambda v: F.struct(p["key"].alias("key"), v.alias("value")))))


def autoconfigs(files: DataFrame) -> DataFrame:
    """class_fqn, source_file, source_format, key from factories (known keys only) and imports files; one row each."""
    read = entries(files, r"^META-INF/(?:spring\.factories|spring/.*\.imports)$").where("content IS NOT NULL").withColumn("text", F.decode("content", "UTF-8"))
    place = F.concat("archive", F.lit("!"), F.col("entry")).alias("source_file")
    made = read.where(F.col("entry") == FACTORIES).select(place, F.explode(factory_rows(F.col("text"))).alias("p")).where(F.col("p.key").isin(FACTORY_KEYS))
    factories = made.select(F.col("p.value").alias("class_fqn"), "source_file", F.lit("factories").alias("source_format"), F.col("p.key").alias("key"))
    key = F.regexp_replace(F.substring_index("entry", "/", -1), r"\.imports$", "").alias("key")
    imports = read.where(F.col("entry") != FACTORIES).select(F.explode(_lines(F.col("text"))).alias("class_fqn"), place, F.lit("imports").alias("source_format"), key)
    return factories.unionByName(imports).distinct()


def content_addressed(files: DataFrame, root: str) -> DataFrame:
    """Path, sha256, cached_path of each archive."""
    sha = F.sha2("content", 256)
    return files.select("path", sha.alias("sha256"), F.concat(F.lit(root.rstrip("/") + "/"), sha, F.lit(".jar")).alias("cached_path"), "length")


def discovered(headers: DataFrame) -> DataFrame:
    """Kinds of classes from their access flags: headers(fqn, super_fqn, access)."""
    bit = lambda n: F.col("access").bitwiseAND(F.lit(n)) != 0
    return headers.select(
        "fqn", "access", "super_fqn", bit(0x200).alias("is_interface"), bit(0x2000).alias("is_annotation"), bit(0x4000).alias("is_enum"), F.col("super_fqn").eqNullSafe("java/lang/Record").alias("is_record"), F.lit(False).alias("is_sealed")
    )


def loose_classes(spark: SparkSession, root: str) -> DataFrame:
    """Archive (the folder), position, fqn, content, problem of class files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.class").load(root)
    tail = F.regexp_replace("path", "^.*" + re.escape(root.rstrip("/")) + "/", "")
    named = files.select(F.lit(root).alias("archive"), F.lit(0).alias("position"), F.regexp_replace(tail, r"\.class$", "").alias("fqn"), "content", F.lit(None).cast("string").alias("problem"))
    return named.where("NOT endswith(fqn, 'module-info')")
