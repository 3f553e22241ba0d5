"""Where tables live: directories named by numbered pointers, JDBC tables, tagged rows. Rows S16, K21 of the survey and D15."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom import schema
from factloom.operators import maintain
from factloom.session import write_shared


_NUMBER = re.compile(r"v(\d{10})")


class Store:
    """A Parquet directory for each table and version. Small numbered files name the directories; the greatest number counts
    and none is ever replaced, so a writer that dies at any step leaves readers on the version before, and of two writers
    that began on the same version the second fails. Works on any file system Hadoop knows whose files are made at once."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _listed(self, name: str) -> tuple[list[int], list[str]]:
        """Numbers of the pointer files, in order, and the directories."""
        folder = self._path(f"{self.root}/{name}")
        if not self._fs.exists(folder):
            return [], []
        held = [(s.getPath().getName(), s.isDirectory()) for s in self._fs.listStatus(folder)]
        return sorted(int(m[1]) for n, d in held if not d and (m := _NUMBER.fullmatch(n))), [n for n, d in held if d]

    def _pointer(self, name: str, number: int) -> str:
        return f"{self.root}/{name}/v{number:010}"

    def _directory(self, name: str, number: int) -> str:
        stream = self._fs.open(self._path(self._pointer(name, number)))
        try:
            return bytes(b & 0xFF for b in iter(stream.read, -1)).decode()
        finally:
            stream.close()

    def version(self, name: str) -> int:
        """The number of the version that counts, 0 without one."""
        return (self._listed(name)[0] or [0])[-1]

    def read(self, name: str) -> DataFrame:
        """The table, empty where nothing was ever written."""
        numbers, directories = self._listed(name)
        if not numbers:
            if any(self._fs.exists(self._path(f"{self.root}/{name}/{d}/_SUCCESS")) for d in directories):
                raise RuntimeError(f"{self.root}/{name} holds data but no version")
            return schema.empty(self.spark, name)
        return self.spark.read.schema(schema.TABLES[name].schema).parquet(f"{self.root}/{name}/{self._directory(name, numbers[-1])}")

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.read(name) for name in schema.TABLES}

    def write(self, name: str, df: DataFrame, sort: Iterable[str] = (), expected: int | None = None) -> None:
        """Replaces the table. ``sort`` clusters files, so filters on those columns skip row groups. ``expected`` is the
        version the rows were made from; the write fails if there is a later one."""
        number = self.version(name) if expected is None else expected
        new = uuid.uuid4().hex
        out = schema.conform(df, name)
        (out.sortWithinPartitions(*sort) if sort else out).write.parquet(f"{self.root}/{name}/{new}")
        self._point(name, number + 1, new)
        self._sweep(name, number)

    def _point(self, name: str, number: int, directory: str) -> None:
        temporary = self._path(f"{self._pointer(name, number)}.{directory}.tmp")
        stream = self._fs.create(temporary, True)
        stream.write(bytearray(directory.encode()))
        stream.close()
        target = self._path(self._pointer(name, number))
        # renaming onto a file that exists fails or, where it would replace it, is not tried
        if self._fs.exists(target) or not self._fs.rename(temporary, target):
            self._fs.delete(temporary, False)
            self._fs.delete(self._path(f"{self.root}/{name}/{directory}"), True)
            raise RuntimeError(f"{self.root}/{name} was written by another meanwhile")

    def _sweep(self, name: str, before: int) -> None:
        """The version before stays for readers that have begun on it; older ones go, their pointers first."""
        numbers, _ = self._listed(name)
        for k in numbers:
            if k < before:
                old = self._directory(name, k)
                self._fs.delete(self._path(self._pointer(name, k)), False)
                self._fs.delete(self._path(f"{self.root}/{name}/{old}"), True)

    def upsert(self, name: str, new: DataFrame, order: str | None = None) -> None:
        """K1 to K15."""
        rows = schema.conform(new, name)
        if schema.TABLES[name].key:
            rows = rows.withColumn("id", F.coalesce("id", schema.stable_id(*(F.col(c) for c in schema.TABLES[name].key))))
        if order:
            rows = rows.withColumn(order, F.col(order))
        version = self.version(name)
        self.write(name, maintain.upsert(self.read(name), rows, name, order), expected=version)

    def replace(self, name: str, new: DataFrame, owner: str) -> None:
        self.write(name, maintain.replace_owned(self.read(name), schema.conform(new, name), owner))

    def delete_classes(self, gone: DataFrame) -> None:
        """Classes by id, with all that hangs on them."""
        names = ["classes", "methods", "fields", "invokes", "lambdas", "spring_injects"]
        left = maintain.cascade({n: self.read(n) for n in names}, "classes", gone)
        for n in reversed(names):
            self.write(n, left[n])

    def migrate(self) -> None:
        """Every table exists and the history is written."""
        for name in schema.TABLES:
            if not self.version(name):
                self.write(name, schema.history(self.spark) if name == "schema_history" else schema.empty(self.spark, name))

    def rebuild(self) -> None:
        """Everything dropped, then made anew."""
        for name in schema.TABLES:
            self._fs.delete(self._path(f"{self.root}/{name}"), True)
        self.migrate()

    def drop(self) -> None:
        """Everything goes."""
        self._fs.delete(self._path(self.root), True)


def read_jdbc(spark: SparkSession, url: str, name: str, partition_column: str | None = None, bounds: tuple[int, int, int] | None = None, properties: Mapping[str, str] | None = None) -> DataFrame:
    """A table of a database, whole; read in parallel by ranges of a numeric column (lower, upper, parts)."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**dict(properties or {}))
    if partition_column and bounds:
        low, high, parts = bounds
        reader = reader.option("partitionColumn", partition_column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.load()


def write_jdbc(df: DataFrame, url: str, name: str, mode: str = "append", properties: Mapping[str, str] | None = None) -> None:
    """K14 into a database."""
    df.write.format("jdbc").option("url", url).option("dbtable", name).options(**dict(properties or {})).mode(mode).save()


def write_tagged(tagged: DataFrame, tag: str = "tag") -> str:
    """Rows of several tables in one pass to the shared folder, a directory for each tag; rows of a tag lie together within
    a task, so a task holds one open file at a time. Returns the path."""
    return write_shared(tagged.sortWithinPartitions(tag), parts=[tag])[0]


def read_tagged(spark: SparkSession, path: str, value: str, columns: str) -> DataFrame:
    """One of them; only its directory is read, and one without rows has none."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/tag={value}")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], columns)
    return spark.read.schema(columns).parquet(f"{path}/tag={value}")
