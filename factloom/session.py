"""Session helpers shared by every operator."""

from __future__ import annotations

import contextlib
import os
import uuid
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession

#: folders of tables cut within a ``scratch`` block
_open: list[list[str]] = []


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by spark.checkpoint.dir. Only a session that runs on this machine alone, as in
    tests, may do without: its own temporary folder is taken. On a cluster that would lose data, so it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return os.path.join(os.environ.get("TMPDIR", "/tmp"), "factloom-shared")


def _remove(spark: SparkSession, path: str, on_exit: bool = False) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.deleteOnExit(p) if on_exit else fs.delete(p, True)


def write_shared(df: DataFrame, parts: Sequence[str] = (), **counted: Column) -> tuple[str, dict]:
    """Writes the rows once as a table in the shared folder: its path and the ``counted`` aggregates, taken while writing.
    ``parts`` are columns with a directory for each value. The table goes with the ``scratch`` block it is written in, else with the session."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/factloom-{uuid.uuid4().hex}"
    seen = Observation() if counted else None
    if seen is not None:
        df = df.observe(seen, *(c.alias(name) for name, c in counted.items()))
    df.write.partitionBy(*parts).parquet(path)
    _remove(spark, path, on_exit=True)
    if _open:
        _open[-1].append(path)
    return path, seen.get if seen is not None else {}


def read_shared(like: DataFrame, *paths: str) -> DataFrame:
    """Tables of one schema in one scan; it survives lost executors, and columns that aren't used aren't read."""
    return like.sparkSession.read.schema(like.schema).parquet(*paths)


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage through a table in the shared folder."""
    return read_shared(df, write_shared(df)[0])


def cut_counted(df: DataFrame, **counted: Column) -> tuple[DataFrame, dict]:
    """The same, with aggregates taken while writing."""
    path, counts = write_shared(df, **counted)
    return read_shared(df, path), counts


#: tables made once in a session: (application, name, place, bytes, time of change) to path
_loaded: dict[tuple, str] = {}


def loaded(spark: SparkSession, root: str, source: str, name: str, make: Callable[[], str]) -> str:
    """The path ``make`` gives, made anew only when the source table has changed since. For tables that many queries of a
    session read, such as names brought into one form at load."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{source}.parquet")
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    key = (spark.sparkContext.applicationId, name, root, fs.getContentSummary(place).getLength(), fs.getFileStatus(place).getModificationTime())
    if key not in _loaded:
        held, _open[:] = _open[:], []  # not part of any scratch block
        try:
            _loaded[key] = make()
        finally:
            _open[:] = held
    return _loaded[key]


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables cut within are removed at the end; for work whose results are stored or collected inside."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            _remove(spark, path)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
