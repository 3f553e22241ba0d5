"""Queries over XML whose tables have ids beyond 32 bits, against their SQL."""

import dataclasses
import os

import duckdb
import pytest

from factloom import schema
from factloom.plans import built
from factloom.sources.store import Store

ROOT = "/root/testdata/sf0.001"
SHIFT = 3_000_000_000

pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no tables here")


@pytest.fixture(scope="module")
def shifted(tmp_path_factory):
    root, con = tmp_path_factory.mktemp("shifted"), duckdb.connect()
    for name in ("classes", "dubbo_services", "mybatis_statements"):
        con.execute(f"COPY (SELECT * REPLACE (id + {SHIFT} AS id) FROM '{ROOT}/{name}.parquet') TO '{root}/{name}.parquet'")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{root}/{name}.parquet'")
    return str(root), con


@pytest.mark.parametrize(
    "name",
    [
        "xml_method_configs",
        "component_scans",
        "xml_beans",
        "xml_registries",
        "xml_statements",
        "xml_result_maps",
        "xml_references",
        "xml_services",
    ],
)
def test_ids_beyond_32_bits(spark, shifted, rows, name):
    root, con = shifted
    df = built.QUERIES[name](spark, root)
    expected = con.execute(f"SELECT {', '.join(df.columns)} FROM ({built.SQL[name]})").fetchall()
    assert expected and rows(df) == sorted(expected, key=repr)


def test_timeouts_stored_as_32_bits_are_read(spark, rows, tmp_path, monkeypatch):
    wide, store = schema.TABLES["dubbo_method_configs"], Store(spark, str(tmp_path / "store"))
    config = lambda name, ms: spark.createDataFrame([(1, 0, name, ms)], "service_id bigint, reference_id bigint, method_name string, timeout_ms bigint")
    with monkeypatch.context() as m:
        m.setitem(schema.TABLES, "dubbo_method_configs", dataclasses.replace(wide, columns=wide.columns.replace("timeout_ms bigint", "timeout_ms int")))
        store.upsert("dubbo_method_configs", config("old", 500))
    store.upsert("dubbo_method_configs", config("new", SHIFT))
    assert rows(store.read("dubbo_method_configs").select("method_name", "timeout_ms")) == [("new", SHIFT), ("old", 500)]
