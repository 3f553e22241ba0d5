"""Properties that hold whatever the data."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.operators import graph as G
from factloom.operators import hierarchy as H
from factloom.operators import maintain as M
from factloom.operators import nested as N
from factloom.streaming import incremental

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
NODE = st.sampled_from([f"n{k}" for k in range(8)])


@FEW
@given(links=st.lists(st.tuples(NODE, st.none() | NODE), max_size=12))
def test_closure_is_transitive(spark, links):
    frame = spark.createDataFrame(links, "node string, parent string")
    pairs = {(r.ancestor, r.descendant): r.distance for r in H.closure(H.hierarchy(frame)).collect()}
    for (a, b), d in pairs.items():
        for (c, e), f in pairs.items():
            if b == c and (a, e) in pairs:
                assert pairs[a, e] == d + f


@FEW
@given(rows=st.lists(st.tuples(st.integers(0, 3), st.none() | st.text("ab", max_size=2), st.integers(0, 9)), max_size=10))
def test_merges_are_idempotent_and_independent_of_order(spark, rows):
    schema = "k int, v string, at int"
    old = spark.createDataFrame([], "k int, v string")
    new = spark.createDataFrame(rows, schema)
    once = M.merge(old, new, ["k"], keep=["v"], stable=[], order="at")
    result = sorted(map(tuple, once.collect()), key=repr)
    assert sorted(map(tuple, M.merge(once, new, ["k"], keep=["v"], stable=[], order="at").collect()), key=repr) == result
    shuffled = spark.createDataFrame(rows[::-1], schema).repartition(3)
    assert sorted(map(tuple, M.merge(old, shuffled, ["k"], keep=["v"], stable=[], order="at").collect()), key=repr) == result


@FEW
@given(links=st.lists(st.tuples(NODE, NODE), max_size=14))
def test_paths_are_as_long_as_the_depth(spark, links):
    edges = spark.createDataFrame([(a, b, k) for k, (a, b) in enumerate(links)], "src string, dst string, edge_ord bigint")
    depth = {r.vertex: r.depth for r in G.reach(edges, "n0", 9).collect()}
    for v in list(depth)[:3]:
        path = G.find_path(edges, "n0", v, 9)
        assert len(path) == depth[v] + 1 and all(p in set(links) for p in zip(path, path[1:]))


JSON = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=3), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from(["result_maps", "cases", "a", "fallbacks", "map_id", "value"]), x, max_size=4), max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(value=JSON)
def test_both_parsers_agree(value):
    import json

    text = json.dumps(value, ensure_ascii=False, indent=1)
    assert N._read_iteratively(text) == value
    assert all(path.rsplit("/", 1)[0] == parent if parent else "/" not in path for _, path, parent, *_ in N.visit(text))


def test_stream_of_calls_by_day(spark, tmp_path):
    """Late rows within the watermark count, those beyond it are left out."""
    schema = "at timestamp, call_kind string"
    for n, rows in enumerate([[("2024-01-01 10:00:00", "invoke"), ("2024-01-03 10:00:00", "invoke")], [("2024-01-03 09:30:00", "invoke"), ("2024-01-01 11:00:00", "invoke"), ("2024-01-09 00:00:00", "invoke")]]):
        spark.createDataFrame(rows, "a string, call_kind string").select(F.to_timestamp("a").alias("at"), "call_kind").coalesce(1).write.json(str(tmp_path / "in" / str(n)))
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in" / "*"))
        q = incremental.windowed_calls(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = {str(r.period.start)[:10]: r.n_calls for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got["2024-01-01"] == 1 and got["2024-01-03"] == 2
