import json

import pytest

from pyspark.sql import functions as F

from factloom.operators import nested as N
from factloom.sources.store import read_tagged, write_tagged


def brute(payload):
    """Recursive reading of the definition."""
    fields = {"result_maps": "map_id", "associations": "property", "collections": "property", "cases": "value", "registries": "registry_id", "fallbacks": "registry_id"}
    names = {**{f: f for f in fields}, "resultMaps": "result_maps"}
    out = []

    def held(v):
        if isinstance(v, str):
            try:
                inner = json.loads(v)
            except ValueError:
                return v
            return held(inner) if isinstance(inner, (dict, list, str)) else v
        return v

    def camel(name):
        a, *b = name.split("_")
        return a + "".join(x.title() for x in b)

    def walk(v, path):
        v = held(v)
        if isinstance(v, list):
            for x in v:
                walk(x, path)
        elif isinstance(v, dict):
            for k, x in v.items():
                if k in names:
                    f = names[k]
                    x = held(x)
                    for i, y in enumerate(x if isinstance(x, list) else [x]):
                        y = held(y)
                        p = f"{path}/{f}[{i}]" if path else f"{f}[{i}]"
                        if isinstance(y, dict):
                            n = next((y[z] for z in (fields[f], camel(fields[f])) if y.get(z) is not None), "")
                            out.append((p, n if isinstance(n, str) else json.dumps(n, separators=(",", ":"))))
                            walk(y, p)
                else:
                    walk(x, path)

    try:
        walk(json.loads(payload, parse_constant=lambda x: 1 / 0), "")
    except (ValueError, TypeError, ZeroDivisionError):
        return []
    return sorted(out)


CASES = [
    None, "", "   ", "null", "[]", "{}", "7", "nope", '{"result_maps": [', '{"result_maps": [{"map_id": "a"}]} x', '{"result_maps": [{"map_id": NaN}]}',
    '{"result_maps": [{"map_id": "a", "associations": [null, {"property": "p"}, 3]}]}',
    '{"resultMaps": {"mapId": "a", "discriminator": {"cases": [{"value": 3}, {"value": true}, {"value": null}, {}]}}}',
    '{"mapper": "{\\"result_maps\\": \\"[{\\\\\\"map_id\\\\\\": 1.5}]\\"}"}',
    '{"dubbo": {"registries": [{"registryId": "r", "fallbacks": [{"registry_id": "s", "fallbacks": {"registryId": "t"}}]}]}, "x": [[{"cases": [{"value": {"a": 1}}]}]]}',
    '[{"cases": [[{"value": 1}], {"value": 2}]}]',
    '{"result_maps": [{"map_id": "a"}], "resultMaps": [{"map_id": "b"}]}',
]


@pytest.mark.parametrize("payload", CASES)
def test_visitor_against_recursion(payload):
    got = sorted((path, name) for _, path, _, _, name, _ in N.visit(payload))
    assert got == brute(payload) if payload else got == []


def test_depth_beyond_the_parser():
    deep = 60_000
    text = '{"associations":' * deep + "null" + "}" * deep
    assert [p for _, p, *_ in N.visit('{"a":' * deep + '{"cases":[{"value":"x"}]}' + "}" * deep)] == ["cases[0]"]
    assert N._read_iteratively('{"a": [1, {"b": "c"}, []], "d": {}, "e": -1.5e3, "f": "\\u0041"}') == {"a": [1, {"b": "c"}, []], "d": {}, "e": -1500.0, "f": "A"}
    assert next(N.visit(text[: 16 * 3] + "{}" + "}" * 3))[1] == "associations[0]"
    for bad in ("[1,]", '{"a" 1}', "[1 2]", "{,}", '{"a":1', "[01]", "]", '"a'):
        with pytest.raises(ValueError):
            N._read_iteratively(bad)


def test_tables_keep_their_links(spark, rows):
    payload = '{"result_maps": [{"map_id": "m", "extends": "base", "associations": {"property": "p", "javaType": "a.B", "collections": [{"property": "q"}]}}]}'
    records = spark.createDataFrame([(1, payload, "z"), (1, payload, "z"), (2, None, "z")], "record_id bigint, payload string, tag string")
    tagged = N.emit_tagged(records, F.col("record_id"), F.col("payload"))
    tables = N.split_tables(lambda tag: tagged.where(F.col("tag") == tag))
    assert rows(tables["result_maps"].select("record_id", "node_path", "parent_path", "map_id", "extends_")) == [(1, "result_maps[0]", None, "m", "base")] * 2
    assert rows(tables["associations"].select("parent_path", "property", "java_type")) == [("result_maps[0]", "p", "a.B")] * 2
    assert rows(tables["collections"].select("parent_path", "property")) == [("result_maps[0]/associations[0]", "q")] * 2
    assert rows(N.child_counts(tagged)) == [(1, "result_maps[0]", "m", 2, 2, 0)]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "record_id bigint, payload string")
    assert N.emit_tagged(empty, F.col("record_id"), F.col("payload")).count() == 0


def test_dealt_fields_reach_the_tables(spark, rows):
    maps = '"result_maps": [{"map_id": "m", "association_count": 7, "note": "kept", "associations": []}, {"map_id": "n", "associationCount": "2"}, {"map_id": "o"}]'
    fallback = '"fallbacks": [{"registryId": "s"}, {"registryId": "t", "sourceFile": "own.xml"}]'
    payloads = [
        f'{{"dubbo": {{"registries": [{{"registry_id": "r", "address": "a:1", {fallback}}}]}}, {maps}, "source_file": "top.xml"}}',
        '{"sourceFile": "camel.xml", "part": {"source_file": "part.xml", "registries": {"registry_id": "r"}}}',
        '{"registries": [{"registry_id": "r"}]}',
    ]
    tagged = N.emit_tagged(spark.createDataFrame(list(enumerate(payloads)), "record_id bigint, payload string"), F.col("record_id"), F.col("payload"))
    tables = N.split_tables(lambda tag: tagged.where(F.col("tag") == tag))
    assert rows(tables["result_maps"].select("map_id", "association_count", F.get_json_object("own_fields", "$.note"))) == [("m", "7", "kept"), ("n", "2", None), ("o", None, None)]
    assert rows(tables["registries"].select("record_id", "source_file")) == [(0, "top.xml"), (1, "part.xml"), (2, None)]
    assert rows(tables["fallbacks"].select("registry_id", "source_file")) == [("s", "top.xml"), ("t", "own.xml")]


def test_columns_below_any_depth(spark, rows):
    deep = 1_500
    text = '{"result_maps":{"map_id":"m","extends":"b","note":' + '{"a":' * deep + '{"b":[1,"x"]}' + "}" * deep + ',' + '"discriminator":{"column":"c","cases":{"value":"v",' * deep + '"last":null' + "}}" * deep + "}}"
    records = spark.createDataFrame([(1, text)], "record_id bigint, payload string")
    path = write_tagged(N.emit_tagged(records, F.col("record_id"), F.col("payload")))
    tables = N.split_tables(lambda tag: read_tagged(spark, path, tag, N.TAGGED))
    assert rows(tables["result_maps"].select("map_id", "extends_")) == [("m", "b")]
    own = tables["result_maps"].first()["own_fields"]
    assert own == '{"note":' + '{"a":' * deep + '{"b":[1,"x"]}' + "}" * deep + ',"discriminator":{"column":"c"}}'
    assert rows(tables["cases"].groupBy("value").count()) == [("v", deep)]


def test_nested_result_maps_count_for_each_above(spark, rows):
    payload = '{"result_maps": [{"map_id": "a", "associations": {"property": "p", "x": {"resultMaps": [null, {"mapId": "b", "cases": [{"value": 1}, {"value": 2}]}]}}}, {"map_id": "c"}]}'
    tagged = N.emit_tagged(spark.createDataFrame([(1, payload)], "record_id bigint, payload string"), F.col("record_id"), F.col("payload"), False)
    assert rows(N.child_counts(tagged)) == [
        (1, "result_maps[0]", "a", 1, 0, 2),
        (1, "result_maps[0]/associations[0]/result_maps[1]", "b", 0, 0, 2),
        (1, "result_maps[1]", "c", 0, 0, 0),
    ]
