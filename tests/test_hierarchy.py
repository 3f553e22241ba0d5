import random

import pytest

from factloom.operators import hierarchy as H
from factloom.operators.skew_join import heavy, unique_join

SCHEMA = "node string, parent string, root string, path string"


def frame(spark, links):
    return spark.createDataFrame([(n, p, "x", "y") for n, p in links], SCHEMA)


def brute(links):
    parent = {}
    for n, p in links:
        if n is not None:
            old = parent.get(n)
            parent[n] = p if old is None else old if p is None else min(old, p)
    out = {}
    for n in parent:
        path = [n]
        while parent.get(path[-1]) is not None and parent[path[-1]] not in path:
            path.append(parent[path[-1]])
        end = parent.get(path[-1])
        if end is None:
            out[n] = (path[-1], len(path) - 1, path[::-1])
        else:
            at = path.index(end)
            out[n] = (min(path[at:]), -1 if at == 0 else -2, path[: at + 1][::-1])
    return out


def got(spark, links):
    return {r.node: (r.root, r.depth, r.path) for r in H.hierarchy(frame(spark, links)).collect()}


@pytest.mark.parametrize(
    "links",
    [
        [],
        [("a", None)],
        [("a", "a")],
        [("a", "gone")],
        [(None, "a"), (None, None)],
        [("a", "b"), ("a", "c"), ("b", None), ("c", None)],
        [("a", "b"), ("b", "a"), ("c", "a"), ("d", "c"), ("e", None), ("f", "e")],
        [(f"n{i:03}", f"n{i + 1:03}") for i in range(70)],
        [(f"n{i:03}", f"n{(i + 1) % 37:03}") for i in range(37)] + [(f"t{i}", "n005" if i == 0 else f"t{i - 1}") for i in range(20)],
        [("", "x"), ("x", None), ("n" * 5000, "")],
    ],
)
def test_cases(spark, links):
    assert got(spark, links) == brute(links)


def test_random_forests_with_cycles(spark):
    rng = random.Random(4)
    links = [(f"n{i}", None if rng.random() < 0.1 else f"n{rng.randrange(300)}") for i in range(300)]
    assert got(spark, links) == brute(links)


def test_without_paths_gives_the_same_roots(spark):
    links = [("a", "b"), ("b", "c"), ("c", None), ("x", "y"), ("y", "x"), ("z", "x")]
    plain = {r.node: (r.root, r.depth) for r in H.hierarchy(frame(spark, links), paths=False).collect()}
    assert plain == {n: v[:2] for n, v in brute(links).items()}


def test_closure_and_counts(spark, rows):
    tree = H.hierarchy(frame(spark, [("a", "b"), ("b", "c"), ("c", None), ("d", "c"), ("x", "x"), ("y", "x")]))
    assert rows(H.closure(tree)) == [("b", "a", 1), ("c", "a", 2), ("c", "b", 1), ("c", "d", 1), ("x", "y", 1)]
    assert rows(H.descendant_counts(tree)) == [("b", 1, 1), ("c", 3, 2), ("x", 1, 1)]


def test_join_keeps_every_row_whatever_the_share(spark, rows):
    left = spark.createDataFrame([("hot", i) for i in range(50)] + [(f"k{i}", i) for i in range(30)] + [(None, 1)], "k string, i int")
    right = spark.createDataFrame([("hot", "h"), ("k3", "three"), ("other", "o")], "k string, v string")
    expect = rows(left.join(right, "k", "left"))
    for hot in ([], ["hot"], ["hot", "k3", "gone"], None):
        assert rows(unique_join(left, right, "k", hot=hot).select("k", "i", "v")) == expect
        assert rows(unique_join(left, right, "k", "inner", hot=hot).select("k", "i", "v")) == [r for r in expect if r[2]]
    assert heavy(left, "k", 2) == ["hot"] and heavy(left.limit(0), "k") == []


def test_kept_columns_and_missing_parents(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("a", "b", 3), ("b", "gone", 2), ("c", "c", 5), ("d", "c", 6)], "node string, parent string, v int")
    assert {(r.node, r.root, r.depth, r.v) for r in H.hierarchy(edges, keep=["v"]).collect()} == {("a", "gone", 2, 3), ("b", "gone", 1, 2), ("c", "c", -1, 5), ("d", "c", -2, 6)}


def test_long_tails_into_long_cycles(spark):
    links = [(f"c{i:02}", f"c{(i + 1) % 12:02}") for i in range(12)] + [(f"a{i:02}", "c05" if i == 0 else f"a{i - 1:02}") for i in range(45)]
    assert got(spark, links) == brute(links)
