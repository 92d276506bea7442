"""Repeated nodes, however deep they are nested, against the recursion itself."""

import random

from voltloom.operators import graph as G


def by_recursion(rows, nodes):
    said = {n: sorted({(p, o) for s, p, o in rows if s == n}) for n in nodes}

    def sign(n, way):
        if n in way:
            return "_:cycle"
        return "[" + ";".join(sorted(f"{p}={sign(o, way | {n}) if o in said else o}" for p, o in said[n])) + "]"

    first, out = {}, set()
    for n in sorted(nodes):
        keep = first.setdefault(sign(n, frozenset()), n)
        if keep != n:
            out.add((n, keep))
    return out


def found(spark, rows, nodes):
    t = spark.createDataFrame(rows, "s string, p string, o string")
    return sorted(tuple(r) for r in G.repeated_nodes(t, spark.createDataFrame([(n,) for n in nodes], "s string")).collect())


def test_nested_deeper_than_any_level(spark):
    chain = lambda name, end: [(f"{name}{i}", "q", f"{name}{i + 1}") for i in range(6)] + [(f"{name}6", "v", end)]
    rows = chain("a", "1") + chain("b", "1") + chain("c", "2")
    nodes = [f"{x}{i}" for x in "abc" for i in range(7)]
    assert found(spark, rows, nodes) == sorted((f"b{i}", f"a{i}") for i in range(7)) == sorted(by_recursion(rows, nodes))


def test_cycles_and_equal_inner_nodes(spark):
    rows = [("a", "p", "a"), ("b", "p", "c"), ("c", "p", "b"), ("d", "p", "d"), ("x", "q", "b"), ("y", "q", "c"), ("z", "q", "a"), ("x", "v", "1"), ("y", "v", "1"), ("z", "v", "1"), ("one", "r", "e"), ("two", "r", "e"), ("two", "r", "f"), ("z", "r", "e")]
    nodes = ["a", "b", "c", "d", "x", "y", "z", "one", "two", "e", "f"]
    want = by_recursion(rows, nodes)
    assert {("d", "a"), ("c", "b"), ("y", "x"), ("f", "e")} == want
    assert found(spark, rows, nodes) == sorted(want)


def test_random_graphs(spark):
    r = random.Random(7)
    for _ in range(2):
        nodes = [f"n{i:02}" for i in range(24)]
        rows = [(n, r.choice("pq"), r.choice([*nodes, *"1212121212121212121212"])) for n in nodes for _ in range(r.choice((1, 1, 2)))]
        assert found(spark, rows, nodes) == sorted(by_recursion(rows, nodes))
