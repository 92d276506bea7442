import random

import pytest

from voltloom.operators.hierarchy import descendants, hierarchy

SCHEMA = "p string, node string, parent string, NODE string, count int"


def brute(edges):
    up = {}
    for p, n, o in edges:
        if p and n and n.strip() and o and o.strip():
            up[p, n] = min(o, up.get((p, n), o))
    nodes = {k for k in up} | {(p, o) for p, n, o in edges if p and n and n.strip() and o and o.strip()}
    out = {}
    for p, n in nodes:
        path, x = [n], n
        while (p, x) in up and up[p, x] not in path:
            x = up[p, x]
            path.append(x)
        if (p, x) not in up:
            out[p, n] = ("", x, len(path) - 1, path[::-1])
        else:
            out[p, n] = ("cycle" if up[p, x] == n else "under_cycle", None, None, None)
    return out


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_against_brute_force(spark, block):
    rng = random.Random(block)
    names = [f"http://n{i % 7}.example/a#{i}" for i in range(60)]
    edges = [(p, names[i], rng.choice(names[: max(1, i)])) for p in ("a", "b") for i in range(1, 60) if rng.random() < 0.9]
    edges += [("a", names[3], names[40]), ("a", names[9], names[9]), ("b", "only", "root"), ("b", " ", "x"), ("b", "y", None), (None, "q", "r")]
    edges += edges[:10]
    df = spark.createDataFrame([(*e, "clash", 1) for e in edges], SCHEMA.replace("NODE", "other"))
    got = {(r.p, r.node): r for r in hierarchy(df, block=block).collect()}
    want = brute(edges)
    assert got.keys() == want.keys()
    for k, (status, root, depth, path) in want.items():
        r = got[k]
        assert (r.status, r.root, r.depth, r.path) == (status, root, depth, path), k
        if status == "":
            assert r.below == sum(1 for (p, n), w in want.items() if p == k[0] and w[3] and k[1] in w[3][:-1]), k
    pairs = {(r.p, r.ancestor, r.node, r.distance) for r in descendants(hierarchy(df, block=block)).collect()}
    assert pairs == {(p, a, n, len(w[3]) - 1 - i) for (p, n), w in want.items() if w[3] for i, a in enumerate(w[3][:-1])}


def test_cycle_across_blocks_and_clashing_columns(spark):
    rows = [("a", f"http://n{i}.example/#x", f"http://n{(i + 1) % 5}.example/#x", "z", 0) for i in range(5)] + [("a", "http://m.example/#y", "http://n2.example/#x", "z", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.node: r.status for r in hierarchy(df, block=1).collect()}
    assert got.pop("http://m.example/#y") == "under_cycle"
    assert set(got.values()) == {"cycle"} and len(got) == 5


def test_empty(spark):
    assert hierarchy(spark.createDataFrame([], SCHEMA)).count() == 0


def test_deep_chain_over_blocks(spark):
    """A chain of 10,000 levels through alternating namespaces, one of them larger than a block, and a circle of blocks."""
    ns = lambda i: f"http://{'a' if i % 2 else 'b' if i % 3 else 'c'}/x#{i}"
    rows = [("p", ns(i), ns(i - 1)) for i in range(1, 10_001)] + [("q", f"http://r{i % 3}/{i}", f"http://r{(i + 1) % 60 % 3}/{(i + 1) % 60}") for i in range(60)] + [("q", "leaf", "http://r0/0")]
    df = spark.createDataFrame(rows, "p string, node string, parent string")
    got = {(r.p, r.node): r for r in hierarchy(df, block=1_000, paths=False).collect()}
    assert all(got["p", ns(i)].depth == i and got["p", ns(i)].root == ns(0) for i in range(10_001))
    assert {r.status for (p, n), r in got.items() if p == "q" and n != "leaf"} == {"cycle"} and got["q", "leaf"].status == "under_cycle" and len(got) == 10_062


def test_paths_agree_with_depths(spark):
    rng = random.Random(4)
    rows = [(p, f"n{i % 7}#{i}", f"n{j % 7}#{j}") for p in "pq" for i in range(1, 400) for j in [rng.randrange(0 if p == "p" else -3, i + (p == "q" and rng.random() < 0.02))]]
    df = spark.createDataFrame(rows, "p string, node string, parent string")
    for block in (20, 100_000):
        full, short = hierarchy(df, block=block).collect(), hierarchy(df, block=block, paths=False).collect()
        assert {(r.p, r.node, r.root, r.depth, r.status) for r in full} == {(r.p, r.node, r.root, r.depth, r.status) for r in short}
        assert all(len(r.path) == r.depth + 1 and r.path[0] == r.root and r.path[-1] == r.node for r in full if not r.status)
        under = {}
        for r in full:
            for x in (r.path or [])[:-1]:
                under[r.p, x] = under.get((r.p, x), 0) + 1
        assert all(r.below == under.get((r.p, r.node), 0) for r in full if not r.status)
