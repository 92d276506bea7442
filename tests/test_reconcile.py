import random

import numpy as np
import pytest

from voltloom.operators import reconcile as R


def test_mulmod():
    rng = random.Random(0)
    a, b = ([rng.choice([0, 1, R.P - 1, rng.randrange(R.P)]) for _ in range(500)] for _ in range(2))
    assert R.mulmod(np.array(a, np.uint64), np.array(b, np.uint64)).tolist() == [x * y % R.P for x, y in zip(a, b)]


@pytest.mark.parametrize("da, db, bound", [(0, 1, 1), (3, 2, 5), (3, 2, 8), (0, 8, 8), (5, 5, 10), (4, 4, 7)])
def test_rational(da, db, bound):
    rng = random.Random(da * 10 + db)
    a, b = ({rng.randrange(R.POINTS) for _ in range(n)} for n in (da, db))
    both = {rng.randrange(R.POINTS) for _ in range(20)}
    value = lambda s, z: int(np.prod([1])) * __import__("functools").reduce(lambda u, x: u * (z - x) % R.P, s, 1)
    zs = [R.POINTS + k for k in range(bound + 1 + R.EXTRA)]
    f = [value(a | both, z) * pow(value(b | both, z), -1, R.P) % R.P for z in zs]
    found = R.rational(f, da - db, bound)
    if da + db > bound:
        assert found is None
    else:
        assert [len(x) - 1 for x in found] == [da, db]
        assert all(R._value(found[0], x) == 0 for x in a) and all(R._value(found[1], x) == 0 for x in b)


@pytest.mark.parametrize("per_bucket", [4, 1000])
def test_tables(spark, per_bucket):
    rng = random.Random(per_bucket)
    common = [(f"k{i}", rng.choice("pq"), rng.choice([None, "", "v", "w"])) for i in range(300)]
    a = common + [(f"a{i}", "p", "x") for i in range(40)] + [(None, None, None)] + common[:50]
    b = common + [(f"b{i}", "p", "x") for i in range(7)] + [("k1", "p", "other")]
    df = [spark.createDataFrame([(*r, 1) for r in x], "k string, f string, v string, x int").select("k", "f", "v") for x in (a, b)]
    got = {tuple(r) for r in R.reconcile(*df, per_bucket=per_bucket, first=2).collect()}
    assert got == {("a", *r) for r in set(a) - set(b)} | {("b", *r) for r in set(b) - set(a)}


def test_hot_record_and_summary(spark):
    a = [("g", "hot", "p", f"v{i}") for i in range(500)] + [("g", "gone", "p", "1"), ("g", "same", "q", "1")]
    b = [("g", "hot", "p", f"v{i}") for i in range(250)] + [("g", "new", "p", "1"), ("g", "same", "q", "1")]
    df = [spark.createDataFrame(x, "graph string, s string, p string, v string") for x in (a, b)]
    rows = R.compare_records(*df, ["graph", "s"], "p", ["v"])
    assert {tuple(r) for r in R.summary(rows, ["graph", "s"], "p").collect()} == {("g", "hot", "p", "differs"), ("g", "gone", "", "only_a"), ("g", "new", "", "only_b")}


def test_empty(spark):
    e = spark.createDataFrame([], "k string, v string")
    one = spark.createDataFrame([("a", None)], "k string, v string")
    assert R.reconcile(e, e).count() == 0
    assert [tuple(r) for r in R.reconcile(e, one).collect()] == [("b", "a", None)]
    assert [tuple(r) for r in R.reconcile(one, e).collect()] == [("a", "a", None)]
