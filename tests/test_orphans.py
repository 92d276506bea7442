import random

import numpy as np

from voltloom.operators.orphans import DAY, Bitmap, orphans, report


def test_bitmap():
    rng = np.random.default_rng(0)
    for n in (0, 5, 4096, 30_000):
        x = np.unique(rng.integers(0, 1 << 16, n)).astype(np.uint16)
        other = np.unique(rng.integers(0, 1 << 16, 20_000)).astype(np.uint16)
        b = Bitmap.from_bytes(Bitmap(x).to_bytes())
        assert b.members().tolist() == x.tolist()
        assert b.and_not(Bitmap(other).dense()).members().tolist() == sorted(set(x.tolist()) - set(other.tolist()))


def brute(refs, changes):
    out = set()
    for g, target, t in refs:
        if target is None or t is None:
            continue
        own = [(u, not alive) for k, u, alive in changes if k == target and u is not None]
        past = [x for x in own if x[0] <= t]
        if past:
            if max(past)[1]:
                out.add((g, target, t, "deleted"))
        elif any(not gone for _, gone in own):
            out.add((g, target, t, "late"))
        else:
            out.add((g, target, t, "missing"))
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    time = lambda: rng.choice([None, *[rng.randrange(6 * DAY) for _ in range(9)], 2 * DAY])
    changes = [(f"k{rng.randrange(60)}", time(), rng.random() < 0.6) for _ in range(150)] + [(None, 5, True)]
    refs = [(f"g{i}", rng.choice([f"k{rng.randrange(80)}", "hot", None]), time()) for i in range(500)]
    r = spark.createDataFrame([(*x, 1) for x in refs], "g string, target string, t bigint, id int")
    c = spark.createDataFrame(changes + changes[:20], "target string, t bigint, alive boolean")
    got = [(x.g, x.target, x.t, x.status) for x in orphans(r, c).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(refs, changes)


def test_empty_and_report(spark):
    r = spark.createDataFrame([("g", "p", "k", 5)], "graph string, p string, target string, t bigint")
    none = spark.createDataFrame([], "target string, t bigint, alive boolean")
    found = orphans(r, none)
    assert [x.status for x in found.collect()] == ["missing"]
    assert orphans(r.limit(0), none).count() == 0
    months = spark.createDataFrame([("g", "2031-01")], "graph string, month string")
    assert [tuple(x) for x in report(found, months).collect()] == [("p", "2031-01", "missing", 1)]
