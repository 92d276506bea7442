"""Differences between two copies of data by characteristic polynomials.

Each side's rows become elements x of the field of 2^61 - 1, spread by a second hash over buckets of
about ``PER_BUCKET`` rows. A bucket's sketch is the value of the product of (z - x) at a few points z.
The quotient of both sides' sketches is a rational function whose numerator and denominator have the
differing elements as roots; it is found by the extended Euclidean algorithm if the degree bound is
high enough, which two more points verify; the buckets that fail are sketched again with the bound
doubled. So what is exchanged between the sides grows with the differences, not with the data. The
differing elements are then looked up in the rows of both sides, and fields are compared.

Buckets are filled by a hash of whole distinct rows, so a hot record or graph can't fill one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut

P = (1 << 61) - 1
#: Elements are below 2^60, the points from there on, so no point is an element.
POINTS = 1 << 60
PER_BUCKET = 64
#: First bound of a bucket's differences, and points beside it that verify the result.
FIRST, EXTRA = 8, 2


def mulmod(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b mod 2^61 - 1 of uint64 arrays below the modulus."""
    low31, low30 = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
    a1, a0, b1, b0 = a >> np.uint64(31), a & low31, b >> np.uint64(31), b & low31
    mid = a1 * b0 + a0 * b1
    t = ((a1 * b1) << np.uint64(1)) + (mid >> np.uint64(30)) + ((mid & low30) << np.uint64(31)) + a0 * b0
    t = (t & np.uint64(P)) + (t >> np.uint64(61))
    return np.where(t >= P, t - np.uint64(P), t)


def sketches(bucket: np.ndarray, x: np.ndarray, points: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets, their numbers of elements, and a matrix of their polynomials at the points."""
    order = np.argsort(bucket, kind="stable")
    bucket, x = bucket[order], x[order].astype(np.uint64)
    ids, starts, counts = np.unique(bucket, return_index=True, return_counts=True)
    z = np.arange(POINTS, POINTS + points, dtype=np.uint64)
    out = np.ones((len(ids), points), np.uint64)
    for k in range(int(counts.max()) if len(ids) else 0):  # the k-th element of every bucket at once
        some = np.flatnonzero(counts > k)
        term = z[None, :] - x[starts[some] + k][:, None]
        out[some] = mulmod(out[some], term)
    return ids, counts, out


def _mul(a: list[int], b: list[int]) -> list[int]:
    out = [0] * (len(a) + len(b) - 1)
    for i, u in enumerate(a):
        for j, v in enumerate(b):
            out[i + j] = (out[i + j] + u * v) % P
    return out


def _trim(a: list[int]) -> list[int]:
    while len(a) > 1 and not a[-1]:
        a.pop()
    return a


def _value(a: list[int], z: int) -> int:
    r = 0
    for c in reversed(a):
        r = (r * z + c) % P
    return r


def rational(f: list[int], difference: int, bound: int) -> tuple[list[int], list[int]] | None:
    """Monic (numerator, denominator) with quotient f[k] at point k, degrees of the given difference
    and of at most ``bound`` in sum; None if the points beyond the bound contradict it."""
    n_deg = (bound + difference) // 2
    if n_deg < 0 or n_deg - difference < 0:
        return None
    zs = [POINTS + k for k in range(len(f))]
    # Newton's interpolation of the first bound + 1 points
    m = min(bound + 1, len(f))
    c = f[:m]
    for j in range(1, m):
        inv = pow(j, -1, P)  # the points are consecutive
        for i in range(m - 1, j - 1, -1):
            c[i] = (c[i] - c[i - 1]) * inv % P
    poly, base = [0], [1]
    for i in range(m):
        poly = [(u + c[i] * v) % P for u, v in zip(poly + [0] * (len(base) - len(poly)), base)]
        base = _mul(base, [-zs[i] % P, 1])
    r0, r1, t0, t1 = base, _trim(poly), [0], [1]
    while len(r1) - 1 > n_deg:
        inv, q, rem = pow(r1[-1], -1, P), [0] * (len(r0) - len(r1) + 1), list(r0)
        for i in range(len(q) - 1, -1, -1):
            q[i] = u = rem[i + len(r1) - 1] * inv % P
            if u:
                for j, v in enumerate(r1):
                    rem[i + j] = (rem[i + j] - u * v) % P
        qt = _mul(q, t1)
        width = max(len(t0), len(qt))
        t0, t1 = t1, _trim([((t0[i] if i < len(t0) else 0) - (qt[i] if i < len(qt) else 0)) % P for i in range(width)])
        r0, r1 = r1, _trim(rem[: len(r1) - 1] or [0])
    if not r1[-1] or not t1[-1] or (len(r1) - 1) - (len(t1) - 1) != difference:
        return None
    a, b = pow(r1[-1], -1, P), pow(t1[-1], -1, P)
    top, bottom = [u * a % P for u in r1], [u * b % P for u in t1]
    if any(_value(top, z) != y * _value(bottom, z) % P for z, y in zip(zs, f)):
        return None
    return top, bottom


def _sketch(points: int):
    def run(batches):
        data = [b for b in batches if b.num_rows]
        if data:
            t = pa.Table.from_batches(data)
            ids, n, values = sketches(t["bucket"].to_numpy(), t["x"].to_numpy(), points)
            flat = pa.array(values.ravel().view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, points, dtype=np.int32)), flat)
            out = pa.table([pa.array(ids), pa.array(n.astype(np.int64)), lists], names=["bucket", "n", "values"])
            yield from out.to_batches(max_chunksize=10_000)

    return run


def _decode(bound: int):
    """Sketches of both sides of a bucket -> both polynomials, or neither if the bound is too low."""

    def run(batches):
        for batch in batches:
            d = batch.to_pydict()
            tops, bottoms = [], []
            for na, va, nb, vb in zip(d["na"], d["va"], d["nb"], d["vb"]):
                va, vb = va or [1] * (bound + 1 + EXTRA), vb or [1] * (bound + 1 + EXTRA)
                found = rational([a * pow(b, -1, P) % P for a, b in zip(va, vb)], (na or 0) - (nb or 0), bound)
                tops.append(found and found[0])
                bottoms.append(found and found[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tops, pa.list_(pa.int64())), pa.array(bottoms, pa.list_(pa.int64()))], names=["bucket", "top", "bottom"])

    return run


def _roots(batches):
    """The elements of a bucket at which its polynomial is zero."""
    for batch in batches:
        x = batch.column("x").to_numpy().astype(np.uint64)
        poly = batch.column("poly")
        ends, flat = poly.offsets.to_numpy(), poly.values.to_numpy().astype(np.uint64)
        degree = np.diff(ends) - 1
        r = np.zeros(len(x), np.uint64)
        for k in range(int(degree.max()) + 1 if len(x) else 0):  # Horner's rule, from the highest coefficient
            some = np.flatnonzero(degree >= k)
            t = mulmod(r[some], x[some]) + flat[ends[some + 1] - 1 - k]
            r[some] = np.where(t >= P, t - np.uint64(P), t)
        yield from pa.Table.from_batches([batch]).select(["bucket", "x"]).filter(pa.array(r == 0)).to_batches()


def elements(rows: DataFrame) -> DataFrame:
    """The rows with a hash that places them in a bucket and their field element, hashes of all columns
    (null is a value)."""
    key = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in rows.columns]
    return rows.withColumn("place", F.xxhash64(F.lit("bucket"), *key)).withColumn("x", F.xxhash64(*key).bitwiseAND(F.lit(POINTS - 1).cast("bigint")))


def reconcile(a: DataFrame, b: DataFrame, per_bucket: int = PER_BUCKET, first: int = FIRST) -> DataFrame:
    """(side 'a' or 'b', the columns): the distinct rows of two tables of the same columns that the
    other side lacks. Nulls are equal to nulls; repeated rows count once.

    Each side is computed and written once, and shuffled once, into its buckets. Buckets that differ
    in more than ``per_bucket`` elements (a bulk difference) have no use for polynomials: their elements
    are compared directly."""
    cols = a.columns
    a, b = cut(elements(a)), cut(elements(b.select(*cols)))
    buckets = max(1, (a.count() + b.count()) // (2 * per_bucket))
    bucket = F.pmod("place", F.lit(buckets).cast("bigint")).alias("bucket")
    # a partition holds whole buckets; so do the partitions of what is written
    keys = [cut(side.select(bucket, "x").repartition("bucket").distinct()) for side in (a, b)]
    own, bound, found = keys, first, []
    while True:
        points = bound + 1 + EXTRA
        sa, sb = (
            k.mapInArrow(_sketch(points), "bucket bigint, n bigint, values array<bigint>").select("bucket", F.col("n").alias(f"n{s}"), F.col("values").alias(f"v{s}"))
            for k, s in zip(own, "ab")
        )
        both = sa.join(sb, "bucket", "full").where("not (va <=> vb and na <=> nb)").select("bucket", "na", "va", "nb", "vb")
        solved = cut(both.mapInArrow(_decode(bound), "bucket bigint, top array<bigint>, bottom array<bigint>"))
        for side, k, poly in (("a", keys[0], "top"), ("b", keys[1], "bottom")):
            roots = k.join(solved.where(F.size(poly) > 1).select("bucket", F.col(poly).alias("poly")), "bucket")
            found.append(roots.select("bucket", "x", "poly").mapInArrow(_roots, "bucket bigint, x bigint").withColumn("side", F.lit(side)))
        failed = solved.where("top is null").select("bucket")
        if failed.isEmpty():
            break
        own, bound = [k.join(failed, "bucket", "left_semi") for k in keys], bound * 2
        if bound > per_bucket:
            for side, k, other in (("a", own[0], own[1]), ("b", own[1], own[0])):
                found.append(k.join(other, ["bucket", "x"], "left_anti").select("bucket", "x", F.lit(side).alias("side")))
            break
        own = [k.repartition("bucket") for k in own]
    keys_found = found[0]
    for more in found[1:]:
        keys_found = keys_found.unionByName(more)
    keys_found = cut(keys_found)
    out = [
        side.withColumn("bucket", bucket).join(keys_found.where(F.col("side") == s).select("bucket", "x"), ["bucket", "x"], "left_semi").select(F.lit(s).alias("side"), *cols).distinct()
        for side, s in ((a, "a"), (b, "b"))
    ]
    return out[0].unionByName(out[1])


def compare_records(a: DataFrame, b: DataFrame, key: list[str], field: str, values: list[str]) -> DataFrame:
    """Differing rows of two tables of (key, field, values): side, key, field, values. A record is a
    key with a row; a record that one side lacks has a row with field ''."""

    def whole(t: DataFrame) -> DataFrame:
        t = t.select(*key, field, *values)
        heads = t.select(*key, F.lit("").alias(field), *[F.lit(None).cast("string").alias(v) for v in values])
        return t.unionByName(heads)

    return reconcile(whole(a), whole(b))


def summary(rows: DataFrame, key: list[str], field: str) -> DataFrame:
    """(key, field, kind) from the rows of ``compare_records``: only_a, only_b, or differs by field."""
    g = rows.groupBy(*key).agg(
        F.max(F.when(F.col(field) == "", F.concat(F.lit("only_"), "side"))).alias("only"),
        F.collect_set(F.when(F.col(field) != "", F.col(field))).alias("fields"),  # fields are few: the columns of a record
    )
    one = F.array(F.struct(F.lit("").alias(field), F.col("only").alias("kind")))
    many = F.transform("fields", lambda f: F.struct(f.alias(field), F.lit("differs").alias("kind")))
    return g.select(*key, F.inline(F.when(F.col("only").isNotNull(), one).otherwise(many)))
