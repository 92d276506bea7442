"""References to records that do not exist, by compressed bitmaps.

The referenced keys are encoded as dense integers. For each range of 2^16 integers and each period
(a day) there are three bitmaps: keys referenced, keys whose last change in the period is a
declaration, and keys withdrawn in it. Going through the periods of a range in order, the parent
bitmap holds the keys that exist from the start of the period to its end; references AND NOT parents
survive. The survivors (orphans, and keys declared or withdrawn on the very day) are decoded and
judged against their own changes at the exact time.

Bitmaps are compressed as sorted 16-bit arrays up to 4096 members, as plain bits beyond.

What is shuffled by key is aggregated first (distinct key and time), so a key with a third of all
references is no larger than its distinct times; the references themselves, written once, meet the judged
keys in a join that splits the keys with very many rows by their number.

Defined results: a reference with a null graph or subject or blank target is none; one whose time is
unknown is not judged; a change whose time is unknown doesn't count; of a declaration and a
withdrawal at one instant the withdrawal is the later.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut

DAY = 86_400_000_000
RANGE = 1 << 16
ARRAY_MOST = 4096
#: Rows of one key that a task of a join takes, and keys at most that are split for having more.
PART_ROWS, MAX_HOT = 1_000_000, 10_000


class Bitmap:
    """A set of integers below 2^16."""

    __slots__ = ("lows", "bits")

    def __init__(self, lows: np.ndarray | None = None, bits: np.ndarray | None = None) -> None:
        if bits is None and len(lows) > ARRAY_MOST:
            bits = np.zeros(RANGE, np.uint8)
            bits[lows] = 1
            bits = np.packbits(bits, bitorder="little")
        self.bits = bits
        self.lows = None if bits is not None else np.unique(np.asarray(lows, np.uint16))

    def dense(self) -> np.ndarray:
        if self.bits is not None:
            return self.bits
        bits = np.zeros(RANGE, np.uint8)
        bits[self.lows] = 1
        return np.packbits(bits, bitorder="little")

    def members(self) -> np.ndarray:
        return self.lows if self.bits is None else np.flatnonzero(np.unpackbits(self.bits, bitorder="little")).astype(np.uint16)

    def and_not(self, other: np.ndarray) -> Bitmap:
        """Without the members of a plain bitmap."""
        if self.bits is None:
            held = (other[self.lows >> 3] >> (self.lows & 7).astype(np.uint8)) & 1
            return Bitmap(self.lows[held == 0])
        return Bitmap(bits=self.bits & ~other)

    def to_bytes(self) -> bytes:
        return b"a" + self.lows.tobytes() if self.bits is None else b"b" + self.bits.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Bitmap:
        return cls(np.frombuffer(data[1:], np.uint16)) if data[:1] == b"a" else cls(bits=np.frombuffer(data[1:], np.uint8))


REFERENCED, DECLARED, GONE, WITHDRAWN = range(4)


def _build(batches):
    """(range, period, kind, low), sorted -> (range, period, kind, bitmap)."""
    kept: pa.Table | None = None

    def bitmaps(t: pa.Table):
        d = {c: t[c].to_numpy() for c in ("range", "period", "kind", "low")}
        key = np.stack([d["range"], d["period"], d["kind"]])
        starts = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)]))
        parts = np.split(d["low"], starts[1:])
        yield from pa.table({
            "range": pa.array(d["range"][starts]), "period": pa.array(d["period"][starts]), "kind": pa.array(d["kind"][starts]),
            "bits": pa.array([Bitmap(x).to_bytes() for x in parts], pa.binary()),
        }).to_batches()

    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([kept, t]) if kept is not None else t
        last = [t[c].to_numpy() for c in ("range", "period", "kind")]
        other = np.flatnonzero(np.any([x != x[-1] for x in last], axis=0))
        at = int(other[-1]) + 1 if len(other) else 0
        kept = t.slice(at)
        if at:
            yield from bitmaps(t.slice(0, at))
    if kept is not None and kept.num_rows:
        yield from bitmaps(kept)


def _survive(batches):
    """Bitmaps sorted by range and period -> the (id, period) that are referenced AND NOT there
    throughout the period."""
    current, parents = None, None
    pending: dict[int, Bitmap] = {}
    period = None
    empty = np.zeros(RANGE // 8, np.uint8)

    def close():
        nonlocal parents
        through = parents & ~pending[WITHDRAWN].dense() if WITHDRAWN in pending else parents
        left = pending[REFERENCED].and_not(through).members() if REFERENCED in pending else []
        if DECLARED in pending:
            parents = parents | pending[DECLARED].dense()
        if GONE in pending:
            parents = parents & ~pending[GONE].dense()
        return [current * RANGE + int(x) for x in left]

    for b in batches:
        ids: list[int] = []
        periods: list[int] = []
        for r, t, k, bits in zip(*[b.column(c).to_pylist() for c in ("range", "period", "kind", "bits")]):
            if (r, t) != (current, period):
                if period is not None:
                    own = close()
                    ids += own
                    periods += [period] * len(own)
                if r != current:
                    current, parents = r, empty
                pending, period = {}, t
            pending[k] = Bitmap.from_bytes(bits)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(periods, pa.int64())], names=["id", "period"])
    if period is not None:
        own = close()
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([period] * len(own), pa.int64())], names=["id", "period"])


def salted(df: DataFrame, other: DataFrame, keys: list[str], counts: DataFrame, how: str = "inner", rows: int = PART_ROWS) -> DataFrame:
    """df joined with a smaller table. counts: (keys, count) of df. The rows of a key with more than ``rows``
    of them go to as many tasks as that takes, and the other table's row of that key is copied as
    often; all other keys are joined as they are.

    The hot keys are gathered: of n rows at most n / rows keys can be hot, and at most MAX_HOT are split."""
    hot = counts.where(F.col("count") > rows).orderBy(F.desc("count")).limit(MAX_HOT)
    parts = hot.select(*keys, F.ceil(F.col("count") / rows).cast("int").alias("__parts"))
    found = parts.collect()
    if not found:
        return df.join(other, keys, how)
    parts = F.broadcast(df.sparkSession.createDataFrame(found, parts.schema))
    n = F.coalesce("__parts", F.lit(1))
    left = df.join(parts, keys, "left").withColumn("__salt", F.pmod(F.hash(*df.columns), n)).drop("__parts")
    right = other.join(parts, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), n - 1))).drop("__parts")
    return left.join(right, [*keys, "__salt"], how).drop("__salt")


def orphans(references: DataFrame, changes: DataFrame, period: int = DAY) -> DataFrame:
    """The references (extra columns, target, t) whose target does not exist at time t, with their
    status: ``deleted``, ``late`` or ``missing``. changes: (target, t, alive boolean); t is BIGINT
    microseconds on both."""
    references = cut(references.where("target is not null and t is not null"))
    asked = cut(references.groupBy("target", "t").count())
    # dense integers; the dictionary is written, for they differ between runs
    keys = cut(asked.select("target").distinct().withColumn("id", F.monotonically_increasing_id()))
    known = changes.where("target is not null and t is not null").groupBy("target", "t").agg(F.min("alive").alias("alive"))
    known = cut(known.join(keys, "target").select("id", "t", "alive"))
    counts = asked
    asked = cut(asked.join(keys, "target").select("id", "target", "t"))
    day = F.floor(F.col("t") / F.lit(period)).cast("bigint")
    by_day = known.groupBy("id", day.alias("period")).agg(F.max_by("alive", "t").alias("last"), F.min("alive").alias("least"))
    kinds = F.array_compact(F.array(F.when(F.col("last"), F.lit(DECLARED)).otherwise(F.lit(GONE)), F.when(~F.col("least"), F.lit(WITHDRAWN))))
    members = by_day.select("id", "period", F.explode(kinds).alias("kind")).unionByName(
        asked.select("id", day.alias("period"), F.lit(REFERENCED).alias("kind")).distinct()
    )
    bitmaps = (
        members.select(F.shiftright("id", 16).alias("range"), "period", "kind", F.col("id").bitwiseAND(F.lit(RANGE - 1).cast("bigint")).cast("int").alias("low"))
        .repartition("range")
        .sortWithinPartitions("range", "period", "kind", "low")
        .mapInArrow(_build, "range bigint, period bigint, kind int, bits binary")
    )
    left = bitmaps.mapInArrow(_survive, "id bigint, period bigint")
    doubtful = cut(asked.withColumn("period", day).join(left, ["id", "period"], "left_semi").select("id", "target", "t"))
    # exact: the last change at or before the time, over the distinct times of a key
    line = doubtful.select("id", "t", F.col("target"), F.lit(None).cast("boolean").alias("alive"), F.lit(1).alias("asks")).unionByName(
        known.join(doubtful.select("id").distinct(), "id", "left_semi").select("id", "t", F.lit(None).cast("string").alias("target"), "alive", F.lit(0).alias("asks"))
    )
    past = Window.partitionBy("id").orderBy("t", "asks").rowsBetween(Window.unboundedPreceding, 0)
    judged = line.withColumn("was", F.last("alive", ignorenulls=True).over(past)).withColumn("ever", F.max("alive").over(Window.partitionBy("id")))
    status = F.when(F.col("was"), F.lit(None).cast("string")).when(~F.col("was"), "deleted").when(F.col("ever"), "late").otherwise("missing")
    judged = judged.where("asks = 1").select("target", "t", status.alias("status")).where("status is not null")
    return salted(references, judged, ["target", "t"], counts)


def report(found: DataFrame, periods: DataFrame) -> DataFrame:
    """(p, month, status, n): the orphan references of each predicate and month. found: (graph, p,
    status), periods: (graph, month), one row for each graph."""
    counted = found.groupBy("graph", "p", "status").count()
    return counted.join(periods, "graph", "left").groupBy("p", "month", "status").agg(F.sum("count").alias("n"))
