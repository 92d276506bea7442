"""Items into containers of fixed capacity: bound-certified repacking.

Items are spread by hash over groups of about ``PER_GROUP``. Each group is packed by best fit
decreasing in one task, and dual feasible functions give a lower bound of its containers. A group
that meets its bound is certified optimal and stays. The groups with a gap exchange their items (a
new hash over those groups) and are packed again, until all groups of a capacity are certified, one is
left, or a round gains no container; a new packing is kept if it takes fewer containers. Each round but the
last saves a container, so there are no more rounds than the gap has containers.

An item larger than the capacity is cut into full containers and a rest, which is packed like any
other item. Sizes are integers; items of size 0 or null need no container. Equal sizes are taken in
the order of their ids, so the result doesn't depend on the order of rows. Repeated rows are items of
their own.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PER_GROUP = 50_000


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each size; sizes must be sorted from large to small."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # containers by the space left
    open_rooms, n, out = 0, 0, np.empty(len(sizes), np.int64)
    for i, size in enumerate(sizes.tolist()):
        fits = open_rooms >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            c = room[left].pop()
            if not room[left]:
                open_rooms ^= 1 << left
        else:
            left, c, n = capacity, n, n + 1
        out[i] = c
        if left > size:
            if not room[left - size]:
                open_rooms |= 1 << (left - size)
            room[left - size].append(c)
    return out


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """The most that dual feasible functions prove: the threshold functions (large items count
    whole, small ones not at all) and the rounding functions, each over a histogram of the sizes."""
    h = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    s = np.arange(capacity + 1)
    count, total = np.cumsum(h), np.cumsum(h * s)
    best = -(-int(total[-1]) // capacity)
    k = np.arange(1, capacity // 2 + 1)
    large = count[-1] - count[capacity - k]
    middle = total[capacity - k] - total[k - 1]
    if len(k):
        best = max(best, int((large - (-middle // capacity)).max()))
    for m in range(1, 51):
        whole = (m + 1) * s % capacity == 0
        # in units of 1 / (m * capacity)
        f = np.where(whole, m * s, (m + 1) * s // capacity * capacity)
        best = max(best, -(-int((h * f).sum()) // (m * capacity)))
    return best


def _pack(capacity_of: dict[int, int]):
    def run(key, rows):
        rows = rows.sort_values(["n", "id", "part"], ascending=[False, True, True], kind="stable")
        capacity, sizes = capacity_of[int(key[0])], rows["n"].to_numpy()
        rows["bin"] = best_fit_decreasing(sizes, capacity)
        rows["bins"] = int(rows["bin"].max()) + 1
        rows["bound"] = lower_bound(sizes, capacity)
        return rows

    return run


def pack(items: DataFrame, capacities: dict[int, int], cut, per_group: int = PER_GROUP) -> DataFrame:
    """(limit_id, capacity, container, id, part, start, n, optimal_from): which container holds which
    part of which item. items: (id, n). ``cut`` writes a table and reads it again. ``optimal_from`` is
    the lower bound of the containers of the row's group, ``containers`` what it took."""
    capacity_of = {int(k): int(v) for k, v in capacities.items()}
    pairs = F.array(*[F.struct(F.lit(k).alias("limit_id"), F.lit(c).alias("capacity")) for k, c in capacity_of.items()])
    items = cut(items.where("n > 0"))  # sizes are dear and read twice
    each = items.select("id", F.col("n").cast("bigint").alias("size"), F.explode(pairs).alias("l")).select("id", "size", "l.*")
    each = each.withColumn("full", F.floor(F.col("size") / F.col("capacity")).cast("int"))
    full = each.where("full > 0").select("limit_id", "capacity", "id", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("part")).select(
        "limit_id", "capacity", F.concat_ws("-", F.lit("f"), "limit_id", "id", "part", F.monotonically_increasing_id()).alias("container"), "id", "part",
        (F.col("part").cast("bigint") * F.col("capacity")).alias("start"), F.col("capacity").cast("bigint").alias("n"), F.lit(1).cast("bigint").alias("containers"), F.lit(1).cast("bigint").alias("bound"),
    )
    rest = each.withColumn("n", F.col("size") - F.col("full").cast("bigint") * F.col("capacity")).where("n > 0").select("limit_id", "id", F.col("full").alias("part"), "n")
    rest = cut(rest)
    kind = dict(items.dtypes)["id"]
    schema = f"limit_id int, id {kind}, part int, n bigint, round int, grp bigint, bin bigint, bins bigint, bound bigint"
    groups = {r.limit_id: max(1, -(-r["count"] // per_group)) for r in rest.groupBy("limit_id").count().collect()}
    if not groups:
        groups = {k: 1 for k in capacity_of}

    def packed(rows: DataFrame, number: dict[int, int], turn: int) -> DataFrame:
        wide = F.element_at(F.create_map(*[x for k, g in number.items() for x in (F.lit(k), F.lit(g))]), F.col("limit_id"))
        placed = rows.select("limit_id", "id", "part", "n", F.lit(turn).alias("round"), F.pmod(F.xxhash64(F.lit(turn), "id", "part"), wide.cast("bigint")).alias("grp"))
        shaped = placed.select("*", *[F.lit(0).cast("bigint").alias(c) for c in ("bin", "bins", "bound")])
        return cut(shaped.groupBy("limit_id", "grp").applyInPandas(_pack(capacity_of), schema))

    now, kept = packed(rest, groups, 0), []
    for turn in count(1):
        # one row for each group: bounded by the number of groups, items / per_group
        gaps = now.where("bins > bound").select("limit_id", "grp", "bins").distinct()
        sums = {r.limit_id: (r.g, r.b) for r in gaps.groupBy("limit_id").agg(F.count("*").alias("g"), F.sum("bins").alias("b")).collect() if r.g > 1}
        if not sums:
            break
        again = now.where((F.col("bins") > F.col("bound")) & F.col("limit_id").isin(*sums))
        new = packed(again, {k: g for k, (g, _) in sums.items()}, turn)
        totals = {r.limit_id: r.b for r in new.select("limit_id", "grp", "bins").distinct().groupBy("limit_id").agg(F.sum("bins").alias("b")).collect()}
        better = [k for k in sums if totals[k] < sums[k][1]]
        if not better:
            break
        moved = (F.col("bins") > F.col("bound")) & F.col("limit_id").isin(*better)
        kept.append(now.where(~moved))
        now = new.where(F.col("limit_id").isin(*better))
    for more in kept:
        now = now.unionByName(more)
    capacity = F.element_at(F.create_map(*[x for k, c in capacity_of.items() for x in (F.lit(k), F.lit(c))]), F.col("limit_id"))
    out = now.select(
        "limit_id", capacity.alias("capacity"), F.concat_ws("-", "limit_id", "round", "grp", "bin").alias("container"), "id", "part",
        (F.col("part").cast("bigint") * capacity).alias("start"), "n", F.col("bins").alias("containers"), "bound",
    )
    return out.unionByName(full)
