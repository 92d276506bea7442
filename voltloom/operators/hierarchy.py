"""Parent-child links to full hierarchies.

Blocks of links that lie together are peeled in one task each, leaves first: a peeled node hands
its subtree size to its parent; the reverse of the peel order gives every node the path to the
top of its block, and what can't be peeled is a cycle. A block's top that has its own link in
another block is then a node of a much smaller forest of block tops, which is resolved by pointer jumping, in
rounds that grow with the logarithm of its depth; the two results are joined. No group is larger than
about ``block`` links, and paths are made in batches as their rows are handed on.

Defined results: rows with a null or blank child or parent are no links; repeated links count once;
a node with several parents keeps the smallest one and has ``several`` true (the others remain
nodes); a link to itself is a cycle of one; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import namespace, not_blank, pick
from ..sources.tables import cut

#: Links that one block holds at most; a namespace with more is split by hash.
BLOCK = 200_000
#: Rows and steps of paths that are handed on at a time.
CELLS = 500_000

_LOCAL = "p string, node string, parent string, several boolean, top string, height int, steps array<string>, below bigint, state int"


def _peel(child: np.ndarray, parent: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, list[int], np.ndarray]:
    """Leaf peeling of links child -> parent among nodes 0..n-1, one parent a node.
    Top (-1 on or under a cycle) and subtree size of each node, the peel order, and the mark of
    nodes on a cycle."""
    up = np.full(n, -1, np.int64)
    up[child] = parent
    left = np.bincount(parent, minlength=n).tolist()
    size = np.zeros(n, np.int64).tolist()
    above = up.tolist()
    order = [i for i in range(n) if not left[i]]
    for i in order:  # grows while it is walked: leaves first, then what became a leaf
        if (j := above[i]) >= 0:
            size[j] += size[i] + 1
            left[j] -= 1
            if not left[j]:
                order.append(j)
    cyclic = np.ones(n, bool)
    cyclic[order] = False
    top = [-1] * n
    for i in reversed(order):
        j = above[i]
        top[i] = i if j < 0 else top[j]
    return np.array(top), np.array(size), order, cyclic


_KINDS = {"height": pa.int32(), "state": pa.int32(), "below": pa.int64(), "several": pa.bool_(), "steps": pa.list_(pa.string())}


def _emit(p: str, nodes: list, parents: list, several: list, wanted: list):
    """One row for each link of a block, in batches of bounded size: a path is made when its row is."""
    import pandas as pd

    codes, names = pd.factorize(pd.Series([*nodes, *parents], dtype=object))
    child, parent = codes[: len(nodes)], codes[len(nodes) :]
    top, size, order, cyclic = _peel(child, parent, len(names))
    above = [-1] * len(names)
    for c, q in zip(child.tolist(), parent.tolist()):
        above[c] = q
    height = [0] * len(names)
    for i in reversed(order):  # the reverse of the peel order: parents first
        if above[i] >= 0 and top[i] >= 0:
            height[i] = height[above[i]] + 1

    def steps(i: int, want: bool) -> list | None:
        if top[i] < 0 or not want:
            return None
        out = []
        while above[i] >= 0:
            out.append(names[i])
            i = above[i]
        return out[::-1]

    rows, cells = {k: [] for k in ("p", "node", "parent", "several", "top", "height", "steps", "below", "state")}, 0
    for k, i in enumerate(child.tolist()):
        state = -1 if cyclic[i] else -2 if top[i] < 0 else 0
        own = (p, nodes[k], parents[k], several[k], names[top[i]] if top[i] >= 0 else None, height[i], steps(i, wanted[k]), int(size[i]), state)
        for col, v in zip(rows.values(), own):
            col.append(v)
        cells += 1 + (height[i] if wanted[k] else 0)
        if cells >= CELLS:
            yield _batch(rows)
            rows, cells = {c: [] for c in rows}, 0
    if rows["p"]:
        yield _batch(rows)


def _batch(rows: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, _KINDS.get(k, pa.string())) for k, v in rows.items()], names=list(rows))


def _blocks(batches):
    """Links sorted by block -> one row for each link, with the way to its top."""
    held, now = ([], [], [], []), None
    for b in batches:
        d = b.to_pydict()
        for p, key, *link in zip(d["p"], d["key"], d["node"], d["parent"], d["several"], d["wanted"]):
            if (p, key) != now:
                if held[0]:
                    yield from _emit(now[0], *held)
                held, now = ([], [], [], []), (p, key)
            for col, v in zip(held, link):
                col.append(v)
    if held[0]:
        yield from _emit(now[0], *held)


def _local(links: DataFrame, block: int, wanted: Column) -> DataFrame:
    """Links with their way to the top of their block, the steps of the way where they are wanted. Links
    of one namespace lie together; a large one is split by hash, small ones share a block."""
    placed = links.withColumn("ns", namespace(F.col("node"))).withColumn("wanted", wanted)
    hot = placed.groupBy("p", "ns").count().where(F.col("count") > block)
    parts = hot.select(F.col("p").alias("hp"), F.col("ns").alias("hns"), F.ceil(F.col("count") / block).alias("parts"))
    shared = F.lit(max(1, 8 * links.count() // block)).cast("bigint")
    key = F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("ns"), shared)).otherwise(F.xxhash64("ns", F.pmod(F.xxhash64("node"), F.col("parts"))))
    placed = (
        placed.join(parts, (F.col("p") == F.col("hp")) & (F.col("ns") == F.col("hns")), "left")
        .select("p", "node", "parent", "several", "wanted", key.alias("key"))
    )
    return placed.repartition("p", "key").sortWithinPartitions("p", "key").mapInArrow(_blocks, _LOCAL)


def _pairs(rows: DataFrame, p: str, node: str, parent: str) -> DataFrame:
    return (
        pick(rows, *dict.fromkeys((p, node, parent)))
        .select(F.col(p).alias("p"), F.col(node).alias("node"), F.col(parent).alias("parent"))
        .where(F.col("p").isNotNull() & not_blank(F.col("node")) & not_blank(F.col("parent")))
    )


def links(rows: DataFrame, p: str, node: str, parent: str) -> DataFrame:
    """(p, node, parent, several): one link for each node."""
    return (
        _pairs(rows, p, node, parent)
        .groupBy("p", "node")
        .agg(F.min("parent").alias("parent"), F.max("parent").alias("last"))
        .select("p", "node", "parent", (F.col("parent") != F.col("last")).alias("several"))
    )


def hierarchy(rows: DataFrame, p: str = "p", node: str = "node", parent: str = "parent", block: int = BLOCK, paths: bool = True) -> DataFrame:
    """One row for each node of each ``p``: parent (null for a root), root, depth, path (array from
    the root to the node), below (number of all nodes under it), several and status: '' for a tree,
    'cycle' for a node on a cycle, 'under_cycle' for one whose links lead into one; those have no
    root, depth (null) and path, and below counts only what is under them in their block.

    Without ``paths``, path and below are left out and nothing grows with the depth of the trees."""
    found = cut(links(rows, p, node, parent))
    local = cut(_local(found, block, F.lit(paths)))
    tops = local.where("top is not null").groupBy("p", F.col("top").alias("t")).agg(F.count("*").alias("own"))
    # links of block tops: the forest that is left
    up = cut(
        tops.join(local.withColumnRenamed("p", "lp"), (F.col("p") == F.col("lp")) & (F.col("t") == F.col("node")), "left")
        .select("p", "t", "own", F.col("top").alias("next"), "steps", F.coalesce("height", F.lit(0)).alias("height"), F.coalesce("state", F.lit(0)).alias("state"), F.col("node").isNull().alias("root"))
    )
    edges = up.where("not root and state = 0").select("p", "t", "own", "next", "steps")
    now = up.select(
        "p", "t", F.when(~F.col("root") & (F.col("state") == 0), F.col("next")).alias("next"), F.when(F.col("root"), F.col("t")).alias("r"),
        F.col("height").cast("bigint").alias("far"), F.when(F.col("state") < 0, -2).otherwise(0).alias("st"),
    )
    now, left = _jumped(now, {"far": lambda above, own: above + own})
    circle = None
    if left:  # what reaches no root runs in or into a circle of blocks: peel its leaves
        rest = up.join(now.where("next is not null").select("p", "t"), ["p", "t"], "left_semi").select("p", "t", "next")
        ring, size = rest, left
        while True:
            ring = cut(ring.join(ring.select("p", F.col("next").alias("t")).distinct(), ["p", "t"], "left_semi"))
            if (n := ring.count()) == size or not n:
                break
            size = n
        if paths:
            ring = ring.join(up.select("p", "t", "steps"), ["p", "t"])
        else:  # the same blocks again, with the steps of the circle's tops
            marked = found.join(ring.select("p", F.col("t").alias("node"), F.lit(True).alias("asked")), ["p", "node"], "left")
            steps = _local(marked, block, F.coalesce("asked", F.lit(False))).where("steps is not null")
            ring = steps.select("p", "steps")
        circle = ring.select("p", F.explode("steps").alias("node"), F.lit(True).alias("ring")).distinct()
    ways = now.select("p", "t", F.when(F.col("next").isNull(), F.col("r")).alias("r"), "far", F.when(F.col("next").isNotNull(), -2).otherwise(F.col("st")).alias("st"))
    if paths:
        tree = ways.where("r is not null").select("p", "t").join(up.select("p", "t", "next", "steps", "root"), ["p", "t"])
        tree = cut(tree.select("p", "t", F.when(~F.col("root"), F.col("next")).alias("next"), F.when(F.col("root"), F.array("t")).otherwise(F.col("steps")).alias("way")))
        tree, _ = _jumped(tree, {"way": lambda above, own: F.concat(above, own)})
        ways = ways.join(tree.select("p", "t", "way"), ["p", "t"], "left")
    else:
        ways = ways.withColumn("way", F.lit(None).cast("array<string>"))
    ways = cut(ways)
    ways = ways.select(F.col("p").alias("wp"), F.col("t").alias("wt"), "r", "way", "far", "st")
    out = local.join(ways, (F.col("p") == F.col("wp")) & (F.col("top") == F.col("wt")), "left").select(
        "p", "node", "parent", "several", F.col("r").alias("root"), F.concat("way", "steps").alias("path"), "below",
        F.when(F.col("state") < 0, F.col("state")).otherwise(F.coalesce("st", F.lit(0))).alias("state"), (F.col("far") + F.col("height")).alias("depth"),
    )
    if circle is not None:
        out = out.join(circle, ["p", "node"], "left").withColumn("state", F.when(F.col("ring"), -1).otherwise(F.col("state"))).drop("ring")
    none = F.lit(None).cast("string")
    roots = tops.join(found.select("p", F.col("node").alias("t")), ["p", "t"], "left_anti").select(
        "p", F.col("t").alias("node"), none.alias("parent"), F.lit(False).alias("several"), F.col("t").alias("root"), F.array("t").alias("path"), F.lit(0).cast("bigint").alias("below"), F.lit(0).alias("state"), F.lit(0).cast("bigint").alias("depth")
    )
    out = out.unionByName(roots)
    if not found.where("several").isEmpty():  # parents that were not kept are nodes too
        every = _pairs(rows, p, node, parent).select("p", F.col("parent").alias("node")).distinct()
        alone = every.join(found.select("p", "node").unionByName(roots.select("p", "node")), ["p", "node"], "left_anti")
        out = out.unionByName(
            alone.select("p", "node", none.alias("parent"), F.lit(False).alias("several"), F.col("node").alias("root"), F.array("node").alias("path"), F.lit(0).cast("bigint").alias("below"), F.lit(0).alias("state"), F.lit(0).cast("bigint").alias("depth"))
        )
    status = F.when(F.col("state") == -1, "cycle").when(F.col("state") == -2, "under_cycle").otherwise("")
    tree = F.col("state") == 0
    cols = ["p", "node", "parent", "several", F.when(tree, F.col("root")).alias("root"), F.when(tree, F.col("depth")).alias("depth")]
    if not paths:
        return out.select(*cols, status.alias("status"))
    # sizes: a node's own block, what hangs on it as the top of other blocks, and the same of the tops under it
    tops_path = edges.select("p", "t", "own").join(ways, (F.col("p") == F.col("wp")) & (F.col("t") == F.col("wt"))).where("way is not null")
    more = tops_path.select("p", F.explode(F.expr("slice(way, 1, size(way) - 1)")).alias("node"), "own").unionByName(tops.select("p", F.col("t").alias("node"), "own"))
    more = more.groupBy("p", "node").agg(F.sum("own").alias("more"))
    out = out.join(more, ["p", "node"], "left")
    return out.select(*cols, F.when(tree, F.col("path")).alias("path"), (F.col("below") + F.coalesce("more", F.lit(0))).alias("below"), status.alias("status"))


def _jumped(now: DataFrame, gathered: dict) -> tuple[DataFrame, int]:
    """(p, t, next, ...) after pointer jumping, and how many rows reach no end: each round, a row whose next
    isn't null takes its next's next and what that gathered, so rounds grow with the logarithm of the
    longest way. A round that ends no way is the last: what is left runs in circles."""
    left = now.where("next is not null").count()
    passed = [c for c in now.columns if c not in ("p", "t", "next", *gathered)]
    while left:
        other = now.select(F.col("p").alias("q"), F.col("t").alias("u"), *[F.col(c).alias(f"{c}_") for c in now.columns if c not in ("p", "t")])
        j = now.where("next is not null").join(other, (F.col("p") == F.col("q")) & (F.col("next") == F.col("u")))
        new = j.select("p", "t", F.col("next_").alias("next"), *[F.col(f"{c}_").alias(c) for c in passed], *[f(F.col(f"{c}_"), F.col(c)).alias(c) for c, f in gathered.items()])
        now = cut(now.where("next is null").unionByName(new))
        before, left = left, now.where("next is not null").count()
        if left == before:
            break
    return now, left


def descendants(nodes: DataFrame) -> DataFrame:
    """All nodes under each node, one row for each pair, from the paths of ``hierarchy``: a list of
    them in one row would not be bounded."""
    return nodes.where("status = ''").select(
        "p", F.posexplode(F.expr("slice(path, 1, size(path) - 1)")).alias("at", "ancestor"), "node", "depth"
    ).select("p", "ancestor", "node", (F.col("depth") - F.col("at")).alias("distance"))
