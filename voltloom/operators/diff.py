"""Comparison of two graphs and of what they describe. Each is a join on keys, never a loop over one
side; outputs are the five text columns item, rdf_type, property, value_a, value_b."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The mark of a missing value, and the datatypes that compare by value.
NONE = "N/A"
NUMERIC = ("xsd:decimal", "xsd:integer", "xsd:float")


def _types(t: DataFrame) -> DataFrame:
    return t.where("p = 'rdf:type'").groupBy("s").agg(F.min("o").alias("rdf_type"))


def _values(t: DataFrame) -> DataFrame:
    number = F.col("o_dt").isin(*NUMERIC)
    # an approximate number is compared as a double, text of comments without its language tag
    v = F.when(number, F.coalesce(F.expr("try_cast(o AS double)").cast("string"), F.col("o"))).otherwise(F.col("o"))
    return t.where("p <> 'rdf:type' and o is not null and o <> ''").groupBy("s", "p", v.alias("v")).agg(F.min("o").alias("o"))


def graph_diff(a: DataFrame, b: DataFrame, skip: Iterable[str] = ()) -> DataFrame:
    """(item, rdf_type, property, value_a, value_b) of two graphs (s, p, o, o_dt): values that only one
    side has, and a 'New' row for each subject that only one side has with its type. Subjects of the
    types in ``skip`` are left out. One full join on (s, p, value), one on (s, type)."""
    skip = list(skip)
    ta, tb = (_types(t).where(~F.col("rdf_type").isin(*skip)) if skip else _types(t) for t in (a, b))
    both = ta.withColumnRenamed("rdf_type", "type_a").join(tb.withColumnRenamed("rdf_type", "type_b"), "s", "full")
    kind = F.coalesce("type_a", "type_b")
    new = both.where("not type_a <=> type_b").select(
        F.col("s").alias("item"), kind.alias("rdf_type"), F.lit("New").alias("property"),
        F.coalesce("type_a", F.lit(NONE)).alias("value_a"), F.coalesce("type_b", F.lit(NONE)).alias("value_b"),
    )
    va, vb = _values(a), _values(b)
    cells = va.withColumnRenamed("o", "a").join(vb.withColumnRenamed("o", "b"), ["s", "p", "v"], "full").where("a is null or b is null")
    # a changed single value is one row, not two
    cells = cells.groupBy("s", "p").agg(F.array_sort(F.collect_set("a")).alias("a"), F.array_sort(F.collect_set("b")).alias("b"))
    single = (F.size("a") == 1) & (F.size("b") == 1)
    pair = lambda x, y: F.struct(x.alias("value_a"), y.alias("value_b"))
    rows = F.when(single, F.array(pair(F.get("a", F.lit(0)), F.get("b", F.lit(0))))).otherwise(
        F.concat(F.transform("a", lambda x: pair(x, F.lit(NONE))), F.transform("b", lambda x: pair(F.lit(NONE), x)))
    )
    changed = cells.join(both.select("s", kind.alias("rdf_type")), "s").select(F.col("s").alias("item"), "rdf_type", F.col("p").alias("property"), F.inline(rows))
    return new.unionByName(changed)


def class_counts(t: DataFrame) -> DataFrame:
    """(cls, n): distinct subjects of each type."""
    return t.where("p = 'rdf:type'").select("s", F.col("o").alias("cls")).distinct().groupBy("cls").agg(F.count("*").alias("n"))


def count_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    x, y = class_counts(a).withColumnRenamed("n", "n_a"), class_counts(b).withColumnRenamed("n", "n_b")
    j = x.join(y, "cls", "full").select("cls", F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"))
    return j.withColumn("status", F.when(F.col("n_a") == F.col("n_b"), "Same - Compare class count").otherwise("Different - Compare class count"))


def profile_diff(a: DataFrame, b: DataFrame, key: str, fields: Iterable[str]) -> DataFrame:
    """(key, field, value_a, value_b): wide descriptions of schema elements, matched by ``key`` (a local
    name, so a changed namespace is itself a difference), fields unpivoted; a missing value is '-'."""

    def tall(t: DataFrame, name: str) -> DataFrame:
        rows = F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f), F.lit("-")).alias(name)) for f in fields])
        return t.select(key, F.inline(rows))

    j = tall(a, "value_a").join(tall(b, "value_b"), [key, "field"], "full")
    j = j.select(key, "field", F.coalesce("value_a", F.lit("-")).alias("value_a"), F.coalesce("value_b", F.lit("-")).alias("value_b"))
    return j.where("value_a <> value_b")


def nearest(a: DataFrame, b: DataFrame, key: list[str], value: str, ids: tuple[str, str], pieces: int = 200) -> DataFrame:
    """Each row of a with the row of b of the same key whose value is nearest (of equals the smaller
    id). Rows without key or value, and keys that b lacks, have none.

    No pairs are made: both sides lie in order of their values, and a row's neighbours are the last value
    of b before it and the first one behind it. A key is cut into ranges of values that hold about as
    many rows each, so that no task sorts a hot one; neighbours beyond a range come from one row a range."""
    x = a.select(*key, F.col(value).alias("v"), F.col(ids[0]).alias("id_a"), F.lit(None).cast(dict(b.dtypes)[ids[1]]).alias("id_b"))
    y = b.where(F.col(value).isNotNull()).groupBy(*key, F.col(value).alias("v")).agg(F.min(ids[1]).alias("id_b"))
    both = x.where("v is not null").unionByName(y.withColumn("id_a", F.lit(None).cast(dict(a.dtypes)[ids[0]])))
    shares = F.array(*[F.lit(i / pieces) for i in range(1, pieces)])
    bounds = both.agg(F.percentile_approx("v", shares, 10_000).alias("b")).first().b or []
    if bounds:
        limits = F.array(*[F.lit(v) for v in sorted(set(bounds))])
        both = both.withColumn("part", F.size(F.filter(limits, lambda u: u < F.col("v"))))
    else:
        both = both.withColumn("part", F.lit(0))
    own = F.when(F.col("id_b").isNotNull(), F.struct("v", "id_b"))
    edges = both.groupBy(*key, "part").agg(F.max(own).alias("last"), F.min(own).alias("first"))
    line = Window.partitionBy(*key).orderBy("part")
    edges = edges.select(
        *key, "part", F.last("last", True).over(line.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.first("first", True).over(line.rowsBetween(1, Window.unboundedFollowing)).alias("behind")
    )
    up = Window.partitionBy(*key, "part").orderBy("v")
    down = Window.partitionBy(*key, "part").orderBy(F.desc("v"))
    near = both.select("*", F.last(own, True).over(up).alias("low"), F.last(own, True).over(down).alias("high")).where("id_a is not null")
    near = near.join(edges, [*key, "part"]).withColumn("low", F.coalesce("low", "before")).withColumn("high", F.coalesce("high", "behind"))
    far = lambda c: F.abs(F.col("v") - F.col(f"{c}.v"))
    as_high = F.col("low").isNull() | (far("high") < far("low")) | ((far("high") == far("low")) & (F.col("high.id_b") < F.col("low.id_b")))
    best = F.when(F.col("high").isNotNull() & as_high, F.col("high")).otherwise(F.col("low"))
    return near.withColumn("best", best).where("best is not null").select(*key, "id_a", F.col("v").alias("value_a"), "best.id_b", F.col("best.v").alias("value_b"))


def overlap_first(a: DataFrame, b: DataFrame, member: str) -> DataFrame:
    """(id_a, id_b): the smallest b that shares a member with a. a, b: (id, member)."""
    j = a.select(F.col("id").alias("id_a"), member).join(b.select(F.col("id").alias("id_b"), member), member)
    return j.groupBy("id_a").agg(F.min("id_b").alias("id_b"))


def undirected(df: DataFrame, one: str, other: str, flow: str) -> DataFrame:
    """The pair in the order of its names, the flow's sign turned with it."""
    turned = F.col(one) > F.col(other)
    return df.select(F.least(one, other).alias("n1"), F.greatest(one, other).alias("n2"), F.when(turned, -F.col(flow)).otherwise(F.col(flow)).alias("flow"))


def solution_stats(pairs: DataFrame, by: str, a: Column, b: Column) -> DataFrame:
    """(by, n, largest, mean) of the absolute differences that aren't 0, rounded to 2 places."""
    d = F.abs(a - b)
    return pairs.withColumn("__d", d).where("__d <> 0").groupBy(by).agg(F.count("*").alias("n"), F.round(F.max("__d"), 2).alias("largest"), F.round(F.avg("__d"), 2).alias("mean"))


def first_per(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")
