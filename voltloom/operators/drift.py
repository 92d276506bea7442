"""Schemas that drift between files: one consistent table, and every change between the files of a
series.

Each file's field types are read in parallel, straight from its records (the text of a record is
parsed to a variant in the JVM), and folded through a lattice of types: null is below all; number,
boolean, array and object are each below string, so fields of mixed types become text. Fields
that were renamed go to one column. All files are cast to that schema, and the changes are logged in
order of the files.

Defined results: a line that is null or no complete JSON object is skipped; of a key named twice the last value counts; a repeated line counts
once; of several values of one item and field in a file the smallest by type and hash counts; equal
counts of two types are settled by the order of ``TYPES``; a file without complete records has no
fields; a record without ``item`` puts its fields into its file, but is no evidence for a
rename and gives a type only where no item has one; fields beyond
``max_columns`` go to one JSON column.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ids import pick
from ..sources.tables import cut

#: The JSON types, in the order that settles ties.
TYPES = ("string", "number", "boolean", "array", "object")


_SORTED = sorted(TYPES)
_HASH = (1 << 60) - 1


def json_type(text: Column) -> Column:
    """The JSON type of a value's JSON text, as its place in _SORTED; null for null."""
    first = F.substring(text, 1, 1)
    of = {t: F.lit(i) for i, t in enumerate(_SORTED)}
    return (
        F.when(first == '"', of["string"]).when(first == "{", of["object"]).when(first == "[", of["array"])
        .when(first.isin("t", "f"), of["boolean"]).when(first != "n", of["number"])
    )


def complete(record: Column) -> Column:
    """An array of the record as a variant if it is one complete JSON object, else of null."""
    # the parser stops after a text's first value and doesn't see what follows; in brackets it does
    several = F.try_parse_json(F.when(F.ltrim(record, F.lit(" \t\r\n")).startswith("{"), F.concat(F.lit("["), record, F.lit("]"))))
    # named in a lambda function, so that it is parsed once
    return F.transform(F.array(several), lambda x: F.when(F.try_variant_get(x, "$[1]", "variant").isNull(), F.try_variant_get(x, "$[0]", "variant")))


@contextmanager
def repeated_keys(spark: SparkSession):
    """In here records may name a key twice. Spark reads the setting when it makes a plan, and again when it copies one."""
    key = "spark.sql.variant.allowDuplicateKeys"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def parsed(records: DataFrame) -> DataFrame:
    """The complete records with their variant v."""
    with repeated_keys(records.sparkSession):
        # a generator, for a filter would parse each record once more
        # (array_compact would name its lambda anew in each copy of the plan, and no two would share a shuffle)
        return records.withColumn("v", F.explode(F.filter(complete(F.col("record")), lambda x: x.isNotNull()))).drop("record")


def values(records: DataFrame, broad: bool = False) -> DataFrame:
    """(series, file, item, lone, field, packed[, broad]): one row for each non-null field of each complete
    record, together by file. item: a hash; lone: whether the record has none. packed: the value's JSON type
    from bit 60 on, and a hash of its JSON text; broad: whether it is a number that needs double.

    What is shuffled is fixed in size but for names, whatever the size of the values, and is not
    aggregated before: in a file's own order the names of a row are those of the row before it and take
    next to nothing compressed, in the order of a hash table they take three times as much."""
    r = parsed(pick(records, "series", "file_name", "record").where("series is not null and file_name is not null"))
    r = r.select("series", F.col("file_name").alias("file"), F.xxhash64(F.expr("try_variant_get(v, '$.item', 'string')")).alias("item"), F.expr("try_variant_get(v, '$.item', 'string') IS NULL").alias("lone"), "v")
    rows = r.lateralJoin(records.sparkSession.tvf.variant_explode(F.col("v").outer()).select("key", "value"))
    text = rows.where("key <> 'item'").select("series", "file", "item", "lone", F.col("key").alias("field"), F.to_json("value").alias("text"))
    kind = json_type(F.col("text"))
    packed = F.shiftleft(kind.cast("bigint"), 60).bitwiseOR(F.xxhash64("text").bitwiseAND(F.lit(_HASH)))
    number = (kind == F.lit(_SORTED.index("number"))) & (F.col("text").rlike("[.eE]") | (F.length("text") > 18))
    rows = text.select("series", "file", "item", "lone", "field", packed.alias("packed"), *[number.cast("int").alias("broad")] * broad)
    return rows.where("packed is not null").repartition("series", "file")


def facts(rows: DataFrame) -> DataFrame:
    """(series, file, item, field, packed, items[, broad], n) of the rows of ``values``, which stay where they
    are: the fields of each item of each file, and each value of the records without item. items: 1, or 0
    of records without item; n: how many records have it.

    Filters go by ``items`` and not by ``lone``: Spark would move those below the shuffle, where it
    could no longer be read by all that need it."""
    broad = [F.max("broad").alias("broad")] if "broad" in rows.columns else []
    return rows.groupBy("series", "file", "item", "lone", "field", F.when(F.col("lone"), F.col("packed")).alias("own")).agg(
        F.min("packed").alias("packed"), F.max((~F.col("lone")).cast("int")).alias("items"), *broad, F.count("*").alias("n")
    ).drop("own", "lone")


def _type(packed: str = "packed") -> Column:
    return F.element_at(F.array(*map(F.lit, _SORTED)), F.shiftright(packed, 60).cast("int") + F.lit(1))


def file_schemas(found: DataFrame) -> DataFrame:
    """(series, file, field, type): the most frequent type of a field in a file, of its items if any."""
    rank = F.element_at(F.create_map(*[x for i, t in enumerate(TYPES) for x in (F.lit(t), F.lit(-i))]), F.col("type"))
    return (
        found.groupBy("series", "file", "field", _type().alias("type")).agg(F.sum("items").alias("items"), F.sum("n").alias("n"))
        .groupBy("series", "file", "field").agg(F.max_by("type", F.struct("items", F.when(F.col("items") == 0, F.col("n")).otherwise(0), rank)).alias("type"))
    )


def _changes(records: DataFrame, least_items: int, share: float) -> DataFrame:
    """(series, file, change, field, new_field): the renames, and all fields that come, go or change type.

    One plan reads the shuffled rows of ``values`` more than once, for the files' types and for the values of
    the fields that come or go. Joins are named: Spark takes the fields of a variant for a small part
    of it (by its estimate 25 times too small) and would send them all to the driver for a broadcast."""
    found = facts(values(records))
    schemas = file_schemas(found)
    files = pick(records, "series", "file_name", "exported_at").groupBy("series", F.col("file_name").alias("file")).agg(F.min("exported_at").alias("at"))
    w = Window.partitionBy("series").orderBy("at", "file")
    # a file counts in the step to it and in the one from it; cut, for a table read twice in a plan keeps aliases in one place only
    step = lambda to, before, new: F.when(to.isNotNull() & before.isNotNull(), F.struct(to.alias("to"), before.alias("before"), F.lit(new).alias("new")))
    here, last, following = F.col("file"), F.lag("file").over(w), F.lead("file").over(w)
    steps = cut(files.select("series", "file", F.array_compact(F.array(step(here, last, True), step(following, here, False))).alias("steps")))
    there = schemas.join(steps.hint("merge"), ["series", "file"]).select("series", "field", "type", F.inline("steps").alias("file", "before", "is_new"))
    both = there.groupBy("series", "file", "before", "field").agg(F.max(F.when(~F.col("is_new"), F.col("type"))).alias("old"), F.max(F.when(F.col("is_new"), F.col("type"))).alias("new"))
    both = both.where("old is null or new is null or old <> new")
    # where values are needed: of a field that goes, in the file before; of one that comes, in the file itself
    at = F.when(F.col("new").isNull(), F.col("before")).when(F.col("old").isNull(), F.col("file"))
    needed = both.select("series", at.alias("at_file"), F.struct("field", F.col("file").alias("to"), F.col("new").isNull().alias("goes")).alias("x")).where("at_file is not null")
    # a row for each file, so that the values need not be shuffled by field as well
    needed = needed.groupBy("series", F.col("at_file").alias("file")).agg(F.collect_list("x").alias("needed")).hint("shuffle_hash")
    used = found.where("items > 0").select("series", "file", "field", "item", "packed").join(needed, ["series", "file"])
    used = used.select("series", "item", "packed", F.inline(F.filter("needed", lambda x: x["field"] == F.col("field"))).alias("field", "to", "goes"))
    value = F.struct("field", "packed")
    items = used.groupBy("series", F.col("to").alias("file"), "item").agg(F.collect_list(F.when(F.col("goes"), value)).alias("gone"), F.collect_list(F.when(~F.col("goes"), value)).alias("come"))
    items = items.where("size(gone) > 0 and size(come) > 0").select("series", "file", "come", F.inline("gone").alias("field", "was"))
    renamed = (
        items.select("series", "file", "field", "was", F.inline("come").alias("new_field", "is"))
        .groupBy("series", "file", "field", "new_field")
        .agg(F.count("*").alias("n"), F.sum((F.col("was") == F.col("is")).cast("bigint")).alias("same"))
        .where((F.col("n") >= least_items) & (F.col("same") >= F.col("n") * share))
    )
    change = F.when(F.col("new").isNull(), "removed").when(F.col("old").isNull(), "added").otherwise("type_changed")
    # new names for what comes out, else the plan keeps those of the first copy of its shuffle and can't share that
    out = both.select(F.col("series").alias("series"), F.col("file").alias("file"), change.alias("change"), F.col("field").alias("field"), F.lit("").alias("new_field"))
    return out.unionByName(renamed.select("series", "file", F.lit("renamed").alias("change"), "field", "new_field"))


def changes(records: DataFrame, least_items: int = 3, share: float = 0.9) -> DataFrame:
    """(series, file_name, change, field, new_field): each change between a file and the one before
    it in its series by exported_at, files of one instant by name."""
    with repeated_keys(records.sparkSession):
        out = cut(_changes(records, least_items, share))
    renamed = out.where("change = 'renamed'")
    taken = renamed.select("series", "file", F.lit("removed").alias("change"), "field").unionByName(
        renamed.select("series", "file", F.lit("added").alias("change"), F.col("new_field").alias("field"))
    ).distinct()
    plain = out.where("change <> 'renamed'").join(taken.hint("merge"), ["series", "file", "change", "field"], "left_anti")
    return (
        plain.unionByName(renamed)
        .select("series", F.col("file").alias("file_name"), "change", "field", "new_field")
    )


def canonical_names(renames: list[tuple[str, str, int]], weight: dict[str, int], least: int = 2) -> dict[str, str]:
    """Field -> the most frequent name of all that it was renamed to or from in ``least`` files."""
    root = {f: f for f in weight}

    def find(x: str) -> str:
        while root[x] != x:
            x = root[x]
        return x

    for a, b, n in renames:
        if n >= least and a in root and b in root:
            x, y = find(a), find(b)
            if x != y:
                x, y = sorted((x, y), key=lambda f: (-weight[f], f))
                root[y] = x
    return {f: find(f) for f in root}


def consistent(records: DataFrame, max_columns: int = 500) -> DataFrame:
    """All complete records in one table: series, file_name, line_no, item and one column for each
    field, of the lowest type that holds all its values; renamed fields share a column. Repeated
    lines stay. What is gathered at the driver is one row for each distinct field name."""
    types = cut(facts(values(records, broad=True)).groupBy("field", _type().alias("type")).agg(F.sum("items").alias("n"), F.max("broad").alias("broad")))
    top = types.groupBy("field").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "field").limit(max_columns)
    known = {r.field: r.n for r in top.collect()}
    kinds: dict[str, dict[str, int]] = {}
    for r in types.join(top.select("field"), "field").collect():
        kinds.setdefault(r.field, {})[r.type] = r.broad
    log = changes(records).where("change = 'renamed'").groupBy("field", "new_field").count()
    log = log.join(top.select("field"), "field").join(top.select(F.col("field").alias("new_field")), "new_field")
    names = canonical_names([(r.field, r.new_field, r["count"]) for r in log.collect()], known)
    groups: dict[str, list[str]] = {}
    for f in sorted(known, key=lambda f: (-known[f], f)):
        groups.setdefault(names[f], []).append(f)
    v, taken = F.col("v"), {"series", "file_name", "line_no", "item", "other_fields"}
    r = parsed(pick(records, "series", "file_name", "line_no", "record"))
    cols = []
    for name, fields in groups.items():
        seen = {k: b for f in fields for k, b in kinds[f].items()}
        kind = promote(seen)
        out = base = "".join(c if c.isalnum() else "_" for c in name.strip().lower()).strip("_") or "field"
        i = 2
        while out in taken:
            out, i = f"{base}_{i}", i + 1
        taken.add(out)
        paths = [F.try_variant_get(v, "$[" + _quoted(f) + "]", kind) for f in fields]
        cols.append(F.coalesce(*paths).alias(out))
    lone = "try_variant_get(v, '$.item', 'string')"
    return r.select("series", "file_name", "line_no", F.expr(lone).alias("item"), *cols, F.when(F.lit(len(known) >= max_columns), F.to_json("v")).alias("other_fields"))


def _quoted(name: str) -> str:
    return '"' + name.replace("\\", "\\\\").replace('"', '\\"') + '"'


def promote(seen: dict[str, int]) -> str:
    """The lowest column type above all JSON types seen; broad numbers need double."""
    if set(seen) == {"boolean"}:
        return "boolean"
    if set(seen) == {"number"}:
        return "double" if seen["number"] else "bigint"
    return "string"
