"""The queries of the data-processing problems 1 to 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import expand, not_blank, object_id, one_spaced, pick, readable, trimmed
from ..operators import drift as D
from ..operators import hierarchy as H
from ..operators import orphans as O
from ..operators import reconcile as R
from ..operators import wide as W
from ..sources.tables import table

#: The two hierarchy fields.
LINKS = ("rdfs:subClassOf", "cims:belongsToCategory")


def _links(spark: SparkSession, d: str) -> DataFrame:
    t = pick(table(spark, d, "triples"), "graph", "s", "p", "o").where(F.col("p").isin(*LINKS) & not_blank(F.col("o")))
    t = t.withColumn("s", object_id(F.col("s"))).distinct()
    return expand(t, table(spark, d, "prefixes"), "o").select("p", F.col("s").alias("node"), F.col("o").alias("parent"))


def p1_nodes(spark: SparkSession, d: str) -> DataFrame:
    nodes = H.hierarchy(_links(spark, d))
    return nodes.withColumn("path", F.array_join("path", " > "))


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    return H.descendants(H.hierarchy(_links(spark, d)))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    depth = F.when(F.col("status") == "cycle", -1).when(F.col("status") == "under_cycle", -2).otherwise(F.col("depth"))
    return H.hierarchy(_links(spark, d), paths=False).select("p", "node", F.coalesce("root", F.lit("")).alias("root"), depth.cast("bigint").alias("depth"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return D.changes(table(spark, d, "description_exports"))


def p2_consistent(spark: SparkSession, d: str) -> DataFrame:
    return D.consistent(table(spark, d, "description_exports"))


#: The two required booleans and the types that require them.
REQUIRED = {
    "cim:SvSwitch": ["cim:SvSwitch.open"],
    "cim:Terminal": ["cim:ACDCTerminal.connected"],
    "cim:ACDCConverterDCTerminal": ["cim:ACDCTerminal.connected"],
}
#: Wide tables are made of graphs with these marks in their names.
PROFILES = "_(SV|SSH)_"
#: Attributes that a datatype map may declare before its table is no longer read at the driver.
MAX_DECLARED = 2_000


def declared(spark: SparkSession, d: str) -> dict[str, str]:
    """The datatype map, one row for each attribute; of several datatypes the smallest counts."""
    t = pick(table(spark, d, "datatype_map"), "p", "dt").where("p is not null").groupBy("p").agg(F.min("dt").alias("dt"))
    rows = t.limit(MAX_DECLARED + 1).collect()
    if len(rows) > MAX_DECLARED:
        raise ValueError("too many declared attributes for a wide table")
    return {r.p: r.dt or "xsd:string" for r in rows}


def _instances(spark: SparkSession, d: str) -> DataFrame:
    rows = pick(table(spark, d, "triples"), "graph", "s", "p", "o")
    return W.wide(rows.where(F.col("graph").rlike(PROFILES)), declared(spark, d), REQUIRED)


def p3_wide(spark: SparkSession, d: str) -> DataFrame:
    return _instances(spark, d).withColumn("problems", F.array_join(F.transform("problems", lambda x: F.concat(x["p"], F.lit(" "), x["kind"])), "; "))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    booleans = sorted({a for v in REQUIRED.values() for a in v})
    rows = pick(table(spark, d, "triples"), "graph", "s", "p", "o")
    found = W.wide(rows.where(F.col("p").isin("rdf:type", *booleans)), {a: "xsd:boolean" for a in booleans}, REQUIRED)
    return W.problems(found)


#: The fields that both systems hold.
SHARED = ("rdfs:label", "rdfs:comment", "rdfs:subClassOf", "cim:SvSwitch.open")


def _shared(spark: SparkSession, d: str, name: str) -> DataFrame:
    """(graph, s, p, v, lang): the shared fields, equal where values are equal."""
    t = pick(table(spark, d, name), "graph", "s", "p", "o", "o_lang").where(F.col("p").isin(*SHARED) & not_blank(F.col("o")))
    o, text = F.col("o"), F.col("p").isin("rdfs:label", "rdfs:comment")
    link = t.where("p = 'rdfs:subClassOf'").select("graph", "s", "p", "o")
    link = expand(link.distinct(), table(spark, d, "prefixes"), "o").withColumn("o_lang", F.lit(None).cast("string"))
    rest = t.where("p <> 'rdfs:subClassOf'").withColumn("o", F.when(text, one_spaced(o)).otherwise(F.coalesce(readable(o), trimmed(o))))
    rest = rest.withColumn("o_lang", F.when(text, F.lower("o_lang")))
    return rest.unionByName(link).select("graph", object_id(F.col("s")).alias("s"), "p", F.col("o").alias("v"), F.col("o_lang").alias("lang"))


def _differences(spark: SparkSession, d: str) -> DataFrame:
    return R.compare_records(_shared(spark, d, "triples"), _shared(spark, d, "triples_b"), ["graph", "s"], "p", ["v", "lang"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return R.summary(_differences(spark, d), ["graph", "s"], "p")


def p4_values(spark: SparkSession, d: str) -> DataFrame:
    """Each value that one side has and the other lacks."""
    return _differences(spark, d).where("p <> ''")


#: The two references.
REFERENCES = ("cim:SvSwitch.Switch", "cims:belongsToCategory")


def arrivals(spark: SparkSession, d: str) -> DataFrame:
    """(graph, t, month): each file's earliest arrival and the month it is for."""
    m = pick(table(spark, d, "file_metadata"), "file_name", "arrived_at", "final_ts").where("file_name is not null")
    m = m.groupBy(F.col("file_name").alias("graph")).agg(F.min("arrived_at").alias("t"), F.min(F.struct("arrived_at", "final_ts")).alias("first"))
    return m.select("graph", F.expr("unix_micros(cast(t AS timestamp))").alias("t"), F.date_format(F.col("first.final_ts").cast("timestamp"), "yyyy-MM").alias("month"))


def _references(spark: SparkSession, d: str) -> DataFrame:
    t = pick(table(spark, d, "triples"), "graph", "s", "p", "o").where(F.col("p").isin(*REFERENCES) & not_blank(F.col("o")) & F.col("s").isNotNull())
    t = t.withColumn("s", object_id(F.col("s")))
    switch = t.where("p = 'cim:SvSwitch.Switch'").withColumn("o", object_id(F.col("o")))
    category = expand(t.where("p = 'cims:belongsToCategory'").distinct(), table(spark, d, "prefixes"), "o")
    refs = switch.unionByName(category).distinct()
    return O.salted(refs, arrivals(spark, d).select("graph", "t"), ["graph"], t.groupBy("graph").count()).select("graph", "s", "p", F.col("o").alias("target"), "t")


def _changes(spark: SparkSession, d: str) -> DataFrame:
    rows = pick(table(spark, d, "triples"), "graph", "s", "p").where("p = 'rdf:type' and s is not null")
    counts = rows.groupBy("graph").count()
    rows = rows.select("graph", object_id(F.col("s")).alias("target")).distinct()
    there = O.salted(rows, arrivals(spark, d).select("graph", "t"), ["graph"], counts).select("target", "t", F.lit(True).alias("alive"))
    x = pick(table(spark, d, "difference_rows"), "side", "s", "p", "created_at").where("p = 'rdf:type' and side in ('forward', 'reverse')")
    moved = x.select(object_id(F.col("s")).alias("target"), F.expr("unix_micros(cast(created_at AS timestamp))").alias("t"), (F.col("side") == "forward").alias("alive"))
    return there.unionByName(moved)


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return O.orphans(_references(spark, d), _changes(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("graph", "s", "p", "status").distinct()


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return O.report(p5_found(spark, d), arrivals(spark, d).select("graph", "month"))
