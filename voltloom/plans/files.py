"""Queries of readers, writers and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import mapping as M
from ..sources import rdf, writers
from ..sources.tables import shared_folder, table
from ..streaming import replay
from .catalogue import query
from .graphs import T


def _full(t):
    """The mapped rows with full IRIs."""
    iri = lambda c: F.concat(F.lit("http://m.example/"), F.replace(c, F.lit(":"), F.lit("#")))
    return t.select(
        "graph", iri(F.col("s")).alias("s"), F.lit("iri").alias("s_kind"), F.when(F.col("p") == "rdf:type", rdf.RDF + "type").otherwise(iri(F.col("p"))).alias("p"),
        F.when(F.col("o_kind") == "iri", iri(F.col("o"))).otherwise(F.col("o")).alias("o"), "o_kind", F.replace("o_dt", F.lit("xsd:"), F.lit(rdf.XSD)).alias("o_dt"), F.lit(None).cast("string").alias("o_lang"),
    )


_CUSTOMERS = M.sql("customer", "A", "customer", "c_custkey", "cim:Customer", M.CUSTOMERS)
_FULL = f"SELECT 'http://m.example/' || replace(s, ':', '#') AS s, CASE WHEN p = 'rdf:type' THEN '{rdf.RDF}type' ELSE 'http://m.example/' || p END AS p, CASE WHEN o_kind = 'iri' THEN 'http://m.example/' || replace(o, ':', '#') ELSE o END AS o, o_kind"


def _customers(spark, d):
    return M.statements(table(spark, d, "customer"), "A", "customer", "c_custkey", "cim:Customer", M.CUSTOMERS)


@query("a1_turtle_round_trip", _FULL + f", replace(o_dt, 'xsd:', '{rdf.XSD}') AS o_dt FROM ({_CUSTOMERS})")
def a1(spark, d):
    place = f"{shared_folder(spark)}/turtle-{uuid.uuid4().hex}"
    rows = writers.turtle_rows(_full(_customers(spark, d)))
    # parts of whole subjects, each a document
    rows.select(F.col("text").alias("value")).write.option("lineSep", "\n\n").text(place)
    docs = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(place)
    parsed = docs.select("path", "content").mapInArrow(_parse_turtle, rdf.SCHEMA)
    return parsed.select("s", "p", "o", "o_kind", "o_dt")


def _parse_turtle(batches):
    import pyarrow as pa

    names = [x.split()[0] for x in rdf.SCHEMA.split(", ")]
    for b in batches:
        for where, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            cols = list(zip(*rdf.turtle(data, where.rsplit("/", 1)[-1])))
            if cols:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=names)


@query("a8_datatype_lines", "SELECT p, dt FROM datatype_map")
def a8(spark, d):
    lines = writers.properties(table(spark, d, "datatype_map"))
    return rdf.datatype_lines(lines)


@query("a15_header_time", "SELECT DISTINCT file_name, header_ts AS at FROM file_metadata WHERE header_ts IS NOT NULL")
def a15(spark, d):
    m = table(spark, d, "file_metadata").where("header_ts is not null").select("file_name", "header_ts").distinct()
    text = F.concat(F.lit("<rdf:RDF>\n<md:Model.endDate>2000</md:Model.endDate><md:Model.scenarioTime>"), "header_ts", F.lit("</md:Model.scenarioTime>"))
    return m.select("file_name", rdf.header_time(text).alias("at"))


@query("b1_rdf_xml", """WITH v AS (SELECT graph, s, string_agg(DISTINCT x, chr(10) ORDER BY x) AS body FROM (SELECT graph, s, CASE WHEN o_kind = 'literal' THEN '    <' || p || CASE WHEN o_lang IS NOT NULL THEN ' xml:lang="' || o_lang || '"' ELSE '' END || '>' || replace(replace(replace(replace(o, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</' || p || '>'
ELSE '    <' || p || ' rdf:resource="' || replace(replace(replace(replace(o, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '"/>' END AS x FROM triples WHERE p <> 'rdf:type' AND o IS NOT NULL) GROUP BY 1, 2), t AS (SELECT graph, s, min(o) AS cls FROM triples WHERE p = 'rdf:type' GROUP BY 1, 2)
SELECT coalesce(v.graph, t.graph) AS graph, coalesce(cls, 'zzzzzzzzzz') AS sort_key, coalesce(v.s, t.s) AS s, '  <' || coalesce(cls, 'rdf:Description') || ' rdf:about="' || coalesce(v.s, t.s) || '">' || chr(10) || coalesce(body || chr(10), '') || '  </' || coalesce(cls, 'rdf:Description') || '>' AS text FROM v FULL JOIN t ON v.graph = t.graph AND v.s = t.s""")
def b1(spark, d):
    return writers.rdf_xml_rows(T(spark, d, "graph", "s", "p", "o", "o_kind", "o_lang"))


@query("b11_properties", "SELECT DISTINCT p || '=Datatype[' || dt || ']' AS value FROM datatype_map")
def b11(spark, d):
    return writers.properties(table(spark, d, "datatype_map"))


@query("b14_descriptions_json", "SELECT s, '{\"s\":\"' || s || '\",\"n\":' || count(*) || '}' AS record FROM triples WHERE p = 'rdf:type' AND o = 'rdfs:Class' GROUP BY 1")
def b14(spark, d):
    t = T(spark, d, "s", "p", "o").where("p = 'rdf:type' and o = 'rdfs:Class'").groupBy("s").agg(F.count("*").alias("n"))
    return t.select("s", F.to_json(F.struct("s", "n")).alias("record"))


@query("n1_stream_windows", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def n1(spark, d):
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "false").parquet(f"{d}/events.parquet*")
    stream = stream.withColumn("at", F.col("ts").cast("timestamp"))
    out = replay.run_available(replay.windowed_counts(stream, "at", "event_type", "1 day", "1 day"), spark, ["start", "event_type"])
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))
