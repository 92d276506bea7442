"""Queries of conversion by options, imports, exports and the remaining functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import files as N
from ..operators import convert as C
from ..operators import rdfs as R
from ..operators import tasks as K
from ..operators.graph import closure
from ..sources import mapping as M
from ..sources.discovery import discover, near_field
from ..sources.tables import table
from .catalogue import query
from .graphs import T
from .joins import _ab


@query("a9_imports_closure", """WITH RECURSIVE t AS (SELECT 'r' || (o_orderkey % 40) AS graph, 'owl:imports' AS p, 'dir/r' || (o_orderkey % 40 + 1 + o_custkey % 3) AS o FROM orders), e AS (SELECT DISTINCT graph AS s, regexp_extract(o, '[^/#]*$') AS o FROM t WHERE regexp_extract(o, '[^/#]*$') IN (SELECT graph FROM t)), c(root, graph) AS (SELECT s, o FROM e UNION SELECT c.root, e.o FROM c JOIN e ON e.s = c.graph)
SELECT root, count(DISTINCT graph) AS graphs FROM (SELECT root, graph FROM c UNION SELECT graph, graph FROM t) GROUP BY 1""")
def a9(spark, d):
    k = F.col("o_orderkey") % 40
    t = table(spark, d, "orders").select(F.concat(F.lit("r"), k).alias("graph"), F.lit("s").alias("s"), F.lit("owl:imports").alias("p"), F.concat(F.lit("dir/r"), k + 1 + F.col("o_custkey") % 3).alias("o")).distinct()
    return C.with_imports(t).groupBy("root").agg(F.countDistinct("graph").alias("graphs"))


@query("a17_glob", "SELECT DISTINCT path FROM file_metadata WHERE regexp_matches(path, '^.*/[^/]*_SV_[^/]*\\.xml$')")
def a17(spark, d):
    return discover(table(spark, d, "file_metadata"), glob="**/*_SV_*.xml")


@query("a16_discover", "SELECT DISTINCT path FROM file_metadata WHERE ends_with(lower(path), '.xml') AND NOT contains('/' || path, '/archive/') AND NOT contains('/' || path, '/rescan/')")
def a16(spark, d):
    return discover(table(spark, d, "file_metadata"), ignored=("archive", "rescan"))


@query("m11_near_field", r"""WITH x AS (SELECT DISTINCT file_name, header_ts, CASE length(file_name) % 3 WHEN 0 THEN '<md:Model.scenarioTime>' || header_ts || '</md:Model.scenarioTime>' WHEN 1 THEN '<x md:Model.scenarioTime="' || header_ts || '"/>' ELSE 'scenarioTime of the model is ' || filename_ts || ' or so' END AS text, length(file_name) % 3 AS k, filename_ts FROM file_metadata)
SELECT file_name, CASE WHEN k < 2 THEN try_strptime(header_ts, '%Y-%m-%dT%H:%M:%SZ') ELSE try_strptime(filename_ts, '%Y%m%dT%H%MZ') END AS time FROM x""")
def m11(spark, d):
    k = F.length("file_name") % 3
    text = F.when(k == 0, F.concat(F.lit("<md:Model.scenarioTime>"), "header_ts", F.lit("</md:Model.scenarioTime>"))).when(k == 1, F.concat(F.lit('<x md:Model.scenarioTime="'), "header_ts", F.lit('"/>')))
    m = table(spark, d, "file_metadata").select("file_name", text.otherwise(F.concat(F.lit("scenarioTime of the model is "), "filename_ts", F.lit(" or so"))).alias("text"), "header_ts", "filename_ts").distinct()
    return m.select("file_name", near_field(F.col("text"), "scenarioTime").cast("timestamp").cast("timestamp_ntz").alias("time"))


@query("b9_csv_rows", """SELECT s, '"' || s || '","' || replace(coalesce(o, ''), '"', '""') || '"' AS line FROM (SELECT DISTINCT s, o FROM triples WHERE p = 'rdfs:label')""")
def b9(spark, d):
    q = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    return T(spark, d, "s", "p", "o").where("p = 'rdfs:label'").select("s", "o").distinct().select("s", F.concat(q(F.col("s")), F.lit(","), q(F.col("o"))).alias("line"))


@query("b10_restore_text", "SELECT l_orderkey AS k, string_agg(x, '|' ORDER BY x) AS text FROM (SELECT l_orderkey, lpad(CAST(l_linenumber AS VARCHAR), 2, '0') || ':' || l_returnflag AS x FROM lineitem) GROUP BY 1")
def b10(spark, d):
    x = F.concat(F.lpad(F.col("l_linenumber").cast("string"), 2, "0"), F.lit(":"), "l_returnflag")
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_join(F.array_sort(F.collect_list(x)), "|").alias("text"))


@query("b13_report_groups", "SELECT profile, regexp_extract(file_name, '^[0-9]{8}T[0-9]{4}Z_([A-Z0-9]+)_', 1) AS own, strftime(final_ts, '%Y-%m') AS month, '<group n=\"' || count(DISTINCT file_name) || '\"/>' AS xml FROM file_metadata WHERE profile IS NOT NULL GROUP BY 1, 2, 3")
def b13(spark, d):
    m = table(spark, d, "file_metadata").where("profile is not null")
    return m.groupBy("profile", N.party(F.col("file_name")).alias("own"), F.date_format(F.col("final_ts").cast("timestamp"), "yyyy-MM").alias("month")).agg(F.format_string('<group n="%d"/>', F.countDistinct("file_name")).alias("xml"))


@query("o1_convert_union_owl", """WITH v AS (SELECT graph, s, p, o FROM triples WHERE contains(graph, 'vocabulary') UNION SELECT graph, s, p, o FROM triples_b WHERE contains(graph, 'vocabulary')), h AS (SELECT s FROM v WHERE p = 'rdf:type' AND o = 'owl:Ontology' EXCEPT SELECT s FROM v WHERE p = 'sh:declare'), k AS (SELECT * FROM v WHERE s NOT IN (SELECT s FROM h)),
w AS (SELECT DISTINCT s, CASE WHEN p = 'rdf:type' AND o = 'rdfs:Class' THEN 'owl:Class' WHEN p = 'cims:stereotype' AND contains(lower(o), 'enum') THEN 'owl:NamedIndividual' WHEN p = 'cims:stereotype' AND o IN ('CIMDatatype', 'Primitive') THEN 'owl:DatatypeProperty' END AS o FROM k)
SELECT * FROM k UNION SELECT g.graph, w.s, 'rdf:type', w.o FROM w JOIN (SELECT DISTINCT s, graph FROM k) g USING (s) WHERE w.o IS NOT NULL""")
def o1(spark, d):
    t = T(spark, d).where("graph like '%vocabulary%'")
    b = table(spark, d, "triples_b").where("graph like '%vocabulary%'")
    return C.convert(t, C.ConvertOptions(union=[b], keep_headers=False, add_owl=True))


@query("o2_inheritance_list", "WITH RECURSIVE e AS (SELECT DISTINCT s, o FROM triples WHERE p = 'rdfs:subClassOf' AND o IS NOT NULL), c(s, up) AS (SELECT s, o FROM e UNION SELECT c.s, e.o FROM c JOIN e ON e.s = c.up) SELECT up AS s, 'owl:members' AS p, s AS o FROM c WHERE s IN (SELECT s FROM triples WHERE p = 'cims:stereotype' AND ends_with(o, '#concrete'))")
def o2(spark, d):
    return C.convert(T(spark, d), C.ConvertOptions(inheritance_list=True, only_concrete=True))


_UUID = lambda x: f"'urn:uuid:' || substr({x}, 1, 8) || '-' || substr({x}, 9, 4) || '-' || substr({x}, 13, 4) || '-' || substr({x}, 17, 4) || '-' || substr({x}, 21, 12)"


@query("k9_multiply_and_connect", f"""WITH t AS (SELECT DISTINCT graph, s, p, o, o_kind FROM triples WHERE p IS NOT NULL AND (contains(graph, '_EQ_') OR contains(graph, '_SSH_'))),
skip AS (SELECT DISTINCT s FROM t WHERE p = 'rdf:type' AND o IN ('md:FullModel', 'cim:ControlArea', 'cim:LoadArea', 'cim:SubGeographicalRegion', 'cim:GeographicalRegion')),
c AS (SELECT graph, CASE WHEN starts_with(s, 'urn:uuid:') AND s NOT IN (SELECT s FROM skip WHERE s IS NOT NULL) THEN {_UUID("md5('copy ' || i || '|' || s)")} ELSE s END AS s, p, CASE WHEN starts_with(o, 'urn:uuid:') AND o NOT IN (SELECT s FROM skip WHERE s IS NOT NULL) THEN {_UUID("md5('copy ' || i || '|' || o)")} ELSE o END AS o, o_kind FROM t, range(0, 2) r(i)),
n AS (SELECT i, {_UUID("md5('line segment ' || i || '|urn:uuid:11111111-2222-3333-4444-555555555555')")} AS seg, {_UUID("md5('line ' || i || '|urn:uuid:11111111-2222-3333-4444-555555555555')")} AS line, {_UUID("md5('terminal 1 ' || i || '|urn:uuid:11111111-2222-3333-4444-555555555555')")} AS t1, {_UUID("md5('terminal 2 ' || i || '|urn:uuid:11111111-2222-3333-4444-555555555555')")} AS t2, {_UUID("md5('copy ' || i || '|urn:uuid:11111111-2222-3333-4444-555555555555')")} AS node FROM range(0, 2) r(i)),
g AS (SELECT graph, contains(graph, 'SSH') AS ssh, min(CASE WHEN p = 'rdf:type' AND o = 'cim:SubGeographicalRegion' THEN s END) AS region FROM t GROUP BY graph),
l AS (SELECT graph, ssh, region, n.* FROM g, n),
r AS (SELECT graph, unnest([{{'s': t1, 'p': 'rdf:type', 'o': 'cim:Terminal', 'o_kind': 'iri'}}, {{'s': t1, 'p': 'cim:ACDCTerminal.connected', 'o': 'true', 'o_kind': 'literal'}}, {{'s': t2, 'p': 'rdf:type', 'o': 'cim:Terminal', 'o_kind': 'iri'}}, {{'s': t2, 'p': 'cim:ACDCTerminal.connected', 'o': 'true', 'o_kind': 'literal'}}]) AS x FROM l WHERE ssh
UNION ALL SELECT graph, unnest([{{'s': seg, 'p': 'rdf:type', 'o': 'cim:ACLineSegment', 'o_kind': 'iri'}}, {{'s': seg, 'p': 'cim:ACLineSegment.bch', 'o': '0.0001875', 'o_kind': 'literal'}}, {{'s': seg, 'p': 'cim:ACLineSegment.gch', 'o': '0', 'o_kind': 'literal'}}, {{'s': seg, 'p': 'cim:ACLineSegment.r', 'o': '0.011', 'o_kind': 'literal'}}, {{'s': seg, 'p': 'cim:ACLineSegment.x', 'o': '0.011', 'o_kind': 'literal'}}, {{'s': seg, 'p': 'cim:Conductor.length', 'o': '0.01', 'o_kind': 'literal'}}, {{'s': seg, 'p': 'cim:IdentifiedObject.name', 'o': 'ACLineSegment ' || i, 'o_kind': 'literal'}}, {{'s': seg, 'p': 'cim:Equipment.EquipmentContainer', 'o': line, 'o_kind': 'iri'}}, {{'s': seg, 'p': 'cim:ConductingEquipment.BaseVoltage', 'o': 'urn:uuid:65dd04e7-9258-4b3b-9123-74e35dec032e', 'o_kind': 'iri'}},
{{'s': line, 'p': 'rdf:type', 'o': 'cim:Line', 'o_kind': 'iri'}}, {{'s': line, 'p': 'cim:IdentifiedObject.name', 'o': 'LineEB ' || i, 'o_kind': 'literal'}}, {{'s': line, 'p': 'cim:Line.Region', 'o': region, 'o_kind': 'iri'}},
{{'s': t1, 'p': 'rdf:type', 'o': 'cim:Terminal', 'o_kind': 'iri'}}, {{'s': t1, 'p': 'cim:IdentifiedObject.name', 'o': 'TerminalEB-1 ' || i, 'o_kind': 'literal'}}, {{'s': t1, 'p': 'cim:ACDCTerminal.sequenceNumber', 'o': '1', 'o_kind': 'literal'}}, {{'s': t1, 'p': 'cim:Terminal.ConductingEquipment', 'o': seg, 'o_kind': 'iri'}}, {{'s': t1, 'p': 'cim:Terminal.ConnectivityNode', 'o': 'urn:uuid:11111111-2222-3333-4444-555555555555', 'o_kind': 'iri'}},
{{'s': t2, 'p': 'rdf:type', 'o': 'cim:Terminal', 'o_kind': 'iri'}}, {{'s': t2, 'p': 'cim:IdentifiedObject.name', 'o': 'TerminalEB-2 ' || i, 'o_kind': 'literal'}}, {{'s': t2, 'p': 'cim:ACDCTerminal.sequenceNumber', 'o': '2', 'o_kind': 'literal'}}, {{'s': t2, 'p': 'cim:Terminal.ConductingEquipment', 'o': seg, 'o_kind': 'iri'}}, {{'s': t2, 'p': 'cim:Terminal.ConnectivityNode', 'o': node, 'o_kind': 'iri'}}]) AS x FROM l WHERE NOT ssh)
SELECT graph, s, p, o FROM t UNION SELECT graph, s, p, o FROM c UNION SELECT graph, x.s, x.p, x.o FROM r WHERE x.o IS NOT NULL""")
def k9(spark, d):
    t = table(spark, d, "triples").where("p is not null and (contains(graph, '_EQ_') or contains(graph, '_SSH_'))")
    return K.multiply_and_connect(t, 3, "urn:uuid:11111111-2222-3333-4444-555555555555").select("graph", "s", "p", "o").distinct()


@query("m1_split_iri", "SELECT DISTINCT s, regexp_extract(s, '^(.*[#/])', 1) AS ns, regexp_extract(s, '[^#/]*$') AS name FROM triples WHERE starts_with(s, 'http')")
def m1(spark, d):
    from ..functions.ids import local_name, namespace

    s = F.col("s")
    return T(spark, d, "s").where(s.startswith("http")).distinct().select("s", namespace(s).alias("ns"), local_name(s).alias("name"))


@query("m2_strip_datatype", "SELECT DISTINCT o || '^^' || o_dt AS typed, o AS plain FROM triples WHERE o_dt = 'xsd:boolean' AND o <> '' AND NOT contains(o, '^')")
def m2(spark, d):
    t = T(spark, d, "o", "o_dt").where("o_dt = 'xsd:boolean' and o <> '' and not contains(o, '^')").select(F.concat("o", F.lit("^^"), "o_dt").alias("typed")).distinct()
    return t.select("typed", F.get(F.split("typed", r"\^\^"), F.lit(0)).alias("plain"))


@query("m4_token_match", "SELECT DISTINCT file_name, regexp_matches(upper(regexp_replace(file_name, '[^A-Za-z0-9]', '_', 'g')), '(^|_)SV[0-9]*($|_)') AS hit FROM file_metadata")
def m4(spark, d):
    return table(spark, d, "file_metadata").select("file_name", N.has_token(F.col("file_name"), "SV").alias("hit")).distinct()


@query("m9_camel_split", "SELECT DISTINCT s, regexp_replace(regexp_extract(s, '[^#/]*$'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g') AS words FROM triples WHERE p = 'rdfs:label' AND starts_with(s, 'http')")
def m9(spark, d):
    from ..functions.ids import local_name

    t = T(spark, d, "s", "p").where("p = 'rdfs:label' and s like 'http%'").select("s").distinct()
    return t.select("s", F.regexp_replace(local_name(F.col("s")), "([a-z0-9])([A-Z])", "$1 $2").alias("words"))


@query("m19_merge_counts", "SELECT user_id, CAST(sum(n) AS BIGINT) AS n, max(n) AS most FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def m19(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").count().groupBy("user_id").agg(F.sum("count").alias("n"), F.max("count").alias("most"))


_CP = "cp AS (SELECT DISTINCT p_brand AS cls, 'size' || p_size AS property FROM part), con AS (SELECT DISTINCT p_brand AS cls FROM part WHERE p_brand LIKE '%1')"


def _class_properties(spark, d):
    p = table(spark, d, "part")
    cp = p.select(F.col("p_brand").alias("cls"), F.concat(F.lit("size"), "p_size").alias("property")).distinct()
    return cp, p.where("p_brand like '%1'").select(F.col("p_brand").alias("cls")).distinct()


_VALUES = [("size1", "minInclusive", "0"), ("size2", "maxLength", "5"), ("size2", "maxLength", "5"), ("none", "maxLength", "1")]


@query("j9_value_constraints", f"WITH {_CP}, r(property, component, value) AS (SELECT DISTINCT * FROM (VALUES " + ", ".join(map(str, _VALUES)) + ")) SELECT cls || '.' || property || '-' || component AS shape, cls AS target_class, property AS path, component, value AS parameter FROM cp JOIN con USING (cls) JOIN r USING (property)")
def j9(spark, d):
    cp, concrete = _class_properties(spark, d)
    return R.value_constraints(spark.createDataFrame(_VALUES, "property string, component string, value string"), cp, concrete)


_UP = "WITH RECURSIVE e AS (SELECT DISTINCT s, o FROM triples WHERE p = 'rdfs:subClassOf' AND starts_with(o, 'http')), c(child, ancestor) AS (SELECT s, o FROM e UNION SELECT c.child, e.o FROM c JOIN e ON e.s = c.ancestor), k AS (SELECT DISTINCT s FROM triples WHERE p = 'cims:stereotype' AND ends_with(o, '#concrete')), pairs AS (SELECT child, ancestor FROM c UNION ALL SELECT s, s FROM k), cls AS (SELECT DISTINCT s FROM triples_b WHERE p = 'rdfs:label' AND starts_with(s, 'http'))"


@query("j8_concrete_in_tiers", _UP + " SELECT DISTINCT cls.s AS cls, child AS concrete FROM cls JOIN pairs ON regexp_extract(ancestor, '[^#/]*$') = regexp_extract(cls.s, '[^#/]*$') WHERE child IN (SELECT s FROM k)")
def j8(spark, d):
    t = T(spark, d)
    up = closure(t.where("p = 'rdfs:subClassOf' and o like 'http%'").select("s", "o"))
    concrete = t.where("p = 'cims:stereotype' and o like '%#concrete'").select(F.col("s").alias("cls")).distinct()
    classes = table(spark, d, "triples_b").where("p = 'rdfs:label' and s like 'http%'").select(F.col("s").alias("cls")).distinct()
    return R.concrete_below(classes, [(up, concrete)], by_local_name=True)


@query("j16_template", f"WITH {_CP} SELECT cls, property, CASE WHEN k % 3 = 0 THEN 'Attribute' WHEN k % 3 = 1 THEN 'Association' ELSE 'Enumeration' END AS kind, CASE WHEN k % 3 = 0 THEN 'xsd:float' END AS dt, '0..1' AS multiplicity FROM cp JOIN (SELECT DISTINCT 'size' || p_size AS property, p_size AS k FROM part) USING (property) WHERE k % 6 <> 5")
def j16(spark, d):
    cp, _ = _class_properties(spark, d)
    k = F.col("k")
    pr = table(spark, d, "part").select(F.concat(F.lit("size"), "p_size").alias("property"), F.col("p_size").alias("k")).distinct()
    pr = pr.select("property", F.lit("0..1").alias("multiplicity"), F.when(k % 6 == 5, "No").when(k % 3 == 1, "Yes").alias("association_used"), F.when(k % 3 == 0, "Float").alias("datatype"))
    dts = R.datatype_map(pr, spark.createDataFrame([], "cls string, primitive string"))
    return R.template(cp, pr.drop("datatype"), dts)
