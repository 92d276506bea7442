"""Queries of derivations from vocabularies, of model manipulation and of graph patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rdfs as R
from ..operators import sparql as P
from ..operators import tasks as K
from ..sources import mapping as M
from ..sources.tables import table
from .catalogue import query
from .graphs import COLS, T
from .joins import _ab

_A = f"WITH a AS ({M.A_SQL}) "


@query("j1_manifest", """WITH h AS (SELECT graph, arg_min(s, o || s) AS s FROM triples WHERE p = 'rdf:type' AND o IN ('dcat:Dataset', 'md:FullModel') GROUP BY 1),
m(p, f) AS (VALUES ('dcterms:conformsTo', 'md:Model.profile'), ('dcterms:description', 'md:Model.description'), ('dcterms:issued', 'md:Model.created'), ('dcterms:publisher', 'md:Model.modelingAuthoritySet'), ('dcterms:requires', 'md:Model.DependentOn'), ('dcat:keyword', 'dcat:keyword'), ('dcat:startDate', 'md:Model.scenarioTime'), ('dcat:version', 'md:Model.version'))
SELECT DISTINCT t.graph, h.s AS dataset, m.p, trim(t.o, ' ') AS o FROM triples t JOIN h ON h.graph = t.graph AND h.s = t.s JOIN m ON m.f = t.p WHERE trim(t.o, ' ') <> '' UNION ALL SELECT graph, s, 'dcterms:title', graph FROM h""")
def j1(spark, d):
    return R.manifest(T(spark, d))


@query("j12_datatype_map", "SELECT DISTINCT 'lineitem.' || l_returnflag AS property, CASE l_returnflag WHEN 'A' THEN 'xsd:float' WHEN 'N' THEN 'xsd:integer' ELSE 'xsd:boolean' END AS dt FROM lineitem")
def j12(spark, d):
    flag = F.col("l_returnflag")
    kind = F.when(flag == "A", "http://x#ActivePower").when(flag == "N", "http://x#Integer").otherwise("http://x#Boolean")
    props = table(spark, d, "lineitem").select(F.concat(F.lit("lineitem."), flag).alias("property"), kind.alias("datatype")).distinct()
    return R.datatype_map(props, spark.createDataFrame([("http://x#ActivePower", "http://x#Float")], "cls string, primitive string"))


@query("j15_description_table", """WITH g AS (SELECT s, min(CASE WHEN p = 'rdf:type' THEN o END) AS kind, min(CASE WHEN p = 'rdfs:label' THEN o END) AS label, min(CASE WHEN p = 'rdfs:comment' THEN o END) AS description, min(CASE WHEN p = 'cims:belongsToCategory' THEN o END) AS category,
array_agg(DISTINCT CASE WHEN p = 'cims:stereotype' THEN regexp_extract(o, '[^#/]*$') END) AS st FROM triples GROUP BY 1)
SELECT s AS item, CASE WHEN kind = 'cims:ClassCategory' THEN 'Package' WHEN list_contains(st, 'enumeration') THEN 'Enum' WHEN kind = 'rdfs:Class' THEN 'Class' WHEN list_contains(st, 'attribute') THEN 'Attribute' END AS type, label, category, coalesce(array_to_string(list_sort(list_filter(st, lambda x: x IS NOT NULL)), '; '), '') AS stereotypes,
CASE WHEN list_contains(st, 'concrete') THEN 'Yes' ELSE 'No' END AS concrete, CAST(NULL AS VARCHAR) AS multiplicity, CAST(NULL AS VARCHAR) AS association_used, description FROM g WHERE kind IN ('cims:ClassCategory', 'rdfs:Class') OR list_contains(st, 'enumeration') OR list_contains(st, 'attribute')""")
def j15(spark, d):
    return R.descriptions(T(spark, d))


_PROP_SQL = """pr AS (SELECT 'p' || (p_partkey % 50) AS property, 'c' || (p_partkey % 10) AS domain, CASE p_size % 4 WHEN 0 THEN '1..1' WHEN 1 THEN '0..1' WHEN 2 THEN '1..n' ELSE '0..n' END AS m, CASE WHEN p_partkey % 50 % 2 = 0 THEN 'xsd:float' END AS dt, CASE WHEN p_partkey % 50 % 7 = 1 THEN 'No' WHEN p_partkey % 50 % 2 = 1 THEN 'Yes' END AS used FROM part WHERE p_partkey BETWEEN 1 AND 50),
up(cls, anc) AS (SELECT 'c' || i, 'c' || j FROM range(10) a(i), range(10) b(j) WHERE j < i AND i // 5 = j // 5), all_p AS (SELECT domain AS cls, property FROM pr UNION SELECT up.cls, property FROM up JOIN pr ON pr.domain = up.anc), x AS (SELECT a.cls, pr.* FROM all_p a JOIN pr USING (property) WHERE a.cls IN ('c4', 'c9', 'c2'))"""


@query("j4_generate_constraints", f"""WITH {_PROP_SQL} SELECT property || '-cardinality' AS shape, cls AS target_class, property AS path, 'maxCount' AS component, '0' AS parameter FROM x WHERE used = 'No'
UNION ALL SELECT property || '-cardinality', cls, property, 'minCount', '1' FROM x WHERE coalesce(used, '') <> 'No' AND m IN ('1..1', '1..n') UNION ALL SELECT property || '-cardinality', cls, property, 'maxCount', '1' FROM x WHERE coalesce(used, '') <> 'No' AND m IN ('1..1', '0..1')
UNION ALL SELECT property || '-datatype', cls, property, 'datatype', dt FROM x WHERE dt IS NOT NULL UNION ALL SELECT property || '-valueType', cls, property, 'class', 'cim:Target' FROM x WHERE used = 'Yes'""")
def j4(spark, d):
    k = F.col("p_partkey")
    m = F.element_at(F.array(*[F.lit(x) for x in ("1..1", "0..1", "1..n", "0..n")]), F.col("p_size") % 4 + 1)
    n = k % 50
    used = F.when(n % 7 == 1, "No").when(n % 2 == 1, "Yes")
    pr = table(spark, d, "part").where("p_partkey between 1 and 50").select(
        F.concat(F.lit("p"), n).alias("property"), F.concat(F.lit("c"), k % 10).alias("domain"), F.when(used == "Yes", "cim:Target").alias("rng"), F.when(n % 2 == 0, "Float").alias("datatype"), m.alias("multiplicity"), used.alias("association_used")
    )
    chain = spark.createDataFrame([(f"c{i}", f"c{i - 1}") for i in range(10) if i % 5], "s string, o string")
    concrete = spark.createDataFrame([("c4",), ("c9",), ("c2",)], "cls string")
    return R.constraints(pr, chain, concrete, R.datatype_map(pr, spark.createDataFrame([], "cls string, primitive string")))


_ALL_SQL = """pr AS (SELECT 'p' || p_partkey AS property, CASE WHEN p_size = 50 THEN 'Part' WHEN p_size % 8 = 0 THEN p_type ELSE p_brand END AS domain, CASE p_size % 4 WHEN 0 THEN '1..1' WHEN 1 THEN '0..1' WHEN 2 THEN '1..n' ELSE '0..n' END AS m, CASE WHEN p_partkey % 2 = 0 THEN 'xsd:float' END AS dt, CASE WHEN p_partkey % 7 = 1 THEN 'No' WHEN p_partkey % 2 = 1 THEN 'Yes' END AS used FROM part),
up(cls, anc) AS (SELECT p_brand, p_type FROM part UNION SELECT p_brand, 'Part' FROM part UNION SELECT p_brand, p_brand FROM part), x AS (SELECT up.cls, pr.* FROM pr JOIN up ON up.anc = pr.domain)"""


@query("j4_generate_constraints_all", f"""WITH {_ALL_SQL} SELECT property || '-cardinality' AS shape, cls AS target_class, property AS path, 'maxCount' AS component, '0' AS parameter FROM x WHERE used = 'No'
UNION ALL SELECT property || '-cardinality', cls, property, 'minCount', '1' FROM x WHERE coalesce(used, '') <> 'No' AND m IN ('1..1', '1..n') UNION ALL SELECT property || '-cardinality', cls, property, 'maxCount', '1' FROM x WHERE coalesce(used, '') <> 'No' AND m IN ('1..1', '0..1')
UNION ALL SELECT property || '-datatype', cls, property, 'datatype', dt FROM x WHERE dt IS NOT NULL UNION ALL SELECT property || '-valueType', cls, property, 'class', 'cim:Target' FROM x WHERE used = 'Yes'""")
def j4_all(spark, d):
    """A property for every part; brands are concrete, below the types they occur with, and these below Part."""
    k, part = F.col("p_partkey"), table(spark, d, "part")
    m = F.element_at(F.array(*[F.lit(x) for x in ("1..1", "0..1", "1..n", "0..n")]), F.col("p_size") % 4 + 1)
    used = F.when(k % 7 == 1, "No").when(k % 2 == 1, "Yes")
    domain = F.when(F.col("p_size") == 50, "Part").when(F.col("p_size") % 8 == 0, F.col("p_type")).otherwise(F.col("p_brand"))
    pr = part.select(F.concat(F.lit("p"), k).alias("property"), domain.alias("domain"), F.when(used == "Yes", "cim:Target").alias("rng"), F.when(k % 2 == 0, "Float").alias("datatype"), m.alias("multiplicity"), used.alias("association_used"))
    links = F.array(F.struct(F.col("p_brand").alias("s"), F.col("p_type").alias("o")), F.struct(F.col("p_type").alias("s"), F.lit("Part").alias("o")))
    chain = part.select(F.inline(links)).distinct()
    concrete = part.select(F.col("p_brand").alias("cls")).distinct()
    return R.constraints(pr, chain, concrete, R.datatype_map(pr, spark.createDataFrame([], "cls string, primitive string")))


@query("j14_skos_pivot", "SELECT DISTINCT 'skos:' || c_mktsegment AS s, p, CASE p WHEN 'rdf:type' THEN 'skos:Concept' WHEN 'skos:prefLabel' THEN c_mktsegment ELSE 'skos:Segments' END AS o FROM customer, (VALUES ('rdf:type'), ('skos:prefLabel'), ('skos:inScheme')) v(p)")
def j14(spark, d):
    seg = table(spark, d, "customer").select("c_mktsegment").distinct()
    rows = F.array(*[F.struct(F.lit(p).alias("p"), o.alias("o")) for p, o in (("rdf:type", F.lit("skos:Concept")), ("skos:prefLabel", F.col("c_mktsegment")), ("skos:inScheme", F.lit("skos:Segments")))])
    return seg.select(F.concat(F.lit("skos:"), "c_mktsegment").alias("s"), F.inline(rows))


@query("j22_rule_table", "SELECT s AS rule, coalesce(max(CASE WHEN p = 'rdfs:label' THEN o END), 'NA') AS name, coalesce(max(CASE WHEN p = 'rdfs:comment' THEN o END), 'NA') AS description, coalesce(max(CASE WHEN p = 'sh:severity' THEN o END), 'NA') AS severity FROM triples WHERE p IN ('rdfs:label', 'rdfs:comment', 'sh:severity') GROUP BY 1")
def j22(spark, d):
    t = T(spark, d).where("p in ('rdfs:label', 'rdfs:comment', 'sh:severity')")
    own = lambda p, n: F.coalesce(F.max(F.when(F.col("p") == p, F.col("o"))), F.lit("NA")).alias(n)
    return t.groupBy(F.col("s").alias("rule")).agg(own("rdfs:label", "name"), own("rdfs:comment", "description"), own("sh:severity", "severity"))


@query("j24_instance_tree", "SELECT o AS cls, s || '|' || coalesce(n.name, '') AS instance FROM (SELECT DISTINCT s, o FROM triples WHERE p = 'rdf:type') LEFT JOIN (SELECT s, min(o) AS name FROM triples WHERE p = 'cim:IdentifiedObject.name' GROUP BY 1) n USING (s)")
def j24(spark, d):
    t = T(spark, d)
    names = t.where("p = 'cim:IdentifiedObject.name'").groupBy("s").agg(F.min("o").alias("name"))
    types = t.where("p = 'rdf:type'").select("s", F.col("o").alias("cls")).distinct()
    return types.join(names, "s", "left").select("cls", F.concat("s", F.lit("|"), F.coalesce("name", F.lit(""))).alias("instance"))


_NEW = lambda c: f"'urn:uuid:' || substr(md5('|' || {c}), 1, 8) || '-' || substr(md5('|' || {c}), 9, 4) || '-' || substr(md5('|' || {c}), 13, 4) || '-' || substr(md5('|' || {c}), 17, 4) || '-' || substr(md5('|' || {c}), 21, 12)"


@query("k1_regenerate_ids", f"SELECT graph, CASE WHEN starts_with(s, 'urn:uuid:') THEN {_NEW('s')} ELSE s END AS s, p, CASE WHEN starts_with(o, 'urn:uuid:') THEN {_NEW('o')} ELSE o END AS o FROM triples WHERE p <> 'cim:IdentifiedObject.mRID'")
def k1(spark, d):
    return K.regenerate_ids(T(spark, d).where("p <> 'cim:IdentifiedObject.mRID'"))


@query("k2_mrid_from_id", "SELECT DISTINCT s, 'cim:IdentifiedObject.mRID' AS p, regexp_replace(s, '^(urn:uuid:|#_)', '') AS o FROM triples WHERE p = 'rdf:type' AND o = 'cim:Terminal'")
def k2(spark, d):
    return K.mrid_from_id(T(spark, d), ["cim:Terminal"])


@query("k3_delete_required", "SELECT graph, s, p, o FROM triples t WHERE NOT EXISTS (SELECT 1 FROM triples x WHERE x.graph = t.graph AND x.s = t.s AND x.p = 'rdf:type' AND (x.o, t.p) IN (('cim:SvSwitch', 'cim:SvSwitch.open'), ('cim:Terminal', 'cim:Terminal.phases')))")
def k3(spark, d):
    required = spark.createDataFrame([("cim:SvSwitch", "cim:SvSwitch.open"), ("cim:Terminal", "cim:Terminal.phases")], "cls string, p string")
    return K.delete_required(T(spark, d), required).select("graph", "s", "p", "o")


@query("k4_break_datatypes", "SELECT graph, s, p, CASE WHEN o_kind <> 'literal' THEN o WHEN o_dt = 'xsd:integer' THEN '1.1' WHEN o_dt IN ('xsd:float', 'xsd:decimal') THEN '1,1' WHEN o_dt = 'xsd:boolean' THEN 'truee' WHEN o_dt IN ('xsd:date', 'xsd:dateTime') THEN 'not a date' ELSE o END AS o FROM triples WHERE p IS NOT NULL")
def k4(spark, d):
    return K.break_datatypes(T(spark, d, *COLS).where("p is not null")).select("graph", "s", "p", "o")


@query("k5_header_description", "WITH h AS (SELECT DISTINCT graph, s FROM triples WHERE p = 'rdf:type' AND o = 'md:FullModel') SELECT graph, s, p, o FROM triples t WHERE p IS DISTINCT FROM 'md:Model.description' OR (graph, s) NOT IN (SELECT (graph, s) FROM h) UNION ALL SELECT graph, s, 'md:Model.description', 'changed' FROM h")
def k5(spark, d):
    return K.set_header(T(spark, d).where("p is not null"), {"md:Model.description": "changed"}).unionByName(T(spark, d).where("p is null"))


@query("k7_rename", "SELECT graph, s, p, CASE WHEN p = 'md:Model.modelingAuthoritySet' AND o IN (SELECT min(o) FROM triples WHERE p = 'md:Model.modelingAuthoritySet') THEN 'http://new.example/' ELSE o END AS o FROM triples WHERE p IS NOT NULL")
def k7(spark, d):
    t = T(spark, d).where("p is not null")
    names = t.where("p = 'md:Model.modelingAuthoritySet'").agg(F.min("o").alias("old")).withColumn("new", F.lit("http://new.example/"))
    return K.rename_values(t, names, ["md:Model.modelingAuthoritySet"])


@query("k8_multiply_n", _A + "SELECT graph || '-' || i AS graph, s || '-' || i AS s, p, CASE WHEN o_kind = 'iri' AND p <> 'rdf:type' THEN o || '-' || i ELSE o END AS o FROM a, range(1, 4) r(i)")
def k8(spark, d):
    return K.multiply(_ab(spark, d)[0], 3).select("graph", "s", "p", "o")


@query("k10_multiply_over", "WITH c(i, ts, pr) AS (VALUES (1, '2031-05-01T00:30:00Z', '1D'), (2, '2031-05-01T01:30:00Z', '2D')) SELECT graph || '-' || i AS graph, s || '-' || i AS s, p, CASE WHEN p = 'md:Model.scenarioTime' THEN ts WHEN p = 'md:Model.description' THEN pr WHEN o_kind = 'iri' AND starts_with(o, 'urn:uuid:') THEN o || '-' || i ELSE o END AS o FROM triples, c WHERE p IS NOT NULL AND contains(graph, '_SV_')")
def k10(spark, d):
    t = T(spark, d, *COLS).where("p is not null and graph like '%\\_SV\\_%'")
    return K.multiply_over(t, [("2031-05-01T00:30:00Z", "1D"), ("2031-05-01T01:30:00Z", "2D")])


_DECL = [("SV", "cim:SvSwitch", "cim:SvSwitch.open"), ("SSH", "cim:Terminal", "cim:ACDCTerminal.connected"), ("EQ", "cim:Terminal", "cim:Terminal.phases")]


@query("k15_split_profiles", "WITH d(profile, cls, p) AS (VALUES " + ", ".join(map(str, _DECL)) + "), ty AS (SELECT DISTINCT s, o AS cls FROM triples WHERE p = 'rdf:type') SELECT q.profile, q.s, q.p, t.o FROM (SELECT DISTINCT profile, s, p FROM ty JOIN d USING (cls)) q JOIN triples t ON t.s = q.s AND t.p = q.p UNION ALL SELECT DISTINCT profile, s, 'rdf:type', cls FROM ty JOIN d USING (cls)")
def k15(spark, d):
    return K.split_by_profile(T(spark, d), spark.createDataFrame(_DECL, "profile string, cls string, p string"))


@query("k17_strictest_wins", """WITH r AS (SELECT p_brand AS cls, p_type AS p, CASE p_partkey % 4 WHEN 0 THEN 'minCount' WHEN 1 THEN 'maxCount' WHEN 2 THEN 'minInclusive' ELSE 'maxLength' END AS c, CAST(p_size AS DOUBLE) AS v FROM part), x AS (SELECT cls, p, max(CASE WHEN c = 'minCount' THEN v END) AS "minCount", max(CASE WHEN c = 'minInclusive' THEN v END) AS "minInclusive", CAST(NULL AS DOUBLE) AS "minExclusive", CAST(NULL AS DOUBLE) AS "minLength",
min(CASE WHEN c = 'maxCount' THEN v END) AS "maxCount", CAST(NULL AS DOUBLE) AS "maxInclusive", CAST(NULL AS DOUBLE) AS "maxExclusive", min(CASE WHEN c = 'maxLength' THEN v END) AS "maxLength" FROM r GROUP BY 1, 2) SELECT * FROM x""")
def k17(spark, d):
    c = F.element_at(F.array(*[F.lit(x) for x in ("minCount", "maxCount", "minInclusive", "maxLength")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return R.strictest(table(spark, d, "part").select(F.col("p_brand").alias("cls"), F.col("p_type").alias("p"), c.alias("component"), F.col("p_size").cast("string").alias("value")))


@query("k13_generate")
def k13(spark, d):
    n = table(spark, d, "part").count()
    return K.generate(spark, "cim:Breaker", n, {"cim:Switch.ratedCurrent": ("xsd:float", 0, 5000), "cim:Switch.normalOpen": ("xsd:boolean", 0, 1), "cim:Breaker.poles": ("xsd:integer", 1, 3)}, seed=42)


def _sparql(spark, d, text):
    return P.select(T(spark, d, *COLS), text)


@query("s1_bgp_optional", "SELECT a.s, a.o AS label, c.o AS comment FROM (SELECT DISTINCT s, o FROM triples WHERE p = 'rdfs:label' AND o IS NOT NULL) a LEFT JOIN (SELECT DISTINCT s, o FROM triples WHERE p = 'cims:stereotype' AND o IS NOT NULL) c USING (s)")
def s1(spark, d):
    return _sparql(spark, d, "SELECT ?s ?label ?comment WHERE { ?s rdfs:label ?label . OPTIONAL { ?s cims:stereotype ?comment } }")


@query("s2_bgp_minus", "SELECT DISTINCT s FROM triples WHERE p = 'rdf:type' AND o = 'rdfs:Class' AND s NOT IN (SELECT s FROM triples WHERE p = 'rdfs:subClassOf' AND o IS NOT NULL)")
def s2(spark, d):
    return _sparql(spark, d, "SELECT DISTINCT ?s WHERE { ?s a rdfs:Class . MINUS { ?s rdfs:subClassOf ?o } }")


@query("s3_path_plus", "WITH RECURSIVE e AS (SELECT DISTINCT s, o FROM triples WHERE p = 'rdfs:subClassOf' AND o IS NOT NULL), c(s, up) AS (SELECT s, o FROM e UNION SELECT c.s, e.o FROM c JOIN e ON e.s = c.up) SELECT s, up FROM c")
def s3(spark, d):
    return _sparql(spark, d, "SELECT ?s ?up WHERE { ?s rdfs:subClassOf+ ?up }")


@query("s4_group_having", "SELECT cls, count(*) AS n, min(s) AS least FROM (SELECT DISTINCT s, o AS cls FROM triples WHERE p = 'rdf:type' AND o IS NOT NULL) GROUP BY 1 HAVING count(*) > 100")
def s4(spark, d):
    return _sparql(spark, d, "SELECT ?cls (COUNT(?s) AS ?n) (MIN(?s) AS ?least) WHERE { ?s rdf:type ?cls } GROUP BY ?cls HAVING (?n > 100)")


@query("s5_filters_union", "SELECT s, o AS v FROM (SELECT DISTINCT s, o FROM triples WHERE p = 'rdfs:label') WHERE contains(o, 'Tap') AND length(o) < 20 UNION ALL SELECT s, o FROM (SELECT DISTINCT s, o FROM triples WHERE p = 'cim:IdentifiedObject.name') WHERE starts_with(lower(o), 'bri')")
def s5(spark, d):
    return _sparql(spark, d, "SELECT ?s ?v WHERE { { ?s rdfs:label ?v FILTER(CONTAINS(?v, 'Tap') && STRLEN(?v) < 20) } UNION { ?s cim:IdentifiedObject.name ?v FILTER(STRSTARTS(LCASE(?v), 'bri')) } }")


@query("s6_exists_order", "SELECT s, o AS open FROM (SELECT DISTINCT s, o FROM triples WHERE p = 'cim:SvSwitch.open' AND o IS NOT NULL) x WHERE s NOT IN (SELECT s FROM triples WHERE p = 'cim:SvSwitch.phase' AND o IS NOT NULL) ORDER BY s, open LIMIT 50")
def s6(spark, d):
    return _sparql(spark, d, "SELECT ?s ?open WHERE { ?s cim:SvSwitch.open ?open FILTER NOT EXISTS { ?s cim:SvSwitch.phase ?x } } ORDER BY ?s ?open LIMIT 50")


@query("s6_exists_order_all", "SELECT s, o AS open FROM (SELECT DISTINCT s, o FROM triples WHERE p = 'cim:SvSwitch.open' AND o IS NOT NULL) x WHERE s NOT IN (SELECT s FROM triples WHERE p = 'cim:SvSwitch.phase' AND o IS NOT NULL) ORDER BY s, open")
def s6_all(spark, d):
    return _sparql(spark, d, "SELECT ?s ?open WHERE { ?s cim:SvSwitch.open ?open FILTER NOT EXISTS { ?s cim:SvSwitch.phase ?x } } ORDER BY ?s ?open")
