"""Queries of the operators on statement rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ids import local_name, pick
from ..operators import graph as G
from ..sources import mapping as M
from ..sources.tables import table
from .catalogue import query

COLS = ("graph", "s", "p", "o", "o_kind", "o_dt", "o_lang")


def T(spark, d, *cols):
    return pick(table(spark, d, "triples"), *(cols or ("graph", "s", "p", "o")))


@query("c1_match_pattern", "SELECT graph, s FROM triples WHERE p = 'rdf:type' AND o = 'cim:SvSwitch'")
def c1(spark, d):
    return G.match(T(spark, d), p="rdf:type", o="cim:SvSwitch").select("graph", "s")


@query("c2_exists", "SELECT graph, s, p, o FROM triples WHERE s IN (SELECT s FROM triples WHERE p = 'cims:stereotype' AND o = 'Description')")
def c2(spark, d):
    return G.having(T(spark, d), "cims:stereotype", "Description").select("graph", "s", "p", "o")


@query("c3_inheritance_filter", "SELECT s, p, o FROM triples WHERE p IN ('rdf:type', 'rdfs:subClassOf', 'rdfs:subPropertyOf', 'rdfs:domain', 'rdfs:range')")
def c3(spark, d):
    return G.inheritance_only(T(spark, d)).select("s", "p", "o")


@query("c4_strip_headers", """WITH h AS (SELECT s FROM triples WHERE p = 'rdf:type' AND o = 'owl:Ontology' EXCEPT SELECT s FROM triples WHERE p = 'sh:declare')
SELECT graph, p, count(*) AS n FROM triples WHERE s NOT IN (SELECT s FROM h) GROUP BY 1, 2""")
def c4(spark, d):
    return G.strip_headers(T(spark, d)).groupBy("graph", "p").agg(F.count("*").alias("n"))


@query("c5_tagged_deletion", r"""WITH gone AS (SELECT s FROM triples WHERE p = 'cims:belongsToCategory' AND regexp_extract(o, '[^#/:]*$') = 'Package_TapGroup' UNION SELECT s FROM triples WHERE p = 'rdfs:label' AND o = 'Tap'
UNION SELECT s FROM triples WHERE p = 'cims:stereotype' AND o = 'Primitive'), hangs AS (SELECT s FROM triples WHERE p IN ('rdfs:domain', 'rdfs:range', 'rdf:type') AND o IN (SELECT s FROM gone))
SELECT s, p, o FROM triples WHERE s NOT IN (SELECT s FROM gone) AND s NOT IN (SELECT s FROM hangs)""")
def c5(spark, d):
    return G.delete_tagged(T(spark, d), "Package_TapGroup", "Tap", "Primitive").select("s", "p", "o")


@query("c6_conflict_resolution", """WITH v AS (SELECT s, o, min(graph) AS g FROM triples WHERE p = 'rdfs:label' GROUP BY 1, 2), w AS (SELECT *, count(*) OVER (PARTITION BY s) AS n, min(g) OVER (PARTITION BY s) AS f FROM v)
SELECT graph, s, p, o FROM triples t WHERE p = 'rdfs:label' AND NOT EXISTS (SELECT 1 FROM w WHERE w.s = t.s AND w.o = t.o AND n > 1 AND g = f)""")
def c6(spark, d):
    return G.resolve_conflicts(T(spark, d).where("p = 'rdfs:label'"), "rdfs:label", F.col("graph")).select("graph", "s", "p", "o")


@query("c7_header_argmax", """WITH c AS (SELECT graph, s, count(*) AS n FROM triples WHERE (graph, s) IN (SELECT (graph, s) FROM triples WHERE p = 'rdf:type' AND o IN ('md:FullModel')) GROUP BY 1, 2)
SELECT graph, s, n FROM c QUALIFY row_number() OVER (PARTITION BY graph ORDER BY n DESC, s DESC) = 1""")
def c7(spark, d):
    return G.keep_largest_header(T(spark, d), "md:FullModel", ["graph"])


@query("c8_strip_prefixes", r"""WITH x AS (SELECT graph, s AS x FROM triples UNION ALL SELECT graph, p FROM triples UNION ALL SELECT graph, o FROM triples),
n AS (SELECT DISTINCT graph, CASE WHEN regexp_matches(x, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN regexp_extract(x, '^(.*[#/])', 1) END AS ns, CASE WHEN regexp_matches(x, '^[A-Za-z0-9]*:[^/ ]') THEN split_part(x, ':', 1) END AS prefix FROM x WHERE x IS NOT NULL)
SELECT DISTINCT graph, prefix, ns FROM prefixes p WHERE EXISTS (SELECT 1 FROM n WHERE n.graph = p.graph AND n.ns = p.ns) OR EXISTS (SELECT 1 FROM n WHERE n.graph = p.graph AND n.prefix = p.prefix)""")
def c8(spark, d):
    return G.used_prefixes(pick(table(spark, d, "prefixes"), "graph", "prefix", "ns"), T(spark, d))


@query("c9_prefix_dedup", "SELECT ns, min(prefix) AS prefix FROM prefixes GROUP BY 1")
def c9(spark, d):
    return G.one_prefix(table(spark, d, "prefixes"))


@query("c10_package_retarget", """WITH v AS (SELECT * FROM triples WHERE contains(graph, 'vocabulary')), r AS (SELECT graph, s, p, CASE WHEN p = 'cims:belongsToCategory' THEN 'http://x.example#Package_AllProfile' ELSE o END AS o FROM v
WHERE s NOT IN (SELECT s FROM v WHERE p = 'rdf:type' AND o = 'cims:ClassCategory')), g AS (SELECT DISTINCT graph FROM r)
SELECT * FROM r UNION SELECT graph, 'http://x.example#Package_AllProfile', p, o FROM g, (VALUES ('rdf:type', 'cims:ClassCategory'), ('rdfs:label', 'Package_AllProfile'), ('rdfs:comment', 'Package Package_AllProfile')) x(p, o)""")
def c10(spark, d):
    return G.retarget_packages(T(spark, d).where(F.col("graph").contains("vocabulary")), "http://x.example#Package_AllProfile")


@query("c11_owl_typing", """SELECT DISTINCT s, 'rdf:type' AS p, o FROM (SELECT s, CASE o WHEN 'rdfs:Class' THEN 'owl:Class' WHEN 'rdf:Property' THEN 'owl:ObjectProperty' END AS o FROM triples WHERE p = 'rdf:type'
UNION ALL SELECT s, CASE WHEN contains(lower(o), 'enum') THEN 'owl:NamedIndividual' WHEN o IN ('CIMDatatype', 'Primitive') THEN 'owl:DatatypeProperty' END FROM triples WHERE p = 'cims:stereotype') WHERE o IS NOT NULL""")
def c11(spark, d):
    return G.owl_types(T(spark, d))


_PARTS = {"p_brand": "str", "p_type": "str", "p_size": "int"}
_PART_SQL = M.sql("part", "A", "part", "p_partkey", "cim:Part", _PARTS)


@query("c12_bnode_dedup", f"""WITH t AS ({_PART_SQL}), g AS (SELECT s, string_agg(p || '=' || o, ';' ORDER BY p || '=' || o) AS sig FROM t GROUP BY 1)
SELECT s, keep FROM (SELECT s, min(s) OVER (PARTITION BY sig) AS keep FROM g) WHERE s <> keep""")
def c12(spark, d):
    t = M.statements(table(spark, d, "part"), "A", "part", "p_partkey", "cim:Part", _PARTS)
    return G.repeated_nodes(t, t.select("s").distinct())


@query("c12_bnode_nested", """WITH RECURSIVE n AS (SELECT p_partkey AS k, p_size % 2 AS v, p_partkey % 12 = 11 OR p_partkey = (SELECT max(p_partkey) FROM part) AS leaf FROM part),
c(k, sig) AS (SELECT k, '[v=' || v || ']' FROM n WHERE leaf UNION ALL SELECT n.k, '[next=' || c.sig || ';v=' || n.v || ']' FROM n JOIN c ON c.k = n.k + 1 WHERE NOT n.leaf)
SELECT s, keep FROM (SELECT 'part/' || k AS s, min('part/' || k) OVER (PARTITION BY sig) AS keep FROM c) WHERE s <> keep""")
def c12_nested(spark, d):
    """Chains of twelve parts, each nested in the one before it."""
    k, part = F.col("p_partkey"), table(spark, d, "part")
    name = lambda c: F.concat(F.lit("part/"), c.cast("string"))
    part = part.crossJoin(part.agg(F.max("p_partkey").alias("last")))
    rows = F.array(F.struct(F.lit("v").alias("p"), (F.col("p_size") % 2).cast("string").alias("o")), F.struct(F.lit("next").alias("p"), F.when((k % 12 != 11) & (k != F.col("last")), name(k + 1)).alias("o")))
    t = part.select(name(k).alias("s"), F.inline(rows)).where("o is not null")
    return G.repeated_nodes(t, t.select("s").distinct())


@query("c13_rename_ns", """SELECT graph, CASE WHEN starts_with(s, 'urn:uuid:') THEN '#_' || substr(s, 10) ELSE s END AS s, p, CASE WHEN starts_with(o, 'urn:uuid:') THEN '#_' || substr(o, 10) ELSE o END AS o FROM triples""")
def c13(spark, d):
    return G.rename_namespace(T(spark, d), "urn:uuid:", "#_", ("s", "o"))


@query("c14_objects_of", "SELECT DISTINCT o FROM triples WHERE p = 'cims:stereotype' AND o IS NOT NULL")
def c14(spark, d):
    return G.objects_of(T(spark, d), "cims:stereotype")


@query("c15_compact", r"""WITH pf AS (SELECT graph, ns, min(prefix) AS prefix FROM prefixes GROUP BY 1, 2)
SELECT t.graph, p, CASE WHEN NOT regexp_matches(s, '^https?://') THEN s WHEN prefix IS NOT NULL THEN prefix || ':' || substr(s, length(regexp_extract(s, '^(.*[#/])', 1)) + 1) ELSE substr(s, length(regexp_extract(s, '^(.*[#/])', 1)) + 1) END AS s
FROM triples t LEFT JOIN pf ON pf.graph = t.graph AND pf.ns = regexp_extract(s, '^(.*[#/])', 1) AND regexp_matches(s, '^https?://') WHERE p = 'rdfs:label'""")
def c15(spark, d):
    return G.compact(T(spark, d, "graph", "s", "p").where("p = 'rdfs:label'"), table(spark, d, "prefixes"), "s")


@query("c16_render", "SELECT graph, s, p, CASE WHEN o IS NULL THEN '' WHEN o_kind = 'iri' THEN regexp_extract(o, '[^#/]*$') ELSE o END AS shown FROM triples")
def c16(spark, d):
    t = T(spark, d, "graph", "s", "p", "o", "o_kind")
    return t.select("graph", "s", "p", F.when(F.col("o").isNull(), "").when(F.col("o_kind") == "iri", local_name(F.col("o"))).otherwise(F.col("o")).alias("shown"))


@query("a2_prefix_versions", "SELECT graph, CASE WHEN prefix = 'cim' THEN 'cim' || regexp_extract(ns, '/cim/([0-9]+)#', 1) ELSE prefix END AS prefix, ns FROM prefixes")
def a2(spark, d):
    p = pick(table(spark, d, "prefixes"), "graph", "prefix", "ns")
    return p.withColumn("prefix", F.when(F.col("prefix") == "cim", F.concat(F.lit("cim"), F.regexp_extract("ns", "/cim/([0-9]+)#", 1))).otherwise(F.col("prefix")))


@query("a5_assign_datatypes", """SELECT graph, s, t.p, o, CASE WHEN o_kind <> 'literal' OR o_lang IS NOT NULL THEN o_dt ELSE coalesce(m.dt, 'xsd:string') END AS o_dt FROM triples t LEFT JOIN datatype_map m ON m.p = t.p""")
def a5(spark, d):
    m = table(spark, d, "datatype_map").groupBy("p").agg(F.min("dt").alias("dt"))
    keep = (F.col("o_kind") != "literal") | F.col("o_lang").isNotNull()
    return T(spark, d, *COLS).join(m, "p", "left").select("graph", "s", "p", "o", F.when(keep, F.col("o_dt")).otherwise(F.coalesce("dt", F.lit("xsd:string"))).alias("o_dt"))


@query("h1_union", "SELECT graph, s, p, o FROM triples UNION SELECT graph, s, p, o FROM triples_b")
def h1(spark, d):
    return G.union(T(spark, d), pick(table(spark, d, "triples_b"), "graph", "s", "p", "o"))


@query("h2_difference", "SELECT s, p, o FROM triples WHERE p = 'rdfs:label' AND o IS NOT NULL AND (s, p, o) NOT IN (SELECT (s, p, o) FROM triples_b WHERE s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL)")
def h2(spark, d):
    t = T(spark, d).where("p = 'rdfs:label' and o is not null")
    return G.minus(t, table(spark, d, "triples_b")).select("s", "p", "o")


@query("h3_symmetric_difference", f"WITH a AS ({M.A_SQL}), b AS ({M.B_SQL}) (SELECT 'A' AS side, s, p, o FROM (SELECT s, p, o FROM a EXCEPT SELECT s, p, o FROM b)) UNION ALL (SELECT 'B', s, p, o FROM (SELECT s, p, o FROM b EXCEPT SELECT s, p, o FROM a))")
def h3(spark, d):
    return G.symmetric_difference(*M.order_models(table(spark, d, "orders")))


@query("h5_list_equal", """WITH a AS (SELECT l_orderkey AS k, array_agg(l_returnflag) AS x FROM lineitem GROUP BY 1), b AS (SELECT l_orderkey AS k, array_agg(l_returnflag) AS y FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)
SELECT k, len(x) = len(y) AND list_has_all(y, x) AS same FROM a JOIN b USING (k)""")
def h5(spark, d):
    li = table(spark, d, "lineitem")
    a = li.groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list("l_returnflag").alias("x"))
    b = li.where("l_linestatus = 'F'").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list("l_returnflag").alias("y"))
    return a.join(b, "k").select("k", ((F.size("x") == F.size("y")) & (F.size(F.array_except("x", "y")) == 0)).alias("same"))


_CLOSURE = "WITH RECURSIVE e AS (SELECT 'customer/' || c_custkey AS s, 'nation/' || c_nationkey AS o FROM customer UNION ALL SELECT 'supplier/' || s_suppkey, 'nation/' || s_nationkey FROM supplier UNION ALL SELECT 'nation/' || n_nationkey, 'region/' || n_regionkey FROM nation), c(child, ancestor) AS (SELECT s, o FROM e UNION SELECT c.child, e.o FROM c JOIN e ON e.s = c.ancestor)"


def _edges(spark, d):
    edge = lambda t, a, k, b, f: table(spark, d, t).select(F.concat(F.lit(a), k).alias("s"), F.concat(F.lit(b), f).alias("o"))
    return edge("customer", "customer/", "c_custkey", "nation/", "c_nationkey").union(edge("supplier", "supplier/", "s_suppkey", "nation/", "s_nationkey")).union(edge("nation", "nation/", "n_nationkey", "region/", "n_regionkey"))


@query("j2_subclass_closure", _CLOSURE + " SELECT child, ancestor FROM c")
def j2(spark, d):
    return G.closure(_edges(spark, d))


_PROPS = [("region.tariff", "region"), ("region.zone", "region"), ("nation.code", "nation"), ("nation.name", "nation")]


@query("j3_inherited_props", _CLOSURE + ", pr AS (SELECT 'region.zone' AS property, 'region/' || r_regionkey AS domain FROM region UNION ALL SELECT 'nation.code', 'nation/' || n_nationkey FROM nation) SELECT domain AS cls, property, domain AS declared_on FROM pr UNION SELECT child, property, domain FROM c JOIN pr ON pr.domain = c.ancestor")
def j3(spark, d):
    pr = table(spark, d, "region").select(F.lit("region.zone").alias("property"), F.concat(F.lit("region/"), "r_regionkey").alias("domain")).union(
        table(spark, d, "nation").select(F.lit("nation.code"), F.concat(F.lit("nation/"), "n_nationkey"))
    )
    return G.inherited(pr, _edges(spark, d))


@query("e14_wide_predicates", """SELECT s, coalesce(string_agg(DISTINCT CASE WHEN p = 'rdfs:label' THEN o END, '; ' ORDER BY CASE WHEN p = 'rdfs:label' THEN o END), '') AS label,
coalesce(string_agg(DISTINCT CASE WHEN p = 'cims:stereotype' THEN o END, '; ' ORDER BY CASE WHEN p = 'cims:stereotype' THEN o END), '') AS stereotype FROM triples WHERE p IN ('rdfs:label', 'cims:stereotype') GROUP BY 1""")
def e14(spark, d):
    return G.wide_star(T(spark, d), {"rdfs:label": "label", "cims:stereotype": "stereotype"})
