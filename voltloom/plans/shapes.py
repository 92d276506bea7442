"""Queries of shapes graphs, mappings and load-flow comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import files as N
from ..operators import diff as D
from ..operators import shapes as H
from ..operators import tasks as K
from ..sources.tables import table
from .catalogue import query
from .graphs import COLS, T
from .joins import _FLOW, _flows

#: Labels, comments and packages of the vocabulary read as shapes.
_SHAPES = "t AS (SELECT DISTINCT s, CASE p WHEN 'rdfs:label' THEN 'sh:name' WHEN 'rdfs:comment' THEN 'sh:message' WHEN 'cims:belongsToCategory' THEN 'sh:group' ELSE 'sh:path' END AS p, o FROM triples WHERE p IN ('rdfs:label', 'rdfs:comment', 'cims:belongsToCategory', 'rdfs:subClassOf') AND o IS NOT NULL)"


def _shapes(spark, d):
    p = F.col("p")
    t = T(spark, d).where("p in ('rdfs:label', 'rdfs:comment', 'cims:belongsToCategory', 'rdfs:subClassOf') and o is not null")
    return t.select("s", F.when(p == "rdfs:label", "sh:name").when(p == "rdfs:comment", "sh:message").when(p == "cims:belongsToCategory", "sh:group").otherwise("sh:path").alias("p"), "o").distinct()


@query("j17_shape_inventory", f"WITH {_SHAPES} SELECT s AS shape, min(CASE WHEN p = 'sh:name' THEN o END) AS name, min(CASE WHEN p = 'sh:group' THEN o END) AS grp, 'Regular' AS kind, 'sh:Violation' AS severity, min(CASE WHEN p = 'sh:message' THEN o END) AS message FROM t GROUP BY 1 HAVING count(*) FILTER (p = 'sh:path') > 0")
def j17(spark, d):
    return H.inventory(_shapes(spark, d))


_ROWS = [(1, "", "Tap", "sh:severity", "sh:Warning"), (2, "Package", "Tap", "sh:severity", "sh:Info"), (3, "", "Relay", "sh:message", "changed")]


@query("d15_shape_override", f"WITH {_SHAPES}, r(n, grp, name, p, value) AS (VALUES " + ", ".join(map(str, _ROWS)) + """), h AS (SELECT x.s, r.p, arg_max(r.value, r.n) AS value FROM (SELECT DISTINCT s, o AS name FROM t WHERE p = 'sh:name') x JOIN r ON r.name = x.name LEFT JOIN (SELECT s, min(o) AS grp FROM t WHERE p = 'sh:group' GROUP BY 1) g ON g.s = x.s
WHERE CASE WHEN g.grp IS NULL THEN r.grp = '' ELSE contains(g.grp, r.grp) END GROUP BY 1, 2) SELECT s, p, o FROM t WHERE (s, p) NOT IN (SELECT (s, p) FROM h) UNION SELECT s, p, value FROM h""")
def d15(spark, d):
    return H.override(_shapes(spark, d), spark.createDataFrame(_ROWS, "n int, grp string, name string, property string, value string"))


@query("j6_split_shapes", f"WITH {_SHAPES} SELECT s, p, o FROM t WHERE NOT ends_with(s, 'Kind') AND NOT (ends_with(o, 'Kind') AND o IN (SELECT s FROM t))")
def j6(spark, d):
    return H.split_off(_shapes(spark, d), "Kind")[0].select("s", "p", "o")


@query("j7_without_isolated", "SELECT DISTINCT s FROM triples WHERE p = 'rdf:type' AND o = 'rdfs:Class' AND (s IN (SELECT s FROM triples WHERE p = 'rdfs:subClassOf') OR s IN (SELECT o FROM triples WHERE p = 'rdfs:subClassOf' AND o IS NOT NULL))")
def j7(spark, d):
    t = T(spark, d)
    return H.without_isolated(t.where("p = 'rdfs:subClassOf'").select("s", "o"), t.where("p = 'rdf:type' and o = 'rdfs:Class'").select("s").distinct())


@query("j13_serialization_info", "SELECT DISTINCT s AS item, CASE WHEN o = 'Description' THEN 'about' ELSE 'enum' END AS kind FROM triples WHERE p = 'cims:stereotype' AND (o = 'Description' OR ends_with(o, '#enumeration'))")
def j13(spark, d):
    t = T(spark, d).where("p = 'cims:stereotype' and (o = 'Description' or o like '%#enumeration')")
    return t.select(F.col("s").alias("item"), F.when(F.col("o") == "Description", "about").otherwise("enum").alias("kind")).distinct()


@query("j21_common_data", "SELECT DISTINCT 'http://temp.example/' || regexp_extract(s, '[^#/]*$') AS s, p, CASE WHEN starts_with(o, 'http://vocab.') THEN 'http://temp.example/' || regexp_extract(o, '[^#/]*$') ELSE o END AS o FROM triples WHERE starts_with(s, 'http://vocab.') AND p NOT IN ('dcat:keyword') AND o IS NOT NULL")
def j21(spark, d):
    local = lambda c: F.concat(F.lit("http://temp.example/"), F.regexp_extract(c, "[^#/]*$", 0))
    t = T(spark, d).where("s like 'http://vocab.%' and p <> 'dcat:keyword' and o is not null")
    return t.select(local("s").alias("s"), "p", F.when(F.col("o").startswith("http://vocab."), local("o")).otherwise(F.col("o")).alias("o")).distinct()


@query("j25_header_rows", "SELECT graph, max(CASE WHEN p = 'md:Model.modelingAuthoritySet' THEN o END) AS mas, min(CASE WHEN p = 'rdf:type' THEN s END) AS id FROM triples WHERE p = 'md:Model.modelingAuthoritySet' OR (p = 'rdf:type' AND o = 'md:FullModel') GROUP BY 1")
def j25(spark, d):
    t = T(spark, d).where("p = 'md:Model.modelingAuthoritySet' or (p = 'rdf:type' and o = 'md:FullModel')")
    return t.groupBy("graph").agg(F.max(F.when(F.col("p") == "md:Model.modelingAuthoritySet", F.col("o"))).alias("mas"), F.min(F.when(F.col("p") == "rdf:type", F.col("s"))).alias("id"))


_FILES = f"f AS (SELECT DISTINCT profile, file_name AS file, coalesce(file_group, 'none') AS grp, strftime(final_ts, '%Y-%m-%d') AS ts FROM file_metadata WHERE profile IN ('EQ', 'SV', 'SSH'))"
_TOKENS = [(1, "EQ;SV", "plain"), (2, "ZIP:*QELM*SV*.xml", "glob"), (3, "SSH", "one"), (4, "nothing", "none")]


@query("d13_resolve_inputs", f"""WITH {_FILES}, i AS (SELECT DISTINCT grp, ts FROM f WHERE profile <> 'EQ'), t("row", token, profile) AS (VALUES (1, 'EQ', 'EQ'), (1, 'SV', 'SV'), (2, '*QELM*SV*.xml', 'SV'), (3, 'SSH', 'SSH')), j AS (SELECT "row", token, f.* FROM t JOIN f USING (profile) WHERE token = profile OR regexp_full_match(file, '.*QELM.*SV.*\\.xml'))
SELECT "row", token, grp, ts AS at, file FROM j WHERE profile <> 'EQ' UNION SELECT "row", token, j.grp, i.ts, file FROM j JOIN i ON i.grp = j.grp WHERE profile = 'EQ'""")
def d13(spark, d):
    m = table(spark, d, "file_metadata").where("profile in ('EQ', 'SV', 'SSH')")
    files = m.select("profile", F.col("file_name").alias("file"), F.coalesce("file_group", F.lit("none")).alias("grp"), F.date_format(F.col("final_ts").cast("timestamp"), "yyyy-MM-dd").alias("at")).distinct()
    tokens = H.expand_inputs(spark.createDataFrame(_TOKENS, "row int, xml_inputs string, notes string"))
    return H.resolve_inputs(tokens, files, {"EQ": "static", "SV": "timestamped", "SSH": "timestamped"})


@query("l7_categorise", """WITH m AS (SELECT file_group, strftime(final_ts, '%Y-%m-%d') AS day, string_agg(DISTINCT file_name, ';' ORDER BY file_name) AS files FROM file_metadata WHERE file_group IS NOT NULL AND final_ts IS NOT NULL GROUP BY 1, 2),
x AS (SELECT file_group, day, CASE file_group WHEN 'intraday' THEN 'CGMES_all.ttl' WHEN 'archive' THEN 'NC_all.ttl' WHEN 'inbox' THEN 'NCP_v2-4-0/NC-v2-4-0_AP-Con-Complex-Common-SHACL.ttl' ELSE 'other.ttl' END AS ttl, files || CASE WHEN day < '2031-03-01' THEN ';Grid_CommonData_CGM-CD.xml' WHEN day < '2031-05-01' THEN ';Grid_CommonData_CGM-CD.xml;Svedala_EQ;Britheim_EQ' ELSE '' END AS xml FROM m)
SELECT file_group, day, CASE WHEN starts_with(ttl, 'NCP_v2-4-0/NC-v2-4-0_AP-Con-Complex-Common-SHACL.ttl') THEN 'DANGLINGREFERENCE' WHEN starts_with(ttl, 'NC_') THEN 'NC_SINGLE'
WHEN starts_with(ttl, 'CGMES_') AND contains(xml, 'Grid_CommonData_CGM-CD.xml') AND contains(xml, 'EQ') AND contains(xml, 'Svedala') AND contains(xml, 'Britheim') THEN 'CGMES_CGM'
WHEN starts_with(ttl, 'CGMES_') AND contains(xml, 'Grid_CommonData_CGM-CD.xml') AND contains(xml, 'EQ') AND contains(xml, 'SSH') AND contains(xml, 'TP') AND contains(xml, 'SV') THEN 'CGMES_IGM_COMPLETE' WHEN starts_with(ttl, 'CGMES_') THEN 'CGMES_SINGLE_PROFILE' ELSE 'UNKNOWN' END AS category FROM x""")
def l7(spark, d):
    """Mapping rows of each group's files of a day, with a constraint file by group."""
    m = table(spark, d, "file_metadata").where("file_group is not null and final_ts is not null")
    m = m.groupBy("file_group", F.date_format(F.col("final_ts").cast("timestamp"), "yyyy-MM-dd").alias("day")).agg(F.array_join(F.array_sort(F.collect_set("file_name")), ";").alias("files"))
    g, day, more = F.col("file_group"), F.col("day"), "Grid_CommonData_CGM-CD.xml"
    ttl = F.when(g == "intraday", "CGMES_all.ttl").when(g == "archive", "NC_all.ttl").when(g == "inbox", "NCP_v2-4-0/NC-v2-4-0_AP-Con-Complex-Common-SHACL.ttl").otherwise("other.ttl")
    xml = F.concat("files", F.when(day < "2031-03-01", f";{more}").when(day < "2031-05-01", f";{more};Svedala_EQ;Britheim_EQ").otherwise(""))
    return m.select("file_group", "day", H.category(ttl, xml).alias("category"))


@query("l5_result_extraction", f"WITH {_SHAPES}, m AS (SELECT s, max(CASE WHEN p = 'sh:name' THEN o END) AS name, max(CASE WHEN p = 'sh:message' THEN o END) AS description FROM t GROUP BY 1), k AS (SELECT length(s) AS k, min(s) AS s FROM m GROUP BY 1) SELECT event_id, m.s AS source_shape, name, description FROM events JOIN k ON k.k = 20 + event_id % 60 JOIN m ON m.s = k.s")
def l5(spark, d):
    own = lambda p: F.max(F.when(F.col("p") == p, F.col("o")))
    meta = _shapes(spark, d).groupBy("s").agg(own("sh:name").alias("name"), own("sh:message").alias("description"))
    # the fixture's results name a shape by the length of its id
    meta = meta.groupBy(F.length("s").alias("k")).agg(F.min_by(F.struct("s", "name", "description"), "s").alias("m"))
    e = table(spark, d, "events").select("event_id", (F.col("event_id") % 60 + 20).alias("k"))
    return e.join(meta, "k").select("event_id", F.col("m.s").alias("source_shape"), "m.name", "m.description")


@query("g3_top_constraints", "SELECT p, o, count(*) AS n FROM triples WHERE p = 'cims:stereotype' GROUP BY 1, 2 ORDER BY n DESC, o")
def g3(spark, d):
    return T(spark, d, "p", "o").where("p = 'cims:stereotype'").groupBy("p", "o").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "o")


@query("i3_loose_profile_diff", "WITH a AS (SELECT regexp_extract(s, '[^#/]*$') AS name, max(o) AS v FROM triples WHERE p = 'rdfs:label' AND starts_with(s, 'http') GROUP BY 1), b AS (SELECT regexp_extract(s, '[^#/]*$') AS name, max(o) AS v FROM triples_b WHERE p = 'rdfs:label' AND starts_with(s, 'http') GROUP BY 1) SELECT name, 'label' AS field, coalesce(a.v, '-') AS value_a, coalesce(b.v, '-') AS value_b FROM a FULL JOIN b USING (name) WHERE coalesce(a.v, '-') <> coalesce(b.v, '-')")
def i3(spark, d):
    from ..functions.ids import local_name, pick

    one = lambda t: t.where("p = 'rdfs:label' and s like 'http%'").groupBy(local_name(F.col("s")).alias("name")).agg(F.max("o").alias("label"))
    return D.profile_diff(one(T(spark, d, "s", "p", "o")), one(pick(table(spark, d, "triples_b"), "s", "p", "o")), "name", ["label"])


@query("i6_state_diff", """WITH v AS (SELECT graph, s, max(CASE WHEN p = 'cim:SvSwitch.Switch' THEN o END) AS sw, max(CASE WHEN p = 'cim:SvSwitch.open' THEN lower(trim(o, ' ')) END) AS open FROM triples WHERE p IN ('cim:SvSwitch.Switch', 'cim:SvSwitch.open') GROUP BY 1, 2)
SELECT sw, min(open) AS least, max(open) AS most, count(*) AS n FROM v WHERE sw <> '' AND open IS NOT NULL GROUP BY 1 HAVING min(open) <> max(open)""")
def i6(spark, d):
    # all records of a switch in one aggregation instead of a join of every pair of models
    own = lambda p, v: F.max(F.when(F.col("p") == p, v))
    v = T(spark, d).where("p in ('cim:SvSwitch.Switch', 'cim:SvSwitch.open')").groupBy("graph", "s").agg(own("cim:SvSwitch.Switch", F.col("o")).alias("sw"), own("cim:SvSwitch.open", F.lower(F.trim("o"))).alias("open"))
    return v.where("sw <> '' and open is not null").groupBy("sw").agg(F.min("open").alias("least"), F.max("open").alias("most"), F.count("*").alias("n")).where("least <> most")


@query("i7_flow_diff", f"WITH x AS ({_FLOW}), u AS (SELECT least(f, t) AS n1, greatest(f, t) AS n2, CASE WHEN f > t THEN -q ELSE q END AS flow FROM x WHERE f <> t), a AS (SELECT n1, n2, flow FROM u WHERE flow > 0), b AS (SELECT n1, n2, flow FROM u WHERE flow < 0) SELECT n1, n2, a.flow AS flow_a, b.flow AS flow_b, abs(abs(a.flow) - abs(b.flow)) AS delta FROM a JOIN b USING (n1, n2)")
def i7(spark, d):
    u = D.undirected(_flows(spark, d).where("f <> t"), "f", "t", "q")
    g = u.groupBy("n1", "n2").agg(F.max(F.when(F.col("flow") > 0, F.col("flow"))).alias("flow_a"), F.min(F.when(F.col("flow") < 0, F.col("flow"))).alias("flow_b"))
    return g.where("flow_a is not null and flow_b is not null").withColumn("delta", F.abs(F.abs("flow_a") - F.abs("flow_b")))


@query("k6_authority_set", "WITH h AS (SELECT DISTINCT graph, s FROM triples WHERE p = 'rdf:type' AND o = 'md:FullModel' AND contains(graph, '_SV_')) SELECT graph, s, p, o FROM triples WHERE contains(graph, '_SV_') AND p IS NOT NULL AND (p <> 'md:Model.modelingAuthoritySet' OR (graph, s) NOT IN (SELECT (graph, s) FROM h)) UNION ALL SELECT graph, s, 'md:Model.modelingAuthoritySet', 'http://tso.example/' FROM h")
def k6(spark, d):
    return K.set_header(T(spark, d).where("p is not null and graph like '%\\_SV\\_%'"), {"md:Model.modelingAuthoritySet": "http://tso.example/"})


@query("k16_header_dependencies", "WITH h AS (SELECT DISTINCT file_name, profile, strftime(final_ts, '%Y-%m-%d') AS day, regexp_extract(file_name, '^[0-9]{8}T[0-9]{4}Z_([A-Z0-9]+)_', 1) AS own FROM file_metadata WHERE profile IN ('EQ', 'SSH', 'SV')) SELECT a.file_name, b.file_name AS depends_on FROM h a JOIN h b ON a.own = b.own AND a.day = b.day WHERE (a.profile, b.profile) IN (('SSH', 'EQ'), ('SV', 'SSH'))")
def k16(spark, d):
    m = table(spark, d, "file_metadata").where("profile in ('EQ', 'SSH', 'SV')").select("file_name", "profile", F.date_format(F.col("final_ts").cast("timestamp"), "yyyy-MM-dd").alias("day"), N.party(F.col("file_name")).alias("own")).distinct()
    needs = F.when(F.col("profile") == "SSH", "EQ").when(F.col("profile") == "SV", "SSH")
    a = m.select("file_name", "day", "own", needs.alias("profile")).where("profile is not null")
    return a.join(m.withColumnRenamed("file_name", "depends_on"), ["profile", "day", "own"]).select("file_name", "depends_on")


@query("m7_country_owner", """WITH x AS (SELECT DISTINCT file_name, file_group, replace(upper(trim(regexp_extract(file_name, '[^_]*_(.*)', 1))), '-', '_') AS t, replace(replace(upper(file_group), '-', ''), '_', '') AS g FROM file_metadata WHERE file_group IS NOT NULL),
y AS (SELECT *, CASE WHEN starts_with(t, 'REE_') THEN 'REE' WHEN starts_with(t, 'REN_') THEN 'REN' WHEN starts_with(t, 'RTEFRANCE_') OR starts_with(t, 'RTE_') THEN 'RTE' END AS owner FROM x)
SELECT file_name, file_group, owner, owner IS NULL OR g = owner OR (owner = 'RTE' AND g = 'RTEFRANCE') AS applies FROM y""")
def m7(spark, d):
    """The tokens are file names without their time."""
    t = F.regexp_extract("file_name", "[^_]*_(.*)", 1)
    m = table(spark, d, "file_metadata").where("file_group is not null")
    return m.select("file_name", "file_group", N.country_owner(t).alias("owner"), N.applies_to(t, F.col("file_group")).alias("applies")).distinct()


@query("m18_array_functions", "SELECT o_custkey AS k, len(list_distinct(array_agg(o_orderpriority))) AS n, list_contains(array_agg(o_orderpriority), '1-URGENT') AS urgent FROM orders GROUP BY 1")
def m18(spark, d):
    g = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.collect_list("o_orderpriority").alias("x"))
    return g.select("k", F.size(F.array_distinct("x")).cast("bigint").alias("n"), F.array_contains("x", "1-URGENT").alias("urgent"))


@query("a12_typed_rows", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def a12(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
