"""Queries of the joins, aggregations and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ids import local_name
from ..operators import diff as D
from ..operators import graph as G
from ..operators import tasks as K
from ..sources import mapping as M
from ..sources.tables import table
from .catalogue import query
from .graphs import T

_A, _B = f"a AS ({M.A_SQL})", f"b AS ({M.B_SQL})"
_AB = f"WITH {_A}, {_B} "


def _ab(spark, d):
    return M.order_models(table(spark, d, "orders"))


@query("d1_shared_assoc_join", """WITH q AS (SELECT l_partkey AS part, l_returnflag AS f, CAST(sum(l_quantity) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2)
SELECT a.part, a.v AS value_a, b.v AS value_b, abs(a.v - b.v) AS delta FROM q a JOIN q b ON a.part = b.part WHERE a.f = 'A' AND b.f = 'R' AND a.v <> b.v""")
def d1(spark, d):
    q = table(spark, d, "lineitem").where("l_returnflag in ('A', 'R')").groupBy(F.col("l_partkey").alias("part")).agg(
        F.sum(F.when(F.col("l_returnflag") == "A", F.col("l_quantity"))).cast("bigint").alias("value_a"), F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))).cast("bigint").alias("value_b")
    )
    # both records of an association in one aggregation: no self-join
    return q.where("value_a <> value_b").withColumn("delta", F.abs(F.col("value_a") - F.col("value_b")))


@query("d2_overlap_first_match", """WITH m AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS part, o_orderstatus AS st FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT a.id AS id_a, min(b.id) AS id_b FROM m a JOIN m b ON a.part = b.part WHERE a.st = 'F' AND b.st = 'O' GROUP BY 1""")
def d2(spark, d):
    m = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("part")).distinct()
    m = m.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus"), "id")
    # the smallest partner of a member is enough: the join is with one row for each member
    first = m.where("o_orderstatus = 'O'").groupBy("part").agg(F.min("id").alias("id"))
    return D.overlap_first(m.where("o_orderstatus = 'F'"), first, "part")


@query("d3_subject_predicate_join", _AB + "SELECT a.s, a.p, a.o AS value_a, b.o AS value_b FROM a JOIN b ON a.s = b.s AND a.p = b.p WHERE a.o <> b.o")
def d3(spark, d):
    a, b = _ab(spark, d)
    return a.select("s", "p", F.col("o").alias("value_a")).join(b.select("s", "p", F.col("o").alias("value_b")), ["s", "p"]).where("value_a <> value_b")


@query("d4_full_outer_diff", _AB + ", x AS (SELECT DISTINCT s FROM a), y AS (SELECT DISTINCT s FROM b) SELECT coalesce(x.s, y.s) AS s, CASE WHEN x.s IS NULL THEN 'added' WHEN y.s IS NULL THEN 'removed' ELSE 'kept' END AS status FROM x FULL JOIN y ON x.s = y.s")
def d4(spark, d):
    a, b = (m.where("p = 'rdf:type'").select("s").distinct() for m in _ab(spark, d))
    j = a.withColumn("in_a", F.lit(1)).join(b.withColumn("in_b", F.lit(1)), "s", "full")
    return j.select("s", F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").otherwise("kept").alias("status"))


_LOCAL = "SELECT DISTINCT s, regexp_extract(s, '[^#/]*$') AS name FROM triples WHERE p = 'rdf:type' AND o = 'rdfs:Class'"


@query("d5_local_name_lookup", f"WITH c AS ({_LOCAL}) SELECT name, count(DISTINCT s) AS classes, count(DISTINCT regexp_extract(s, '^(.*[#/])', 1)) AS namespaces, min(s) AS first FROM c GROUP BY 1 HAVING count(DISTINCT s) > 1")
def d5(spark, d):
    c = G.of_type(T(spark, d), "rdfs:Class").withColumn("name", local_name(F.col("s")))
    from ..functions.ids import namespace

    return c.groupBy("name").agg(F.countDistinct("s").alias("classes"), F.countDistinct(namespace(F.col("s"))).alias("namespaces"), F.min("s").alias("first")).where("classes > 1")


@query("d6_inject_missing", "SELECT DISTINCT graph, s, 'cim:SvSwitch.phase' AS p, 'ABC' AS o FROM triples t WHERE p = 'rdf:type' AND o = 'cim:SvSwitch' AND NOT EXISTS (SELECT 1 FROM triples x WHERE x.graph = t.graph AND x.s = t.s AND x.p = 'cim:SvSwitch.phase')")
def d6(spark, d):
    return K.inject(T(spark, d), spark.createDataFrame([("cim:SvSwitch", "cim:SvSwitch.phase", "ABC")], "cls string, p string, o string"))


@query("j23_populate", """WITH v(cls, p, o) AS (VALUES ('cim:SvSwitch', 'cim:SvSwitch.phase', 'ABC'), ('cim:SvSwitch', 'cim:SvSwitch.open', 'false'), ('cim:Terminal', 'cim:Terminal.phases', 'ABC'), ('cim:Terminal', 'cim:ACDCTerminal.connected', 'true'), ('cim:ACDCConverterDCTerminal', 'cim:ACDCTerminal.connected', 'false'))
SELECT t.graph, t.s, v.p, min(v.o) AS o FROM triples t JOIN v ON t.p = 'rdf:type' AND t.o = v.cls WHERE NOT EXISTS (SELECT 1 FROM triples x WHERE x.graph = t.graph AND x.s = t.s AND x.p = v.p) AND t.s IS NOT NULL GROUP BY 1, 2, 3""")
def j23(spark, d):
    v = [("cim:SvSwitch", "cim:SvSwitch.phase", "ABC"), ("cim:SvSwitch", "cim:SvSwitch.open", "false"), ("cim:Terminal", "cim:Terminal.phases", "ABC"), ("cim:Terminal", "cim:ACDCTerminal.connected", "true"), ("cim:ACDCConverterDCTerminal", "cim:ACDCTerminal.connected", "false")]
    return K.inject(T(spark, d).where("s is not null"), spark.createDataFrame(v, "cls string, p string, o string"))


@query("d7_missing_records", "SELECT p_partkey AS part FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_linestatus = 'F')")
def d7(spark, d):
    li = table(spark, d, "lineitem").where("l_returnflag = 'R' and l_linestatus = 'F'")
    return table(spark, d, "part").join(li, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select(F.col("p_partkey").alias("part"))


_FLOW = "SELECT cn.n_name AS f, sn.n_name AS t, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation cn ON cn.n_nationkey = c_nationkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation sn ON sn.n_nationkey = s_nationkey GROUP BY 1, 2"


def _flows(spark, d):
    n = table(spark, d, "nation")
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("f"))
    s = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("t"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey"))
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return li.groupBy("f", "t").agg(F.sum("l_quantity").cast("bigint").alias("q"))


@query("d8_undirected_key", f"WITH x AS ({_FLOW}) SELECT least(f, t) AS n1, greatest(f, t) AS n2, CASE WHEN f > t THEN -q ELSE q END AS flow FROM x")
def d8(spark, d):
    return D.undirected(_flows(spark, d), "f", "t", "q")


@query("d9_nearest_value", """WITH a AS (SELECT c_custkey AS id_a, c_nationkey AS nation, CAST(c_acctbal * 100 AS BIGINT) AS value_a FROM customer), b AS (SELECT s_suppkey AS id_b, s_nationkey AS nation, CAST(s_acctbal * 100 AS BIGINT) AS value_b FROM supplier)
SELECT nation, id_a, value_a, id_b, value_b FROM a JOIN b USING (nation) QUALIFY row_number() OVER (PARTITION BY id_a ORDER BY abs(value_a - value_b), id_b) = 1""")
def d9(spark, d):
    cents = lambda c: F.round(F.col(c) * 100).cast("bigint").alias("v")
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nation"), cents("c_acctbal"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("nation"), cents("s_acctbal"))
    return D.nearest(a, b, ["nation"], "v", ("k", "k"))


@query("d10_join_predicate", "SELECT o_orderkey AS k, c_custkey AS c FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal <> 0 AND o_orderstatus <> 'P'")
def d10(spark, d):
    o, c = table(spark, d, "orders").where("o_orderstatus <> 'P'"), table(spark, d, "customer").where("c_acctbal <> 0")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("k"), F.col("c_custkey").alias("c"))


@query("d11_both_way_anti", """WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 49), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_discount > 0.09)
SELECT k, 'not in second list' AS verdict FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, 'not in first list' FROM b WHERE k NOT IN (SELECT k FROM a)""")
def d11(spark, d):
    # one scan and one aggregation serve both lists and both directions
    li = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.max(F.col("l_quantity") > 49).alias("a"), F.max(F.col("l_discount") > 0.09).alias("b"))
    return li.where("a <> b").select("k", F.when(F.col("a"), "not in second list").otherwise("not in first list").alias("verdict"))


@query("d12_file_pairing", """WITH m AS (SELECT DISTINCT file_name, profile, header_ts FROM file_metadata WHERE profile IN ('SV', 'SSH') AND header_ts IS NOT NULL)
SELECT a.file_name AS sv, min(b.file_name) AS ssh FROM m a LEFT JOIN m b ON b.profile = 'SSH' AND b.header_ts = a.header_ts WHERE a.profile = 'SV' GROUP BY 1""")
def d12(spark, d):
    m = table(spark, d, "file_metadata").where("profile in ('SV', 'SSH') and header_ts is not null").select("file_name", "profile", "header_ts").distinct()
    ssh = m.where("profile = 'SSH'").groupBy("header_ts").agg(F.min("file_name").alias("ssh"))
    return m.where("profile = 'SV'").join(ssh, "header_ts", "left").groupBy(F.col("file_name").alias("sv")).agg(F.min("ssh").alias("ssh"))


@query("d14_id_rewrite", "SELECT CASE WHEN starts_with(s, 'orders/') THEN 'new/' || md5(s) ELSE s END AS s, p, CASE WHEN starts_with(o, 'orders/') AND o_kind = 'iri' THEN 'new/' || md5(o) ELSE o END AS o FROM (" + M.A_SQL + ")")
def d14(spark, d):
    a, _ = _ab(spark, d)
    new = lambda c: F.when(F.col(c).startswith("orders/"), F.concat(F.lit("new/"), F.md5(F.col(c).cast("binary"))))
    return a.select(F.coalesce(new("s"), "s").alias("s"), "p", F.coalesce(F.when(F.col("o_kind") == "iri", new("o")), "o").alias("o"))


@query("d16_lookup_chain", "SELECT t.p, m.dt, count(*) AS n, min(t.o) AS least FROM triples t JOIN datatype_map m ON m.p = t.p WHERE t.o IS NOT NULL GROUP BY 1, 2")
def d16(spark, d):
    t = T(spark, d, "p", "o").where("o is not null").groupBy("p").agg(F.count("*").alias("n"), F.min("o").alias("least"))
    return t.join(table(spark, d, "datatype_map"), "p").select("p", "dt", "n", "least")


@query("e1_class_counts", "SELECT o AS cls, count(DISTINCT s) AS n FROM triples WHERE p = 'rdf:type' GROUP BY 1")
def e1(spark, d):
    return D.class_counts(T(spark, d))


@query("e2_count_diff", """WITH a AS (SELECT o AS cls, count(DISTINCT s) AS n_a FROM triples WHERE p = 'rdf:type' AND contains(graph, '_SV_') GROUP BY 1), b AS (SELECT o AS cls, count(DISTINCT s) AS n_b FROM triples WHERE p = 'rdf:type' AND contains(graph, '_SSH_') GROUP BY 1)
SELECT coalesce(a.cls, b.cls) AS cls, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b, CASE WHEN coalesce(n_a, 0) = coalesce(n_b, 0) THEN 'Same' ELSE 'Different' END || ' - Compare class count' AS status FROM a FULL JOIN b ON a.cls = b.cls""")
def e2(spark, d):
    t = T(spark, d)
    return D.count_diff(t.where(F.col("graph").contains("_SV_")), t.where(F.col("graph").contains("_SSH_")))


@query("e8_solution_stats", """WITH q AS (SELECT l_partkey AS part, l_returnflag AS f, sum(CAST(l_quantity AS BIGINT)) AS v FROM lineitem GROUP BY 1, 2), j AS (SELECT a.part, abs(a.v - b.v) AS d FROM q a JOIN q b ON a.part = b.part AND a.f = 'A' AND b.f = 'R')
SELECT 'quantity' AS quantity, count(*) AS n, CAST(max(d) AS BIGINT) AS largest, round(avg(d), 2) AS mean FROM j WHERE d <> 0""")
def e8(spark, d):
    return D.solution_stats(d1(spark, d).withColumn("quantity", F.lit("quantity")), "quantity", F.col("value_a"), F.col("value_b"))


@query("e9_island_sizes", "SELECT islands, n, largest FROM (SELECT count(*) AS islands, CAST(sum(c) AS BIGINT) AS n, max(c) AS largest FROM (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY 1))")
def e9(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey").count().agg(F.count("*").alias("islands"), F.sum("count").alias("n"), F.max("count").alias("largest"))


@query("e12_namespaces", "SELECT DISTINCT regexp_extract(s, '^(.*[#/])', 1) AS ns FROM triples WHERE starts_with(s, 'http')")
def e12(spark, d):
    from ..functions.ids import namespace

    return T(spark, d, "s").where(F.col("s").startswith("http")).select(namespace(F.col("s")).alias("ns")).distinct()


@query("e13_joined_labels", "SELECT s, string_agg(o, ',' ORDER BY o) AS stereotypes FROM (SELECT DISTINCT s, o FROM triples WHERE p = 'cims:stereotype' AND o IS NOT NULL) GROUP BY 1")
def e13(spark, d):
    t = T(spark, d, "s", "p", "o").where("p = 'cims:stereotype' and o is not null")
    return t.groupBy("s").agg(F.array_join(F.sort_array(F.collect_set("o")), ",").alias("stereotypes"))


@query("e15_class_rows", "SELECT ty.o AS cls, t.p, count(*) AS n, count(DISTINCT t.s) AS subjects FROM (SELECT DISTINCT graph, s, o FROM triples WHERE p = 'rdf:type') ty JOIN triples t ON t.graph = ty.graph AND t.s = ty.s WHERE t.p <> 'rdf:type' GROUP BY 1, 2")
def e15(spark, d):
    t = T(spark, d)
    ty = t.where("p = 'rdf:type'").select("graph", "s", F.col("o").alias("cls")).distinct()
    return ty.join(t.where("p <> 'rdf:type'").select("graph", "s", "p"), ["graph", "s"]).groupBy("cls", "p").agg(F.count("*").alias("n"), F.countDistinct("s").alias("subjects"))


@query("e16_catalog_rollup", "SELECT p, CASE WHEN count(o) = 0 THEN 'none' ELSE string_agg(o, ' | ' ORDER BY o) END AS vals FROM (SELECT DISTINCT p, o FROM triples WHERE p IN ('md:Model.modelingAuthoritySet', 'md:Model.profile') AND o <> '') GROUP BY 1")
def e16(spark, d):
    t = T(spark, d, "p", "o").where("p in ('md:Model.modelingAuthoritySet', 'md:Model.profile') and o <> ''")
    return t.groupBy("p").agg(F.array_join(F.array_sort(F.collect_set("o")), " | ").alias("vals"))


@query("e17_file_counts", "SELECT profile, final_ts, count(*) AS n FROM file_metadata GROUP BY 1, 2 HAVING count(*) <> 1")
def e17(spark, d):
    return table(spark, d, "file_metadata").groupBy("profile", "final_ts").agg(F.count("*").alias("n")).where("n <> 1")


@query("e18_sparql_aggregates", "SELECT p, count(*) AS n, count(DISTINCT o) AS distinct_o, min(o) AS least, max(o) AS most FROM triples GROUP BY 1 HAVING count(*) > 10")
def e18(spark, d):
    return T(spark, d, "p", "o").groupBy("p").agg(F.count("*").alias("n"), F.countDistinct("o").alias("distinct_o"), F.min("o").alias("least"), F.max("o").alias("most")).where("n > 10")


@query("g6_cap_per_group", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 3")
def g6(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, d, "events").withColumn("n", F.row_number().over(w)).where("n <= 3").select("user_id", "event_id")


@query("g7_order_limit", "SELECT o_orderkey AS k, o_orderpriority AS pr FROM orders ORDER BY o_orderpriority, o_orderkey LIMIT 20 OFFSET 5")
def g7(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("pr")).orderBy("pr", "k").limit(25).offset(5)


_DBL = "CASE WHEN o_dt IN ('xsd:decimal', 'xsd:integer', 'xsd:float') THEN CAST(CAST(o AS DOUBLE) AS VARCHAR) ELSE o END"


@query("i1_graph_diff", _AB + f""", va AS (SELECT s, p, {_DBL} AS v, min(o) AS a FROM a WHERE p <> 'rdf:type' GROUP BY 1, 2, 3), vb AS (SELECT s, p, {_DBL} AS v, min(o) AS b FROM b WHERE p <> 'rdf:type' GROUP BY 1, 2, 3),
c AS (SELECT coalesce(va.s, vb.s) AS s, coalesce(va.p, vb.p) AS p, a, b FROM va FULL JOIN vb ON va.s = vb.s AND va.p = vb.p AND va.v = vb.v WHERE a IS NULL OR b IS NULL),
g AS (SELECT s, p, count(a) AS na, count(b) AS nb, max(a) AS ma, max(b) AS mb FROM c GROUP BY 1, 2), sa AS (SELECT DISTINCT s FROM a), sb AS (SELECT DISTINCT s FROM b)
SELECT s AS item, 'cim:Order' AS rdf_type, p AS property, ma AS value_a, mb AS value_b FROM g WHERE na = 1 AND nb = 1
UNION ALL SELECT s, 'cim:Order', p, coalesce(a, 'N/A'), coalesce(b, 'N/A') FROM c JOIN g USING (s, p) WHERE NOT (na = 1 AND nb = 1)
UNION ALL SELECT coalesce(sa.s, sb.s), 'cim:Order', 'New', CASE WHEN sa.s IS NULL THEN 'N/A' ELSE 'cim:Order' END, CASE WHEN sb.s IS NULL THEN 'N/A' ELSE 'cim:Order' END FROM sa FULL JOIN sb ON sa.s = sb.s WHERE sa.s IS NULL OR sb.s IS NULL""")
def i1(spark, d):
    return D.graph_diff(*_ab(spark, d))


_DESCR = "SELECT regexp_extract(s, '[^#/]*$') AS name, max(CASE WHEN p = 'rdfs:label' THEN o END) AS label, max(CASE WHEN p = 'rdfs:comment' THEN o END) AS comment, min(regexp_extract(s, '^(.*[#/])', 1)) AS namespace FROM {} WHERE p IN ('rdfs:label', 'rdfs:comment') AND starts_with(s, 'http') GROUP BY 1"


def _described(t):
    from ..functions.ids import namespace

    t = t.where("p in ('rdfs:label', 'rdfs:comment') and s like 'http%'")
    own = lambda p: F.max(F.when(F.col("p") == p, F.col("o")))
    return t.groupBy(local_name(F.col("s")).alias("name")).agg(own("rdfs:label").alias("label"), own("rdfs:comment").alias("comment"), F.min(namespace(F.col("s"))).alias("namespace"))


@query("i2_profile_diff", f"WITH x AS ({_DESCR.format('triples')}), y AS ({_DESCR.format('triples_b')}), u AS (SELECT name, field, v FROM x UNPIVOT INCLUDE NULLS (v FOR field IN (label, comment, namespace))), w AS (SELECT name, field, v FROM y UNPIVOT INCLUDE NULLS (v FOR field IN (label, comment, namespace))) SELECT coalesce(u.name, w.name) AS name, coalesce(u.field, w.field) AS field, coalesce(u.v, '-') AS value_a, coalesce(w.v, '-') AS value_b FROM u FULL JOIN w ON u.name = w.name AND u.field = w.field WHERE coalesce(u.v, '-') <> coalesce(w.v, '-')")
def i2(spark, d):
    from ..functions.ids import pick

    b = pick(table(spark, d, "triples_b"), "s", "p", "o")
    return D.profile_diff(_described(T(spark, d, "s", "p", "o")), _described(b), "name", ["label", "comment", "namespace"])


@query("i5_aligned_diff", _AB + ", c AS (SELECT 'model/' || substr(s, 8) AS s, p, o FROM b WHERE starts_with(s, 'orders/')), e AS (SELECT 'model/' || substr(s, 8) AS s, p, o FROM a) (SELECT s, p, o FROM e EXCEPT SELECT s, p, o FROM c)")
def i5(spark, d):
    a, b = (G.rename_namespace(m.select("s", "p", "o"), "orders/", "model/", ("s",)) for m in _ab(spark, d))
    return a.subtract(b)
