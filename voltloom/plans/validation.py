"""Queries of constraint checks, validation statistics and file-name functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import files as N
from ..operators import shacl as S
from ..operators import shapes as H
from ..operators import statistics as E
from ..operators.graph import closure
from ..sources import mapping as M
from ..sources.tables import table
from .catalogue import query
from .graphs import COLS, T

_A = f"a AS ({M.A_SQL})"
_R = "SELECT '{n}' AS source_shape, {f} AS focus_node, 'Violation' AS severity, '' AS message, {v} AS value, '{p}' AS path, '{c}' AS constraint_component "


def _r(name, path, component, focus="s", value="CAST(NULL AS VARCHAR)"):
    return _R.format(n=name, f=focus, v=value, p=path, c=component)


def _orders(spark, d):
    return M.order_models(table(spark, d, "orders"))[0]


def _shape(name, path, constraints, **target):
    return S.Shape(name, path, constraints=constraints, **(target or {"target_class": "cim:Order"}))


_SW = {"target_class": "cim:SvSwitch"}
_F = "f AS (SELECT DISTINCT s FROM triples WHERE p = 'rdf:type' AND o = 'cim:SvSwitch'), v AS (SELECT DISTINCT s, o, o_kind, o_dt, o_lang, p FROM triples WHERE o IS NOT NULL AND s IN (SELECT s FROM f))"


@query("l4_mincount", f"WITH {_F} " + _r("S1", "cim:SvSwitch.Switch", "minCount") + "FROM f WHERE s NOT IN (SELECT s FROM v WHERE p = 'cim:SvSwitch.Switch')")
def l4_min(spark, d):
    return S.check(T(spark, d, *COLS), _shape("S1", "cim:SvSwitch.Switch", {"minCount": 1}, **_SW))


@query("l4_maxcount", f"WITH {_F} " + _r("S2", "cim:SvSwitch.open", "maxCount") + "FROM v WHERE p = 'cim:SvSwitch.open' GROUP BY s HAVING count(*) > 1")
def l4_max(spark, d):
    return S.check(T(spark, d, *COLS), _shape("S2", "cim:SvSwitch.open", {"maxCount": 1}, **_SW))


@query("l4_datatype", f"WITH {_F} " + _r("S3", "cim:SvSwitch.open", "datatype", value="o") + "FROM v WHERE p = 'cim:SvSwitch.open' AND (o_kind <> 'literal' OR o_dt IS DISTINCT FROM 'xsd:boolean' OR NOT regexp_full_match(o, 'true|false|1|0'))")
def l4_datatype(spark, d):
    return S.check(T(spark, d, *COLS), _shape("S3", "cim:SvSwitch.open", {"datatype": "xsd:boolean"}, **_SW))


@query("l4_nodekind", f"WITH {_F} " + _r("S4", "cim:SvSwitch.Switch", "nodeKind", value="o") + "FROM v WHERE p = 'cim:SvSwitch.Switch' AND o_kind <> 'iri'")
def l4_kind(spark, d):
    return S.check(T(spark, d, *COLS), _shape("S4", "cim:SvSwitch.Switch", {"nodeKind": "IRI"}, **_SW))


@query("l4_in", f"WITH {_A} " + _r("S5", "orders.o_orderpriority", "in", value="o") + "FROM a WHERE p = 'orders.o_orderpriority' AND o NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')")
def l4_in(spark, d):
    return S.check(_orders(spark, d), _shape("S5", "orders.o_orderpriority", {"in": ["1-URGENT", "2-HIGH", "3-MEDIUM"]}))


_CU = {"target_class": "cim:Order"}


def _both(spark, d):
    c = M.statements(table(spark, d, "customer").where("c_custkey % 10 <> 0"), "A", "customer", "c_custkey", "cim:Customer", M.CUSTOMERS)
    return _orders(spark, d).unionByName(c)


_BOTH = f"a AS ({M.A_SQL} UNION ALL {M.sql('customer', 'A', 'customer', 'c_custkey', 'cim:Customer', M.CUSTOMERS, 'c_custkey % 10 <> 0')})"


@query("l4_class", f"WITH {_BOTH} " + _r("S6", "orders.o_custkey", "class", value="o") + "FROM a WHERE p = 'orders.o_custkey' AND o NOT IN (SELECT s FROM a WHERE p = 'rdf:type' AND o = 'cim:Customer')")
def l4_class(spark, d):
    return S.check(_both(spark, d), _shape("S6", "orders.o_custkey", {"class": "cim:Customer"}))


@query("l4_closed", f"WITH {_A} SELECT DISTINCT 'S7' AS source_shape, s AS focus_node, 'Violation' AS severity, '' AS message, p AS value, '' AS path, 'closed' AS constraint_component FROM a WHERE p NOT IN ('rdf:type', 'orders.o_custkey', 'orders.o_totalprice', 'orders.o_orderdate', 'orders.o_orderstatus')")
def l4_closed(spark, d):
    return S.check(_orders(spark, d), _shape("S7", "", {"closed": ["rdf:type", "orders.o_custkey", "orders.o_totalprice", "orders.o_orderdate", "orders.o_orderstatus"]}))


@query("l4_range", f"WITH {_A} " + _r("S8", "orders.o_totalprice", "minInclusive", value="o") + "FROM a WHERE p = 'orders.o_totalprice' AND CAST(o AS DOUBLE) < 50000 UNION ALL " + _r("S8", "orders.o_totalprice", "maxExclusive", value="o") + "FROM a WHERE p = 'orders.o_totalprice' AND CAST(o AS DOUBLE) >= 300000")
def l4_range(spark, d):
    # both tests of a value come from one pass; only one of them can fail
    s = _shape("S8", "orders.o_totalprice", {"minInclusive": 50000.0, "maxExclusive": 300000.0})
    return S.check(_orders(spark, d), s)


@query("l4_length", f"WITH {_A} " + _r("S9", "orders.o_orderpriority", "maxLength", value="o") + "FROM a WHERE p = 'orders.o_orderpriority' AND length(o) > 6 UNION ALL " + _r("S9", "orders.o_orderpriority", "minLength", value="o") + "FROM a WHERE p = 'orders.o_orderpriority' AND length(o) < 6")
def l4_length(spark, d):
    return S.check(_orders(spark, d), _shape("S9", "orders.o_orderpriority", {"maxLength": 6, "minLength": 6}))


@query("l4_pattern", f"WITH {_A} " + _r("S10", "orders.o_orderpriority", "pattern", value="o") + "FROM a WHERE p = 'orders.o_orderpriority' AND NOT regexp_matches(o, '^[1-3]-')")
def l4_pattern(spark, d):
    return S.check(_orders(spark, d), _shape("S10", "orders.o_orderpriority", {"pattern": "^[1-3]-"}))


@query("l4_inverse_path", f"WITH {_BOTH} " + _r("S11", "^orders.o_custkey", "minCount", focus="c.s") + "FROM a c WHERE c.p = 'rdf:type' AND c.o = 'cim:Customer' AND c.s NOT IN (SELECT o FROM a WHERE p = 'orders.o_custkey')")
def l4_inverse(spark, d):
    return S.check(_both(spark, d), _shape("S11", "^orders.o_custkey", {"minCount": 1}, target_class="cim:Customer"))


@query("l4_sequence_path", f"WITH {_BOTH} " + _r("S12", "orders.o_custkey/customer.c_mktsegment", "in", focus="x.s", value="y.o") + "FROM a x JOIN a y ON x.p = 'orders.o_custkey' AND y.s = x.o AND y.p = 'customer.c_mktsegment' WHERE y.o NOT IN ('BUILDING', 'MACHINERY')")
def l4_sequence(spark, d):
    return S.check(_both(spark, d), _shape("S12", "orders.o_custkey/customer.c_mktsegment", {"in": ["BUILDING", "MACHINERY"]}))


@query("l4_alternative_path", "WITH v AS (SELECT DISTINCT s, o, o_kind, o_dt, o_lang FROM triples WHERE p IN ('rdfs:label', 'rdfs:comment') AND o IS NOT NULL AND s IN (SELECT s FROM triples WHERE p = 'rdf:type' AND o = 'rdfs:Class')) " + _r("S13", "rdfs:label|rdfs:comment", "languageIn", value="o") + "FROM v WHERE lower(o_lang) IS DISTINCT FROM 'en'")
def l4_alternative(spark, d):
    return S.check(T(spark, d, *COLS), _shape("S13", "rdfs:label|rdfs:comment", {"languageIn": ["en"]}, target_class="rdfs:Class"))


@query("l4_uniquelang", "WITH v AS (SELECT DISTINCT s, o, o_kind, o_dt, o_lang FROM triples WHERE p = 'rdfs:label' AND o IS NOT NULL AND o_lang IS NOT NULL AND s IN (SELECT s FROM triples WHERE p = 'rdf:type' AND o = 'rdfs:Class')) " + _r("S14", "rdfs:label", "uniqueLang", value="lower(o_lang)") + "FROM v GROUP BY s, lower(o_lang) HAVING count(*) > 1")
def l4_unique(spark, d):
    return S.check(T(spark, d, *COLS), _shape("S14", "rdfs:label", {"uniqueLang": True}, target_class="rdfs:Class"))


_LI = {"l_orderkey": "int", "l_quantity": "money", "l_extendedprice": "money", "l_tax": "money"}


def _lines(spark, d):
    agg = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_quantity").alias("q_min"), F.max("l_quantity").alias("q_max"))
    return M.statements(agg, "A", "line", "l_orderkey", "cim:Line", {"q_min": "money", "q_max": "money"})


_LINES = "a AS (SELECT 'line/' || l_orderkey AS s, CAST(CAST(min(l_quantity) AS DECIMAL(18,2)) AS VARCHAR) AS q_min, CAST(CAST(max(l_quantity) AS DECIMAL(18,2)) AS VARCHAR) AS q_max FROM lineitem GROUP BY 1)"


@query("l4_lessthan", f"WITH {_LINES} " + _r("S15", "line.q_min", "lessThan", value="q_min") + "FROM a WHERE NOT CAST(q_min AS DOUBLE) < CAST(q_max AS DOUBLE)")
def l4_less(spark, d):
    return S.check(_lines(spark, d), _shape("S15", "line.q_min", {"lessThan": "line.q_max"}, target_class="cim:Line"))


@query("l4_equals", f"WITH {_LINES} " + _r("S16", "line.q_min", "equals", value="q_min") + "FROM a WHERE q_min <> q_max UNION ALL " + _r("S16", "line.q_min", "equals", value="q_max") + "FROM a WHERE q_min <> q_max")
def l4_equals(spark, d):
    return S.check(_lines(spark, d), _shape("S16", "line.q_min", {"equals": "line.q_max"}, target_class="cim:Line"))


@query("l4_disjoint", f"WITH {_LINES} " + _r("S17", "line.q_min", "disjoint", value="q_min") + "FROM a WHERE q_min = q_max")
def l4_disjoint(spark, d):
    return S.check(_lines(spark, d), _shape("S17", "line.q_min", {"disjoint": "line.q_max"}, target_class="cim:Line"))


@query("l4_or", f"WITH {_A} " + _r("S18", "orders.o_orderpriority", "or", value="o") + "FROM a WHERE p = 'orders.o_orderpriority' AND NOT (o IN ('1-URGENT') OR length(o) <= 5)")
def l4_or(spark, d):
    return S.check(_orders(spark, d), _shape("S18", "orders.o_orderpriority", {"or": [{"in": ["1-URGENT"]}, {"maxLength": 5}]}))


@query("l4_xone_not", f"WITH {_A} " + _r("S19", "orders.o_orderpriority", "xone", value="o") + "FROM a WHERE p = 'orders.o_orderpriority' AND (CAST(o IN ('1-URGENT', '5-LOW') AS INT) + CAST(length(o) <= 6 AS INT)) <> 1 UNION ALL " + _r("S20", "orders.o_orderstatus", "not", value="o") + "FROM a WHERE p = 'orders.o_orderstatus' AND o IN ('P')")
def l4_xone(spark, d):
    return S.validate(_orders(spark, d), [_shape("S19", "orders.o_orderpriority", {"xone": [{"in": ["1-URGENT", "5-LOW"]}, {"maxLength": 6}]}), _shape("S20", "orders.o_orderstatus", {"not": {"in": ["P"]}})])


@query("l4_hasvalue_qualified", f"WITH {_BOTH} " + _r("S21", "orders.o_orderstatus", "hasValue") + "FROM a WHERE p = 'orders.o_orderstatus' AND o <> 'F' UNION ALL " + _r("S22", "^orders.o_custkey", "qualified", focus="c.s") + "FROM (SELECT s FROM a WHERE p = 'rdf:type' AND o = 'cim:Customer') c LEFT JOIN (SELECT o, count(*) AS n FROM a WHERE p = 'orders.o_custkey' AND length(s) > 9 GROUP BY 1) x ON x.o = c.s WHERE coalesce(n, 0) NOT BETWEEN 1 AND 12")
def l4_qualified(spark, d):
    t = _both(spark, d)
    return S.validate(t, [_shape("S21", "orders.o_orderstatus", {"hasValue": "F"}), _shape("S22", "^orders.o_custkey", {"qualified": (1, 12, {"minLength": 10})}, target_class="cim:Customer")])


@query("l4_node", f"WITH {_BOTH} " + _r("S23", "orders.o_custkey", "node", focus="x.s", value="x.o") + "FROM a x JOIN a y ON x.p = 'orders.o_custkey' AND y.s = x.o AND y.p = 'customer.c_mktsegment' AND y.o <> 'BUILDING'")
def l4_node(spark, d):
    inner = _shape("N", "customer.c_mktsegment", {"in": ["BUILDING"]}, target_class="cim:Customer")
    return S.check(_both(spark, d), _shape("S23", "orders.o_custkey", {"node": inner}))


def _all(spark, d, lost=False):
    """Orders and every customer; with ``lost`` every tenth order names a customer that is in no row."""
    k, o = F.col("o_orderkey"), table(spark, d, "orders")
    if lost:
        o = o.withColumn("o_custkey", F.when(k % 10 == 0, -1 - k).otherwise(F.col("o_custkey")))
    c = M.statements(table(spark, d, "customer"), "A", "customer", "c_custkey", "cim:Customer", M.CUSTOMERS)
    return M.order_models(o)[0].unionByName(c)


_C_SQL = M.sql("customer", "A", "customer", "c_custkey", "cim:Customer", M.CUSTOMERS)
_ALL = f"a AS ({M.A_SQL} UNION ALL {_C_SQL})"
_LOST = f"a AS ({M.sql('orders', 'A', 'orders', 'o_orderkey', 'cim:Order', M.ORDERS, change={'o_custkey': 'CASE WHEN o_orderkey % 10 = 0 THEN -1 - o_orderkey ELSE o_custkey END'})} UNION ALL {_C_SQL})"


@query("l4_class_all", f"WITH {_LOST} " + _r("S6", "orders.o_custkey", "class", value="o") + "FROM a WHERE p = 'orders.o_custkey' AND o NOT IN (SELECT s FROM a WHERE p = 'rdf:type' AND o = 'cim:Customer')")
def l4_class_all(spark, d):
    return S.check(_all(spark, d, lost=True), _shape("S6", "orders.o_custkey", {"class": "cim:Customer"}))


@query("l4_inverse_path_all", f"WITH {_ALL} " + _r("S11", "^orders.o_custkey", "minCount", focus="c.s") + "FROM a c WHERE c.p = 'rdf:type' AND c.o = 'cim:Customer' AND c.s NOT IN (SELECT o FROM a WHERE p = 'orders.o_custkey')")
def l4_inverse_all(spark, d):
    return S.check(_all(spark, d), _shape("S11", "^orders.o_custkey", {"minCount": 1}, target_class="cim:Customer"))


@query("l4_sequence_path_all", f"WITH {_ALL} " + _r("S12", "orders.o_custkey/customer.c_mktsegment", "in", focus="x.s", value="y.o") + "FROM a x JOIN a y ON x.p = 'orders.o_custkey' AND y.s = x.o AND y.p = 'customer.c_mktsegment' WHERE y.o NOT IN ('BUILDING', 'MACHINERY')")
def l4_sequence_all(spark, d):
    return S.check(_all(spark, d), _shape("S12", "orders.o_custkey/customer.c_mktsegment", {"in": ["BUILDING", "MACHINERY"]}))


@query("l4_hasvalue_qualified_all", f"WITH {_ALL} " + _r("S21", "orders.o_orderstatus", "hasValue") + "FROM a WHERE p = 'orders.o_orderstatus' AND o <> 'F' UNION ALL " + _r("S22", "^orders.o_custkey", "qualified", focus="c.s") + "FROM (SELECT s FROM a WHERE p = 'rdf:type' AND o = 'cim:Customer') c LEFT JOIN (SELECT o, count(*) AS n FROM a WHERE p = 'orders.o_custkey' AND length(s) > 9 GROUP BY 1) x ON x.o = c.s WHERE coalesce(n, 0) NOT BETWEEN 1 AND 12")
def l4_qualified_all(spark, d):
    return S.validate(_all(spark, d), [_shape("S21", "orders.o_orderstatus", {"hasValue": "F"}), _shape("S22", "^orders.o_custkey", {"qualified": (1, 12, {"minLength": 10})}, target_class="cim:Customer")])


@query("l4_node_all", f"WITH {_ALL} " + _r("S23", "orders.o_custkey", "node", focus="x.s", value="x.o") + "FROM a x JOIN a y ON x.p = 'orders.o_custkey' AND y.s = x.o AND y.p = 'customer.c_mktsegment' AND y.o <> 'BUILDING'")
def l4_node_all(spark, d):
    inner = _shape("N", "customer.c_mktsegment", {"in": ["BUILDING"]}, target_class="cim:Customer")
    return S.check(_all(spark, d), _shape("S23", "orders.o_custkey", {"node": inner}))


@query("l4_subclass_target", "WITH RECURSIVE e AS (SELECT s, o FROM triples WHERE p = 'rdfs:subClassOf' AND starts_with(o, 'http')), c(child, ancestor) AS (SELECT s, o FROM e UNION SELECT c.child, e.o FROM c JOIN e ON e.s = c.ancestor) SELECT ancestor, count(*) AS below FROM c GROUP BY 1")
def l4_subclass(spark, d):
    e = T(spark, d, "s", "p", "o").where("p = 'rdfs:subClassOf' and o like 'http%'").select("s", "o")
    return closure(e).groupBy("ancestor").agg(F.count("*").alias("below"))


def _results(spark, d):
    """Events as validation results: severity by type, an error where a type is 'error'."""
    kind = F.col("event_type")
    sev = F.when(kind == "purchase", "sh:Violation").when(kind == "click", "sh:Warning").when(kind != "error", "sh:Info")
    e = table(spark, d, "events")
    return e.select(
        F.concat(F.lit("TSO"), F.col("user_id") % 20).alias("country"), F.date_trunc("day", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("day"), kind.alias("source"),
        F.when(kind != "error", F.col("event_id").cast("string")).alias("focus_node"), sev.alias("severity"), F.when(kind == "error", "failed").alias("error"),
    )


_EV = """r AS (SELECT 'TSO' || (user_id % 20) AS country, date_trunc('day', ts) AS day, event_type AS source, CASE WHEN event_type <> 'error' THEN CAST(event_id AS VARCHAR) END AS focus_node,
CASE event_type WHEN 'purchase' THEN 'sh:Violation' WHEN 'click' THEN 'sh:Warning' WHEN 'error' THEN NULL ELSE 'sh:Info' END AS severity, CASE WHEN event_type = 'error' THEN 'failed' END AS error FROM events)"""


@query("e4_severity_stats", f"WITH {_EV} SELECT country, count(focus_node) AS all_results, count(*) FILTER (severity = 'sh:Violation') AS violations, count(*) FILTER (severity = 'sh:Warning') AS warnings, count(*) FILTER (severity IS NULL OR severity = 'sh:Info') AS infos, max(error) AS validation_error, count(focus_node) = 0 AND max(error) IS NULL AS conforms FROM r GROUP BY 1")
def e4(spark, d):
    return E.severity_statistics(_results(spark, d), "country")


@query("e5_constraint_stats", f"WITH {_EV} SELECT country, source, severity, count(*) AS n FROM r GROUP BY 1, 2, 3")
def e5(spark, d):
    return E.constraint_statistics(_results(spark, d), "country", "source", "severity")


@query("e6_timestamp_constraint_stats", f"WITH {_EV} SELECT country, CAST(day AS TIMESTAMP) AS day, source, severity, count(*) AS n FROM r GROUP BY 1, 2, 3, 4")
def e6(spark, d):
    return E.constraint_statistics(_results(spark, d), "country", "day", "source", "severity")


@query("e7_timestamp_overview", f"""WITH {_EV}, g AS (SELECT country, CAST(day AS TIMESTAMP) AS day, count(*) FILTER (severity = 'sh:Violation') AS violations, count(*) FILTER (severity = 'sh:Warning') AS warnings, count(*) FILTER (severity = 'sh:Info') AS infos, count(error) AS errors, count(*) AS rows FROM r GROUP BY 1, 2)
SELECT *, CASE WHEN violations > 0 THEN 'Violation' WHEN warnings > 0 THEN 'Warning' WHEN infos > 0 THEN 'Info' WHEN errors > 0 THEN 'Validation error' ELSE 'OK' END AS worst, CASE WHEN errors > 0 THEN 'error' WHEN violations > 0 THEN 'violation' WHEN warnings > 0 THEN 'warning' ELSE 'OK' END AS priority FROM g""")
def e7(spark, d):
    return E.overview(_results(spark, d), "country", "day")


@query("l6_auto_test", """WITH x AS (SELECT DISTINCT CASE WHEN event_type = 'error' THEN 'NonConform' ELSE 'Conform' END AS category, event_type AS rule, CAST(user_id AS VARCHAR) AS file FROM events), f AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS file, event_type AS rule FROM events WHERE value > 150)
SELECT x.rule, x.file, CASE WHEN category = 'Conform' THEN 'unexpected trigger' ELSE 'expected trigger not found' END AS verdict FROM x LEFT JOIN f ON f.file = x.file AND f.rule = x.rule WHERE (category = 'Conform') = (f.file IS NOT NULL)""")
def l6(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("file"), F.col("event_type").alias("rule"), "value")
    expected = e.select("file", "rule", F.when(F.col("rule") == "error", "NonConform").otherwise("Conform").alias("category")).distinct()
    return E.auto_test(expected, e.where("value > 150").select("file", "rule"))


_DEC = "SELECT l_orderkey AS k, count(*) FILTER (l_returnflag = 'N') AS resolved, count(*) FILTER (l_returnflag = 'R') AS missing, bool_and(l_linestatus = 'O') AS other, count(*) AS expected FROM lineitem GROUP BY 1"


def _decisions(spark, d):
    li = table(spark, d, "lineitem")
    c = lambda x: F.count(F.when(x, 1))
    return li.groupBy(F.col("l_orderkey").alias("k")).agg(c(F.col("l_returnflag") == "N").alias("resolved"), c(F.col("l_returnflag") == "R").alias("missing"), F.min(F.col("l_linestatus") == "O").alias("other"), F.count("*").alias("expected"))


@query("l8_run_decision", f"WITH x AS ({_DEC}) SELECT k, resolved > 0 AND (missing = 0 OR (NOT other AND expected > 1)) AS runs FROM x")
def l8(spark, d):
    c = [F.col(x) for x in ("resolved", "missing", "other", "expected")]
    return _decisions(spark, d).select("k", N.run_decision(*c).alias("runs"))


@query("l9_completeness", f"""WITH x AS ({_DEC}) SELECT k, CASE WHEN missing > 0 AND other THEN 'Missing - country-specific input' WHEN missing > 0 AND resolved > 0 AND expected > 1 THEN 'Partial input - validation executed'
WHEN missing > 0 THEN 'Missing input - skipped' WHEN resolved > expected THEN 'Too many files' ELSE 'OK' END AS status FROM x""")
def l9(spark, d):
    c = [F.col(x) for x in ("resolved", "missing", "other", "expected")]
    return _decisions(spark, d).select("k", N.completeness(*c).alias("status"))


#: Written out by hand, in the order in which the marks are looked for.
_PROFILE = """CASE WHEN regexp_matches(m, '(^|_)EQBD[0-9]*($|_)') THEN 'EQBD' WHEN regexp_matches(m, '(^|_)TPBD[0-9]*($|_)') THEN 'TPBD' WHEN regexp_matches(m, '(^|_)SSH[0-9]*($|_)') THEN 'SSH' WHEN regexp_matches(m, '(^|_)SSI[0-9]*($|_)') THEN 'SSI'
WHEN regexp_matches(m, '(^|_)SIS[0-9]*($|_)') THEN 'SIS' WHEN regexp_matches(m, '(^|_)RAS[0-9]*($|_)') THEN 'RAS' WHEN regexp_matches(m, '(^|_)SAR[0-9]*($|_)') THEN 'SAR' WHEN regexp_matches(m, '(^|_)IAM[0-9]*($|_)') THEN 'IAM' WHEN regexp_matches(m, '(^|_)AE[0-9]*($|_)') THEN 'AE'
WHEN regexp_matches(m, '(^|_)EQ[0-9]*($|_)') THEN 'EQ' WHEN regexp_matches(m, '(^|_)TP[0-9]*($|_)') THEN 'TP' WHEN regexp_matches(m, '(^|_)SV[0-9]*($|_)') THEN 'SV' WHEN regexp_matches(m, '(^|_)AP[0-9]*($|_)') THEN 'AP' WHEN regexp_matches(m, '(^|_)PS[0-9]*($|_)') THEN 'PS'
WHEN regexp_matches(m, '(^|_)AS[0-9]*($|_)') THEN 'AS' WHEN regexp_matches(m, '(^|_)CO[0-9]*($|_)') THEN 'CO' WHEN regexp_matches(m, '(^|_)ER[0-9]*($|_)') THEN 'ER' WHEN regexp_matches(m, '(^|_)RA[0-9]*($|_)') THEN 'RA' WHEN regexp_matches(m, '(^|_)OP[0-9]*($|_)') THEN 'OP' END"""
_MARKED = "SELECT DISTINCT file_name, path, regexp_replace(upper(file_name || ' ' || path), '[^A-Z0-9]+', '_', 'g') AS m FROM file_metadata"


@query("m5_profile_detect", f"SELECT file_name, path, {_PROFILE} AS profile FROM ({_MARKED})")
def m5(spark, d):
    return table(spark, d, "file_metadata").select("file_name", "path", N.profile(F.col("file_name"), F.col("path")).alias("profile")).distinct()


@query("m6_owner", f"""WITH x AS (SELECT file_name, path, {_PROFILE} AS profile FROM ({_MARKED})), y AS (SELECT *, trim(regexp_extract(path, '(?:^|/) *((?:IGM|TSO)_[^/]+)', 1)) AS folder, least(nullif(instr(upper(file_name), '_' || profile || '_'), 0), nullif(instr(upper(file_name), '-' || profile || '-'), 0), nullif(instr(upper(file_name), '_' || profile || '.'), 0), nullif(instr(upper(file_name), '-' || profile || '.'), 0)) AS place FROM x),
z AS (SELECT *, CASE WHEN place > 1 THEN regexp_replace(regexp_replace(substr(file_name, 1, place - 1), '[^A-Za-z0-9_-]+', '_', 'g'), '_+$', '') END AS before FROM y)
SELECT file_name, path, CASE WHEN folder <> '' THEN folder WHEN before <> '' THEN before ELSE 'UNKNOWN_TSO' END AS owner FROM z""")
def m6(spark, d):
    m = table(spark, d, "file_metadata").select("file_name", "path").distinct()
    return m.select("file_name", "path", N.owner(F.col("file_name"), F.col("path"), N.profile(F.col("file_name"), F.col("path"))).alias("owner"))


_HEADER, _NAMED = "try_strptime(header_ts, '%Y-%m-%dT%H:%M:%SZ')", "try_strptime(filename_ts, '%Y%m%dT%H%MZ')"


@query("m10_normalize_ts", f"SELECT DISTINCT file_name, {_HEADER} AS header, {_NAMED} AS named FROM file_metadata")
def m10(spark, d):
    ntz = lambda c: N.instant(F.col(c)).cast("timestamp").cast("timestamp_ntz")
    return table(spark, d, "file_metadata").select("file_name", ntz("header_ts").alias("header"), ntz("filename_ts").alias("named")).distinct()


@query("m16_time_source", f"""WITH f AS (SELECT coalesce(file_group, '') AS grp, path, {_HEADER} AS header, {_NAMED} AS named FROM file_metadata), h AS (SELECT DISTINCT grp, header FROM f WHERE header IS NOT NULL), m AS (SELECT grp, named, arg_min(header, path) AS mapped FROM f WHERE header IS NOT NULL AND named IS NOT NULL GROUP BY 1, 2),
x AS (SELECT f.*, m.mapped, h.header IS NOT NULL AND minute(f.named) = 30 AND second(f.named) = 0 AS same FROM f LEFT JOIN h ON h.grp = f.grp AND h.header = f.named LEFT JOIN m ON m.grp = f.grp AND m.named = f.named)
SELECT grp, path, CASE WHEN header IS NOT NULL THEN 'METADATA_HOUR' WHEN named IS NOT NULL AND same THEN 'FILENAME_MAPPED_TO_SAME_HOUR_METADATA' WHEN named IS NOT NULL AND mapped IS NOT NULL THEN 'FILENAME_MAPPED_TO_METADATA_HOUR' WHEN named IS NOT NULL THEN 'FILENAME_HOUR' ELSE 'NONE' END AS source,
CAST(date_trunc('hour', CASE WHEN header IS NOT NULL THEN header WHEN same THEN named WHEN mapped IS NOT NULL THEN mapped ELSE named END) + INTERVAL 30 MINUTE AS TIMESTAMP) AS time FROM x""")
def m16(spark, d):
    m = table(spark, d, "file_metadata").select(F.coalesce("file_group", F.lit("")).alias("grp"), "path", N.instant(F.col("header_ts")).alias("header"), N.instant(F.col("filename_ts")).alias("named"))
    return H.time_sources(m).select("grp", "path", "source", "time")


@query("m13_report_time", "SELECT event_id, CAST(date_trunc('hour', ts) + INTERVAL 30 MINUTE AS TIMESTAMP) AS report FROM events")
def m13(spark, d):
    return table(spark, d, "events").select("event_id", N.report_time(F.col("ts")).alias("report"))


@query("m15_market_hour", "SELECT event_id, CAST(date_trunc('day', ts) + to_hours(CAST(event_id % 24 + 1 - 3 AS INTEGER)) AS TIMESTAMP) AS start FROM events")
def m15(spark, d):
    return table(spark, d, "events").select("event_id", N.market_hour(F.date_trunc("day", F.col("ts").cast("timestamp")), (F.col("event_id") % 24 + 1).cast("int")).alias("start"))


@query("m3_safe_name", "SELECT DISTINCT path, regexp_replace(path, '[^A-Za-z0-9._-]+', '_', 'g') AS safe FROM file_metadata")
def m3(spark, d):
    return table(spark, d, "file_metadata").select("path", N.safe_name(F.col("path")).alias("safe")).distinct()


@query("m8_csv_field", """SELECT DISTINCT s, CASE WHEN regexp_matches(o, '[",\\r\\n;]') THEN '"' || replace(o, '"', '""') || '"' ELSE o END AS field FROM triples WHERE p = 'rdfs:comment'""")
def m8(spark, d):
    return T(spark, d, "s", "p", "o").where("p = 'rdfs:comment'").select("s", N.csv_field(F.col("o")).alias("field")).distinct()


@query("j5_cardinality_parse", """WITH x AS (SELECT p_partkey AS k, CASE p_size % 6 WHEN 0 THEN '1' WHEN 1 THEN '0..1' WHEN 2 THEN '1..n' WHEN 3 THEN '0..n' WHEN 4 THEN '2..5' ELSE '1..10' END AS m FROM part)
SELECT k, CASE WHEN length(m) = 1 THEN 1 WHEN length(m) = 4 AND substr(m, 2, 2) = '..' THEN coalesce(TRY_CAST(substr(m, 1, 1) AS INTEGER), 0) END AS low, CASE WHEN length(m) = 1 THEN 1 WHEN length(m) = 4 AND substr(m, 2, 2) = '..' THEN coalesce(TRY_CAST(substr(m, 4, 1) AS INTEGER), 999) END AS high FROM x""")
def j5(spark, d):
    m = F.element_at(F.array(*[F.lit(x) for x in ("1", "0..1", "1..n", "0..n", "2..5", "1..10")]), F.col("p_size") % 6 + 1)
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), N.cardinality(m).alias("c")).select("k", "c.low", "c.high")


@query("j19_type_inference", "SELECT graph, s, p, CASE WHEN regexp_full_match(o, '[+-]?[0-9]{1,18}') THEN 'xsd:integer' WHEN regexp_full_match(o, '[+-]?([0-9]+[.][0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN 'xsd:float' ELSE 'xsd:string' END AS dt FROM triples WHERE o_kind = 'literal'")
def j19(spark, d):
    return T(spark, d, "graph", "s", "p", "o", "o_kind").where("o_kind = 'literal'").select("graph", "s", "p", N.scalar_type(F.col("o")).alias("dt"))
