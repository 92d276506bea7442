"""Queries of validation runs: mapping rows over the files of each group and instant, and their reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import runs as V
from ..operators import statistics as E
from ..operators.shacl import Shape
from ..sources.tables import table
from .catalogue import query

#: A mapping as users write it: row, constraint file, inputs.
MAPPING = [(1, "CGMES_SV.ttl", "SV;SSH"), (2, "CGMES_EQ.ttl", "EQ"), (3, "NC_RAS.ttl", "RAS"), (4, "CGMES_SV.ttl", "SV;REE_SSH")]
SHAPES = {
    "CGMES_SV.ttl": [
        Shape("open", "cim:SvSwitch.open", target_class="cim:SvSwitch", constraints={"minCount": 1, "maxCount": 1}),
        Shape("connected", "cim:ACDCTerminal.connected", target_class="cim:Terminal", severity="Warning", constraints={"minCount": 1, "lexical": "xsd:boolean"}),
        Shape("switch", "cim:SvSwitch.Switch", target_class="cim:SvSwitch", severity="Info", constraints={"nodeKind": "IRI"}),
    ],
    "CGMES_EQ.ttl": [Shape("name", "cim:IdentifiedObject.name", subjects_of="cim:Switch.normalOpen", constraints={"minCount": 1, "maxCount": 1})],
    "NC_RAS.ttl": [Shape("any", "rdf:type", target_class="cim:Terminal", constraints={"minCount": 9})],
}


def _mapping(spark):
    return spark.createDataFrame(MAPPING, "row int, ttl string, xml_inputs string")


def _files(spark, d):
    m = table(spark, d, "file_metadata").where("profile is not null and file_group is not null and final_ts is not null")
    return m.select("profile", F.col("file_group").alias("grp"), F.col("final_ts").alias("at"), F.col("file_name").alias("file")).distinct()


def _statements(spark, d):
    return table(spark, d, "triples").where("p is not null").select("graph", "s", "p", "o", "o_kind", "o_dt")


_CHECKS = """f AS (SELECT DISTINCT profile, file_group AS grp, final_ts AS "at", file_name AS file FROM file_metadata WHERE profile IS NOT NULL AND file_group IS NOT NULL AND final_ts IS NOT NULL),
tok("row", token) AS (VALUES (1, 'SV'), (1, 'SSH'), (2, 'EQ'), (3, 'RAS'), (4, 'SV'), (4, 'REE_SSH')),
m("row", ttl, category, name) AS (VALUES (1, 'CGMES_SV.ttl', 'CGMES_SINGLE_PROFILE', 'SV + SSH'), (2, 'CGMES_EQ.ttl', 'CGMES_SINGLE_PROFILE', 'EQ'), (3, 'NC_RAS.ttl', 'NC_SINGLE', 'RAS'), (4, 'CGMES_SV.ttl', 'CGMES_SINGLE_PROFILE', 'SV + SSH')),
h AS (SELECT DISTINCT "row", token, grp, "at", file FROM tok JOIN f ON token = profile),
e AS (SELECT tok."row", tok.token, i.grp, i."at", EXISTS (SELECT 1 FROM h WHERE h."row" = tok."row" AND h.token = tok.token AND h.grp = i.grp AND h."at" = i."at") AS has FROM tok, (SELECT DISTINCT grp, "at" FROM f) i),
c AS (SELECT "row", grp, "at", count(*) AS expected, count(*) FILTER (NOT has) AS missing, coalesce(string_agg(token, '; ' ORDER BY token) FILTER (NOT has), '') AS missing_inputs, bool_and(token = 'REE_SSH' AND replace(replace(upper(grp), '-', ''), '_', '') <> 'REE') FILTER (NOT has) AS other FROM e GROUP BY 1, 2, 3),
k AS (SELECT c.*, m.ttl, m.category, strftime("at", '%Y-%m-%dT%H:%M:%SZ') AS at_text, grp || '__' || strftime("at", '%Y-%m-%dT%H:%M:%SZ') || '__' || m.name AS dataset, (SELECT count(DISTINCT file) FROM h WHERE h."row" = c."row" AND h.grp = c.grp AND h."at" = c."at") AS resolved FROM c JOIN m USING ("row")),
x AS (SELECT *, resolved > 0 AND (missing = 0 OR (NOT other AND expected > 1)) AS runs, CASE WHEN missing > 0 AND other THEN 'Missing - country-specific input' WHEN missing > 0 AND resolved > 0 AND expected > 1 THEN 'Partial input - validation executed' WHEN missing > 0 THEN 'Missing input - skipped' WHEN resolved > expected THEN 'Too many files' ELSE 'OK' END AS status FROM k)"""


def _results_sql(runs: str) -> str:
    """Results of the shapes over d(key, ttl, s, p, o, o_kind)."""
    return f"""d AS ({runs}),
n AS (SELECT DISTINCT key, s FROM d WHERE p = 'rdf:type' AND o = 'cim:SvSwitch' AND ttl = 'CGMES_SV.ttl'), w AS (SELECT DISTINCT key, s FROM d WHERE p = 'rdf:type' AND o = 'cim:Terminal' AND ttl = 'CGMES_SV.ttl'), q AS (SELECT DISTINCT key, s FROM d WHERE p = 'cim:Switch.normalOpen' AND ttl = 'CGMES_EQ.ttl'),
v AS (SELECT DISTINCT key, s, p, o, o_kind, o_dt FROM d WHERE o IS NOT NULL),
r AS (SELECT key, 'open' AS source_shape, s AS focus_node, 'Violation' AS severity, CAST(NULL AS VARCHAR) AS value, CASE WHEN c = 0 THEN 'minCount' ELSE 'maxCount' END AS constraint_component FROM (SELECT n.key, n.s, count(v.o) AS c FROM n LEFT JOIN v ON v.key = n.key AND v.s = n.s AND v.p = 'cim:SvSwitch.open' GROUP BY 1, 2) WHERE c <> 1
UNION ALL SELECT key, 'connected', s, 'Warning', NULL, 'minCount' FROM (SELECT w.key, w.s, count(v.o) AS c FROM w LEFT JOIN v ON v.key = w.key AND v.s = w.s AND v.p = 'cim:ACDCTerminal.connected' GROUP BY 1, 2) WHERE c = 0
UNION ALL SELECT w.key, 'connected', w.s, 'Warning', v.o, 'lexical' FROM w JOIN v ON v.key = w.key AND v.s = w.s AND v.p = 'cim:ACDCTerminal.connected' WHERE v.o_kind <> 'literal' OR NOT regexp_full_match(v.o, 'true|false|1|0')
UNION ALL SELECT n.key, 'switch', n.s, 'Info', v.o, 'nodeKind' FROM n JOIN v ON v.key = n.key AND v.s = n.s AND v.p = 'cim:SvSwitch.Switch' WHERE v.o_kind <> 'iri'
UNION ALL SELECT key, 'name', s, 'Violation', NULL, CASE WHEN c = 0 THEN 'minCount' ELSE 'maxCount' END FROM (SELECT q.key, q.s, count(v.o) AS c FROM q LEFT JOIN v ON v.key = q.key AND v.s = q.s AND v.p = 'cim:IdentifiedObject.name' GROUP BY 1, 2) WHERE c <> 1)"""


_BY_TIME = _CHECKS + ", " + _results_sql("SELECT DISTINCT x.dataset || '|' || x.\"row\" AS key, x.ttl, s, p, o, o_kind, o_dt FROM x JOIN h USING (\"row\", grp, \"at\") JOIN triples ON graph = file WHERE p IS NOT NULL AND x.runs")
_BY_TIME += ", y AS (SELECT x.\"row\", x.grp, x.\"at\", x.ttl, x.dataset, r.* EXCLUDE (key) FROM r JOIN x ON r.key = x.dataset || '|' || x.\"row\")"


@query("l2_input_checks", f"WITH {_CHECKS} SELECT \"row\", grp, \"at\", ttl, expected, resolved, missing, missing_inputs, category, status, runs FROM x")
def l2_checks(spark, d):
    return V.input_checks(_mapping(spark), _files(spark, d)).drop("xml_inputs", "files")


def _by_time(spark, d):
    return V.validate_by_timestamp(_statements(spark, d), _mapping(spark), _files(spark, d), SHAPES)


@query("l2_validate_by_timestamp", f"WITH {_BY_TIME} SELECT * FROM y")
def l2(spark, d):
    return _by_time(spark, d).select("row", "grp", "at", "ttl", "dataset", "source_shape", "focus_node", "severity", "value", "constraint_component")


@query("l1_validate_by_mapping", """WITH f AS (SELECT DISTINCT profile, file_name AS file FROM file_metadata WHERE profile IS NOT NULL AND file_group IS NOT NULL AND final_ts IS NOT NULL), """ + _results_sql(
    "SELECT DISTINCT '1' AS key, 'CGMES_SV.ttl' AS ttl, s, p, o, o_kind, o_dt FROM f JOIN triples ON graph = file WHERE p IS NOT NULL AND profile IN ('SV', 'SSH') UNION SELECT DISTINCT '2', 'CGMES_EQ.ttl', s, p, o, o_kind, o_dt FROM f JOIN triples ON graph = file WHERE p IS NOT NULL AND profile = 'EQ'"
) + "SELECT CAST(key AS INTEGER) AS \"row\", CASE key WHEN '1' THEN 'CGMES_SV.ttl' ELSE 'CGMES_EQ.ttl' END AS ttl, r.* EXCLUDE (key) FROM r")
def l1(spark, d):
    """Row 4 has no run: what it lacks is another country's."""
    return V.validate_by_mapping(_statements(spark, d), _mapping(spark), _files(spark, d), SHAPES).select("row", "ttl", "source_shape", "focus_node", "severity", "value", "constraint_component")


@query("l10_dataset_names", f"WITH {_CHECKS} SELECT \"row\", grp, \"at\", dataset FROM x")
def l10(spark, d):
    at = F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return V.input_checks(_mapping(spark), _files(spark, d)).select("row", "grp", "at", V.timestamped_name(F.col("grp"), at, F.col("xml_inputs"), F.col("files")).alias("dataset"))


@query("b5_statistics", f"WITH {_BY_TIME} SELECT dataset, ttl, count(*) AS all_results, count(*) FILTER (severity = 'Violation') AS violations, count(*) FILTER (severity = 'Warning') AS warnings, count(*) FILTER (severity = 'Info') AS infos, CAST(NULL AS VARCHAR) AS validation_error, false AS conforms FROM y GROUP BY 1, 2")
def b5(spark, d):
    return E.severity_statistics(_by_time(spark, d).withColumn("error", F.lit(None).cast("string")), "dataset", "ttl")


@query("b5_constraint_statistics", f"WITH {_BY_TIME} SELECT \"row\", grp, \"at\", ttl, dataset, severity, source_shape, '' AS message, CASE source_shape WHEN 'open' THEN 'cim:SvSwitch.open' WHEN 'connected' THEN 'cim:ACDCTerminal.connected' WHEN 'switch' THEN 'cim:SvSwitch.Switch' ELSE 'cim:IdentifiedObject.name' END AS path, constraint_component, count(*) AS n FROM y GROUP BY ALL")
def b5_constraints(spark, d):
    return E.constraint_statistics(_by_time(spark, d), "row", "grp", "at", "ttl", "dataset", "severity", "source_shape", "message", "path", "constraint_component")


@query("b6_overview", f"WITH {_BY_TIME}, g AS (SELECT grp, \"at\", count(*) FILTER (severity = 'Violation') AS violations, count(*) FILTER (severity = 'Warning') AS warnings, count(*) FILTER (severity = 'Info') AS infos, CAST(0 AS BIGINT) AS errors, count(*) AS rows FROM y GROUP BY 1, 2) SELECT *, CASE WHEN violations > 0 THEN 'Violation' WHEN warnings > 0 THEN 'Warning' WHEN infos > 0 THEN 'Info' ELSE 'OK' END AS worst, CASE WHEN violations > 0 THEN 'violation' WHEN warnings > 0 THEN 'warning' ELSE 'OK' END AS priority FROM g")
def b6(spark, d):
    return E.overview(_by_time(spark, d).withColumn("error", F.lit(None).cast("string")), "grp", "at")


@query("b6_input_completeness", f"WITH {_CHECKS} SELECT grp, \"at\", status, count(*) AS rows, sum(expected) AS expected, sum(resolved) AS resolved, sum(missing) AS missing FROM x GROUP BY 1, 2, 3")
def b6_inputs(spark, d):
    g = V.input_checks(_mapping(spark), _files(spark, d)).groupBy("grp", "at", "status")
    return g.agg(F.count("*").alias("rows"), *[F.sum(c).alias(c) for c in ("expected", "resolved", "missing")])
