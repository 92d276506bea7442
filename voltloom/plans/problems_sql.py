"""The SQL that the queries of problems 1 to 5 are checked against."""

_U = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"


def oid(c: str) -> str:
    return f"CASE WHEN regexp_full_match({c}, '#_{_U}') THEN 'urn:uuid:' || lower(substr({c}, 3)) WHEN regexp_full_match({c}, '(?i:urn:uuid:){_U}') THEN lower({c}) ELSE {c} END"


WS = "' ' || chr(9) || chr(10) || chr(13) || chr(160)"


def trim(c: str) -> str:
    return f"trim({c}, {WS})"


PF = "pf AS (SELECT graph AS pg, prefix AS pp, min(ns) AS ns FROM prefixes GROUP BY 1, 2)"


def full(c: str) -> str:
    """Full IRI, where pf is joined on needs(c)."""
    return f"CASE WHEN ns IS NOT NULL THEN ns || substr({c}, strpos({c}, ':') + 1) ELSE {oid(c)} END"


def on(graph: str, c: str) -> str:
    return f"pf.pg = {graph} AND pf.pp = split_part({c}, ':', 1) AND NOT regexp_matches({c}, '^([A-Za-z][A-Za-z0-9+.-]*://|(?i:urn:)|#)') AND contains({c}, ':')"


_LINKS = f"""WITH RECURSIVE {PF},
links AS (SELECT p, {oid('s')} AS node, min({full('o')}) AS parent FROM triples LEFT JOIN pf ON {on('graph', 'o')}
  WHERE p IN ('rdfs:subClassOf', 'cims:belongsToCategory') AND {trim('o')} <> '' AND s <> '' GROUP BY 1, 2),
nodes AS (SELECT p, node FROM links UNION SELECT p, parent FROM links),
reach(p, node, up) AS (SELECT p, node, parent FROM links UNION SELECT r.p, r.node, l.parent FROM reach r JOIN links l ON l.p = r.p AND l.node = r.up),
ring AS (SELECT p, node FROM reach WHERE node = up),
under AS (SELECT DISTINCT r.p, r.node FROM reach r JOIN ring c ON c.p = r.p AND c.node = r.up),
top AS (SELECT r.p, r.node, count(*) AS depth, max(CASE WHEN l.node IS NULL THEN r.up END) AS root FROM reach r LEFT JOIN links l ON l.p = r.p AND l.node = r.up GROUP BY 1, 2)
"""

SQL = {
    "p1_found": _LINKS + """SELECT n.p, n.node, CASE WHEN u.node IS NOT NULL THEN '' ELSE coalesce(t.root, n.node) END AS root,
CAST(CASE WHEN c.node IS NOT NULL THEN -1 WHEN u.node IS NOT NULL THEN -2 ELSE coalesce(t.depth, 0) END AS BIGINT) AS depth
FROM nodes n LEFT JOIN top t USING (p, node) LEFT JOIN ring c USING (p, node) LEFT JOIN under u USING (p, node)""",
    "p1_descendants": _LINKS + """, num AS (SELECT n.p, n.node, coalesce(t.depth, 0) AS depth FROM nodes n LEFT JOIN top t USING (p, node) WHERE NOT EXISTS (SELECT 1 FROM under u WHERE u.p = n.p AND u.node = n.node))
SELECT r.p, r.up AS ancestor, r.node, CAST(a.depth - b.depth AS BIGINT) AS distance FROM reach r JOIN num a ON a.p = r.p AND a.node = r.node JOIN num b ON b.p = r.p AND b.node = r.up""",
}

_BOOL = f"CASE WHEN lower({trim('o')}) IN ('true', '1') THEN 'true' WHEN lower({trim('o')}) IN ('false', '0') THEN 'false' END"
SQL["p3_found"] = f"""WITH v AS (SELECT graph, {oid('s')} AS s, p, {_BOOL} AS b, o FROM triples WHERE p IN ('cim:SvSwitch.open', 'cim:ACDCTerminal.connected', 'rdf:type')),
cells AS (SELECT graph, s, p, count(DISTINCT b) AS n FROM v WHERE p <> 'rdf:type' GROUP BY 1, 2, 3),
must AS (SELECT DISTINCT graph, s, CASE WHEN o = 'cim:SvSwitch' THEN 'cim:SvSwitch.open' ELSE 'cim:ACDCTerminal.connected' END AS p FROM v WHERE p = 'rdf:type' AND o IN ('cim:SvSwitch', 'cim:Terminal', 'cim:ACDCConverterDCTerminal'))
SELECT graph, s, p, CASE n WHEN 0 THEN 'unreadable' ELSE 'conflict' END AS kind FROM cells WHERE n <> 1
UNION ALL SELECT graph, s, p, 'absent' FROM must WHERE NOT EXISTS (SELECT 1 FROM cells c WHERE c.graph = must.graph AND c.s = must.s AND c.p = must.p)"""
SQL["p2_found"] = r"""WITH lines AS (SELECT DISTINCT series, file_name AS file, CAST(record AS JSON) AS j FROM description_exports WHERE json_valid(record) AND json_type(record) = 'OBJECT'),
keys AS (SELECT series, file, j, unnest(json_keys(j)) AS field FROM lines),
vals AS (SELECT DISTINCT series, file, j->>'item' AS item, field, json_extract(j, '$."' || field || '"') AS v FROM keys WHERE field <> 'item'),
facts AS (SELECT series, file, item, field, CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'number' END AS type, CAST(v AS VARCHAR) AS value FROM vals WHERE json_type(v) <> 'NULL'),
types AS (SELECT series, file, field, arg_max(type, n) AS type FROM (SELECT series, file, field, type, count(DISTINCT item) AS n FROM facts GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
files AS (SELECT series, file, lag(file) OVER (PARTITION BY series ORDER BY since, file) AS before FROM (SELECT series, file_name AS file, min(exported_at) AS since FROM description_exports GROUP BY 1, 2)),
later AS (SELECT f.series, f.file, f.before, t.field, t.type FROM files f JOIN types t ON t.series = f.series AND t.file = f.file WHERE f.before IS NOT NULL),
earlier AS (SELECT f.series, f.file, f.before, t.field, t.type FROM files f JOIN types t ON t.series = f.series AND t.file = f.before),
removed AS (SELECT * FROM earlier e WHERE NOT EXISTS (SELECT 1 FROM later l WHERE l.file = e.file AND l.series = e.series AND l.field = e.field)),
added AS (SELECT * FROM later l WHERE NOT EXISTS (SELECT 1 FROM earlier e WHERE l.file = e.file AND l.series = e.series AND l.field = e.field)),
renamed AS (SELECT r.series, r.file, r.field, a.field AS new_field FROM removed r JOIN added a ON a.series = r.series AND a.file = r.file
  JOIN facts x ON x.series = r.series AND x.file = r.before AND x.field = r.field JOIN facts y ON y.series = r.series AND y.file = r.file AND y.field = a.field AND y.item = x.item
  GROUP BY 1, 2, 3, 4 HAVING count(*) >= 3 AND sum(CASE WHEN x.value = y.value THEN 1 ELSE 0 END) >= 0.9 * count(*))
SELECT series, file AS file_name, 'renamed' AS change, field, new_field FROM renamed
UNION ALL SELECT series, file, 'removed', field, '' FROM removed r WHERE NOT EXISTS (SELECT 1 FROM renamed x WHERE x.series = r.series AND x.file = r.file AND x.field = r.field)
UNION ALL SELECT series, file, 'added', field, '' FROM added r WHERE NOT EXISTS (SELECT 1 FROM renamed x WHERE x.series = r.series AND x.file = r.file AND x.new_field = r.field)
UNION ALL SELECT e.series, e.file, 'type_changed', e.field, '' FROM earlier e JOIN later l USING (series, file, field) WHERE e.type <> l.type"""

_SPACED = f"{trim("regexp_replace(o, '[ ' || chr(9) || chr(10) || chr(13) || chr(160) || ']+', ' ', 'g')")}"


def _side(name: str) -> str:
    return f"""SELECT DISTINCT graph, {oid('s')} AS s, p, CASE WHEN p = 'rdfs:subClassOf' THEN {full('o')} WHEN p = 'cim:SvSwitch.open' THEN coalesce({_BOOL}, {trim('o')}) ELSE {_SPACED} END AS v,
CASE WHEN p IN ('rdfs:label', 'rdfs:comment') THEN lower(o_lang) END AS lang FROM {name} LEFT JOIN pf ON p = 'rdfs:subClassOf' AND {on('graph', 'o')}
WHERE p IN ('rdfs:label', 'rdfs:comment', 'rdfs:subClassOf', 'cim:SvSwitch.open') AND {trim('o')} <> ''"""


_AB = f"WITH {PF}, a AS ({_side('triples')}), b AS ({_side('triples_b')}), da AS (SELECT * FROM a EXCEPT SELECT * FROM b), db AS (SELECT * FROM b EXCEPT SELECT * FROM a)"
SQL["p4_values"] = _AB + " SELECT 'a' AS side, * FROM da UNION ALL SELECT 'b', * FROM db"
SQL["p4_found"] = _AB + """, ra AS (SELECT DISTINCT graph, s FROM a), rb AS (SELECT DISTINCT graph, s FROM b)
SELECT graph, s, '' AS p, 'only_a' AS kind FROM (SELECT * FROM ra EXCEPT SELECT * FROM rb) UNION ALL SELECT graph, s, '', 'only_b' FROM (SELECT * FROM rb EXCEPT SELECT * FROM ra)
UNION ALL SELECT graph, s, p, 'differs' FROM (SELECT graph, s, p FROM da UNION SELECT graph, s, p FROM db) JOIN ra USING (graph, s) JOIN rb USING (graph, s)"""

_ORPHANS = f"""WITH {PF}, arr AS (SELECT file_name AS graph, min(arrived_at) AS t, strftime(arg_min(final_ts, arrived_at), '%Y-%m') AS month FROM file_metadata GROUP BY 1),
refs AS (SELECT DISTINCT x.graph, {oid('s')} AS s, p, {full('o')} AS target, arr.t FROM triples x JOIN arr ON arr.graph = x.graph LEFT JOIN pf ON {on('x.graph', 'o')}
  WHERE p IN ('cim:SvSwitch.Switch', 'cims:belongsToCategory') AND {trim('o')} <> '' AND s IS NOT NULL),
ev AS (SELECT DISTINCT {oid('s')} AS target, arr.t, true AS alive FROM triples x JOIN arr ON arr.graph = x.graph WHERE p = 'rdf:type'
  UNION SELECT {oid('s')}, created_at, side = 'forward' FROM difference_rows WHERE p = 'rdf:type'),
st AS (SELECT r.target, r.t, max(e.t) FILTER (e.t <= r.t) AS last, arg_max(e.alive, e.t) FILTER (e.t <= r.t) AS was, coalesce(bool_or(e.alive), false) AS ever
  FROM (SELECT DISTINCT target, t FROM refs) r LEFT JOIN ev e ON e.target = r.target GROUP BY 1, 2),
orphan AS (SELECT DISTINCT graph, s, p, CASE WHEN last IS NOT NULL THEN 'deleted' WHEN ever THEN 'late' ELSE 'missing' END AS status FROM refs JOIN st USING (target, t) WHERE was IS NOT TRUE)
"""
SQL["p5_found"] = _ORPHANS + "SELECT graph, s, p, status FROM orphan"
SQL["p5_report"] = _ORPHANS + "SELECT p, month, status, count(*) AS n FROM orphan JOIN arr USING (graph) GROUP BY 1, 2, 3"
