import pytest
from pyspark.sql import functions as F

from voltloom.functions import files as N
from voltloom.functions.ids import expand, object_id, pick, readable
from voltloom.operators import diff as D
from voltloom.operators import graph as G
from voltloom.operators import rdfs as R
from voltloom.operators import shacl as S
from voltloom.operators import shapes as H
from voltloom.operators import sparql as P
from voltloom.operators import tasks as K
from voltloom.operators.statistics import overview, severity_statistics

T = "graph string, s string, p string, o string, o_kind string, o_dt string, o_lang string"


def rows(spark, *triples):
    full = [("g", s, p, o, "iri" if p == "rdf:type" or str(o).startswith("x:") else "literal", *(rest or (None, None))) for s, p, o, *rest in triples]
    return spark.createDataFrame([r if len(r) == 7 else (*r, None) for r in full], T)


def test_identifiers(spark):
    u = "0A1B2c3d-0000-4000-8000-00000000000F"
    df = spark.createDataFrame([(f"#_{u}",), (f"URN:UUID:{u}",), (f"#_{u}\n",), ("#_1",), (None,)], "c string")
    assert [r[0] for r in df.select(object_id(F.col("c"))).collect()] == [f"urn:uuid:{u.lower()}"] * 2 + [f"#_{u}\n", "#_1", None]
    v = spark.createDataFrame([(" TRUE ",), ("0\n",), ("",), (None,), ("1.0",)], "c string")
    assert [r[0] for r in v.select(readable(F.col("c"))).collect()] == ["true", "false", None, None, None]
    px = spark.createDataFrame([("g", "", "http://n#"), ("g", "a", "http://b#"), ("g", "a", "http://a#"), ("g", "a", "http://a#"), (None, "a", "x")], "graph string, prefix string, ns string")
    t = spark.createDataFrame([("g", ":N"), ("g", "a:X:y"), ("h", "a:X"), ("g", "http://q/z"), ("g", None), ("g", "plain")], "graph string, o string")
    assert sorted(str(r.o) for r in expand(t, px, "o").collect()) == sorted(["http://n#N", "http://a#X:y", "a:X", "http://q/z", "None", "plain"])
    assert pick(spark.createDataFrame([(1, 2)], "S int, s int"), "s").first().s == 2
    with pytest.raises(ValueError):
        pick(px, "nothing")


def test_graph(spark):
    t = rows(spark, ("h", "rdf:type", "owl:Ontology"), ("h", "v", "1"), ("k", "rdf:type", "owl:Ontology"), ("k", "sh:declare", "d"), ("a", "v", "1"))
    assert {r.s for r in G.strip_headers(t).collect()} == {"k", "a"}
    loop = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "a"), (None, "a")], "s string, o string")
    got = {tuple(r) for r in G.closure(loop).collect()}
    assert {(i, j) for i in "abc" for j in "abc"} | {("x", j) for j in "abc"} == got
    assert G.closure(loop.limit(0)).count() == 0
    n = rows(spark, ("b1", "p", "1"), ("b1", "q", "b3"), ("b2", "p", "1"), ("b2", "q", "b4"), ("b3", "r", "z"), ("b4", "r", "z"), ("b5", "r", "y"))
    nodes = n.select("s").distinct()
    assert {tuple(r) for r in G.repeated_nodes(n, nodes, levels=2).collect()} == {("b2", "b1"), ("b4", "b3")}
    conflict = spark.createDataFrame([("f1", "s", "m", "1"), ("f2", "s", "m", "2"), ("f1", "u", "m", "1")], "graph string, s string, p string, o string")
    assert sorted((r.s, r.o) for r in G.resolve_conflicts(conflict, "m", F.col("graph")).collect()) == [("s", "2"), ("u", "1")]


def test_diff_laws(spark):
    a = rows(spark, ("s", "rdf:type", "C"), ("s", "v", "1.0", "xsd:float", None), ("s", "w", "x"), ("s", "m", "1"), ("s", "m", "2"), ("gone", "rdf:type", "C"), ("s", "e", ""))
    b = rows(spark, ("s", "rdf:type", "C"), ("s", "v", "1.00", "xsd:float", None), ("s", "w", "y"), ("s", "m", "1"), ("s", "m", "3"), ("s", "m", "4"))
    assert D.graph_diff(a, a).count() == 0
    got = {tuple(r) for r in D.graph_diff(a, b).collect()}
    assert got == {("s", "C", "w", "x", "y"), ("s", "C", "m", "2", "N/A"), ("s", "C", "m", "N/A", "3"), ("s", "C", "m", "N/A", "4"), ("gone", "C", "New", "C", "N/A")}
    turned = {(i, t, p, y, x) for i, t, p, x, y in got}
    assert {tuple(r) for r in D.graph_diff(b, a).collect()} == turned
    assert D.graph_diff(a, b, skip=["C"]).count() == 0


def test_shapes_conform_and_not(spark):
    t = rows(
        spark, ("a", "rdf:type", "Sub"), ("a", "n", "5", "xsd:integer", None), ("b", "rdf:type", "C"), ("b", "n", "x", "xsd:integer", None), ("b", "n", "7", None, None), ("c", "rdf:type", "C"),
        ("s", "sh:targetClass", "C"), ("s", "sh:property", "x:q"), ("x:q", "sh:path", "n"), ("x:q", "sh:minCount", "1"), ("x:q", "sh:maxCount", "1"), ("x:q", "sh:datatype", "xsd:integer"), ("x:q", "sh:severity", "sh:Warning"),
    )
    below = spark.createDataFrame([("Sub", "C")], "child string, ancestor string")
    shapes = S.read_shapes(t)
    assert len(shapes) == 1 and shapes[0].severity == "Warning"
    got = {(r.focus_node, r.constraint_component, r.value) for r in S.validate(t, shapes, below).collect()}
    assert got == {("b", "maxCount", None), ("b", "datatype", "x"), ("b", "datatype", "7"), ("c", "minCount", None)}
    with pytest.raises(ValueError):
        S.check(t, S.Shape("z", "n", "C", constraints={"nonsense": 1}))


def test_statistics(spark):
    r = spark.createDataFrame([("d", "f", "sh:Violation", None), ("d", "f", "odd", None), ("d", None, None, "failed"), ("e", None, None, None)], "d string, focus_node string, severity string, error string")
    got = {x.d: x for x in severity_statistics(r, "d").collect()}
    assert (got["d"].violations, got["d"].conforms, got["e"].conforms) == (1, False, True)
    o = {x.d: x for x in overview(r, "d").collect()}["d"]
    assert (o.worst, o.priority, o.errors) == ("Violation", "error", 1)


def test_queries_in_text(spark):
    t = rows(spark, ("a", "rdf:type", "c:T"), ("a", "c:n", "5"), ("b", "rdf:type", "c:T"), ("b", "c:n", "9"), ("b", "c:up", "a"), ("a", "c:up", "r"), ("r", "c:n", "1"), ("a", "c:n", "5"))
    run = lambda q: sorted(tuple(str(v) for v in r) for r in P.select(t, q).collect())
    assert run("SELECT ?s WHERE { ?s a c:T ; c:n ?n FILTER(?n > 6) }") == [("b",)]
    assert run("SELECT ?s ?u WHERE { ?s c:up* ?u . ?s a c:T }") == [("a", "a"), ("a", "r"), ("b", "a"), ("b", "b"), ("b", "r")]
    assert run("SELECT ?s WHERE { ?s c:up/c:n '1' }") == [("a",)]
    assert run("SELECT ?x WHERE { ?x ^c:up ?y . ?y a c:T }") == [("a",), ("r",)]
    assert run("SELECT (COUNT(*) AS ?k) (SUM(?n) AS ?t) WHERE { ?s c:n ?n }") == [("3", "15.0")]
    assert run("SELECT ?s ?l WHERE { ?s c:n ?n BIND(STRBEFORE('key=1', '=') AS ?l) VALUES ?s { 'a' } }") == [("a", "key")]
    assert run("SELECT ?s WHERE { ?s c:n ?n FILTER(?n IN ('5', '1') || STRAFTER(?s, 'x') = 'q') } ORDER BY DESC(?s) LIMIT 1") == [("r",)]
    for bad in ("", "ASK { ?s ?p ?o }", "CONSTRUCT { } WHERE { }", "SELECT ?s WHERE { GRAPH ?g { ?s ?p ?o } }", "SELECT ?s WHERE { ?s"):
        with pytest.raises(P.Unsupported):
            P.select(t, bad)


def test_tasks(spark):
    t = rows(spark, ("urn:uuid:1", "rdf:type", "C"), ("urn:uuid:1", "cim:IdentifiedObject.mRID", "1"), ("urn:uuid:2", "ref", "urn:uuid:1"))
    a, b = (K.regenerate_ids(t, s).collect() for s in ("x", "y"))
    assert a[0].s == a[1].s == a[2].o and a[1].o == a[0].s[9:] and a[0].s != b[0].s
    made = K.generate(spark, "C", 50, {"n": ("xsd:integer", 1, 3), "f": ("xsd:float", 0, 1)}, seed=1)
    assert made.collect() == K.generate(spark, "C", 50, {"n": ("xsd:integer", 1, 3), "f": ("xsd:float", 0, 1)}, seed=1).collect()
    assert {r.o for r in made.where("p = 'n'").collect()} <= {"1", "2", "3"}
    assert {r.o for r in K.generate(spark, "C", 3, {"n": ("xsd:integer", 1, 3)}, conform=False).where("p = 'n'").collect()} == {"1.1"}
    header = rows(spark, ("h", "rdf:type", "md:FullModel"), ("h", "d", "old"), ("o", "d", "stays"))
    assert sorted((r.s, r.o) for r in K.set_header(header, {"d": "new"}).where("p = 'd'").collect()) == [("h", "new"), ("o", "stays")]


def test_vocabulary_and_names(spark):
    m = spark.createDataFrame([("1",), ("0..1",), ("M#M:2..n",), ("0..12",), (None,)], "m string").select(N.cardinality(F.col("m")).alias("c"))
    assert [r.c and tuple(r.c) for r in m.collect()] == [(1, 1), (0, 1), (2, 999), None, None]
    n = spark.createDataFrame([("x_EQBD_1.xml",), ("20310101T0030Z_REE_SSH1.xml",), ("sequel.xml",)], "n string").select(N.profile(F.col("n")).alias("p"))
    assert [r.p for r in n.collect()] == ["EQBD", "SSH", None]
    d = spark.createDataFrame([("2031-05-01", h) for h in (1, 2, 3)], "d string, h int").select(N.market_hour(F.to_timestamp("d"), F.col("h")).alias("t"))
    assert [str(r.t) for r in d.collect()] == ["2031-04-30 22:00:00", "2031-04-30 23:00:00", "2031-05-01 00:00:00"]
    head = rows(spark, ("f", "rdf:type", "md:FullModel"), ("f", "md:Model.version", " 3 "), ("f", "md:Model.created", None))
    assert {(r.p, r.o) for r in R.manifest(head).collect()} == {("dcat:version", "3"), ("dcterms:title", "g")}
    full = "Grid_CommonData_CGM-CD.xml;x_EQ;"
    cases = [
        ("NCP_v2-4-0/NC-v2-4-0_AP-Con-Complex-Common-SHACL.ttl", "", "DANGLINGREFERENCE"), ("NC_x.ttl", full, "NC_SINGLE"), ("CGMES_x.ttl", full + "Svedala;Britheim", "CGMES_CGM"),
        ("CGMES_x.ttl", full + "SSH;TP;SV;Svedala", "CGMES_IGM_COMPLETE"), ("CGMES_x.ttl", full + "SSH;TP", "CGMES_SINGLE_PROFILE"), ("x.ttl", full, "UNKNOWN"), (None, None, "UNKNOWN"),
    ]
    c = spark.createDataFrame(cases, "t string, x string, k string").select("k", H.category(F.col("t"), F.col("x")).alias("got"))
    assert all(r.k == r.got for r in c.collect())


def test_names_of_files(spark):
    names = [("a_SSH_EQ.xml", "p", "SSH"), ("x_AE_RAS.xml", "p", "RAS"), ("a.xml", "/in/TP/a.xml", "TP"), ("a--SV1..xml", "p", "SV"), ("EQBD-EQ.xml", "p", "EQBD"), ("sequel.xml", "p", None)]
    n = spark.createDataFrame(names, "n string, path string, p string").select("p", N.profile(F.col("n"), F.col("path")).alias("got"))
    assert all(r.p == r.got for r in n.collect())
    owners = [
        ("A B_EQ_1.xml", "/x/EQ.xml", "EQ", "A_B"), ("x_EQ_1.xml", "/m/IGM_Nord/x", "EQ", "IGM_Nord"), ("x_EQ_1.xml", "/m/TSO_a/IGM_b/x", "EQ", "TSO_a"), ("_EQ_1.xml", "/m/IGM_", "EQ", "UNKNOWN_TSO"),
        ("20310101T0030Z-PIX-ssh.xml", "/m", "SSH", "20310101T0030Z-PIX"), ("sequel.xml", "/m", None, "UNKNOWN_TSO"),
    ]
    o = spark.createDataFrame(owners, "n string, path string, p string, o string").select("o", N.owner(F.col("n"), F.col("path"), F.col("p")).alias("got"))
    assert [(r.o, r.got) for r in o.collect() if r.o != r.got] == []
    times = ["2031-05-01T00:30:00Z", '"2031-05-01T00:30Z"', "20310501T003000Z", "20310501_003000", " 20310501T0030Z", "20310501_0030", "2031-05-01T01:30:00.000+01:00"]
    t = spark.createDataFrame([(x,) for x in times], "t string").select(N.instant(F.col("t")).cast("string").alias("t"))
    assert {r.t for r in t.collect()} == {"2031-05-01 00:30:00"}
    t = spark.createDataFrame([(x,) for x in ("2031-05-01", "2031-05-01 00:30:00", "", None, "20311301_0030")], "t string").select(N.instant(F.col("t")).alias("t"))
    assert {r.t for r in t.collect()} == {None}
    tokens = [("REE_EQ", "REE", "REE", True), ("{ren-x}", "rte-france", "REN", False), ("RTEFRANCE_SSH", "RTE_FRANCE", "RTE", True), ("x_REE_y", "z", None, True)]
    k = spark.createDataFrame(tokens, "t string, g string, o string, a boolean").select("o", "a", N.country_owner(F.col("t")).alias("own"), N.applies_to(F.col("t"), F.col("g")).alias("app"))
    assert all((r.o, r.a) == (r.own, r.app) for r in k.collect())
    states = [(2, 0, False, 2, "OK"), (3, 0, True, 2, "Too many files"), (1, 1, True, 2, "Missing - country-specific input"), (1, 1, False, 2, "Partial input - validation executed"), (0, 1, False, 2, "Missing input - skipped")]
    s = spark.createDataFrame(states, "r int, m int, c boolean, e int, s string").select("s", N.completeness(F.col("r"), F.col("m"), F.col("c"), F.col("e")).alias("got"))
    assert all(r.s == r.got for r in s.collect())


def test_time_sources(spark):
    files = [("g", "a", "2031-05-01 00:30:00", "2031-05-01 09:00:00"), ("g", "b", None, "2031-05-01 00:30:00"), ("g", "c", None, "2031-05-01 09:00:00"), ("g", "d", None, "2031-05-02 09:00:00"), ("g", "e", None, None), ("h", "f", None, "2031-05-01 00:30:00")]
    df = spark.createDataFrame(files, "grp string, path string, header string, named string").withColumns({c: F.to_timestamp(c) for c in ("header", "named")})
    got = {r.path: (r.source, str(r.time)[:16]) for r in H.time_sources(df).collect()}
    assert got == {
        "a": ("METADATA_HOUR", "2031-05-01 00:30"), "b": ("FILENAME_MAPPED_TO_SAME_HOUR_METADATA", "2031-05-01 00:30"), "c": ("FILENAME_MAPPED_TO_METADATA_HOUR", "2031-05-01 00:30"),
        "d": ("FILENAME_HOUR", "2031-05-02 09:30"), "e": ("NONE", "None"), "f": ("FILENAME_HOUR", "2031-05-01 00:30"),
    }


def test_multiply_and_connect(spark):
    t = rows(spark, ("urn:uuid:n", "rdf:type", "cim:ConnectivityNode"), ("urn:uuid:r", "rdf:type", "cim:SubGeographicalRegion"), ("urn:uuid:t", "cim:Terminal.ConnectivityNode", "urn:uuid:n"), ("urn:uuid:t", "in", "urn:uuid:r"))
    got = K.multiply_and_connect(t, 3, "urn:uuid:n").collect()
    ends = [r.o for r in got if r.p == "cim:Terminal.ConnectivityNode"]
    nodes = {r.s for r in got if r.o == "cim:ConnectivityNode"}
    assert len(nodes) == 3 and set(ends) == nodes and ends.count("urn:uuid:n") == 3 and len(ends) == 7
    assert {r.o for r in got if r.p in ("in", "cim:Line.Region")} == {"urn:uuid:r"} and sum(r.o == "cim:ACLineSegment" for r in got) == 2
    assert K.multiply_and_connect(t, 1, "urn:uuid:n").count() == 4


def test_nearest_is_brute_force(spark):
    import random

    rng = random.Random(8)
    a = [(i, rng.choice("xyz" if i % 9 else "w"), rng.randrange(60)) for i in range(300)] + [(900, None, 1), (901, "x", None)]
    b = [(i, rng.choice("xxxxy"), rng.randrange(0, 60, 3)) for i in range(80)] + [(990, "x", None)]
    df = [spark.createDataFrame(x, "k int, g string, v int") for x in (a, b)]
    want = {(g, i, v, *min((abs(v - w), j, w) for j, h, w in b if h == g and w is not None)[1:]) for i, g, v in a if g in ("x", "y") and v is not None}
    for pieces in (1, 7, 200):
        assert {tuple(r) for r in D.nearest(*df, ["g"], "v", ("k", "k"), pieces=pieces).collect()} == want
    assert D.nearest(df[0].limit(0), df[1].limit(0), ["g"], "v", ("k", "k")).count() == 0


def test_inject(spark):
    t = rows(spark, ("a", "rdf:type", "C"), ("a", "p", "1"), ("b", "rdf:type", "C"), ("b", "rdf:type", "D"), ("c", "q", "1"))
    v = spark.createDataFrame([("C", "p", "9"), ("C", "p", "8"), ("D", "q", "7")], "cls string, p string, o string")
    assert {tuple(r) for r in K.inject(t, v).collect()} == {("g", "b", "p", "8"), ("g", "b", "q", "7")}


def test_sparql_prefixes_and_separator(spark):
    t = rows(spark, ("a", "rdf:type", "cim:Terminal"), ("a", "http://x/y#p", "1"), ("a", "http://x/y#p", "2"))
    head = "# one\nPREFIX m: <http://iec.ch/TC57/CIM100#> prefix : <http://x/y#>\n"
    got = P.select(t, head + "SELECT ?s (GROUP_CONCAT(?o; SEPARATOR = '|') AS ?all) WHERE { ?s a m:Terminal ; :p ?o } GROUP BY ?s").collect()
    assert [tuple(r) for r in got] == [("a", "1|2")]
    with pytest.raises(P.Unsupported):
        P.select(t, head + "SELECT ?s WHERE { ?s q:p ?o }")


def test_closure_of_a_long_chain_with_a_cycle(spark):
    e = [(f"n{i}", f"n{i + 1}") for i in range(40)] + [("c1", "c2"), ("c2", "c1"), ("n40", "c1"), ("n3", None), ("n1", "n2")]
    got = {tuple(r) for r in G.closure(spark.createDataFrame(e, "s string, o string")).collect()}
    chain = {(f"n{i}", f"n{j}") for i in range(41) for j in range(i + 1, 41)}
    assert got == chain | {(f"n{i}", c) for i in range(41) for c in ("c1", "c2")} | {(a, b) for a in ("c1", "c2") for b in ("c1", "c2")}
