import pytest
from pyspark.sql import functions as F

from voltloom.operators import orphans as O
from voltloom.operators import runs as V
from voltloom.operators.shacl import Shape

T = "graph string, s string, p string, o string, o_kind string, o_dt string"
FILES = [("EQ", "g", "1", "a_EQ.xml"), ("SSH", "g", "1", "a_SSH.xml"), ("SSH", "g", "2", "b_SSH.xml"), ("EQBD", "g", "1", "x_EQBD.xml"), ("SSH", "REE", "1", "r_SSH.xml")]


@pytest.fixture(scope="module")
def parts(spark):
    t = [("a_EQ.xml", "s", "rdf:type", "C", "iri", None), ("a_EQ.xml", "s", "to", "x", "iri", None), ("a_SSH.xml", "x", "rdf:type", "D", "iri", None), ("b_SSH.xml", "s", "rdf:type", "C", "iri", None), ("r_SSH.xml", "s", "rdf:type", "C", "iri", None)]
    mapping = [(1, "CGMES_a.ttl", "EQ;SSH"), (2, "NC_b.ttl", "SSH"), (3, "x", "REE_SSH;SSH"), (4, "x", " ; "), (5, "x", "zip:*_EQBD*")]
    return spark.createDataFrame(t, T), spark.createDataFrame(mapping, "row int, ttl string, xml_inputs string"), spark.createDataFrame(FILES, "profile string, grp string, at string, file string")


def test_checks(parts):
    _, mapping, files = parts
    got = {(r.row, r.grp, r.at): (r.expected, r.resolved, r.missing_inputs, r.status, r.runs) for r in V.input_checks(mapping, files).collect()}
    assert got[1, "g", "1"] == (2, 2, "", "OK", True) and got[1, "g", "2"] == (2, 1, "EQ", "Partial input - validation executed", True)
    assert got[2, "REE", "1"] == (1, 1, "", "OK", True) and got[3, "g", "1"] == (2, 1, "REE_SSH", "Missing - country-specific input", False)
    assert got[3, "REE", "1"][3:] == ("Partial input - validation executed", True)
    assert got[5, "g", "2"] == (1, 1, "", "OK", True) and got[5, "REE", "1"] == (1, 0, "*_EQBD*", "Missing input - skipped", False)
    assert not [(k, v) for k, v in got.items() if k[0] == 4]


def test_runs_do_not_meet(parts):
    t, mapping, files = parts
    shapes = {"CGMES_a.ttl": [Shape("k", "to", target_class="C", constraints={"minCount": 1}), Shape("c", "to", target_class="C", constraints={"class": "E"})], "NC_b.ttl": []}
    got = {(r.row, r.grp, r.at, r.dataset, r.source_shape, r.focus_node, r.value) for r in V.validate_by_timestamp(t, mapping, files, shapes).collect()}
    assert got == {(1, "g", "1", "g__1__SSH + EQ", "c", "s", "x")[:3] + ("g__1__EQ + SSH", "c", "s", "x"), (1, "g", "2", "g__2__EQ + SSH", "k", "s", None), (1, "REE", "1", "REE__1__EQ + SSH", "k", "s", None)}
    once = {(r.row, r.source_shape, r.focus_node, r.value) for r in V.validate_by_mapping(t, mapping, files, shapes).collect()}
    assert once == {(1, "c", "s", "x")}


def test_names(spark):
    cases = [([], "UNKNOWN"), (["x/Instance/Grid/CGM/a", "b"], "CGM"), (["x/Instance/Grid/IGM_B/a", "y/Instance/Grid/IGM_A/b"], "IGM_B"), (["x\\a.xml"], "a.xml"), (["q/b", "p/a"], "a")]
    df = spark.createDataFrame(cases, "p array<string>, n string").select("n", V.dataset_name(F.col("p")).alias("got"))
    assert all(r.n == r.got for r in df.collect())
    df = spark.createDataFrame([("SV; x_SSH;EQ", ["f"]), ("other", ["f", "g"]), (None, [])], "i string, f array<string>").select(V.timestamped_name(F.lit("g"), F.lit("t"), F.col("i"), F.col("f")).alias("n"))
    assert [r.n for r in df.collect()] == ["g__t__SV + SSH + EQ", "g__t__f + g", "g__t__UNKNOWN_PROFILES"]


def test_hot_keys_are_split(spark):
    df = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(300)], "k string, v int")
    other = spark.createDataFrame([("hot", 1), ("k3", 2), ("gone", 3)], "k string, w int")
    got = O.salted(df, other, ["k"], df.groupBy("k").count(), rows=20)
    assert "__parts" in got._jdf.queryExecution().toString() and sorted(map(tuple, got.collect())) == sorted([("hot", i, 1) for i in range(300) if i % 3] + [("k3", 3, 2)])
