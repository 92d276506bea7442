from voltloom.operators.graph import symmetric_difference
from voltloom.plans import registry

SCHEMA = "s string, p string, o string"


def test_sides(spark):
    a = spark.createDataFrame([("x", "p", "1"), ("x", "p", "1"), ("x", "p", "2"), ("x", None, None), ("y", "p", None), (None, "p", "1")], SCHEMA)
    b = spark.createDataFrame([("x", "p", "2"), ("x", "p", "2"), ("x", None, None), ("y", "p", ""), ("z", "p", "3"), ("z", "p", "3")], SCHEMA)
    got = sorted(map(str, map(tuple, symmetric_difference(a, b).collect())))
    assert got == sorted(map(str, [("A", "x", "p", "1"), ("A", "y", "p", None), ("A", None, "p", "1"), ("B", "y", "p", ""), ("B", "z", "p", "3")]))
    assert symmetric_difference(a, a).count() == 0


def test_no_side_goes_to_the_driver(spark):
    df = registry.queries()["h3_symmetric_difference"](spark, "/root/testdata/sf0.001")
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
