import pytest

from voltloom.operators import shacl as S

GRAPH = [("N", "rdf:type", "sh:NodeShape"), ("N", "sh:targetClass", "A"), ("N", "sh:targetClass", "B"), ("N", "sh:property", "P"), ("P", "sh:path", "v"), ("P", "sh:minCount", "1")]


def read(spark, *more):
    return S.read_shapes(spark.createDataFrame([*GRAPH, *more], "s string, p string, o string"))


def test_all_targets_and_no_silent_loss(spark):
    assert [x.target_class for x in read(spark)] == ["A", "B"]
    assert [(x.target_class, x.subjects_of) for x in read(spark, ("N", "sh:targetSubjectsOf", "q"))] == [("A", None), ("B", None), (None, "q")]
    for row in (("P", "sh:or", "l"), ("P", "sh:uniqueLang", "true"), ("N", "sh:closed", "true"), ("N", "sh:sparql", "x"), ("N", "sh:minCount", "1")):
        with pytest.raises(ValueError):
            read(spark, row)
