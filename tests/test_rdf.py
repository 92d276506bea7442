import io
import zipfile

import pytest

from voltloom.sources import rdf, writers

R, X = rdf.RDF, rdf.XSD


def triples(rows):
    return sorted((r[1], r[3], r[4], *(x for x in r[6:] if x)) for r in rows)


XML = b"""<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:c="http://c#" xml:base="http://b">
<c:Switch rdf:ID="_1"><c:name xml:lang="en">A &amp; B</c:name><c:n rdf:datatype="http://www.w3.org/2001/XMLSchema#integer">5</c:n><c:of rdf:resource="#_2"/></c:Switch>
<rdf:Description rdf:about="urn:uuid:2" c:short="x"><c:part><c:Part rdf:about="#p"/></c:part><c:list rdf:parseType="Collection"><rdf:Description rdf:about="#a"/></c:list></rdf:Description></rdf:RDF>"""


def test_rdf_xml():
    got = triples(rdf.rdf_xml(XML, "f"))
    assert ("http://b#_1", R + "type", "http://c#Switch") in got and ("http://b#_1", "http://c#name", "A & B", "en") in got
    assert ("http://b#_1", "http://c#n", "5", X + "integer") in got and ("http://b#_1", "http://c#of", "http://b#_2") in got
    assert ("urn:uuid:2", "http://c#short", "x") in got and ("http://b#p", R + "type", "http://c#Part") in got
    assert ("f#b0", R + "first", "http://b#a") in got and ("f#b0", R + "rest", R + "nil") in got


TTL = """@prefix c: <http://c#> . @prefix : <http://d#> .
# comment
:a a c:T ; c:n 5, 2.5, 1e3 ; c:b true ; c:t "x\\"y\\u00e9"@en-GB, '''long
text''' ; c:d "2031"^^c:year ; c:o [ c:p :b ] ; c:l ( :x "y" ) .
[] c:q _:n . <http://e/1.2> c:r c:a.b ."""


def test_turtle():
    got = triples(rdf.turtle(TTL.encode(), "f"))
    assert ("http://d#a", R + "type", "http://c#T") in got and ("http://d#a", "http://c#n", "2.5", X + "decimal") in got and ("http://d#a", "http://c#n", "1e3", X + "double") in got
    assert ("http://d#a", "http://c#t", 'x"yé', "en-GB") in got and ("http://d#a", "http://c#t", "long\ntext") in got and ("http://d#a", "http://c#d", "2031", "http://c#year") in got
    assert ("http://e/1.2", "http://c#r", "http://c#a.b") in got and any(p == "http://c#q" and o == "f#nn" for _, p, o, *_ in got)
    assert sum(1 for _, p, *_ in got if p == R + "first") == 2
    for bad in ('<a> <b> "open', "x:y <b> <c> .", "<a> <b> ."):
        with pytest.raises(ValueError):
            list(rdf.turtle(bad.encode(), "f"))


def test_json_ld():
    doc = b'{"@context": {"c": "http://c#", "k": {"@id": "c:k", "@type": "@id"}}, "@graph": [{"@id": "c:a", "@type": "c:T", "c:n": 5, "k": "c:b", "c:x": {"c:y": {"@value": "v", "@language": "de"}}}]}'
    got = triples(rdf.json_ld(doc, "f"))
    assert ("http://c#a", R + "type", "http://c#T") in got and ("http://c#a", "http://c#n", "5", X + "integer") in got and ("http://c#a", "http://c#k", "http://c#b") in got
    assert any(p == "http://c#y" and o == "v" for _, p, o, *_ in got)


def archive(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, c in files.items():
            z.writestr(n, c)
    return out.getvalue()


def test_read_nested_archives_and_write(spark, tmp_path):
    inner = archive({"dir/b.ttl": TTL, "skip.txt": "x"})
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "all.zip").write_bytes(archive({"a.xml": XML, "inner.zip": inner}))
    (tmp_path / "in" / "c.nt").write_text('<http://x/s> <http://x/p> "o" .\n')
    t = rdf.read(spark, str(tmp_path / "in"))
    assert {r.graph for r in t.select("graph").distinct().collect()} == {"a.xml", "b.ttl", "c.nt"}
    again = [x for r in writers.turtle_rows(t.where("graph = 'c.nt'")).collect() for x in rdf.turtle(r.text.encode(), "g")]
    assert triples(again) == [("http://x/s", "http://x/p", "o")]
    with pytest.raises(ValueError):
        list(rdf.members("x.zip", archive({"../out.ttl": "x"})))
    short = spark.createDataFrame([("g", "urn:uuid:1", "rdf:type", "cim:S", "iri", None), ("g", "urn:uuid:1", "cim:S.n", "a<b", "literal", None)], "graph string, s string, p string, o string, o_kind string, o_lang string")
    xml = writers.rdf_xml_rows(short, about=["cim:Other"])
    assert xml.first().text == '  <cim:S rdf:ID="1">\n    <cim:S.n>a&lt;b</cim:S.n>\n  </cim:S>'
    writers.write_documents(xml, str(tmp_path / "out"), "<rdf:RDF>", "</rdf:RDF>")
    assert spark.read.text(str(tmp_path / "out")).where("value like '%rdf:RDF%'").count() == 2


def test_small_formats(spark):
    lines = spark.createDataFrame([("cim:A.b=Float[xsd:float -> class java.lang.Float]",), ("# x=Y[z]",), ("broken",)], "value string")
    assert [tuple(r) for r in rdf.datatype_lines(lines).collect()] == [("cim:A.b", "xsd:float")]
    csv = spark.createDataFrame([("﻿xml_inputs,ttl,notes",), ("",), ("# c",), ('"EQ;SSH","a ""b"".ttl",n',), ("lone",)], "value string")
    assert [tuple(r) for r in rdf.mapping_rows(csv).collect()] == [("EQ;SSH", 'a "b".ttl', "n")]


def test_header_time_after_a_long_head(spark):
    long = "<rdf:RDF>\n" + "<md:Model.DependentOn rdf:resource='urn:uuid:0'/>\n" * 3000
    text = spark.createDataFrame([(long + "<md:Model.scenarioTime>2031-01-01T00:30:00Z</md:Model.scenarioTime>",)], "x string")
    assert text.select(rdf.header_time(text.x)).first()[0] == "2031-01-01T00:30:00Z"


def test_discovery(spark):
    from pyspark.sql import functions as F

    from voltloom.sources import discovery as V

    paths = ["/m/a.xml", "/m/./a.xml", "/m//a.XML", "/m/out/b.xml", "/m/sub/c.xml", "/m/d.rdf", None, "C:\\x\\e.xml"]
    df = spark.createDataFrame([(p, 1) for p in paths], "path string, PATH2 int")
    assert sorted(r.path for r in V.discover(df, ignored=("out",)).collect()) == ["/m/a.XML", "/m/a.xml", "/m/sub/c.xml", "C:/x/e.xml"]
    assert [r.path for r in V.discover(df, glob="/m/*/{c,d}.xml").collect()] == ["/m/sub/c.xml"]
    texts = [
        ('<h md:scenarioTime="2031-05-01T00:30:00Z"/>', True), ("<md:Model.scenarioTime> 20310501T0030Z</md:Model.scenarioTime>", True), ("scenarioTime\tis 2031-05-01T00:30Z", True),
        ('scenarioTime="soon" scenarioTime="20310501_0030"', True), ("scenarioTime " + "x" * 400 + "20310501_0030", False), ("", False), (None, False),
    ]
    t = spark.createDataFrame(texts, "t string, ok boolean").select("ok", V.near_field(F.col("t"), "scenarioTime").cast("string").alias("at"))
    assert all(r.at == ("2031-05-01 00:30:00" if r.ok else None) for r in t.collect())
