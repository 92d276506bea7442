from voltloom import cli
from voltloom.operators import convert as C
from voltloom.sources import rdf

MODEL = """<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:md="http://iec.ch/TC57/61970-552/ModelDescription/1#" xmlns:cim="http://iec.ch/TC57/2013/CIM-schema-cim16#">
<md:FullModel rdf:about="urn:uuid:1"><md:Model.created>2031-01-01T00:00:00Z</md:Model.created><md:Model.profile>http://p/EQ</md:Model.profile></md:FullModel>
<cim:Breaker rdf:ID="_2"><cim:Switch.normalOpen>true</cim:Switch.normalOpen></cim:Breaker></rdf:RDF>"""


def test_manifest_command(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xml").write_text(MODEL)
    t = {(r.p, r.o) for r in rdf.short_names(rdf.read(spark, str(tmp_path / "in"))).collect()}
    assert ("rdf:type", "md:FullModel") in t and ("cim:Switch.normalOpen", "true") in t and ("rdf:type", "cim:Breaker") in t
    assert cli.main(["manifest", "--dir", str(tmp_path / "in"), "--output", str(tmp_path / "out"), "--access-url", "http://files"]) == 0
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("*.txt"))
    got = {(r[3].rsplit("/", 1)[-1], r[4]) for r in rdf.turtle(text.encode(), "m")}
    assert got == {("conformsTo", "http://p/EQ"), ("issued", "2031-01-01T00:00:00Z"), ("title", "a.xml"), ("dcat#accessURL", "http://files/a.xml")}
    (tmp_path / "in" / "a.xml").write_text("<broken")
    assert cli.main(["manifest", "--dir", str(tmp_path / "in"), "--output", str(tmp_path / "out")]) == 3


def test_options_and_imports(spark):
    rows = [
        ("f", "p", "rdf:type", "cims:ClassCategory"), ("f", "c", "rdf:type", "rdfs:Class"), ("f", "c", "cims:belongsToCategory", "p"), ("f", "c", "rdfs:subClassOf", "d"), ("f", "o", "rdf:type", "owl:Ontology"),
        ("f", "owl", "owl:imports", "x/g"), ("g", "q", "owl:imports", "f"), ("f", "q", "owl:imports", "lost.ttl"), ("f", "q", "owl:imports", "http://far/away"),
    ]
    t = spark.createDataFrame(rows, "graph string, s string, p string, o string")
    out = {(r.s, r.p, r.o) for r in C.convert(t, C.ConvertOptions(keep_headers=False, one_package="http://n#All", add_owl=True)).collect()}
    assert ("c", "cims:belongsToCategory", "http://n#All") in out and ("http://n#All", "rdfs:label", "All") in out and ("c", "rdf:type", "owl:Class") in out and not any(s in ("o", "p") for s, _, _ in out)
    assert {tuple(r) for r in C.convert(t, C.ConvertOptions(inheritance_list=True)).collect()} == {("d", "owl:members", "c")}
    assert {r.p for r in C.convert(t, C.ConvertOptions(inheritance_only=True)).collect()} == {"rdf:type", "rdfs:subClassOf"}
    assert {(r.root, r.graph) for r in C.with_imports(t).collect()} == {(a, b) for a in "fg" for b in "fg"}
    assert {r.o for r in C.missing_imports(t).collect()} == {"lost.ttl"}
