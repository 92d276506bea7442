"""Readers of RDF files: RDF/XML, Turtle, N-Triples and JSON-LD, plain or in nested zip archives.

Files are listed and read by Spark (``binaryFile``), parsed in the tasks, one file at a time, into
statement rows. Blank nodes get the file's name, so that those of two files never meet."""

from __future__ import annotations

import io
import json
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XML = "http://www.w3.org/XML/1998/namespace"
XSD = "http://www.w3.org/2001/XMLSchema#"
SCHEMA = "graph string, s string, s_kind string, p string, o string, o_kind string, o_dt string, o_lang string"
#: The prefixes of the standard namespaces; the model namespace is any of a version.
NAMESPACES = {
    RDF: "rdf", "http://www.w3.org/2000/01/rdf-schema#": "rdfs", "http://www.w3.org/2002/07/owl#": "owl", XSD: "xsd", "http://www.w3.org/ns/shacl#": "sh", "http://www.w3.org/ns/dcat#": "dcat",
    "http://purl.org/dc/terms/": "dcterms", "http://www.w3.org/2004/02/skos/core#": "skos", "http://iec.ch/TC57/61970-552/ModelDescription/1#": "md", "http://iec.ch/TC57/61970-552/DifferenceModel/1#": "dm",
    "http://iec.ch/TC57/1999/rdf-schema-extensions-19990926#": "cims",
}
#: Namespaces of all versions of the model.
CIM = re.compile("^http://iec.ch/TC57/(20[0-9]{2}/CIM-schema-cim1[0-9]|CIM100|CIM100-.*)#$")
#: Archives within archives are opened down to this depth.
MOST_NESTED = 5
Row = tuple


def _join(base: str, ref: str) -> str:
    if re.match(r"^[A-Za-z][A-Za-z0-9+.-]*:", ref):
        return ref
    if ref.startswith("#") or not ref:
        return base.split("#")[0] + ref
    return base.rsplit("/", 1)[0] + "/" + ref if "/" in base else ref


def rdf_xml(data: bytes, graph: str, base: str = "") -> Iterator[Row]:
    """Statements of an RDF/XML document: typed nodes, rdf:ID / about / nodeID / resource, property
    attributes, nested nodes, and the parse types Resource, Literal and Collection."""
    made = iter(range(1 << 62))
    new = lambda: f"{graph}#b{next(made)}"
    q = lambda n: f"{{{RDF}}}{n}"
    iri = lambda tag: tag[1:].replace("}", "", 1) if tag[0] == "{" else tag

    def name(e, base):
        if (v := e.get(q("about"))) is not None:
            return _join(base, v), "iri"
        if (v := e.get(q("ID"))) is not None:
            return _join(base, "#" + v), "iri"
        if (v := e.get(q("nodeID"))) is not None:
            return f"{graph}#n{v}", "bnode"
        return new(), "bnode"

    def node(e, base, lang):
        base, lang = e.get(f"{{{XML}}}base", base), e.get(f"{{{XML}}}lang", lang)
        s, kind = name(e, base)
        if e.tag != q("Description"):
            yield graph, s, kind, RDF + "type", iri(e.tag), "iri", None, None
        for k, v in e.attrib.items():
            if k == q("type"):
                yield graph, s, kind, RDF + "type", _join(base, v), "iri", None, None
            elif not k.startswith((f"{{{RDF}}}", f"{{{XML}}}")) and k[0] == "{":
                yield graph, s, kind, iri(k), v, "literal", None, lang
        n = 0
        for p in e:
            pred = iri(p.tag)
            if pred == RDF + "li":
                n += 1
                pred = f"{RDF}_{n}"
            yield from prop(s, kind, pred, p, base, p.get(f"{{{XML}}}lang", lang))

    def prop(s, kind, pred, p, base, lang):
        mode, children = p.get(q("parseType")), list(p)
        if (r := p.get(q("resource"))) is not None:
            yield graph, s, kind, pred, _join(base, r), "iri", None, None
        elif (r := p.get(q("nodeID"))) is not None:
            yield graph, s, kind, pred, f"{graph}#n{r}", "bnode", None, None
        elif mode == "Resource":
            b = new()
            yield graph, s, kind, pred, b, "bnode", None, None
            for c in children:
                yield from prop(b, "bnode", iri(c.tag), c, base, c.get(f"{{{XML}}}lang", lang))
        elif mode == "Collection":
            cells = [new() for _ in children]
            for at, (c, cell) in enumerate(zip(children, cells)):
                o, o_kind = name(c, base)
                if o_kind == "bnode":
                    c.set(q("nodeID"), o.split("#", 1)[1])
                    o = f"{graph}#n{o.split('#', 1)[1]}"
                yield from node(c, base, lang)
                yield graph, cell, "bnode", RDF + "first", o, o_kind, None, None
                rest = cells[at + 1] if at + 1 < len(cells) else RDF + "nil"
                yield graph, cell, "bnode", RDF + "rest", rest, "bnode" if at + 1 < len(cells) else "iri", None, None
            yield graph, s, kind, pred, cells[0] if cells else RDF + "nil", "bnode" if cells else "iri", None, None
        elif mode == "Literal":
            inner = (p.text or "") + "".join(ET.tostring(c, encoding="unicode") for c in children)
            yield graph, s, kind, pred, inner, "literal", RDF + "XMLLiteral", None
        elif children:
            o, o_kind = name(children[0], base)
            if o_kind == "bnode" and children[0].get(q("nodeID")) is None:
                children[0].set(q("nodeID"), o.split("#", 1)[1])
                o = f"{graph}#n{o.split('#', 1)[1]}"
            yield graph, s, kind, pred, o, o_kind, None, None
            yield from node(children[0], base, lang)
        else:
            dt = p.get(q("datatype"))
            yield graph, s, kind, pred, p.text or "", "literal", dt, None if dt else lang

    root = ET.fromstring(data)
    base = root.get(f"{{{XML}}}base", base)
    for e in root if root.tag == q("RDF") else [root]:
        yield from node(e, base, root.get(f"{{{XML}}}lang"))


_TOKEN = re.compile(
    r"""\s+|\#[^\n]*|(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<str>"{3}(?:[^"\\]|\\.|"(?!""))*"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*'{3}|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')"""
    r"""|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<dt>\^\^)|(?P<num>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))(?![\w:])|(?P<bn>_:[\w.-]*\w)"""
    r"""|(?P<name>(?:[A-Za-z][\w.-]*)?:(?:[\w:%\\~!$&'()*+,;=/?#@-]|\.(?=[\w:%-]))*)|(?P<word>[A-Za-z]+)|(?P<mark>[;,.\[\]()])""",
    re.S,
)


def _unescape(t: str) -> str:
    t = t[3:-3] if t[:3] in ('"""', "'''") else t[1:-1]
    plain = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else plain.get(m[1], m[1]), t, flags=re.S)


def turtle(data: bytes, graph: str, base: str = "") -> Iterator[Row]:
    """Statements of a Turtle (or N-Triples) document."""
    text, at = data.decode("utf-8-sig"), 0
    tokens: list[tuple[str, str]] = []
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"{graph}: no Turtle at {text[at : at + 40]!r}")
        at = m.end()
        if m.lastgroup:
            tokens.append((m.lastgroup, m[m.lastgroup]))
    tokens.append(("end", ""))
    prefixes: dict[str, str] = {}
    out: list[Row] = []
    pos, made = 0, iter(range(1 << 62))
    new = lambda: (f"{graph}#b{next(made)}", "bnode", None, None)

    def take(kind=None, value=None):
        nonlocal pos
        t = tokens[pos]
        if (kind and t[0] != kind) or (value and t[1] != value):
            raise ValueError(f"{graph}: {value or kind} expected, found {t[1]!r}")
        pos += 1
        return t[1]

    def named(t: str) -> str:
        prefix, _, local = t.partition(":")
        if prefix not in prefixes:
            raise ValueError(f"{graph}: unknown prefix {prefix!r}")
        return prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)

    def term():
        kind, t = tokens[pos]
        if kind == "iri":
            take()
            return _join(base, t[1:-1]), "iri", None, None
        if kind == "name":
            take()
            return named(t), "iri", None, None
        if kind == "bn":
            take()
            return f"{graph}#n{t[2:]}", "bnode", None, None
        if kind == "num":
            take()
            return t, "literal", XSD + ("double" if "e" in t.lower() else "decimal" if "." in t else "integer"), None
        if kind == "word" and t in ("true", "false"):
            take()
            return t, "literal", XSD + "boolean", None
        if kind == "str":
            take()
            dt = lang = None
            if tokens[pos][0] == "lang":
                lang = take()[1:]
            elif tokens[pos][0] == "dt":
                take()
                dt = term()[0]
            return _unescape(t), "literal", dt, lang
        if t == "[":
            take()
            b = new()
            if tokens[pos][1] != "]":
                pairs(b)
            take("mark", "]")
            return b
        if t == "(":
            take()
            items = []
            while tokens[pos] != ("mark", ")"):
                items.append(term())
            take()
            cells = [new() for _ in items] + [(RDF + "nil", "iri", None, None)]
            for cell, item, rest in zip(cells, items, cells[1:]):
                add(cell, RDF + "first", item)
                add(cell, RDF + "rest", rest)
            return cells[0]
        raise ValueError(f"{graph}: a term expected, found {t!r}")

    def add(s, p, o):
        out.append((graph, s[0], s[1], p, *o))

    def pairs(s):
        while True:
            if tokens[pos] == ("word", "a"):
                take()
                p = RDF + "type"
            else:
                p = term()[0]
            add(s, p, term())
            while tokens[pos][1] == "," and tokens[pos][0] == "mark":
                take()
                add(s, p, term())
            while tokens[pos] == ("mark", ";"):
                take()
                if tokens[pos][0] == "mark" and tokens[pos][1] in ".];":
                    continue
                break
            else:
                return
            if tokens[pos][0] == "mark" and tokens[pos][1] in ".]":
                return

    while tokens[pos][0] != "end":
        kind, t = tokens[pos]
        if (kind == "lang" and t in ("@prefix", "@base")) or (kind == "word" and t.upper() in ("PREFIX", "BASE")):
            take()
            if t.lower().endswith("prefix"):
                label = take("name")
                prefixes[label[:-1]] = _join(base, take("iri")[1:-1])
            else:
                base = _join(base, take("iri")[1:-1])
            if kind == "lang":
                take("mark", ".")
            continue
        s = term()
        if not (s[1] == "bnode" and tokens[pos] == ("mark", ".")):
            pairs(s)
        take("mark", ".")
    yield from out


def json_ld(data: bytes, graph: str, base: str = "") -> Iterator[Row]:
    """Statements of a JSON-LD document whose context maps prefixes and terms to IRIs."""
    made = iter(range(1 << 62))

    def context(c, old):
        out = dict(old)
        for x in c if isinstance(c, list) else [c]:
            if isinstance(x, dict):
                out.update({k: v if isinstance(v, str) else v.get("@id", k) for k, v in x.items() if isinstance(v, (str, dict))})
                out.update({f"type of {k}": v["@type"] for k, v in x.items() if isinstance(v, dict) and "@type" in v})
        return out

    def expand(t, c):
        if t in c and not t.startswith("@"):
            return expand(c[t], {k: v for k, v in c.items() if k != t})
        prefix, colon, local = t.partition(":")
        if colon and prefix in c and not local.startswith("//"):
            return expand(c[prefix], {k: v for k, v in c.items() if k != prefix}) + local
        return c["@vocab"] + t if not colon and "@vocab" in c and not t.startswith(("@", "#")) else t

    def node(d, c):
        c = context(d["@context"], c) if "@context" in d else c
        i = d.get("@id")
        s, kind = (f"{graph}#b{next(made)}", "bnode") if i is None else (f"{graph}#n{i[2:]}", "bnode") if i.startswith("_:") else (_join(base, expand(i, {k: v for k, v in c.items() if k != "@vocab"})), "iri")
        rows = []
        for k, v in d.items():
            if k in ("@id", "@context", "@graph"):
                continue
            for x in v if isinstance(v, list) else [v]:
                p = RDF + "type" if k == "@type" else expand(k, c)
                if k == "@type":
                    rows.append((graph, s, kind, p, expand(x, c), "iri", None, None))
                elif isinstance(x, dict) and "@value" in x:
                    rows.append((graph, s, kind, p, str(x["@value"]), "literal", expand(x["@type"], c) if "@type" in x else None, x.get("@language")))
                elif isinstance(x, dict):
                    o, o_kind, more = node(x, c)
                    rows.append((graph, s, kind, p, o, o_kind, None, None))
                    rows += more
                elif c.get(f"type of {k}") == "@id":
                    rows.append((graph, s, kind, p, _join(base, expand(x, c)), "iri", None, None))
                elif x is not None:
                    dt = XSD + "boolean" if isinstance(x, bool) else XSD + "integer" if isinstance(x, int) else XSD + "double" if isinstance(x, float) else None
                    named = c.get(f"type of {k}")
                    rows.append((graph, s, kind, p, str(x).lower() if isinstance(x, bool) else str(x), "literal", expand(named, c) if named else dt, None))
        return s, kind, rows

    doc = json.loads(data)
    tops = doc if isinstance(doc, list) else [doc]
    for d in tops:
        c = context(d.get("@context", {}), {})
        yield from node({k: v for k, v in d.items() if k != "@graph"}, c)[2] if set(d) - {"@context", "@graph"} else []
        for x in d.get("@graph", []):
            yield from node(x, c)[2]


PARSERS = {"rdf": rdf_xml, "xml": rdf_xml, "owl": rdf_xml, "ttl": turtle, "nt": turtle, "jsonld": json_ld}


def members(name: str, data: bytes, depth: int = 0) -> Iterator[tuple[str, bytes]]:
    """The files of an archive, those of archives within it too; a plain file is its own member.
    Names that lead out of the archive are refused."""
    if not name.lower().endswith(".zip"):
        yield name, data
        return
    if depth >= MOST_NESTED:
        raise ValueError(f"{name}: archives nested too deep")
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for entry in z.infolist():
            path = posixpath.normpath(entry.filename.replace("\\", "/"))
            if path.startswith(("/", "..")) or re.match(r"^[A-Za-z]:", path):
                raise ValueError(f"{name}: {entry.filename!r} leads out of the archive")
            if not entry.is_dir():
                yield from members(posixpath.basename(path), z.read(entry), depth + 1)


def read(spark: SparkSession, path: str, base: str = "http://iec.example/model", glob: str | None = None) -> DataFrame:
    """Statement rows of all files under a path; ``graph`` is the file's name. Files of other kinds
    are left out; a file that can't be parsed ends the read with its name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        files = files.option("pathGlobFilter", glob)
    fields = [f.name for f in spark.createDataFrame([], SCHEMA).schema]

    def parse(batches):
        for b in batches:
            for where, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for name, content in members(where.rsplit("/", 1)[-1], data):
                    parser = PARSERS.get(name.rsplit(".", 1)[-1].lower())
                    if not parser:
                        continue
                    try:
                        rows = list(parser(content, name, base))
                    except (ET.ParseError, ValueError, UnicodeDecodeError) as e:
                        raise ValueError(f"{where}: {name}: {e}") from e
                    for i in range(0, len(rows), 10_000):
                        cols = list(zip(*rows[i : i + 10_000]))
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=fields)

    return files.load(path).select("path", "content").mapInArrow(parse, SCHEMA)


def short_names(t: DataFrame, more: dict[str, str] | None = None) -> DataFrame:
    """Predicates, types and datatypes as prefix:name where their namespace is a known one."""
    known = NAMESPACES | (more or {})
    prefix = F.create_map(*[x for ns, p in known.items() for x in (F.lit(ns), F.lit(p))])

    def short(c: str) -> Column:
        ns = F.regexp_extract(c, r"^(.*[#/])", 1)
        name = F.coalesce(F.element_at(prefix, ns), F.when(ns.rlike(CIM.pattern), "cim"))
        return F.coalesce(F.concat(name, F.lit(":"), F.expr(f"substring({c}, length(regexp_extract({c}, '^(.*[#/])', 1)) + 1)")), F.col(c))

    return t.withColumns({"p": short("p"), "o": F.when(F.col("p") == RDF + "type", short("o")).otherwise(F.col("o")), "o_dt": short("o_dt")})


def assign_datatypes(t: DataFrame, datatypes: DataFrame) -> DataFrame:
    """Literals without a language get their predicate's declared datatype, else xsd:string."""
    m = datatypes.groupBy(F.col("p").alias("__p")).agg(F.min("dt").alias("__dt"))
    keep = (F.col("o_kind") != "literal") | F.col("o_lang").isNotNull()
    return t.join(m, F.col("p") == F.col("__p"), "left").withColumn("o_dt", F.when(keep, F.col("o_dt")).otherwise(F.coalesce("__dt", F.lit("xsd:string")))).drop("__p", "__dt")


#: The datatypes of XML Schema and RDF that a line may declare.
DATATYPES = (
    "string", "boolean", "decimal", "integer", "double", "float", "date", "time", "dateTime", "dateTimeStamp",
    "gYear", "gMonth", "gDay", "gYearMonth", "gMonthDay", "duration", "yearMonthDuration", "dayTimeDuration",
    "byte", "short", "int", "long", "unsignedByte", "unsignedShort", "unsignedInt", "unsignedLong",
    "positiveInteger", "nonNegativeInteger", "negativeInteger", "nonPositiveInteger", "hexBinary", "base64Binary",
    "anyURI", "language", "normalizedString", "token", "NMTOKEN", "Name", "NCName", "QName", "NOTATION", "ID", "IDREF", "ENTITY",
)
RDF_DATATYPES = ("langString", "XMLLiteral", "HTML", "JSON")


def datatype_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """(p, dt) of lines ``IRI=Datatype[xsd -> class]``; others, and those with an unknown datatype, are left out."""
    v = F.col(column)
    xsd, rdf = ("xsd:", "http://www.w3.org/2001/XMLSchema#"), ("rdf:", "http://www.w3.org/1999/02/22-rdf-syntax-ns#")
    known = F.col("dt").isin([a + x for a in xsd for x in DATATYPES] + [a + x for a in rdf for x in RDF_DATATYPES])
    return lines.select(F.trim(F.substring_index(v, "=", 1)).alias("p"), F.trim(F.regexp_extract(v, r"=[^\[]*\[([^\]>]*?)(?:\s*->.*)?\]", 1)).alias("dt")).where(~v.startswith("#") & known)


def mapping_rows(lines: DataFrame, column: str = "value") -> DataFrame:
    """(xml_inputs, ttl, notes) of mapping lines; blank lines, comments and the header are left out."""
    v = F.regexp_replace(F.col(column), "^﻿", "")
    f = F.from_csv(v, F.lit("xml_inputs string, ttl string, notes string"), {"escape": '"', "quote": '"'})
    kept = lines.where((F.trim(v) != "") & ~v.startswith("#") & ~F.lower(v).startswith("xml_inputs"))
    return kept.select(f.alias("f")).select("f.*").where("ttl is not null")


def header_time(text: Column) -> Column:
    """The first time in a document, wherever its header lies: scenario time, else start date, else any
    date but an end."""
    pick = lambda tag: F.nullif(F.regexp_extract(text, rf"(?s)<[^<>]*{tag}[^<>]*>\s*([^<\s]+)", 1), F.lit(""))
    return F.coalesce(pick("[sS]cenarioTime"), pick("[sS]tartDate"), pick(r"(?<![eE]nd)[dD]ate"))
