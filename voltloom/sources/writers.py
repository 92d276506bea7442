"""Statement rows as text: Turtle, RDF/XML, property files and CSV. Each subject becomes one text row in
the JVM, sorted; the files are written by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def xml_text(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def turtle_text(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), c, F.lit('"'))


def turtle_rows(t: DataFrame) -> DataFrame:
    """(graph, s, text): the Turtle block of each subject with full IRIs. A subject's statements are
    what is gathered in one row."""
    ref = lambda c: F.when(c.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.concat(F.lit("<"), c, F.lit(">"))).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    tail = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), "o_lang")).when(F.col("o_dt").isNotNull(), F.concat(F.lit("^^"), ref(F.col("o_dt")))).otherwise(F.lit(""))
    o = F.when(F.col("o_kind") == "literal", F.concat(turtle_text(F.col("o")), tail)).when(F.col("o_kind") == "bnode", F.concat(F.lit("_:"), F.regexp_replace("o", "[^A-Za-z0-9]", "_"))).otherwise(ref(F.col("o")))
    s = F.when(F.col("s_kind") == "bnode", F.concat(F.lit("_:"), F.regexp_replace("s", "[^A-Za-z0-9]", "_"))).otherwise(ref(F.col("s")))
    line = F.concat(F.lit("    "), ref(F.col("p")), F.lit(" "), o)
    rows = t.where("s is not null and p is not null and o is not null").groupBy("graph", "s", s.alias("name")).agg(F.array_join(F.array_sort(F.collect_set(line)), " ;\n").alias("body"))
    return rows.select("graph", "s", F.concat("name", F.lit("\n"), "body", F.lit(" .")).alias("text"))


def rdf_xml_rows(t: DataFrame, about: list[str] | None = None) -> DataFrame:
    """(graph, sort_key, s, text): the RDF/XML element of each subject. t has short names (prefix:name)
    as p and as types. Types in ``about`` (all if None) are named by rdf:about, others by rdf:ID; typed
    subjects come by type, then by name; those without type are last."""
    types = t.where("p = 'rdf:type'").groupBy("graph", "s").agg(F.min("o").alias("cls"))
    value = F.when(F.col("o_kind") == "literal", F.concat(F.lit("    <"), "p", F.when(F.col("o_lang").isNotNull(), F.concat(F.lit(' xml:lang="'), "o_lang", F.lit('"'))).otherwise(F.lit("")), F.lit(">"), xml_text(F.col("o")), F.lit("</"), "p", F.lit(">")))
    value = value.otherwise(F.concat(F.lit("    <"), "p", F.lit(' rdf:resource="'), xml_text(F.col("o")), F.lit('"/>')))
    body = t.where("p <> 'rdf:type' and o is not null and s is not null").groupBy("graph", "s").agg(F.array_join(F.array_sort(F.collect_set(value)), "\n").alias("body"))
    j = body.join(types, ["graph", "s"], "full")
    cls = F.coalesce("cls", F.lit("rdf:Description"))
    by_id = F.lit(False) if about is None else ~cls.isin("rdf:Description", *about)
    name = F.when(by_id, F.concat(F.lit('rdf:ID="'), F.regexp_replace("s", "^.*#|^urn:uuid:", ""), F.lit('"'))).otherwise(F.concat(F.lit('rdf:about="'), xml_text(F.col("s")), F.lit('"')))
    text = F.concat(F.lit("  <"), cls, F.lit(" "), name, F.lit(">\n"), F.coalesce(F.concat("body", F.lit("\n")), F.lit("")), F.lit("  </"), cls, F.lit(">"))
    return j.select("graph", F.coalesce("cls", F.lit("zzzzzzzzzz")).alias("sort_key"), "s", text.alias("text"))


def write_documents(rows: DataFrame, path: str, header: str = "", footer: str = "", by: tuple[str, ...] = ("sort_key", "s")) -> None:
    """One directory of text parts for each graph, in order: header, subjects, footer."""
    own = [c for c in by if c in rows.columns]
    ends = rows.select("graph").distinct().select("graph", F.explode(F.array(F.struct(F.lit(0).alias("at"), F.lit(header).alias("text")), F.struct(F.lit(2).alias("at"), F.lit(footer).alias("text")))).alias("e"))
    blank = [F.lit("").alias(c) for c in own]
    every = rows.select("graph", F.lit(1).alias("at"), *own, "text").unionByName(ends.select("graph", "e.at", *blank, "e.text").where("text <> ''"))
    every.repartition("graph").sortWithinPartitions("graph", "at", *own).select("graph", "text").write.mode("overwrite").partitionBy("graph").text(path)


def properties(datatypes: DataFrame) -> DataFrame:
    """(value): the lines ``p=Datatype[dt]`` of a datatype map, sorted."""
    return datatypes.select(F.concat("p", F.lit("=Datatype["), "dt", F.lit("]")).alias("value")).distinct().orderBy("value")
