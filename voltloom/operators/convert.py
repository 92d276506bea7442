"""Conversion of vocabularies by options, and graphs with what they import."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph as G


@dataclass(frozen=True)
class ConvertOptions:
    """What happens to a vocabulary on its way: in the order of the fields."""

    union: list[DataFrame] = field(default_factory=list)
    #: Files of a detailed union: resources with this (package, label, stereotype) are not taken.
    excluded: tuple[str, str, str] | None = None
    keep_headers: bool = True
    one_package: str | None = None
    add_owl: bool = False
    inheritance_only: bool = False
    inheritance_list: bool = False
    only_concrete: bool = False
    resolve_multiplicity: bool = False


def convert(t: DataFrame, options: ConvertOptions) -> DataFrame:
    """The rows (graph, s, p, o) after the options; with inheritance_list the rows (class, owl:members,
    subclass) instead."""
    t = t.select("graph", "s", "p", "o")
    if options.union:
        t = G.union(t, *[u.select("graph", "s", "p", "o") for u in options.union])
    if options.excluded:
        t = G.delete_tagged(t, *options.excluded)
    if options.resolve_multiplicity:
        t = G.resolve_conflicts(t, "cims:multiplicity", F.col("graph"))
    if not options.keep_headers:
        t = G.strip_headers(t)
    if options.one_package:
        t = G.retarget_packages(t, options.one_package)
    if options.add_owl:
        owl = G.owl_types(t).join(t.select("s", "graph").distinct(), "s").select("graph", "s", "p", "o")
        t = G.union(t, owl)
    if options.inheritance_list:
        up = G.closure(t.where("p = 'rdfs:subClassOf'"))
        if options.only_concrete:
            concrete = t.where((F.col("p") == "cims:stereotype") & F.col("o").endswith("#concrete")).select(F.col("s").alias("child")).distinct()
            up = up.join(concrete, "child", "left_semi")
        return up.select(F.col("ancestor").alias("s"), F.lit("owl:members").alias("p"), F.col("child").alias("o"))
    return G.inheritance_only(t) if options.inheritance_only else t


def with_imports(t: DataFrame) -> DataFrame:
    """(root, graph, s, p, o): each graph with all that it imports, directly or not. An import names a
    file by its last part; imports of http, https and urn names that are no file here are left out."""
    name = F.regexp_extract("o", "[^/#]*$", 0)
    graphs = t.select("graph").distinct()
    edges = t.where("p = 'owl:imports' and o is not null").select(F.col("graph").alias("s"), name.alias("o")).join(graphs.withColumnRenamed("graph", "o"), "o", "left_semi")
    reach = G.closure(edges.select("s", "o")).select(F.col("child").alias("root"), F.col("ancestor").alias("graph"))
    reach = reach.unionByName(graphs.select(F.col("graph").alias("root"), "graph")).distinct()
    return reach.join(t, "graph").select("root", "graph", "s", "p", "o")


def missing_imports(t: DataFrame) -> DataFrame:
    """(graph, o): imports of local files that aren't here."""
    graphs = t.select(F.col("graph").alias("name")).distinct()
    wanted = t.where("p = 'owl:imports' and o is not null").where(~F.col("o").rlike("^(https?|urn):")).select("graph", "o", F.regexp_extract("o", "[^/#]*$", 0).alias("name")).distinct()
    return wanted.join(graphs, "name", "left_anti").select("graph", "o")
