"""Operators on statement rows (graph, s, p, o, ...): patterns, set maintenance, names, closures.

A graph is a set: operators that add rows drop repeated ones. All are plain DataFrame plans."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import namespace
from ..sources.tables import cut

#: The predicates that carry inheritance.
INHERITANCE = ("rdf:type", "rdfs:subClassOf", "rdfs:subPropertyOf", "rdfs:domain", "rdfs:range")


def match(t: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    """Rows of a triple pattern; None is a wildcard. The filters reach the scan."""
    for name, value in (("s", s), ("p", p), ("o", o)):
        if value is not None:
            t = t.where(F.col(name) == value)
    return t


def of_type(t: DataFrame, cls: str) -> DataFrame:
    """Distinct subjects of a type."""
    return match(t, p="rdf:type", o=cls).select("s").distinct()


def having(t: DataFrame, p: str, o: str | None = None) -> DataFrame:
    """Rows of the subjects that have a statement with p (and o)."""
    return t.join(match(t, p=p, o=o).select("s").distinct(), "s", "left_semi")


def union(*graphs: DataFrame) -> DataFrame:
    out = graphs[0]
    for g in graphs[1:]:
        out = out.unionByName(g)
    return out.distinct()


def minus(t: DataFrame, gone: DataFrame, on: Iterable[str] = ("s", "p", "o")) -> DataFrame:
    on = list(on)
    return t.join(gone.select(*on).distinct(), on, "left_anti")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, s, p, o): distinct statements that only A or only B has, nulls being equal. One shuffle by
    subject and no join: Spark takes statements made of a table's columns for as small as that
    table, and would send all of one side to the driver for a broadcast."""
    side = lambda t, bit: t.select("s", "p", "o", F.lit(bit).alias("sides"))
    # all of a subject's rows lie together and compress well; aggregated before the shuffle they would not
    rows = side(a, 1).unionByName(side(b, 2)).repartition("s")
    found = rows.groupBy("s", "p", "o").agg(F.bit_or("sides").alias("sides")).where("sides <> 3")
    return found.select(F.when(F.col("sides") == 1, "A").otherwise("B").alias("side"), "s", "p", "o")


def inheritance_only(t: DataFrame) -> DataFrame:
    return t.where(F.col("p").isin(*INHERITANCE))


def strip_headers(t: DataFrame, header: str = "owl:Ontology", keep: str = "sh:declare") -> DataFrame:
    """Without the statements of header subjects, but for those that have a ``keep`` statement."""
    heads = of_type(t, header).join(match(t, p=keep).select("s").distinct(), "s", "left_anti")
    return t.join(heads, "s", "left_anti")


def delete_tagged(t: DataFrame, package: str, label: str, stereotype: str) -> DataFrame:
    """Without the resources of a package, of a label or of a stereotype, what has such a resource as
    domain, range or type, and their statements. All matches are on local names or texts."""
    local = F.regexp_extract("o", r"[^#/:]*$", 0)
    inside = t.where((F.col("p") == "cims:belongsToCategory") & (local == package)).select("s")
    named = t.where((F.col("p") == "rdfs:label") & (F.col("o") == label)).select("s")
    marked = t.where((F.col("p") == "cims:stereotype") & (F.col("o") == stereotype)).select("s")
    gone = inside.union(named).union(marked).distinct()
    hangs = t.where(F.col("p").isin("rdfs:domain", "rdfs:range", "rdf:type")).join(gone.withColumnRenamed("s", "o"), "o", "left_semi").select("s")
    return t.join(gone.union(hangs).distinct(), "s", "left_anti")


def resolve_conflicts(t: DataFrame, p: str, rank: Column) -> DataFrame:
    """Where a subject has several values of p, those of the first file (lowest rank) go."""
    w = Window.partitionBy("s")
    own = match(t, p=p).withColumn("__r", rank).groupBy("s", "o").agg(F.min("__r").alias("__r"))
    bad = own.withColumn("__n", F.count("*").over(w)).withColumn("__first", F.min("__r").over(w)).where("__n > 1 and __r = __first")
    return t.join(bad.select("s", "o", F.lit(p).alias("p")), ["s", "p", "o"], "left_anti")


def keep_largest_header(t: DataFrame, header: str = "owl:Ontology", by: Iterable[str] = ()) -> DataFrame:
    """The header subject with most statements (of equals the greatest id), for each ``by``."""
    by = list(by)
    counts = t.join(match(t, p="rdf:type", o=header).select(*by, "s").distinct(), [*by, "s"], "left_semi").groupBy(*by, "s").agg(F.count("*").alias("n"))
    if not by:
        return counts.agg(F.max_by("s", F.struct("n", "s")).alias("s"), F.max("n").alias("n"))
    return counts.groupBy(*by).agg(F.max_by("s", F.struct("n", "s")).alias("s"), F.max("n").alias("n"))


def used_prefixes(prefixes: DataFrame, t: DataFrame) -> DataFrame:
    """The prefixes whose namespace some s, p or o of the graph has. p and o may be short names."""
    names = t.select("graph", F.explode(F.array("s", "p", "o")).alias("x")).where("x is not null").select(
        "graph", F.when(F.col("x").rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), namespace(F.col("x"))).alias("ns"), F.when(F.col("x").rlike("^[A-Za-z0-9]*:[^/ ]"), F.substring_index("x", ":", 1)).alias("prefix")
    ).distinct()
    p = prefixes.distinct()
    by_ns = p.join(names.where("ns is not null").select("graph", "ns").distinct(), ["graph", "ns"], "left_semi")
    by_name = p.join(names.where("prefix is not null").select("graph", "prefix").distinct(), ["graph", "prefix"], "left_semi")
    return by_ns.unionByName(by_name).distinct().select("graph", "prefix", "ns")


def one_prefix(prefixes: DataFrame) -> DataFrame:
    """One prefix for each namespace: the smallest."""
    return prefixes.groupBy("ns").agg(F.min("prefix").alias("prefix"))


def retarget_packages(t: DataFrame, package: str) -> DataFrame:
    """All packages replaced by one: their statements go, every link to a package points to it."""
    packs = of_type(t, "cims:ClassCategory")
    rest = t.join(packs, "s", "left_anti").withColumn("o", F.when(F.col("p") == "cims:belongsToCategory", package).otherwise(F.col("o")))
    graphs = rest.select("graph").distinct()
    label = package.split("#")[-1].split("/")[-1]
    new = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(o).alias("o")) for p, o in (("rdf:type", "cims:ClassCategory"), ("rdfs:label", label), ("rdfs:comment", f"Package {label}"))])
    return rest.select("graph", "s", "p", "o").unionByName(graphs.select("graph", F.lit(package).alias("s"), F.inline(new))).distinct()


def owl_types(t: DataFrame) -> DataFrame:
    """(s, p, o): the OWL types that classes, properties and stereotyped subjects get."""
    typed = t.where("p = 'rdf:type'").select("s", F.when(F.col("o") == "rdfs:Class", "owl:Class").when(F.col("o") == "rdf:Property", "owl:ObjectProperty").alias("o"))
    kind = F.when(F.lower("o").contains("enum"), "owl:NamedIndividual").when(F.col("o").isin("CIMDatatype", "Primitive"), "owl:DatatypeProperty")
    marked = t.where("p = 'cims:stereotype'").select("s", kind.alias("o"))
    return typed.union(marked).where("o is not null").distinct().select("s", F.lit("rdf:type").alias("p"), "o")


def _pair(value: Column) -> Column:
    return F.concat_ws("=", "p", value)


def _signed(pairs: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.array_sort(pairs), ";"), F.lit("]"))


def signatures(t: DataFrame, nodes: DataFrame, levels: int | None = None) -> DataFrame:
    """(s, signature): what a node says, whatever its own name: its sorted p=o pairs, where an o that
    is such a node itself stands for its signature, however deep, or for a cycle mark if the way from s
    has been through it. Each round signs the nodes whose inner nodes are signed; what never gets
    so far reaches a cycle. ``levels``: nodes nested deeper than that are an error."""
    inner = nodes.select(F.col("s").alias("o"), F.lit(True).alias("inner")).where("o is not null").distinct()
    none = F.lit(None).cast("string")
    rows = t.join(nodes, "s", "left_semi").select("s", "p", "o").join(inner, "o", "left").select("s", "p", "o", "inner")
    rows = rows.unionByName(nodes.select("s", none.alias("p"), none.alias("o"), F.lit(None).cast("boolean").alias("inner")))
    plain = F.col("inner").isNull() & (F.col("p").isNotNull() | F.col("o").isNotNull())
    said = cut(rows.groupBy("s").agg(F.collect_set(F.when(plain, _pair(F.col("o")))).alias("pairs"), F.collect_set(F.when(F.col("inner"), F.struct("p", "o"))).alias("links")))
    done = said.where("size(links) = 0").select("s", _signed(F.col("pairs")).alias("signature"))
    todo = said.where("size(links) > 0")
    left, depth = todo.count(), 1
    while left:
        own = cut(_inner_signed(todo, done))
        new = own.where("size(open) = 0").select("s", _signed(F.col("pairs")).alias("signature"))
        done, todo = cut(done.unionByName(new)), cut(todo.join(new, "s", "left_anti"))
        before, left = left, todo.count()
        if left == before:
            return done.unionByName(_cyclic(own))
        depth += 1
        if levels is not None and depth > levels:
            raise ValueError(f"nodes are nested deeper than {levels} levels")
    return done


def _inner_signed(todo: DataFrame, done: DataFrame) -> DataFrame:
    """(s, pairs, open): with the pairs of the inner nodes that are signed; open: links to the others."""
    sig = done.select(F.col("s").alias("o"), F.sha2("signature", 256).alias("sig"))
    each = todo.select("s", "pairs", F.inline("links")).join(sig, "o", "left")
    known = F.when(F.col("sig").isNotNull(), _pair(F.col("sig")))
    g = each.groupBy("s").agg(F.first("pairs").alias("own"), F.collect_list(known).alias("more"), F.collect_list(F.when(F.col("sig").isNull(), F.struct("p", "o"))).alias("open"))
    return g.select("s", F.concat("own", "more").alias("pairs"), "open")


def _cyclic(own: DataFrame) -> DataFrame:
    """Signatures of the nodes that reach a cycle: all ways from each of them, until they come back to a
    node they have been through, signed from their ends. own: (s, pairs, open), each with open links."""
    edges = cut(own.select("s", F.inline("open")))
    ahead = F.concat("path", F.array("o"))
    hops, paths = [], own.select(F.array("s").alias("path"))
    while True:
        hop = paths.select("path", F.element_at("path", -1).alias("s")).join(edges, "s").select("path", "p", "o", F.array_contains("path", F.col("o")).alias("back"))
        hops.append(cut(hop))
        on = hops[-1].where("not back")
        if on.isEmpty():
            break
        paths = on.select(ahead.alias("path")).distinct()
    signed = None
    for hop in reversed(hops):
        sig = F.lit("_:cycle")
        if signed is not None:
            hop = hop.withColumn("ahead", ahead).join(signed.select(F.col("path").alias("ahead"), F.sha2("signature", 256).alias("sig")), "ahead", "left")
            sig = F.when(F.col("back"), "_:cycle").otherwise(F.col("sig"))
        g = hop.groupBy("path").agg(F.collect_list(_pair(sig)).alias("more")).withColumn("s", F.element_at("path", -1))
        signed = cut(g.join(own.select("s", "pairs"), "s").select("path", _signed(F.concat("pairs", "more")).alias("signature")))
    return signed.select(F.element_at("path", 1).alias("s"), "signature")


def repeated_nodes(t: DataFrame, nodes: DataFrame, levels: int | None = None) -> DataFrame:
    """(s, keep): nodes with the signature of a smaller node, which stays."""
    first = F.min("s").over(Window.partitionBy("signature"))
    return signatures(t, nodes, levels).withColumn("keep", first).where("s <> keep").select("s", "keep")


def rename_namespace(t: DataFrame, old: str, new: str, columns: Iterable[str] = ("s", "p", "o")) -> DataFrame:
    for c in columns:
        t = t.withColumn(c, F.when(F.startswith(F.col(c), F.lit(old)), F.concat(F.lit(new), F.substring(c, len(old) + 1, 1 << 30))).otherwise(F.col(c)))
    return t


def objects_of(t: DataFrame, p: str) -> DataFrame:
    return match(t, p=p).select("o").where("o is not null").distinct()


def compact(df: DataFrame, prefixes: DataFrame, column: str, graph: str = "graph") -> DataFrame:
    """``column`` as prefix:name where the graph has a prefix for the IRI's namespace (the smallest
    of several), else its local name; others stay."""
    table = prefixes.groupBy(F.col("graph").alias("__g"), F.col("ns").alias("__ns")).agg(F.min("prefix").alias("__p"))
    iri = F.col(column).rlike("^https?://")
    keyed = df.withColumn("__key", F.when(iri, namespace(F.col(column))).otherwise(F.concat(F.lit("\0"), F.pmod(F.hash(*df.columns), F.lit(997)))))
    local = F.expr(f"substring(`{column}`, length(__key) + 1)")
    out = keyed.join(table, (F.col("__key") == F.col("__ns")) & (F.col(graph) == F.col("__g")), "left")
    return out.withColumn(column, F.when(~iri, F.col(column)).when(F.col("__p").isNotNull(), F.concat("__p", F.lit(":"), local)).otherwise(local)).drop("__g", "__ns", "__p", "__key")


def wide_star(t: DataFrame, predicates: Mapping[str, str], separator: str = "; ") -> DataFrame:
    """One row for each subject with a column for each predicate: values sorted and joined. One
    aggregation instead of a join for each pattern of the star."""
    aggs = [F.array_join(F.array_sort(F.collect_set(F.when(F.col("p") == p, F.col("o")))), separator).alias(c) for p, c in predicates.items()]
    return t.where(F.col("p").isin(*predicates)).groupBy("s").agg(*aggs)


def closure(edges: DataFrame, child: str = "s", parent: str = "o", most: int = 64) -> DataFrame:
    """(child, ancestor): all pairs of the transitive closure, cycles or not. Each round joins the pairs that
    the round before found with all that are known, so their length doubles: log2(depth) rounds; a round
    that finds nothing new ends it."""
    e = edges.select(F.col(child).alias("child"), F.col(parent).alias("ancestor")).where("child is not null and ancestor is not null").distinct()
    known = new = cut(e)
    for _ in range(most):
        up = known.select(F.col("child").alias("c"), F.col("ancestor").alias("d"))
        step = new.join(up, F.col("ancestor") == F.col("c")).select("child", F.col("d").alias("ancestor")).distinct()
        new = cut(step.join(known, ["child", "ancestor"], "left_anti"))
        if new.isEmpty():
            break
        known = known.unionByName(new)
    return known


def inherited(properties: DataFrame, subclass: DataFrame) -> DataFrame:
    """(cls, property, declared_on): a class's own properties and those of its ancestors.
    properties: (property, domain), subclass: (s, o)."""
    up = closure(subclass)
    own = properties.select(F.col("domain").alias("cls"), "property", F.col("domain").alias("declared_on"))
    more = up.join(properties, F.col("ancestor") == F.col("domain")).select(F.col("child").alias("cls"), "property", F.col("domain").alias("declared_on"))
    return own.unionByName(more).distinct()
