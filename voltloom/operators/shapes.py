"""Shapes graphs and mappings as tables: inventories, overrides, splits, tests and run plans."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.files import has_token, report_time, time_source
from .graph import closure


def inventory(t: DataFrame) -> DataFrame:
    """(shape, name, grp, kind, severity, message): each property or SPARQL shape of a shapes graph; a
    SPARQL shape has its message where its constraint has it."""
    one = lambda p: F.min(F.when(F.col("p") == p, F.col("o")))
    g = t.groupBy("s").agg(one("sh:name").alias("name"), one("sh:group").alias("grp"), one("sh:severity").alias("severity"), one("sh:message").alias("message"), one("sh:sparql").alias("sparql"), F.max(F.when(F.col("p").isin("sh:path", "sh:sparql"), 1)).alias("is_shape"))
    inner = t.where("p = 'sh:message'").groupBy(F.col("s").alias("sparql")).agg(F.min("o").alias("inner_message"))
    j = g.where("is_shape = 1").join(inner, "sparql", "left")
    kind = F.when(F.col("sparql").isNotNull(), "SPARQL").otherwise("Regular")
    return j.select(F.col("s").alias("shape"), "name", "grp", kind.alias("kind"), F.coalesce("severity", F.lit("sh:Violation")).alias("severity"), F.coalesce("message", "inner_message").alias("message"))


def override(t: DataFrame, rows: DataFrame) -> DataFrame:
    """Statements with values replaced by rows (n, grp, name, property, value): of the shapes whose
    sh:name is the name and whose sh:group contains grp; of several rows the last (greatest n) wins."""
    named = t.where("p = 'sh:name'").select("s", F.col("o").alias("name")).distinct()
    grouped = t.where("p = 'sh:group'").groupBy("s").agg(F.min("o").alias("of"))
    hits = named.join(rows, "name").join(grouped, "s", "left").where(F.coalesce(F.contains("of", "grp"), F.col("grp") == ""))
    best = hits.groupBy("s", F.col("property").alias("p")).agg(F.max_by("value", "n").alias("value"))
    kept = t.join(best, ["s", "p"], "left_anti").select("s", "p", "o")
    return kept.unionByName(best.select("s", "p", F.col("value").alias("o"))).distinct()


def reachable(t: DataFrame, seeds: DataFrame) -> DataFrame:
    """The statements of the seeds (s) and of all that they lead to through blank nodes and lists."""
    edges = t.where("o_kind = 'bnode'").select("s", "o").distinct()
    far = closure(edges).join(seeds.withColumnRenamed("s", "child"), "child", "left_semi").select(F.col("ancestor").alias("s"))
    return t.join(seeds.union(far).distinct(), "s", "left_semi")


def split_off(t: DataFrame, suffix: str) -> tuple[DataFrame, DataFrame]:
    """(without, with) the shapes whose names end so; links to the moved shapes and what is left of node
    shapes go with them."""
    moved = t.select("s").distinct().where(F.col("s").endswith(suffix))
    links = t.join(moved.withColumnRenamed("s", "o"), "o", "left_semi").select("s", "p", "o").distinct()
    owners = links.select("s").distinct()
    rest = t.join(moved, "s", "left_anti").join(links, ["s", "p", "o"], "left_anti")
    heads = t.join(owners, "s", "left_semi").where("p in ('rdf:type', 'sh:targetClass')")
    return rest, t.join(moved, "s", "left_semi").unionByName(heads).unionByName(links.join(t, ["s", "p", "o"]).select(*t.columns)).distinct()


def without_isolated(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes (s) that are a child or a parent in some link."""
    used = edges.select("s").union(edges.select(F.col("o").alias("s"))).distinct()
    return nodes.join(used, "s", "left_semi")


def expand_inputs(mapping: DataFrame, column: str = "xml_inputs") -> DataFrame:
    """(row, token, zipped) of mapping rows (row, xml_inputs): tokens by semicolon."""
    t = F.explode(F.transform(F.split(column, ";"), lambda x: F.trim(x)))
    return mapping.select("row", t.alias("token")).where("token <> ''").select("row", F.regexp_replace("token", "^(?i)ZIP:", "").alias("token"), F.upper("token").startswith("ZIP:").alias("zipped"))


def resolve_inputs(tokens: DataFrame, files: DataFrame, profiles: Mapping[str, str]) -> DataFrame:
    """(row, token, grp, at, file): the files of each token in each group and instant. A bare profile
    takes that profile's files; a name with wildcards those that it matches. profiles: profile -> class;
    static and boundary ones take all files of the group, timestamped ones the instant's.

    Tokens meet files by profile in an equi-join; only wildcards are then tested on those pairs."""
    by = F.create_map(*[x for k, v in profiles.items() for x in (F.lit(k), F.lit(v))])
    names = sorted(profiles, key=lambda p: (-len(p), p))
    found = F.array_compact(F.array(*[F.when(has_token(F.col("token"), p), F.lit(p)) for p in names]))
    t = tokens.withColumn("profile", F.explode(found))
    bare = F.col("token") == F.col("profile")
    like = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace("token", r"([.+()\[\]{}^$|\\])", r"\\$1"), r"\*", ".*"), F.lit("$"))
    j = t.join(files, "profile").where(bare | F.regexp_like("file", like))
    instants = files.where(F.element_at(by, F.col("profile")) == "timestamped").select("grp", "at").distinct()
    timed = j.where(F.element_at(by, F.col("profile")) == "timestamped").select("row", "token", "grp", "at", "file")
    fixed = j.where(F.element_at(by, F.col("profile")) != "timestamped").select("row", "token", "grp", "file").join(instants, "grp").select("row", "token", "grp", "at", "file")
    return timed.unionByName(fixed).distinct()


def category(constraints: Column, inputs: Column) -> Column:
    """What kind of run a mapping row is, by its constraint file and its inputs. Names are fixed values."""
    ttl, xml = F.trim(F.coalesce(constraints, F.lit(""))), F.replace(F.coalesce(inputs, F.lit("")), F.lit("\\"), F.lit("/"))
    cgmes, has = ttl.startswith("CGMES_"), lambda x: xml.contains(x)
    boundary = has("Grid_CommonData_CGM-CD.xml") & has("EQ")
    return (
        F.when(ttl.startswith("NCP_v2-4-0/NC-v2-4-0_AP-Con-Complex-Common-SHACL.ttl"), "DANGLINGREFERENCE")
        .when(ttl.startswith("NC_"), "NC_SINGLE")
        .when(cgmes & boundary & has("Britheim") & has("Svedala"), "CGMES_CGM")
        .when(cgmes & boundary & has("SSH") & has("TP") & has("SV"), "CGMES_IGM_COMPLETE")
        .when(cgmes, "CGMES_SINGLE_PROFILE")
        .otherwise("UNKNOWN")
    )


def time_sources(files: DataFrame) -> DataFrame:
    """files (grp, path, header, named: timestamps) with their ``source`` and the ``time`` that they are
    filed under. A name's time is mapped by the headers of its group: of several that go with one name's
    time, that of the smallest path counts."""
    named, header = F.col("named"), F.col("header")
    pairs = files.where("header is not null and named is not null").groupBy("grp", "named").agg(F.min_by("header", "path").alias("mapped"))
    headers = files.where("header is not null").select("grp", F.col("header").alias("named"), F.lit(True).alias("same")).distinct()
    j = files.join(headers, ["grp", "named"], "left").join(pairs, ["grp", "named"], "left")
    half = F.coalesce("same", F.lit(False)) & (F.minute(named) == 30) & (F.second(named) == 0)
    source = time_source(header, named, half, F.col("mapped").isNotNull())
    time = F.coalesce(header, F.when(half, named), F.col("mapped"), named)
    return j.select(*files.columns, source.alias("source"), report_time(time).alias("time"))


def capped(results: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """At most so many results for each ``by``, in order: a report's limit."""
    w = Window.partitionBy(*by).orderBy(*order)
    return results.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")
