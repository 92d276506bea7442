"""Manipulation of models: new ids, copies, headers, removal and injection of properties, synthetic data.
Nothing is random without a seed, so lost tasks give the same rows again."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def new_id(old: Column, salt: str) -> Column:
    """A uuid object made of the old id and a salt."""
    h = F.md5(F.concat(F.lit(salt + "|"), old).cast("binary"))
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)))


def regenerate_ids(t: DataFrame, salt: str = "", names: tuple[str, ...] = ("cim:IdentifiedObject.mRID",)) -> DataFrame:
    """New ids for all uuid objects, as subjects and as objects; ids written as text (mRID) too. The
    new id is a function of the old one: no map is built or joined."""
    is_id = lambda c: F.col(c).startswith("urn:uuid:")
    s = F.when(is_id("s"), new_id(F.col("s"), salt)).otherwise(F.col("s"))
    text = F.substring(new_id(F.concat(F.lit("urn:uuid:"), F.col("o")), salt), 10, 36)
    o = F.when(F.col("p").isin(*names) & ~is_id("o"), text).when(is_id("o"), new_id(F.col("o"), salt)).otherwise(F.col("o"))
    return t.withColumn("o", o).withColumn("s", s)


def mrid_from_id(t: DataFrame, classes: list[str]) -> DataFrame:
    """(s, p, o) of mRIDs: each object of the classes gets its id without its mark."""
    typed = t.where(F.col("p") == "rdf:type").where(F.col("o").isin(*classes)).select("s").distinct()
    return typed.select("s", F.lit("cim:IdentifiedObject.mRID").alias("p"), F.regexp_replace("s", "^(urn:uuid:|#_)", "").alias("o"))


def delete_required(t: DataFrame, required: DataFrame) -> DataFrame:
    """Without the statements that a (cls, p) of ``required`` demands of their subjects."""
    gone = t.where("p = 'rdf:type'").select("graph", "s", F.col("o").alias("cls")).distinct().join(required, "cls").select("graph", "s", "p").distinct()
    return t.join(gone, ["graph", "s", "p"], "left_anti")


def break_datatypes(t: DataFrame) -> DataFrame:
    """Values that don't fit their datatypes."""
    dt = F.col("o_dt")
    bad = F.when(dt == "xsd:integer", "1.1").when(dt.isin("xsd:float", "xsd:decimal"), "1,1").when(dt == "xsd:boolean", "truee").when(dt.isin("xsd:date", "xsd:dateTime"), "not a date")
    return t.withColumn("o", F.when((F.col("o_kind") == "literal") & bad.isNotNull(), bad).otherwise(F.col("o")))


def set_header(t: DataFrame, values: Mapping[str, str], header: str = "md:FullModel") -> DataFrame:
    """Header statements of the given predicates replaced, or added where missing."""
    heads = t.where((F.col("p") == "rdf:type") & (F.col("o") == header)).select("graph", "s").distinct()
    rest = t.join(heads, ["graph", "s"], "left_anti").select("graph", "s", "p", "o").unionByName(
        t.join(heads, ["graph", "s"], "left_semi").where(~F.col("p").isin(*values)).select("graph", "s", "p", "o")
    )
    rows = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(o).alias("o")) for p, o in values.items()])
    return rest.unionByName(heads.select("graph", "s", F.inline(rows)))


def rename_values(t: DataFrame, names: DataFrame, predicates: list[str]) -> DataFrame:
    """Values of the predicates renamed by (old, new)."""
    own = names.groupBy(F.col("old").alias("__old")).agg(F.min("new").alias("__new"))
    j = t.join(own, (F.col("o") == F.col("__old")) & F.col("p").isin(*predicates), "left")
    return j.withColumn("o", F.coalesce("__new", "o")).drop("__old", "__new")


def inject(t: DataFrame, values: DataFrame) -> DataFrame:
    """(graph, s, p, o) to be added: each subject of a graph that is of a class of ``values`` (cls, p, o) and has no
    statement with that p there. Of several values for a class and p the smallest counts, of several classes too."""
    wanted = values.groupBy("cls", "p").agg(F.min("o").alias("o"))
    typed = t.where(F.col("p") == "rdf:type").select("graph", "s", F.col("o").alias("cls")).distinct()
    lacking = typed.join(wanted, "cls").join(t.select("graph", "s", "p"), ["graph", "s", "p"], "left_anti")
    return lacking.groupBy("graph", "s", "p").agg(F.min("o").alias("o"))


def multiply(t: DataFrame, n: int) -> DataFrame:
    """n copies of a model, each with ids and a graph of its own: rows are repeated, not joined."""
    copies = t.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(n))))
    mark = lambda c: F.concat(F.col(c), F.lit("-"), F.col("copy").cast("string"))
    return copies.select(mark("graph").alias("graph"), mark("s").alias("s"), "p", F.when((F.col("o_kind") == "iri") & (F.col("p") != "rdf:type"), mark("o")).otherwise(F.col("o")).alias("o"), "o_kind", "o_dt")


#: Classes whose objects keep their ids in copies, and what the joining line has.
KEPT = ("md:FullModel", "cim:ControlArea", "cim:LoadArea", "cim:SubGeographicalRegion", "cim:GeographicalRegion")
LINE = {"cim:ACLineSegment.bch": "0.0001875", "cim:ACLineSegment.gch": "0", "cim:ACLineSegment.r": "0.011", "cim:ACLineSegment.x": "0.011", "cim:Conductor.length": "0.01"}
BASE_VOLTAGE = "urn:uuid:65dd04e7-9258-4b3b-9123-74e35dec032e"


def multiply_and_connect(t: DataFrame, n: int, node: str, base_voltage: str = BASE_VOLTAGE, kept: tuple[str, ...] = KEPT) -> DataFrame:
    """The model and n - 1 copies of it, in the same graphs: objects of a copy have ids of their own but for
    those of the classes ``kept``. A line joins the connectivity node ``node`` of the model to each
    copy's: a segment, its container and two terminals in every graph, but in SSH graphs only that
    the terminals are connected. The container lies in the graph's smallest region, if there is one."""
    cols = ["graph", "s", "p", "o", "o_kind"]
    t = t.select(*cols).distinct()
    keep = t.where((F.col("p") == "rdf:type") & F.col("o").isin(*kept)).select(F.col("s").alias("kept")).distinct()
    j = t.join(keep, F.col("s") == F.col("kept"), "left").withColumn("keep_s", F.col("kept").isNotNull()).drop("kept")
    j = j.join(keep, F.col("o") == F.col("kept"), "left").withColumn("keep_o", F.col("kept").isNotNull()).drop("kept")
    turn = F.explode(F.sequence(F.lit(0), F.lit(n - 2))).alias("i") if n > 1 else F.explode(F.array().cast("array<int>")).alias("i")

    def copied(c: str) -> Column:
        return F.when(F.col(c).startswith("urn:uuid:") & ~F.col(f"keep_{c}"), _of_copy(F.col(c), "copy")).otherwise(F.col(c))

    copies = j.select("*", turn).select("graph", copied("s").alias("s"), "p", copied("o").alias("o"), "o_kind")
    # one row for each graph and copy
    graphs = t.groupBy("graph").agg(F.min(F.when((F.col("p") == "rdf:type") & (F.col("o") == "cim:SubGeographicalRegion"), F.col("s"))).alias("region")).select("*", turn)
    segment, line, one, two, other = (_of_copy(F.lit(node), x) for x in ("line segment", "line", "terminal 1", "terminal 2", "copy"))
    named = lambda x: F.concat(F.lit(x + " "), F.col("i").cast("string"))
    rows = [(x, "rdf:type", F.lit("cim:Terminal"), "iri") for x in (one, two)]
    in_ssh = rows + [(x, "cim:ACDCTerminal.connected", F.lit("true"), "literal") for x in (one, two)]
    in_eq = rows + [(segment, "rdf:type", F.lit("cim:ACLineSegment"), "iri"), (line, "rdf:type", F.lit("cim:Line"), "iri")]
    in_eq += [(segment, p, F.lit(v), "literal") for p, v in LINE.items()]
    in_eq += [(x, "cim:IdentifiedObject.name", named(y), "literal") for x, y in ((segment, "ACLineSegment"), (line, "LineEB"), (one, "TerminalEB-1"), (two, "TerminalEB-2"))]
    in_eq += [(x, "cim:ACDCTerminal.sequenceNumber", F.lit(y), "literal") for x, y in ((one, "1"), (two, "2"))]
    in_eq += [(segment, "cim:Equipment.EquipmentContainer", line, "iri"), (segment, "cim:ConductingEquipment.BaseVoltage", F.lit(base_voltage), "iri"), (line, "cim:Line.Region", F.col("region"), "iri")]
    in_eq += [(x, "cim:Terminal.ConductingEquipment", segment, "iri") for x in (one, two)] + [(x, "cim:Terminal.ConnectivityNode", y, "iri") for x, y in ((one, F.lit(node)), (two, other))]
    as_array = lambda rows: F.array(*[F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(k).alias("o_kind")) for s, p, o, k in rows])
    joined = graphs.select("graph", F.inline(F.when(F.col("graph").contains("SSH"), as_array(in_ssh)).otherwise(as_array(in_eq)))).where("o is not null")
    return t.unionByName(copies).unionByName(joined)


def _of_copy(old: Column, what: str) -> Column:
    """A new id for each copy i."""
    h = F.md5(F.concat(F.lit(what + " "), F.col("i").cast("string"), F.lit("|"), old).cast("binary"))
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)))


def multiply_over(t: DataFrame, config: list[tuple[str, str]]) -> DataFrame:
    """A copy for each (time, process): ids of its own, the header's scenario time and process set.
    config is a short list that a user writes."""
    rows = F.array(*[F.struct(F.lit(i).alias("copy"), F.lit(a).alias("at"), F.lit(b).alias("process")) for i, (a, b) in enumerate(config, 1)])
    j = t.select("*", F.inline(rows))
    mark = lambda c: F.concat(F.col(c), F.lit("-"), F.col("copy").cast("string"))
    o = F.when(F.col("p") == "md:Model.scenarioTime", F.col("at")).when(F.col("p") == "md:Model.description", F.col("process")).when((F.col("o_kind") == "iri") & F.col("o").startswith("urn:uuid:"), mark("o")).otherwise(F.col("o"))
    return j.select(mark("graph").alias("graph"), mark("s").alias("s"), "p", o.alias("o"))


def split_by_profile(t: DataFrame, declared: DataFrame) -> DataFrame:
    """(profile, s, p, o): the statements of each profile that declares (profile, cls, p): its types and
    exactly the properties declared on the type."""
    types = t.where("p = 'rdf:type'").select("s", F.col("o").alias("cls")).distinct()
    own = types.join(declared, "cls")
    rows = own.select("profile", "s", "p").distinct().join(t.where("p <> 'rdf:type'").select("s", "p", "o"), ["s", "p"])
    heads = own.select("profile", "s", F.lit("rdf:type").alias("p"), F.col("cls").alias("o")).distinct()
    return rows.select("profile", "s", "p", "o").unionByName(heads)


def generate(spark, cls: str, n: int, attributes: Mapping[str, tuple[str, float, float]], seed: int = 0, conform: bool = True) -> DataFrame:
    """(s, p, o, o_dt) of n objects: each attribute p -> (datatype, low, high) gets a value within its
    bounds, or one that doesn't fit its datatype. The same seed gives the same rows."""

    def value(p: str, dt: str, low: float, high: float) -> Column:
        u = F.pmod(F.xxhash64(F.lit(f"{seed}|{p}"), F.col("id")), F.lit(1_000_000)) / F.lit(1_000_000.0)
        if not conform:
            return F.lit({"xsd:integer": "1.1", "xsd:float": "1,1", "xsd:decimal": "1,1", "xsd:boolean": "truee"}.get(dt, "nonConform"))
        if dt == "xsd:integer":
            return F.floor(F.lit(low) + u * F.lit(high - low + 1)).cast("bigint").cast("string")
        if dt in ("xsd:float", "xsd:decimal"):
            return (F.lit(low) + u * F.lit(high - low)).cast("decimal(18,6)").cast("string")
        if dt == "xsd:boolean":
            return (u < 0.5).cast("string")
        if dt == "xsd:date":
            return F.date_format(F.date_add(F.lit("2030-01-01").cast("date"), F.floor(u * 365).cast("int")), "yyyy-MM-dd")
        return F.concat(F.lit("v"), F.floor(u * 1_000_000).cast("string"))

    rows = [F.struct(F.lit("rdf:type").alias("p"), F.lit(cls).alias("o"), F.lit(None).cast("string").alias("o_dt"))]
    rows += [F.struct(F.lit(p).alias("p"), value(p, *a).alias("o"), F.lit(a[0]).alias("o_dt")) for p, a in attributes.items()]
    ids = spark.range(n).withColumn("s", new_id(F.col("id").cast("string"), f"{cls}|{seed}"))
    return ids.select("s", F.inline(F.array(*rows)))
