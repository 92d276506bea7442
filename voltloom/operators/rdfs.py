"""What a vocabulary says: descriptions, datatypes, constraints generated from it, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.files import cardinality
from .graph import inherited

#: Primitive names and their datatypes.
PRIMITIVES = {
    "Integer": "xsd:integer", "Float": "xsd:float", "Decimal": "xsd:decimal", "String": "xsd:string", "Boolean": "xsd:boolean", "Date": "xsd:date",
    "DateTime": "xsd:dateTime", "DateTimeStamp": "xsd:dateTimeStamp", "Time": "xsd:time", "Duration": "xsd:duration", "MonthDay": "xsd:gMonthDay",
    "LangString": "rdf:langString", "Version": "xsd:string", "UUID": "xsd:string", "StringFixedLanguage": "xsd:string", "URI": "xsd:anyURI", "URL": "xsd:anyURI", "IRI": "xsd:anyURI", "StringIRI": "xsd:anyURI",
}


def _one(p: str) -> Column:
    return F.min(F.when(F.col("p") == p, F.col("o")))


def descriptions(t: DataFrame) -> DataFrame:
    """(item, type, category, stereotypes, concrete, multiplicity, association_used, description): one
    row for each class, package, property and enumeration value; one aggregation by subject."""
    stereo = F.array_sort(F.collect_set(F.when(F.col("p") == "cims:stereotype", F.regexp_extract("o", "[^#/]*$", 0))))
    g = t.where("s is not null").groupBy("s").agg(
        _one("rdf:type").alias("kind"), _one("rdfs:label").alias("label"), _one("rdfs:comment").alias("description"), _one("cims:belongsToCategory").alias("category"), stereo.alias("st"),
        _one("cims:multiplicity").alias("multiplicity"), _one("cims:AssociationUsed").alias("association_used"), _one("rdfs:domain").alias("domain"), F.max((F.col("p") == "rdfs:label").cast("int")).alias("labelled"),
    )
    kind = (
        F.when(F.col("kind") == "cims:ClassCategory", "Package")
        .when(F.array_contains("st", "enumeration"), "Enum")
        .when(F.col("kind") == "rdfs:Class", "Class")
        .when(F.array_contains("st", "attribute"), "Attribute")
        .when(F.col("domain").isNotNull(), "Association")
    )
    concrete = F.when(F.array_contains("st", "concrete"), "Yes").otherwise("No")
    return g.select(F.col("s").alias("item"), kind.alias("type"), "label", "category", F.array_join("st", "; ").alias("stereotypes"), concrete.alias("concrete"), "multiplicity", "association_used", "description").where("type is not null")


def properties_of(t: DataFrame) -> DataFrame:
    """(property, domain, rng, datatype, multiplicity, association_used)."""
    g = t.where("s is not null").groupBy(F.col("s").alias("property")).agg(
        _one("rdfs:domain").alias("domain"), _one("rdfs:range").alias("rng"), _one("cims:dataType").alias("datatype"), _one("cims:multiplicity").alias("multiplicity"), _one("cims:AssociationUsed").alias("association_used")
    )
    return g.where("domain is not null")


def datatype_map(properties: DataFrame, datatypes: DataFrame) -> DataFrame:
    """(property, dt) through the chain datatype class -> its value's primitive -> datatype.
    datatypes: (cls, primitive)."""
    xsd = F.element_at(F.create_map(*[x for k, v in PRIMITIVES.items() for x in (F.lit(k), F.lit(v))]), F.regexp_extract("primitive", "[^#/]*$", 0))
    own = datatypes.groupBy(F.col("cls").alias("datatype")).agg(F.min("primitive").alias("primitive"))
    j = properties.where("datatype is not null").join(own, "datatype", "left").withColumn("primitive", F.coalesce("primitive", "datatype"))
    return j.select("property", xsd.alias("dt")).where("dt is not null").distinct()


def constraints(properties: DataFrame, subclass: DataFrame, concrete: DataFrame, dts: DataFrame) -> DataFrame:
    """(shape, target_class, path, component, parameter): the constraints of each concrete class from its
    own and inherited properties: cardinality, datatype, value class, and none for associations that
    aren't used. concrete: (cls)."""
    p = inherited(properties.select("property", "domain"), subclass).join(concrete, "cls", "left_semi").select("cls", "property")
    j = p.join(properties, "property").join(dts, "property", "left")
    c = cardinality(F.col("multiplicity"))
    unused = F.col("association_used") == "No"
    row = lambda kind, name, value: F.struct(F.concat("property", F.lit(f"-{kind}")).alias("shape"), F.lit(name).alias("component"), value.cast("string").alias("parameter"))
    rows = F.array_compact(F.array(
        F.when(unused, row("cardinality", "maxCount", F.lit(0))),
        F.when(~F.coalesce(unused, F.lit(False)) & (F.col("c.low") > 0), row("cardinality", "minCount", F.col("c.low"))),
        F.when(~F.coalesce(unused, F.lit(False)) & (F.col("c.high") < 999) & (F.col("c.high") > 0), row("cardinality", "maxCount", F.col("c.high"))),
        F.when(F.col("dt").isNotNull(), row("datatype", "datatype", F.col("dt"))),
        F.when(~F.coalesce(unused, F.lit(False)) & F.col("rng").isNotNull(), row("valueType", "class", F.col("rng"))),
    ))
    return j.withColumn("c", c).select(F.col("cls").alias("target_class"), F.col("property").alias("path"), F.inline(rows)).select("shape", "target_class", "path", "component", "parameter").distinct()


def strictest(rows: DataFrame) -> DataFrame:
    """One row for each (cls, p) of constraint rows (cls, p, component, value): the strictest bounds."""
    n = F.expr("try_cast(value AS double)")
    low = lambda c: F.max(F.when(F.col("component") == c, n)).alias(c)
    high = lambda c: F.min(F.when(F.col("component") == c, n)).alias(c)
    return rows.groupBy("cls", "p").agg(*map(low, ("minCount", "minInclusive", "minExclusive", "minLength")), *map(high, ("maxCount", "maxInclusive", "maxExclusive", "maxLength")))


#: Manifest properties and the header fields that they are taken from, best first.
MANIFEST = {
    "dcterms:conformsTo": ("dcterms:conformsTo", "md:Model.profile"), "dcterms:description": ("dcterms:description", "md:Model.description"), "dcterms:issued": ("dcterms:issued", "md:Model.created"),
    "dcterms:publisher": ("dcterms:publisher", "md:Model.modelingAuthoritySet"), "dcterms:requires": ("dcterms:requires", "md:Model.DependentOn"), "dcat:keyword": ("dcat:keyword",),
    "dcat:startDate": ("dcat:startDate", "md:Model.scenarioTime"), "dcat:version": ("dcat:version", "md:Model.version"),
}


def manifest(t: DataFrame) -> DataFrame:
    """(graph, dataset, p, o): a dataset description for each file: all values of the first header
    field that has any, its title the file's name."""
    heads = t.where("p = 'rdf:type' and o in ('dcat:Dataset', 'md:FullModel')").groupBy("graph").agg(F.min(F.struct("o", "s")).alias("h")).select("graph", F.col("h.s").alias("s"))
    rank = F.create_map(*[x for p, fields in MANIFEST.items() for i, f in enumerate(fields) for x in (F.lit(f), F.struct(F.lit(p).alias("p"), F.lit(i).alias("i")))])
    v = t.join(heads, ["graph", "s"], "left_semi").where(F.col("o").isNotNull() & (F.trim("o") != "")).withColumn("r", F.element_at(rank, F.col("p"))).where("r is not null")
    v = v.select("graph", "s", "r.p", "r.i", F.trim("o").alias("o")).distinct()
    best = v.groupBy("graph", "p").agg(F.min("i").alias("i"))
    named = heads.select("graph", F.col("s").alias("dataset"), F.lit("dcterms:title").alias("p"), F.col("graph").alias("o"))
    return v.join(best, ["graph", "p", "i"]).select("graph", F.col("s").alias("dataset"), "p", "o").unionByName(named)


def value_constraints(rows: DataFrame, class_properties: DataFrame, concrete: DataFrame) -> DataFrame:
    """(shape, target_class, path, component, parameter) of user rows (property, component, value): each
    is attached to every concrete class that has the property, itself or by inheritance.
    class_properties: (cls, property)."""
    own = class_properties.join(concrete, "cls", "left_semi").select("cls", "property").distinct()
    return own.join(rows.distinct(), "property").select(
        F.concat("cls", F.lit("."), "property", F.lit("-"), "component").alias("shape"), F.col("cls").alias("target_class"), F.col("property").alias("path"), "component", F.col("value").cast("string").alias("parameter")
    )


def concrete_below(classes: DataFrame, tiers: list[tuple[DataFrame, DataFrame]], by_local_name: bool = False) -> DataFrame:
    """(cls, concrete): for each class its concrete subclasses in any tier of base vocabularies, itself
    too where it is concrete. tiers: (subclass closure (child, ancestor), concrete (cls)) each. With
    ``by_local_name`` classes of other namespaces match by their names."""
    key = (lambda c: F.regexp_extract(c, "[^#/]*$", 0)) if by_local_name else (lambda c: c)
    out = None
    for up, concrete in tiers:
        pairs = up.select("child", "ancestor").unionByName(concrete.select(F.col("cls").alias("child"), F.col("cls").alias("ancestor")))
        pairs = pairs.join(concrete.select(F.col("cls").alias("child")), "child", "left_semi").select(key(F.col("ancestor")).alias("k"), F.col("child").alias("concrete"))
        out = pairs if out is None else out.unionByName(pairs)
    return classes.select("cls", key(F.col("cls")).alias("k")).join(out.distinct(), "k").select("cls", "concrete").distinct()


def template(class_properties: DataFrame, properties: DataFrame, dts: DataFrame) -> DataFrame:
    """(cls, property, kind, dt, multiplicity): what a sheet of each class has a column for."""
    j = class_properties.select("cls", "property").distinct().join(properties, "property").join(dts, "property", "left")
    kind = F.when(F.col("dt").isNotNull(), "Attribute").when(F.col("association_used") == "Yes", "Association").otherwise("Enumeration")
    used = F.coalesce(F.col("association_used") != "No", F.lit(True))
    return j.where(used).select("cls", "property", kind.alias("kind"), "dt", "multiplicity")
