"""Constraint checks on statement rows. A shape is plain data (``Shape``); each constraint becomes one
DataFrame plan over focus nodes and values, all of one result schema.

Focus nodes come from a target class with its subclasses, or from the subjects or objects of a
predicate. Constraints that count values keep the focus nodes without any. A path is a predicate,
``^p`` for its inverse, ``p/q`` for a sequence and ``p|q`` for alternatives."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a literal of a datatype must look like.
LEXICAL = {
    "xsd:integer": r"^[+-]?[0-9]+\z",
    "xsd:decimal": r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)\z",
    "xsd:float": r"^([+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?|-?INF|NaN)\z",
    "xsd:boolean": r"^(true|false|1|0)\z",
    "xsd:date": r"^-?[0-9]{4,}-[0-9]{2}-[0-9]{2}(Z|[+-][0-9]{2}:[0-9]{2})?\z",
    "xsd:dateTime": r"^-?[0-9]{4,}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})?\z",
    "xsd:gMonthDay": r"^--[0-9]{2}-[0-9]{2}(Z|[+-][0-9]{2}:[0-9]{2})?\z",
    "xsd:duration": r"^-?P(?=.)([0-9]+Y)?([0-9]+M)?([0-9]+D)?(T(?=.)([0-9]+H)?([0-9]+M)?([0-9]+([.][0-9]+)?S)?)?\z",
}
RESULT = ("source_shape", "focus_node", "severity", "message", "value", "path", "constraint_component")


@dataclass(frozen=True)
class Shape:
    name: str
    path: str = ""
    target_class: str | None = None
    subjects_of: str | None = None
    objects_of: str | None = None
    severity: str = "Violation"
    message: str = ""
    #: component -> parameter, as in {"minCount": 1, "datatype": "xsd:integer", "in": ["a", "b"]}
    constraints: dict = field(default_factory=dict)


def focus(t: DataFrame, shape: Shape, subclass: DataFrame | None = None) -> DataFrame:
    """Distinct (focus). subclass: (child, ancestor)."""
    if shape.target_class is not None:
        types = t.where("p = 'rdf:type'").select(F.col("s").alias("focus"), F.col("o").alias("cls"))
        mine = types.where(F.col("cls") == shape.target_class)
        if subclass is not None:
            below = subclass.where(F.col("ancestor") == shape.target_class).select(F.col("child").alias("cls"))
            mine = mine.unionByName(types.join(below, "cls", "left_semi"))
        return mine.select("focus").distinct()
    if shape.subjects_of is not None:
        return t.where(F.col("p") == shape.subjects_of).select(F.col("s").alias("focus")).distinct()
    return t.where(F.col("p") == shape.objects_of).select(F.col("o").alias("focus")).where("focus is not null").distinct()


def steps(t: DataFrame, path: str) -> DataFrame:
    """Distinct (focus, value, kind, dt, lang) of a path, without nulls."""
    if "|" in path:
        return reduce(DataFrame.unionByName, (steps(t, x) for x in path.split("|"))).distinct()
    if "/" in path:
        first, *rest = path.split("/")
        out = steps(t, first)
        for p in rest:
            out = out.select("focus", F.col("value").alias("mid")).join(steps(t, p).withColumnRenamed("focus", "mid"), "mid").drop("mid").distinct()
        return out
    if path.startswith("^"):
        return t.where(F.col("p") == path[1:]).select(F.col("o").alias("focus"), F.col("s").alias("value"), F.lit("iri").alias("kind"), F.lit(None).cast("string").alias("dt"), F.lit(None).cast("string").alias("lang")).where("focus is not null").distinct()
    lang = F.col("o_lang") if "o_lang" in t.columns else F.lit(None).cast("string")
    return t.where((F.col("p") == path) & F.col("o").isNotNull()).select(F.col("s").alias("focus"), F.col("o").alias("value"), F.col("o_kind").alias("kind"), F.col("o_dt").alias("dt"), lang.alias("lang")).distinct()


_TESTS = {
    "minInclusive": lambda v, x: v < x, "maxInclusive": lambda v, x: v > x, "minExclusive": lambda v, x: v <= x, "maxExclusive": lambda v, x: v >= x,
}


def _fails(component: str, parameter) -> Column | None:
    """The test of a single value, where there is one: true if it fails."""
    v, number = F.col("value"), F.expr("try_cast(value AS double)")
    if component == "datatype":
        bad = ~F.coalesce(v.rlike(LEXICAL[parameter]), F.lit(False)) if parameter in LEXICAL else F.lit(False)
        return (F.col("kind") != "literal") | ~F.col("dt").eqNullSafe(parameter) | bad
    if component == "lexical":
        return (F.col("kind") != "literal") | ~v.rlike(LEXICAL[parameter])
    if component == "nodeKind":
        return F.col("kind") != {"IRI": "iri", "Literal": "literal", "BlankNode": "bnode"}[parameter]
    if component in _TESTS:
        return F.coalesce(_TESTS[component](number, F.lit(parameter)), F.lit(True))
    if component == "minLength":
        return F.length(v) < parameter
    if component == "maxLength":
        return F.length(v) > parameter
    if component == "pattern":
        return ~v.rlike(parameter)
    if component == "in":
        return ~v.isin(*parameter)
    if component == "languageIn":
        return ~F.coalesce(F.lower("lang").isin(*[x.lower() for x in parameter]), F.lit(False))
    if component in ("or", "and", "xone", "not"):
        inner = [reduce(lambda a, b: a | b, (_fails(c, x) for c, x in one.items())) for one in (parameter if component != "not" else [parameter])]
        if component == "or":
            return reduce(lambda a, b: a & b, inner)
        if component == "and":
            return reduce(lambda a, b: a | b, inner)
        passed = reduce(lambda a, b: a + b, (F.when(f, 0).otherwise(1) for f in inner))
        return passed != 1 if component == "xone" else passed != 0
    return None


def check(t: DataFrame, shape: Shape, subclass: DataFrame | None = None) -> DataFrame:
    """The results (RESULT columns) of all constraints of a shape."""
    nodes = focus(t, shape, subclass)
    none = F.lit(None).cast("string")

    def report(found: DataFrame, component: str, value: Column) -> DataFrame:
        return found.select(
            F.lit(shape.name).alias("source_shape"), F.col("focus").alias("focus_node"), F.lit(shape.severity).alias("severity"), F.lit(shape.message).alias("message"),
            value.cast("string").alias("value"), F.lit(shape.path).alias("path"), F.lit(component).alias("constraint_component"),
        )

    values = steps(t, shape.path).join(nodes, "focus", "left_semi") if shape.path else None
    out, single = [], []
    counted = {c: x for c, x in shape.constraints.items() if c in ("minCount", "maxCount")}
    if counted:  # both bounds from one aggregation
        n = nodes.join(values, "focus", "left").groupBy("focus").agg(F.count("value").alias("n"))
        if "minCount" in counted:
            out.append(report(n.where(F.col("n") < counted["minCount"]), "minCount", none))
        if "maxCount" in counted:
            out.append(report(n.where(F.col("n") > counted["maxCount"]), "maxCount", none))
    for c, x in shape.constraints.items():
        if c in counted:
            continue
        if (bad := _fails(c, x)) is not None:
            single.append(F.when(bad, F.lit(c)))
        elif c == "class":
            types = t.where("p = 'rdf:type'").select(F.col("s").alias("value"), F.col("o").alias("cls"))
            ok = types.where(F.col("cls") == x)
            if subclass is not None:
                ok = ok.unionByName(types.join(subclass.where(F.col("ancestor") == x).select(F.col("child").alias("cls")), "cls", "left_semi"))
            out.append(report(values.join(ok.select("value").distinct(), "value", "left_anti"), c, F.col("value")))
        elif c == "hasValue":
            out.append(report(nodes.join(values.where(F.col("value") == x), "focus", "left_anti"), c, none))
        elif c == "uniqueLang":
            out.append(report(values.where("lang is not null").groupBy("focus", F.lower("lang").alias("lang")).count().where("count > 1"), c, F.col("lang")))
        elif c in ("equals", "disjoint"):
            other = steps(t, x).select("focus", "value").join(nodes, "focus", "left_semi")
            if c == "disjoint":
                out.append(report(values.join(other, ["focus", "value"], "left_semi"), c, F.col("value")))
            else:
                out.append(report(values.select("focus", "value").join(other, ["focus", "value"], "left_anti").union(other.join(values, ["focus", "value"], "left_anti")), c, F.col("value")))
        elif c in ("lessThan", "lessThanOrEquals"):
            other = steps(t, x).select("focus", F.col("value").alias("other"))
            a, b = F.expr("try_cast(value AS double)"), F.expr("try_cast(other AS double)")
            less = F.when(a.isNotNull() & b.isNotNull(), a < b if c == "lessThan" else a <= b).otherwise(F.col("value") < F.col("other") if c == "lessThan" else F.col("value") <= F.col("other"))
            out.append(report(values.join(other, "focus").where(~less), c, F.col("value")))
        elif c == "closed":
            allowed = set(x)
            own = t.join(nodes.withColumnRenamed("focus", "s"), "s", "left_semi").where(~F.col("p").isin(*allowed))
            out.append(report(own.select(F.col("s").alias("focus"), "p").distinct(), c, F.col("p")))
        elif c == "node":
            passed = check(t, x, subclass).select(F.col("focus_node").alias("value")).distinct()
            out.append(report(values.join(passed, "value", "left_semi"), c, F.col("value")))
        elif c == "qualified":
            least, most, test = x
            good = values.where(~_fails(*next(iter(test.items()))))
            n = nodes.join(good, "focus", "left").groupBy("focus").agg(F.count("value").alias("n"))
            out.append(report(n.where((F.col("n") < least) | (F.col("n") > most)), c, none))
        elif c == "sparql":
            out.append(report(x(t, nodes), c, F.col("value")))
        else:
            raise ValueError(f"unknown constraint {c}")
    if single:  # all tests of single values in one pass
        failed = values.withColumn("component", F.explode(F.array_compact(F.array(*single))))
        out.append(failed.select(
            F.lit(shape.name).alias("source_shape"), F.col("focus").alias("focus_node"), F.lit(shape.severity).alias("severity"), F.lit(shape.message).alias("message"),
            "value", F.lit(shape.path).alias("path"), F.col("component").alias("constraint_component"),
        ))
    return reduce(DataFrame.unionByName, out)


def validate(t: DataFrame, shapes: Iterable[Shape], subclass: DataFrame | None = None) -> DataFrame:
    """All results of all shapes in one plan."""
    return reduce(DataFrame.unionByName, (check(t, s, subclass) for s in shapes))


def read_shapes(t: DataFrame, most: int = 100_000) -> list[Shape]:
    """Shapes from their own statement rows (s, p, o); lists must be flattened to repeated values.
    One for each property shape and target. What can't be read is an error, for its violations would be
    lost. A shapes graph is a small document; one of more than ``most`` rows is refused."""
    rows = t.where(F.col("p").startswith("sh:") | (F.col("p") == "rdf:type")).select("s", "p", "o").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many rows for a shapes graph")
    by: dict[str, dict[str, list[str]]] = {}
    for r in rows:
        by.setdefault(r.s, {}).setdefault(r.p, []).append(r.o)
    out, numbers = [], ("minCount", "maxCount", "minLength", "maxLength")
    targets = ("sh:targetClass", "sh:targetSubjectsOf", "sh:targetObjectsOf")
    about = {"rdf:type", "sh:name", "sh:description", "sh:order", "sh:group"}
    for name, d in sorted(by.items()):
        used = "sh:property" in d or "sh:NodeShape" in d.get("rdf:type", []) or any(p.startswith("sh:target") for p in d)
        if used and (bad := sorted(set(d) - {"sh:property", "sh:severity", "sh:message", *targets, *about})):
            raise ValueError(f"{name}: {', '.join(bad)} can't be read")
        for node in sorted(d.get("sh:property", [])):
            q = by.get(node, {})
            c: dict = {}
            for p, vals in q.items():
                k = p[3:]
                if k in numbers:
                    c[k] = int(vals[0])
                elif k in _TESTS:
                    c[k] = float(vals[0])
                elif k in ("in", "languageIn"):
                    c[k] = sorted(vals)
                elif k in ("datatype", "class", "pattern", "hasValue", "equals", "disjoint", "lessThan", "lessThanOrEquals"):
                    c[k] = vals[0]
                elif k == "nodeKind":
                    c[k] = vals[0].split(":")[-1]
                elif p not in {"sh:path", "sh:severity", "sh:message", *about}:
                    raise ValueError(f"{node}: {p} can't be read")
            one = lambda p, x=q: (x.get(p) or [None])[0]
            for i, target in enumerate(targets):
                for x in sorted(d.get(target, [])):
                    at = [x if k == i else None for k in range(3)]
                    out.append(Shape(node, one("sh:path") or "", *at, (one("sh:severity") or "sh:Violation").split(":")[-1], one("sh:message") or "", c))
    return out
