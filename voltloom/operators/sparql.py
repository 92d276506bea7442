"""A subset of SPARQL SELECT over statement rows, compiled to joins.

Basic graph patterns, ``a``, property paths (``/ | ^ + * ?``), OPTIONAL, MINUS, UNION, FILTER with
EXISTS and NOT EXISTS, BIND, VALUES, GROUP BY with aggregates, HAVING, DISTINCT, ORDER BY, LIMIT and
OFFSET. Terms are short names as the rows have them, full IRIs in <>, and literals. A query that declares
prefixes may use no others than these and the rows' own; a declared one stands for the rows' short name of
its namespace, where they have one, else for the full IRI. Other query forms are refused. A graph is a set: repeated rows count once; rows without an object match nothing."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.rdf import CIM, NAMESPACES
from .graph import closure

_TOKEN = re.compile(
    r"""\s+|\#[^\n]*|(?P<var>[?$]\w+)|(?P<iri><[^<>\s]*>)|(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<num>\d+(?:\.\d+)?)|(?P<name>(?:[A-Za-z][\w-]*)?:[\w-]+(?:\.[\w-]+)*)|(?P<word>[A-Za-z_]\w*)|(?P<mark>&&|\|\||[<>!]=|[{}().;,=<>!*/|^+?-])"""
)


_PREFIX = re.compile(r"\s+|#[^\n]*\n|(?i:PREFIX)\s+([A-Za-z][\w.-]*)?:\s*<([^<>\s]*)>")


class Unsupported(ValueError):
    """The text is no query that this subset has."""


def short_of(namespace: str) -> str:
    """What the rows' names of a namespace begin with: its short name and a colon, else the namespace."""
    known = NAMESPACES.get(namespace) or ("cim" if CIM.match(namespace) else None)
    return f"{known}:" if known else namespace


def _named(name: str, declared: dict[str, str]) -> str:
    prefix, local = name.split(":", 1)
    if prefix in declared:
        return declared[prefix] + local
    if prefix in {"cim", *NAMESPACES.values()}:
        return name
    raise Unsupported(f"the prefix of {name} isn't declared")


@dataclass
class Query:
    variables: list[str] = field(default_factory=list)
    computed: list[tuple] = field(default_factory=list)
    distinct: bool = False
    where: list = field(default_factory=list)
    group: list[str] = field(default_factory=list)
    having: object = None
    order: list[tuple[str, bool]] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0


class _Parser:
    def __init__(self, text: str) -> None:
        if not text or not text.strip():
            raise Unsupported("a blank query")
        self.tokens, at, declared = [], 0, {}
        while m := _PREFIX.match(text, at):
            if m[2] is not None:
                declared[m[1] or ""] = short_of(m[2])
            at = m.end()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise Unsupported(f"no SPARQL at {text[at : at + 30]!r}")
            at = m.end()
            if m.lastgroup == "name" and declared:
                self.tokens.append(("name", _named(m["name"], declared)))
            elif m.lastgroup:
                self.tokens.append((m.lastgroup, m[m.lastgroup]))
        self.tokens.append(("end", ""))
        self.i = 0

    def peek(self) -> str:
        return self.tokens[self.i][1].upper() if self.tokens[self.i][0] in ("word", "mark") else ""

    def take(self, *values: str) -> str:
        if values and self.peek() not in values:
            raise Unsupported(f"{' or '.join(values)} expected, found {self.tokens[self.i][1]!r}")
        self.i += 1
        return self.tokens[self.i - 1][1]

    def maybe(self, value: str) -> bool:
        if self.peek() == value:
            self.i += 1
            return True
        return False

    def query(self) -> Query:
        if self.peek() != "SELECT":
            raise Unsupported("only SELECT queries")
        self.take()
        q = Query(distinct=self.maybe("DISTINCT"))
        while self.peek() not in ("WHERE", "{"):
            if self.maybe("*"):
                continue
            if self.maybe("("):
                e = self.expression()
                self.take("AS")
                name = self.take()[1:]
                self.take(")")
                q.computed.append((name, e))
                q.variables.append(name)
            elif self.tokens[self.i][0] == "var":
                q.variables.append(self.take()[1:])
            else:
                raise Unsupported(f"unexpected {self.tokens[self.i][1]!r}")
        self.maybe("WHERE")
        q.where = self.group()
        while self.tokens[self.i][0] != "end":
            word = self.take("GROUP", "HAVING", "ORDER", "LIMIT", "OFFSET").upper()
            if word in ("GROUP", "ORDER"):
                self.take("BY")
            if word == "GROUP":
                while self.tokens[self.i][0] == "var":
                    q.group.append(self.take()[1:])
            elif word == "HAVING":
                q.having = self.expression()
            elif word == "ORDER":
                while self.tokens[self.i][0] == "var" or self.peek() in ("ASC", "DESC"):
                    down = False
                    if self.peek() in ("ASC", "DESC"):
                        down = self.take().upper() == "DESC"
                        self.take("(")
                        q.order.append((self.take()[1:], down))
                        self.take(")")
                    else:
                        q.order.append((self.take()[1:], down))
            elif word == "LIMIT":
                q.limit = int(self.take())
            else:
                q.offset = int(self.take())
        return q

    def group(self) -> list:
        self.take("{")
        out: list = []
        while not self.maybe("}"):
            word = self.peek()
            if word == "OPTIONAL" or word == "MINUS":
                self.take()
                out.append((word.lower(), self.group()))
            elif word == "FILTER":
                self.take()
                out.append(("filter", self.expression()))
            elif word == "BIND":
                self.take()
                self.take("(")
                e = self.expression()
                self.take("AS")
                out.append(("bind", self.take()[1:], e))
                self.take(")")
            elif word == "VALUES":
                self.take()
                name = self.take()[1:]
                self.take("{")
                vals = []
                while not self.maybe("}"):
                    vals.append(self.term()[1])
                out.append(("values", name, vals))
            elif word == "{":
                parts = [self.group()]
                while self.maybe("UNION"):
                    parts.append(self.group())
                out.append(("union", parts))
            elif word in ("GRAPH", "SERVICE"):
                raise Unsupported(word)
            else:
                s = self.term()
                while True:
                    p = self.path()
                    while True:
                        out.append(("triple", s, p, self.term()))
                        if not self.maybe(","):
                            break
                    if not self.maybe(";") or self.peek() in ("}", "."):
                        break
            self.maybe(".")
        return out

    def path(self):
        if self.tokens[self.i][0] == "var":
            return ("var", self.take()[1:])
        parts = [self.sequence()]
        while self.maybe("|"):
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def sequence(self):
        parts = [self.step()]
        while self.maybe("/"):
            parts.append(self.step())
        return parts[0] if len(parts) == 1 else ("seq", parts)

    def step(self):
        if self.maybe("^"):
            return ("inv", self.step())
        if self.maybe("("):
            p = self.path()
            self.take(")")
        elif self.peek() == "A":
            self.take()
            p = ("p", "rdf:type")
        else:
            p = ("p", self.term()[1])
        if self.peek() in ("+", "*", "?"):
            p = (self.take(), p)
        return p

    def term(self):
        kind, t = self.tokens[self.i]
        self.i += 1
        if kind == "var":
            return ("var", t[1:])
        if kind in ("iri", "str"):
            return ("const", re.sub(r"\\(.)", r"\1", t[1:-1]))
        if kind in ("name", "num") or t in ("true", "false"):
            return ("const", t)
        raise Unsupported(f"a term expected, found {t!r}")

    def expression(self, level: int = 0):
        if level == 4:
            return self.primary()
        ops = (("||",), ("&&",), ("=", "!=", "<", ">", "<=", ">="), ("+", "-", "*", "/"))[level]
        left = self.expression(level + 1)
        while True:
            if level == 2 and self.peek() in ("IN", "NOT"):
                negated = self.maybe("NOT")
                self.take("IN")
                left = ("in", left, self.arguments())
                left = ("not", left) if negated else left
            elif self.peek() in ops:
                op = self.take()
                left = (op, left, self.expression(level + 1))
            else:
                return left

    def arguments(self) -> list:
        self.take("(")
        out = []
        while not self.maybe(")"):
            out.append(self.expression())
            self.maybe(",")
        return out

    def primary(self):
        if self.maybe("!"):
            return ("not", self.primary())
        if self.maybe("("):
            e = self.expression()
            self.take(")")
            return e
        if self.tokens[self.i][0] == "word" and self.peek() not in ("TRUE", "FALSE"):
            name = self.take().upper()
            if name == "NOT":
                self.take("EXISTS")
                return ("not", ("exists", self.group()))
            if name == "EXISTS":
                return ("exists", self.group())
            if name in ("COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE", "GROUP_CONCAT"):
                self.take("(")
                distinct, between = self.maybe("DISTINCT"), " "
                inner = None if self.maybe("*") else self.expression()
                if self.maybe(";"):
                    self.take("SEPARATOR")
                    self.take("=")
                    between = self.term()[1]
                self.take(")")
                return ("agg", name, distinct, inner, between)
            return ("call", name, self.arguments())
        return self.term()


def _number(c: Column) -> Column:
    return c.cast("string").try_cast("double")


_CALLS = {
    "STR": lambda a: a, "LCASE": lambda a: F.lower(a), "UCASE": lambda a: F.upper(a), "STRLEN": lambda a: F.length(a), "CONTAINS": lambda a, b: F.contains(a, b), "STRSTARTS": lambda a, b: F.startswith(a, b), "STRENDS": lambda a, b: F.endswith(a, b),
    "STRBEFORE": lambda a, b: F.when(F.contains(a, b), F.substr(a, F.lit(1), F.position(b, a) - 1)).otherwise(F.lit("")), "STRAFTER": lambda a, b: F.when(F.contains(a, b), F.substr(a, F.position(b, a) + F.length(b))).otherwise(F.lit("")), "CONCAT": lambda *a: F.concat(*a), "COALESCE": lambda *a: F.coalesce(*a), "IF": lambda c, a, b: F.when(c, a).otherwise(b), "BOUND": lambda a: a.isNotNull(),
    "REGEX": lambda a, b: F.regexp_like(a, b), "REPLACE": lambda a, b, c: F.regexp_replace(a, b, c), "SUBSTR": lambda a, b, *c: F.substr(a, b.cast("int"), *(x.cast("int") for x in c)), "ABS": lambda a: F.abs(_number(a)), "ROUND": lambda a: F.round(_number(a)),
    "CEIL": lambda a: F.ceil(_number(a)), "FLOOR": lambda a: F.floor(_number(a)), "MD5": lambda a: F.md5(a.cast("binary")), "SHA1": lambda a: F.sha1(a.cast("binary")), "SHA256": lambda a: F.sha2(a.cast("binary"), 256), "YEAR": lambda a: F.year(F.try_to_timestamp(a)), "MONTH": lambda a: F.month(F.try_to_timestamp(a)),
    "DAY": lambda a: F.day(F.try_to_timestamp(a)), "ISIRI": lambda a: a.rlike("^[A-Za-z][A-Za-z0-9+.-]*:|^#"), "ISNUMERIC": lambda a: _number(a).isNotNull(), "ENCODE_FOR_URI": lambda a: F.replace(F.url_encode(a), F.lit("+"), F.lit("%20")), "SAMETERM": lambda a, b: a == b,
}


def _value(e, has: set[str]) -> Column:
    op = e[0]
    if op == "var":
        return F.col(f"`{e[1]}`") if e[1] in has else F.lit(None).cast("string")
    if op == "const":
        return F.lit(float(e[1])) if re.fullmatch(r"\d+(\.\d+)?", e[1]) else F.lit(e[1] == "true") if e[1] in ("true", "false") else F.lit(e[1])
    if op == "not":
        return ~_value(e[1], has)
    if op == "in":
        return _value(e[1], has).isin(*[x[1] for x in e[2]])
    if op == "call":
        if e[1] not in _CALLS:
            raise Unsupported(f"function {e[1]}")
        args = [F.lit(x[1]) if x[0] == "const" and not x[1].isdigit() else _value(x, has) for x in e[2]]
        return _CALLS[e[1]](*args)
    a, b = _value(e[1], has), _value(e[2], has)
    if op == "&&":
        return a & b
    if op == "||":
        return a | b
    numeric = any(x[0] == "const" and re.fullmatch(r"\d+(\.\d+)?", x[1]) for x in e[1:])
    if numeric or op in "+-*/":
        a, b = _number(a), _number(b)
    elif any(x[0] == "const" and x[1] in ("true", "false") for x in e[1:]):
        a, b = a.cast("string"), b.cast("string")
    return {"=": lambda: a == b, "!=": lambda: a != b, "<": lambda: a < b, ">": lambda: a > b, "<=": lambda: a <= b, ">=": lambda: a >= b, "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.try_divide(a, b)}[op]()


def _pairs(t: DataFrame, path) -> DataFrame:
    """Distinct (s, o) of a path."""
    kind = path[0]
    if kind == "p":
        return t.where(F.col("p") == path[1]).select("s", "o")
    if kind == "inv":
        return _pairs(t, path[1]).select(F.col("o").alias("s"), F.col("s").alias("o"))
    if kind == "alt":
        return reduce(DataFrame.union, (_pairs(t, x) for x in path[1])).distinct()
    if kind == "seq":
        first, *rest = path[1]
        out = _pairs(t, first)
        for x in rest:
            out = out.withColumnRenamed("o", "m").join(_pairs(t, x).withColumnRenamed("s", "m"), "m").select("s", "o").distinct()
        return out
    inner = _pairs(t, path[1])
    if kind in "+*":
        far = closure(inner).select(F.col("child").alias("s"), F.col("ancestor").alias("o"))
    else:
        far = inner
    if kind == "+":
        return far
    nodes = t.select("s").union(t.select(F.col("o").alias("s"))).distinct()
    return far.union(nodes.select("s", F.col("s").alias("o"))).distinct()


def _join(a: DataFrame | None, b: DataFrame, how: str = "inner") -> DataFrame:
    if a is None:
        return b
    on = [c for c in a.columns if c in b.columns]
    if not on:
        raise Unsupported("patterns that share no variable")
    return a.join(b, on, how)


def _evaluate(t: DataFrame, group: list) -> DataFrame:
    out: DataFrame | None = None
    later = []
    for e in group:
        kind = e[0]
        if kind == "triple":
            _, s, p, o = e
            rows = t.select("s", "p", "o") if p[0] == "var" else _pairs(t, p)
            names: dict[str, str] = {}
            for c, x in (("s", s), ("p", p), ("o", o)):
                if c not in rows.columns:
                    continue
                if x[0] == "const":
                    rows = rows.where(F.col(c) == x[1])
                elif x[0] == "var":
                    if x[1] in names:
                        rows = rows.where(F.col(c) == F.col(names[x[1]]))
                    else:
                        names[x[1]] = c
            rows = rows.select(*[F.col(c).alias(f"{v}") for v, c in names.items()]) if names else rows.select(F.lit(1).alias("__any")).limit(1)
            out = _join(out, rows)
        elif kind == "optional":
            out = _join(out, _evaluate(t, e[1]), "left")
        elif kind == "minus":
            other = _evaluate(t, e[1])
            on = [c for c in out.columns if c in other.columns]
            out = out.join(other.select(*on).distinct(), on, "left_anti") if on else out
        elif kind == "union":
            parts = [_evaluate(t, x) for x in e[1]]
            out = _join(out, reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts))
        elif kind == "values":
            vals = t.sparkSession.createDataFrame([(x,) for x in e[2]], f"`{e[1]}` string")
            out = _join(out, vals)
        elif kind == "bind":
            out = out.withColumn(e[1], _value(e[2], set(out.columns)))
        else:
            later.append(e[1])  # a filter holds for its whole group
    for e in later:
        negated = e[0] == "not" and e[1][0] == "exists"
        if negated or e[0] == "exists":
            other = _evaluate(t, e[1][1] if negated else e[1])
            on = [c for c in out.columns if c in other.columns]
            out = out.join(other.select(*on).distinct(), on, "left_anti" if negated else "left_semi")
        else:
            out = out.where(_value(e, set(out.columns)))
    return out


def _aggregate(e, has: set[str]) -> Column:
    _, name, distinct, inner, between = e
    v = F.lit(1) if inner is None else _value(inner, has)
    if name == "COUNT":
        return F.countDistinct(v) if distinct else F.count(v)
    if name in ("SUM", "AVG"):
        n = _number(v)
        return (F.sum_distinct(n) if distinct else F.sum(n)) if name == "SUM" else F.avg(n)
    if name == "GROUP_CONCAT":
        return F.array_join(F.array_sort(F.collect_set(v) if distinct else F.collect_list(v)), between)
    return {"MIN": F.min, "MAX": F.max, "SAMPLE": F.min}[name](v)


def select(t: DataFrame, text: str) -> DataFrame:
    """The solutions of a SELECT query, one text column for each variable."""
    q = _Parser(text).query()
    graph = t.select("s", "p", "o").where("s is not null and p is not null and o is not null").distinct()
    out = _evaluate(graph, q.where)
    has = set(out.columns)
    aggregates = [(n, e) for n, e in q.computed if e[0] == "agg"]
    if q.group or aggregates:
        cols = [_aggregate(e, has).alias(n) for n, e in aggregates]
        out = out.groupBy(*q.group).agg(*cols) if cols else out.select(*q.group).distinct()
    for n, e in q.computed:
        if e[0] != "agg":
            out = out.withColumn(n, _value(e, set(out.columns)))
    if q.having is not None:
        out = out.where(_value(q.having, set(out.columns)))
    if q.order:
        out = out.orderBy(*[F.desc(v) if down else F.asc(v) for v, down in q.order])
    out = out.select(*[F.col(f"`{v}`") if v in out.columns else F.lit(None).cast("string").alias(v) for v in q.variables]) if q.variables else out
    if q.distinct:
        out = out.distinct()
        if q.order:
            out = out.orderBy(*[F.desc(v) if down else F.asc(v) for v, down in q.order if v in out.columns])
    if q.limit is not None:
        out = out.limit(q.limit + q.offset)
    return out.offset(q.offset) if q.offset else out
