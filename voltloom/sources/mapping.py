"""Relational tables as statement rows: subject ``table/key``, a type row, one row for each column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a column becomes an object - its text, kind and datatype.
KINDS = {"str": "xsd:string", "int": "xsd:integer", "money": "xsd:decimal", "date": "xsd:date"}


def text(c: Column, kind: str) -> Column:
    if kind.startswith("fk:"):
        return F.concat(F.lit(kind[3:] + "/"), c.cast("string"))
    if kind == "money":
        return c.cast("decimal(18,2)").cast("string")
    if kind == "date":
        return F.date_format(c.cast("timestamp"), "yyyy-MM-dd")
    return c.cast("string")


def statements(df: DataFrame, graph: str, name: str, key: str, cls: str, columns: dict[str, str], subject: Column | None = None) -> DataFrame:
    """(graph, s, p, o, o_kind, o_dt) of a table in one scan: no union of a scan for each predicate."""
    s = subject if subject is not None else F.concat(F.lit(f"{name}/"), F.col(key).cast("string"))
    rows = [F.struct(F.lit("rdf:type").alias("p"), F.lit(cls).alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_dt"))]
    for c, kind in columns.items():
        iri = kind.startswith("fk:")
        rows.append(F.struct(F.lit(f"{name}.{c}").alias("p"), text(F.col(c), kind).alias("o"), F.lit("iri" if iri else "literal").alias("o_kind"), F.lit(KINDS.get(kind)).cast("string").alias("o_dt")))
    return df.select(F.lit(graph).alias("graph"), s.alias("s"), F.inline(F.array(*rows))).where("o is not null")


def sql(table: str, graph: str, name: str, key: str, cls: str, columns: dict[str, str], where: str = "true", subject: str | None = None, change: dict[str, str] | None = None) -> str:
    """The same as a SELECT."""
    s = subject or f"'{name}/' || {key}"
    parts = [f"SELECT '{graph}' AS graph, {s} AS s, 'rdf:type' AS p, '{cls}' AS o, 'iri' AS o_kind, CAST(NULL AS VARCHAR) AS o_dt FROM {table} WHERE {where}"]
    for c, kind in columns.items():
        value = (change or {}).get(c, c)
        if kind.startswith("fk:"):
            o = f"'{kind[3:]}/' || {value}"
        elif kind == "money":
            o = f"CAST(CAST({value} AS DECIMAL(18,2)) AS VARCHAR)"
        elif kind == "date":
            o = f"strftime({value}, '%Y-%m-%d')"
        else:
            o = f"CAST({value} AS VARCHAR)"
        dt = f"'{KINDS[kind]}'" if kind in KINDS else "NULL"
        parts.append(f"SELECT '{graph}', {s}, '{name}.{c}', {o}, '{'iri' if kind.startswith('fk:') else 'literal'}', {dt} FROM {table} WHERE {where} AND {c} IS NOT NULL")
    return " UNION ALL ".join(parts)


#: The columns of the orders mapped by the queries.
ORDERS = {"o_custkey": "fk:customer", "o_orderstatus": "str", "o_totalprice": "money", "o_orderdate": "date", "o_orderpriority": "str"}
CUSTOMERS = {"c_name": "str", "c_nationkey": "fk:nation", "c_acctbal": "money", "c_mktsegment": "str"}


def order_models(orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Model A: all orders; model B: without every 97th key, with another status for every 31st,
    and a copy under a new id of every 89th."""
    a = statements(orders, "A", "orders", "o_orderkey", "cim:Order", ORDERS)
    k = F.col("o_orderkey")
    changed = orders.where(k % 97 != 0).withColumn("o_orderstatus", F.when(k % 31 == 0, "X").otherwise(F.col("o_orderstatus")))
    b = statements(changed, "B", "orders", "o_orderkey", "cim:Order", ORDERS)
    new = statements(orders.where(k % 89 == 0), "B", "orders", "o_orderkey", "cim:Order", ORDERS, F.concat(F.lit("orders/"), k.cast("string"), F.lit("-new")))
    return a, b.unionByName(new)


A_SQL = sql("orders", "A", "orders", "o_orderkey", "cim:Order", ORDERS)
B_SQL = (
    sql("orders", "B", "orders", "o_orderkey", "cim:Order", ORDERS, "o_orderkey % 97 <> 0", change={"o_orderstatus": "CASE WHEN o_orderkey % 31 = 0 THEN 'X' ELSE o_orderstatus END"})
    + " UNION ALL "
    + sql("orders", "B", "orders", "o_orderkey", "cim:Order", ORDERS, "o_orderkey % 89 = 0", subject="'orders/' || o_orderkey || '-new'")
)
