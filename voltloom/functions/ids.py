"""Identifiers and values of statement rows as Column expressions, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The white space of the tables (space, tab, line feed, carriage return, no-break space).
BLANKS = " \t\n\r "
_UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
_RUN = "[ \\t\\n\\r ]+"


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, found by exact name, first one first; other columns may have any name,
    the same name in another letter case too."""
    own = df.columns
    missing = [n for n in names if n not in own]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.toDF(*[f"__{i}" for i in range(len(own))]).select(*[F.col(f"__{own.index(n)}").alias(n) for n in names])


def trimmed(c: Column) -> Column:
    """Without white space at the ends."""
    return F.btrim(c, F.lit(BLANKS))


def not_blank(c: Column) -> Column:
    """Neither null, empty nor white space only."""
    return F.coalesce(F.length(trimmed(c)) > 0, F.lit(False))


def one_spaced(c: Column) -> Column:
    """Each run of white space made one space, the ends cut."""
    return trimmed(F.regexp_replace(c, _RUN, " "))


def object_id(c: Column) -> Column:
    """``urn:uuid:u`` with u in lower case for both spellings of a uuid object; else unchanged."""
    return (
        F.when(c.startswith("#_") & c.rlike(f"^#_{_UUID}\\z"), F.concat(F.lit("urn:uuid:"), F.lower(F.substring(c, 3, 36))))
        .when(c.rlike(f"^(?i:urn:uuid:){_UUID}\\z"), F.lower(c))
        .otherwise(c)
    )


def is_full(c: Column) -> Column:
    """An identifier that no prefix table is needed for."""
    return c.rlike("^([A-Za-z][A-Za-z0-9+.-]*://|(?i:urn:)|#)") | ~c.contains(":")


def expand(df: DataFrame, prefixes: DataFrame, value: str, graph: str = "graph") -> DataFrame:
    """``value`` as full IRI (uuid objects canonical): ``prefix:Name`` is looked up in the prefixes
    of the row's graph. A prefix that the graph doesn't declare leaves the value as it is; of
    several namespaces of one prefix in one graph the smallest counts.

    Rows that need no lookup get spread keys, so that they fill no single partition of the join;
    Catalyst broadcasts the prefix table only where its size is under the session's threshold, and
    AQE splits the partitions of a graph that holds many rows."""
    table = (
        pick(prefixes, "graph", "prefix", "ns")
        .where("graph is not null and prefix is not null and ns is not null")
        .groupBy(F.col("graph").alias("__pg"), F.col("prefix").alias("__pp"))
        .agg(F.min("ns").alias("__ns"))
    )
    v = F.col(value)
    key = F.when(is_full(v) | v.isNull(), F.concat(F.lit("\0"), F.pmod(F.hash(*df.columns), F.lit(997)))).otherwise(F.substring_index(v, ":", 1))
    full = F.when(F.col("__ns").isNotNull(), F.concat("__ns", F.expr(f"substring(`{value}`, length(__key) + 2)"))).otherwise(object_id(v))
    return (
        df.withColumn("__key", key)
        .join(table, (F.col(graph) == F.col("__pg")) & (F.col("__key") == F.col("__pp")), "left")
        .withColumn(value, full)
        .drop("__pg", "__pp", "__ns", "__key")
    )


def readable(c: Column) -> Column:
    """'true' or 'false' if the text is true, false, 1 or 0 in any letter case, else null."""
    t = F.lower(trimmed(c))
    return F.when(t.isin("true", "1"), F.lit("true")).when(t.isin("false", "0"), F.lit("false"))


def local_name(c: Column) -> Column:
    """What follows the last '#' or '/' of an IRI."""
    return F.regexp_extract(c, r"[^#/]*$", 0)


def namespace(c: Column) -> Column:
    """An IRI up to its last '#' or '/'."""
    return F.regexp_extract(c, r"^(.*[#/])", 1)
