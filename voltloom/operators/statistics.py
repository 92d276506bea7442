"""Statistics of validation results: conditional aggregations, partial before their shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def severity_counts(severity: Column) -> list[Column]:
    """violations, warnings, infos: what is neither a violation nor a warning is an info."""
    v, w = severity.contains("Violation"), severity.contains("Warning")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    return [count(v).alias("violations"), count(w & ~v).alias("warnings"), count(~v & ~w).alias("infos")]


def severity_statistics(results: DataFrame, *by: str) -> DataFrame:
    """by, all_results, violations, warnings, infos, conforms: no result at all and no error."""
    g = results.groupBy(*by).agg(*severity_counts(F.coalesce("severity", F.lit(""))), F.count("focus_node").alias("all_results"), F.max("error").alias("validation_error"))
    return g.withColumn("conforms", (F.col("all_results") == 0) & F.col("validation_error").isNull())


def constraint_statistics(results: DataFrame, *by: str) -> DataFrame:
    return results.groupBy(*by).agg(F.count("*").alias("n"))


def overview(results: DataFrame, *by: str) -> DataFrame:
    """by, violations, warnings, infos, errors, worst severity (errors last) and priority (errors first)."""
    valid = F.when(F.col("error").isNull(), F.col("severity"))
    g = results.groupBy(*by).agg(*severity_counts(F.coalesce(valid, F.lit("Violation none"))), F.count("error").alias("errors"), F.count("*").alias("rows"))
    g = g.withColumn("violations", F.col("violations") - F.col("errors"))
    worst = F.when(F.col("violations") > 0, "Violation").when(F.col("warnings") > 0, "Warning").when(F.col("infos") > 0, "Info").when(F.col("errors") > 0, "Validation error").otherwise("OK")
    first = F.when(F.col("errors") > 0, "error").when(F.col("violations") > 0, "violation").when(F.col("warnings") > 0, "warning").otherwise("OK")
    return g.withColumn("worst", worst).withColumn("priority", first)


def auto_test(expected: DataFrame, fired: DataFrame) -> DataFrame:
    """(rule, file, verdict) of rule tests that went wrong. expected: (rule, category, file),
    fired: distinct (file, rule)."""
    j = expected.join(fired.distinct().withColumn("hit", F.lit(True)), ["file", "rule"], "left")
    conform = F.lower("category") == "conform"
    verdict = F.when(conform & F.col("hit"), "unexpected trigger").when(~conform & F.col("hit").isNull(), "expected trigger not found")
    return j.select("rule", "file", verdict.alias("verdict")).where("verdict is not null")
