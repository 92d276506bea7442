"""Validation runs: mapping rows meet the files of each group and instant, and every run's files are
checked by the shapes of its row, all runs of a constraint file in one plan.

Runs never meet: the ids of a run's statements carry its key, so that all joins of the checks stay within
it and are spread over the cluster by run and subject.

Defined results: a row without inputs has no run; a file of several tokens of a row counts once; a run
whose inputs don't suffice (see ``run_decision``) gives no results but stays among the input checks."""

from __future__ import annotations

import json
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.files import BOUNDARY, PROFILES, TIMESTAMPED, applies_to, completeness, has_token, run_decision
from .shacl import Shape, validate
from .shapes import category, expand_inputs, resolve_inputs

#: Rows that a mapping, which users write, may have.
MOST_ROWS = 10_000
#: Kind of each profile.
KINDS = {p: "boundary" if p in BOUNDARY else "timestamped" if p in TIMESTAMPED else "static" for p in PROFILES}
_CUT = "\u0001"
_KEY = ["row", "grp", "at"]


def token_profiles(inputs: Column) -> Column:
    """The profiles that the tokens of a mapping row name, in the order of the tokens."""
    own = lambda t: F.array_compact(F.array(*[F.when(has_token(t, p), F.lit(p)) for p in PROFILES]))
    return F.array_distinct(F.flatten(F.transform(F.split(F.coalesce(inputs, F.lit("")), ";"), own)))


def timestamped_name(group: Column, at: Column, inputs: Column, files: Column) -> Column:
    """Name of a run's data: group, time and profiles, or the files' names where no profile is named."""
    found = token_profiles(inputs)
    named = F.when(F.size(files) > 0, F.array_join(files, " + ")).otherwise("UNKNOWN_PROFILES")
    return F.concat_ws("__", F.coalesce(group, F.lit("")), F.coalesce(at, F.lit("")), F.when(F.size(found) > 0, F.array_join(found, " + ")).otherwise(named))


def dataset_name(paths: Column) -> Column:
    """Name of the data of a run without time: CGM, else the folder of an individual model, else the
    first file's name. Folders are fixed values."""
    paths = F.array_sort(F.transform(paths, lambda p: F.replace(p, F.lit("\\"), F.lit("/"))))
    folders = F.filter(F.transform(paths, lambda p: F.regexp_extract(p, "Instance/Grid/(IGM_[^/]*)", 1)), lambda x: x != "")
    return (
        F.when(F.size(paths) == 0, "UNKNOWN")
        .when(F.exists(paths, lambda p: p.contains("Instance/Grid/CGM")), "CGM")
        .when((F.size(paths) > 1) & (F.size(folders) > 0), F.get(folders, F.lit(0)))
        .otherwise(F.element_at(F.split(F.get(paths, F.lit(0)), "/"), -1))
    )


def _resolved(mapping: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, ttl, xml_inputs, token, grp, at) of all tokens in all groups and instants, and the files of each."""
    rows = mapping.select("row", "ttl", "xml_inputs").limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError("too many rows for a mapping")
    config = F.from_json(F.lit(json.dumps([r.asDict() for r in rows])), "array<struct<row:int,ttl:string,xml_inputs:string>>")
    runs = files.select("grp", "at").distinct().select("grp", "at", F.inline(config))
    tokens = runs.select("*", F.explode(F.transform(F.split("xml_inputs", ";"), lambda x: F.trim(x))).alias("token")).where("token <> ''")
    tokens = tokens.withColumn("token", F.regexp_replace("token", "^(?i)ZIP:", ""))
    found = resolve_inputs(expand_inputs(mapping.select("row", "xml_inputs")), files, KINDS)
    return tokens.distinct(), found


def input_checks(mapping: DataFrame, files: DataFrame) -> DataFrame:
    """(row, grp, at, ttl, xml_inputs, expected, resolved, missing, missing_inputs, files, category, status,
    runs): what each mapping row (row, ttl, xml_inputs) has of its inputs in each group and instant.
    files: (profile, grp, at, file)."""
    tokens, found = _resolved(mapping, files)
    has = found.select("row", "token", "grp", "at").distinct().withColumn("has", F.lit(True))
    own = found.groupBy(*_KEY).agg(F.array_sort(F.collect_set("file")).alias("files"))  # files of one row and instant: few
    j = tokens.join(has, ["row", "token", "grp", "at"], "left")
    lacks = F.col("has").isNull()
    checks = j.groupBy(*_KEY, "ttl", "xml_inputs").agg(
        F.count("*").alias("expected"), F.count(F.when(lacks, 1)).alias("missing"), F.array_join(F.array_sort(F.collect_set(F.when(lacks, F.col("token")))), "; ").alias("missing_inputs"),
        F.coalesce(F.max(F.when(lacks, applies_to(F.col("token"), F.col("grp")))), F.lit(True)).alias("own"),
    )
    checks = checks.join(own, _KEY, "left").withColumn("files", F.coalesce("files", F.array().cast("array<string>")))
    counts = [F.size("files").cast("bigint"), F.col("missing"), ~F.col("own"), F.col("expected")]
    return checks.select(
        *_KEY, "ttl", "xml_inputs", "expected", counts[0].alias("resolved"), "missing", "missing_inputs", "files",
        category(F.col("ttl"), F.col("xml_inputs")).alias("category"), completeness(*counts).alias("status"), run_decision(*counts).alias("runs"),
    )


def validate_runs(t: DataFrame, checks: DataFrame, shapes: Mapping[str, list[Shape]], subclass: DataFrame | None = None) -> DataFrame:
    """(row, grp, at, ttl, dataset, and the columns of a result): all results of the runs among the input
    checks. shapes: constraint file -> its shapes. t: (graph, s, p, o, o_kind, o_dt)."""
    at = F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'") if dict(checks.dtypes)["at"].startswith("timestamp") else F.col("at").cast("string")
    name = timestamped_name(F.col("grp"), at, F.col("xml_inputs"), F.col("files"))
    run = F.concat_ws("|", F.col("row").cast("string"), F.coalesce("grp", F.lit("")), F.coalesce(at, F.lit("")))
    runs = checks.where("runs").select(*_KEY, "ttl", name.alias("dataset"), run.alias("run"), "files")
    data = runs.select("run", "ttl", F.explode("files").alias("graph")).join(t, "graph")
    mine = lambda c: F.concat("run", F.lit(_CUT), c)
    linked = F.col("o_kind").isin("iri", "bnode") & (F.col("p") != "rdf:type")
    data = data.select("ttl", mine("s").alias("s"), "p", F.when(linked, mine("o")).otherwise(F.col("o")).alias("o"), "o_kind", "o_dt").distinct()
    found = [validate(data.where(F.col("ttl") == ttl).drop("ttl"), own, subclass) for ttl, own in shapes.items() if own]
    plain = lambda c: F.regexp_replace(c, f"^[^{_CUT}]*{_CUT}", "")
    every = reduce(DataFrame.unionByName, found)
    every = every.withColumn("run", F.element_at(F.split("focus_node", _CUT), 1)).withColumn("focus_node", plain("focus_node")).withColumn("value", plain("value"))
    return every.join(runs.select(*_KEY, "ttl", "dataset", "run"), "run").drop("run")


def validate_by_timestamp(t: DataFrame, mapping: DataFrame, files: DataFrame, shapes: Mapping[str, list[Shape]], subclass: DataFrame | None = None) -> DataFrame:
    """The results of each mapping row in each group and instant."""
    return validate_runs(t, input_checks(mapping, files), shapes, subclass)


def validate_by_mapping(t: DataFrame, mapping: DataFrame, files: DataFrame, shapes: Mapping[str, list[Shape]], subclass: DataFrame | None = None) -> DataFrame:
    """The results of each mapping row over all files, without groups and times."""
    all_in_one = files.select("profile", F.lit("").alias("grp"), F.lit("").alias("at"), "file").distinct()
    return validate_runs(t, input_checks(mapping, all_in_one), shapes, subclass).drop("grp", "at", "dataset")
