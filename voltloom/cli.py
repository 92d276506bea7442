"""python -m voltloom.cli manifest --dir MODELS --output OUT: a dataset description for each model file, as
Turtle. Exit code 0: written; 1: no model file; 2: wrong arguments; 3: a file can't be read."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.rdfs import manifest
from .sources import rdf, writers


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="voltloom")
    parser.add_argument("command", choices=["manifest"])
    parser.add_argument("--dir", required=True)
    parser.add_argument("--output", required=True)
    parser.add_argument("--access-url", default="")
    a = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    try:
        rows = manifest(rdf.short_names(rdf.read(spark, a.dir)))
        full = {p: ns for ns, p in rdf.NAMESPACES.items()}
        ns = F.create_map(*[x for p, n in full.items() for x in (F.lit(p), F.lit(n))])
        p = F.concat(F.element_at(ns, F.substring_index("p", ":", 1)), F.substring_index("p", ":", -1))
        t = rows.select("graph", F.col("dataset").alias("s"), F.lit("iri").alias("s_kind"), p.alias("p"), "o", F.when(F.col("o").rlike("^(https?://|urn:)"), "iri").otherwise("literal").alias("o_kind"), F.lit(None).cast("string").alias("o_dt"), F.lit(None).cast("string").alias("o_lang"))
        if a.access_url:
            link = t.select("graph", "s").distinct().select("graph", "s", F.lit("iri").alias("s_kind"), F.lit("http://www.w3.org/ns/dcat#accessURL").alias("p"), F.concat(F.lit(a.access_url.rstrip("/") + "/"), "graph").alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_dt"), F.lit(None).cast("string").alias("o_lang"))
            t = t.unionByName(link)
        out = writers.turtle_rows(t)
        if out.isEmpty():
            print("no model file", file=sys.stderr)
            return 1
        out.select("text").write.mode("overwrite").option("lineSep", "\n\n").text(a.output)
        return 0
    except Exception as e:  # noqa: BLE001
        print(f"can't read: {str(e)[:500]}", file=sys.stderr)
        return 3


if __name__ == "__main__":
    sys.exit(main())
