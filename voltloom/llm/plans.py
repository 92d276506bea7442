"""The queries of problems 6 to 8, and SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import cut, table
from . import bpe, pack, sizes, split

TOKENIZER = "byte_bpe_50k"


def _limits(spark: SparkSession, d: str, purpose: str) -> list:
    """The rows of token_limits, a table of fixed size."""
    rows = table(spark, d, "token_limits").where((F.col("purpose") == purpose) & (F.col("tokenizer") == TOKENIZER))
    return rows.select("limit_id", "capacity", "overlap").where("capacity > 0").distinct().orderBy("limit_id").collect()


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents"), bpe.tokenizer_path(TOKENIZER))


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Each document's text as encoded and decoded again."""
    path = bpe.tokenizer_path(TOKENIZER)
    return bpe.decode(bpe.encode(table(spark, d, "documents"), path), path).select("doc_id", "text")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    items = sizes.sizes(table(spark, d, "documents"), bpe.tokenizer_path(TOKENIZER))
    return pack.pack(items, {r.limit_id: r.capacity for r in _limits(spark, d, "container")}, cut).withColumnRenamed("id", "doc_id")


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, the least number that any packing takes by the sum of the tokens, unused space, and
    the fullest container of each capacity."""
    per = p7_containers(spark, d).groupBy("limit_id", "capacity", "container").agg(F.sum("n").alias("used"))
    space = F.count("*") * F.first("capacity") - F.sum("used")
    return per.groupBy("limit_id", "capacity").agg(
        F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.ceil(F.sum("used") / F.first("capacity")).alias("least"), space.alias("unused"), F.max("used").alias("fullest")
    )


def p6_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Rows, and what must hold of the ids of each document: none for an empty text, else one to a byte at most."""
    text = table(spark, d, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"))
    j = p6_ids(spark, d).select("doc_id", F.size("ids").alias("n")).join(text, "doc_id")
    return j.select("doc_id", "bytes", ((F.col("n") <= F.col("bytes")) & ((F.col("n") == 0) == (F.col("bytes") == 0))).alias("holds"))


def p7_holds(spark: SparkSession, d: str) -> DataFrame:
    """(limit_id, doc_id, holds) of each document with ids: its parts follow each other from 0, no part is in
    two containers, only one larger than the capacity is cut, and none of its containers is overfull."""
    rows = p7_containers(spark, d)
    fill = rows.groupBy("limit_id", "container").agg(F.sum("n").alias("used"))
    j = rows.join(fill, ["limit_id", "container"])
    g = j.groupBy("limit_id", "capacity", "doc_id").agg(
        F.count("*").alias("parts"), F.countDistinct("part").alias("own"), F.sum("n").alias("n"), F.max(F.col("start") + F.col("n")).alias("end"), F.min("start").alias("first"), F.max("used").alias("used")
    )
    good = (F.col("parts") == F.col("own")) & (F.col("first") == 0) & (F.col("end") == F.col("n")) & (F.col("used") <= F.col("capacity"))
    return g.select("limit_id", "doc_id", (good & ((F.col("parts") == 1) | (F.col("n") > F.col("capacity")))).alias("holds"))


def p8_holds(spark: SparkSession, d: str) -> DataFrame:
    """(limit_id, doc_id, chars, holds) of each text with pieces: they cover it from its start to its end, each
    within the limit and, but for the first, repeating the stated overlap or marked as short of it."""
    limits = table(spark, d, "token_limits").select("limit_id", "capacity", "overlap").distinct()
    w = Window.partitionBy("limit_id", "doc_id").orderBy("piece")
    rows = p8_pieces(spark, d).drop("text").withColumn("end", F.col("start_char") + F.col("n_chars")).withColumn("before", F.lag("end").over(w)).join(F.broadcast(limits), "limit_id")
    joins = F.when(F.col("before").isNull(), F.col("start_char") == 0).otherwise((F.col("start_char") <= F.col("before")) & (F.col("end") > F.col("before")))
    good = joins & (F.col("n_tokens") <= F.col("capacity")) & ((F.col("piece") == 0) | F.col("overlap_short") | (F.col("overlap_tokens") >= F.col("overlap")))
    return rows.groupBy("limit_id", "doc_id").agg(F.max("end").alias("chars"), F.min(good).alias("holds"))


def p8_pieces(spark: SparkSession, d: str) -> DataFrame:
    limits = [(r.limit_id, r.capacity, r.overlap or 0) for r in _limits(spark, d, "piece")]
    return split.split(table(spark, d, "documents"), bpe.tokenizer_path(TOKENIZER), limits).withColumnRenamed("id", "doc_id")


#: SQL can't count tokens: it says for which documents the query must come out, and that all is well there.
SQL = {
    "p6_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p6_sizes": "SELECT doc_id, coalesce(strlen(text), 0) AS bytes, true AS holds FROM documents",
    "p7_holds": "SELECT limit_id, doc_id, true AS holds FROM documents, (SELECT DISTINCT limit_id FROM token_limits WHERE purpose = 'container' AND tokenizer = 'byte_bpe_50k' AND capacity > 0) WHERE strlen(text) > 0",
}


def queries() -> dict:
    return {n: f for n, f in globals().items() if n[:1] == "p" and n[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
