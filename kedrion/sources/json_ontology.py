"""Sources: the two JSON files of an ontology, and the same as tables.

A file is one JSON array, or JSON Lines (``.jsonl``, ``.ndjson``: one item a line, read in parallel).  Either
scan keeps the position of every item as ``seq``; order is semantic throughout (it decides
which duplicate wins, the order of texts and of children), and is never taken from partition order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINES = (".jsonl", ".ndjson", ".jsonl.gz", ".ndjson.gz")


def load_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Items with their place in the file: ``seq`` and the columns of ``schema``; other keys are ignored.

    An array is one file and one task (its rows stream through one parser); large input should be JSON Lines.
    """
    if not path.rstrip("/").endswith(LINES):
        items = spark.read.schema(schema).option("multiLine", True).json(path)
        return items.select(F.monotonically_increasing_id().alias("seq"), "*")  # one file, one partition
    items = spark.read.schema(schema).json(path)
    meta = F.col("_metadata")
    items = items.select("*", meta["file_path"].alias("__file"), meta["file_size"].alias("__size"), meta["file_block_start"].alias("__start"), F.monotonically_increasing_id().alias("__at"))
    # a row takes a byte at least, so (bytes before the split) + (place in the split) is unique and in order
    splits = items.groupBy("__file", "__size", "__start").agg(F.min("__at").alias("__low"))
    files = splits.select("__file", "__size").distinct()
    before = F.coalesce(F.sum("__size").over(Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a file
    splits = splits.drop("__size").join(files.select("__file", before.alias("__before")), "__file")
    placed = items.join(F.broadcast(splits), ["__file", "__start"])  # one row a split
    return placed.withColumn("seq", F.col("__before") + F.col("__start") + F.col("__at") - F.col("__low")).select("seq", *[c for c in items.columns if not c.startswith("__")])


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """``seq``, ``id``, ``type``, ``text``, ``attributes`` (JSON text); unknown keys are ignored."""
    return load_json(spark, path, "id string, type string, text string, attributes string")


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """``seq``, ``from_id``, ``to_id``, ``relation_type``: no validation, nothing removed."""
    items = load_json(spark, path, "source string, target string, type string")
    return items.select("seq", F.col("source").alias("from_id"), F.col("target").alias("to_id"), F.col("type").alias("relation_type"))


def live(rows: DataFrame) -> DataFrame:
    """Rows of a versioned table that stand (the content of the node file as of now)."""
    return rows.filter("removed_at is null") if "removed_at" in rows.columns else rows
