"""Streaming ingest: the typed scans over arriving nodes and edges.

The reference model is a batch one; its stateless scans hold for streams as they are.  Arriving files are
read with a stated schema and no state is held by the stream: an id that is loaded again keeps all its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kedrion.functions.text import is_page_number, level_of

NODES = "seq bigint, id string, type string, text string, attributes string"
EDGES = "seq bigint, from_id string, to_id string, relation_type string"


def node_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(NODES).parquet(folder)


def chunks(nodes: DataFrame) -> DataFrame:
    """Arriving chunks that are no page numbers."""
    rows = nodes.filter("type = 'Chunk'").filter(~is_page_number(F.col("text")))
    return rows.select("seq", "id", F.coalesce("text", F.lit("")).alias("text"), F.lit("chunk").alias("node_type"))


def sections(nodes: DataFrame) -> DataFrame:
    """Arriving sections with a usable level."""
    rows = nodes.filter("type = 'Section'").select("seq", "id", level_of(F.col("attributes")).alias("level"))
    return rows.filter("level is not null")
