"""An index from ready tables of sections and text nodes (versioned rows; those that stand are used)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kedrion.operators.ingest import last_by_id
from kedrion.sources.index_store import Index
from kedrion.sources.json_ontology import live


def tree_of(sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sections that stand, their children in order)."""
    known = last_by_id(live(sections), "level", "parent_id", "children_ids", "local_text", "subtree_text", "e_local", "e_subtree")
    listed = known.select(F.col("id").alias("parent_id"), F.posexplode("children_ids").alias("pos", "child_id"))
    children = listed.select("parent_id", "child_id", (F.col("pos") + 1).alias("child_ord"))
    children = children.join(known.select(F.col("id").alias("child_id")), "child_id", "left_semi").select("parent_id", "child_id", "child_ord")
    return known.drop("children_ids"), children


def texts_of(text_nodes: DataFrame) -> DataFrame:
    """Text nodes that stand."""
    return last_by_id(live(text_nodes), "section_id", "node_type", "text", "embedding")


def index_of(sections: DataFrame, text_nodes: DataFrame, edges: DataFrame) -> Index:
    known, children = tree_of(sections)
    return Index(known, children, texts_of(text_nodes), edges.select("seq", "from_id", "to_id", "relation_type"))
