"""Counts and checks over an ontology, as reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kedrion.functions.text import is_blank, level_of
from kedrion.functions.vectors import cosine


def level_histogram(sections: DataFrame) -> DataFrame:
    return sections.groupBy("level").agg(F.count("*").alias("n_sections"))


def orphan_sections(sections: DataFrame) -> DataFrame:
    """Sections that are no roots and have no parent."""
    return sections.filter("level <> 1 and parent_id is null").select("id", "level")


def caption_check(text_nodes: DataFrame, edges: DataFrame) -> DataFrame:
    nodes = text_nodes.agg(F.count(F.when(F.col("node_type") == "caption", 1)).alias("caption_nodes"))
    drawn = edges.agg(F.count(F.when(F.col("relation_type") == "CAPTIONS", 1)).alias("caption_edges"))
    return nodes.crossJoin(F.broadcast(drawn))  # one row each


def raw_section_levels(nodes: DataFrame) -> DataFrame:
    has = level_of(F.col("attributes")).isNotNull()
    rows = nodes.filter("type = 'Section'")
    return rows.agg(F.count(F.when(has, 1)).alias("with_level"), F.count(F.when(~has, 1)).alias("without_level"))


def phantom_sections(nodes: DataFrame, sections: DataFrame) -> DataFrame:
    """Section ids that only ever came without a usable level, with whether they leaked into the sections."""
    rows = nodes.filter("type = 'Section' and id is not null").groupBy("id").agg(F.max(level_of(F.col("attributes"))).alias("best"))
    known = sections.select("id", F.lit(True).alias("__known"))
    return rows.filter("best is null").join(known, "id", "left").select("id", F.coalesce("__known", F.lit(False)).alias("leaked"))


def embedding_coverage(text_nodes: DataFrame) -> DataFrame:
    blank, none = is_blank(F.col("text")), F.col("embedding").isNull()
    return text_nodes.agg(F.count(F.when(~blank & none, 1)).alias("text_without_vector"), F.count(F.when(blank & ~none, 1)).alias("blank_with_vector"))


def pair_cosines(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """``id_a``, ``id_b``, ``cos`` of given pairs; vectors: ``id``, ``vector``."""
    a, b = vectors.toDF("id_a", "va"), vectors.toDF("id_b", "vb")
    return pairs.join(a, "id_a").join(b, "id_b").select("id_a", "id_b", F.round(cosine(F.col("va"), F.col("vb")), 6).alias("cos"))
