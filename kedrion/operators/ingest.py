"""Typed scans of the nodes and the links of the graph.

Every scan filters first and removes duplicates after: of the rows of one id that pass, the last gives the
values and the first the position.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kedrion.functions.text import is_page_number, level_of
from kedrion.session import staged_with


@dataclass(frozen=True)
class Ontology:
    """``sections``: seq, id, level, parent_id; ``children``: parent_id, child_id, child_ord;
    ``text_nodes``: seq, id, section_id, node_type, text; ``edges``: seq, from_id, to_id, relation_type."""

    sections: DataFrame
    children: DataFrame
    text_nodes: DataFrame
    edges: DataFrame


def last_values(rows: DataFrame, *columns: str) -> DataFrame:
    """As ``last_by_id`` for a few narrow columns, which go along in one aggregate with map-side combining."""
    best = F.max_by(F.struct(*columns), "seq").alias("__v")
    found = rows.filter("id is not null").groupBy("id").agg(F.min("seq").alias("seq"), best)
    return found.select("seq", "id", *[F.col("__v")[c].alias(c) for c in columns])


#: Ids with several rows are broadcast up to so many (id and two numbers).
FEW_REPEATED = 200_000


def last_by_id(rows: DataFrame, *columns: str) -> DataFrame:
    """``seq`` (first position) and ``columns`` (values of the last row) of every id.

    Only ids and positions are shuffled; rows of ids that occur once stay where they are, texts and vectors with them.
    """
    rows = rows.filter("id is not null").select("seq", "id", *columns)
    places = rows.groupBy(F.col("id").alias("__id")).agg(F.min("seq").alias("__first"), F.max("seq").alias("__last"), F.count("*").alias("__n"))
    again, seen = staged_with(places.filter("__n > 1").drop("__n"), "repeated-ids", rows=F.count("*"))
    if not seen["rows"]:
        return rows
    again = F.broadcast(again) if seen["rows"] <= FEW_REPEATED else again
    joined = rows.join(again, F.col("id") == F.col("__id"), "left")
    once = joined.filter("__id is null").select("seq", "id", *columns)
    last = joined.filter("seq = __last").dropDuplicates(["id"]).select(F.col("__first").alias("seq"), "id", *columns)
    return once.unionByName(last)


def section_scan(nodes: DataFrame) -> DataFrame:
    """Real sections: those with a usable level."""
    rows = nodes.filter("type = 'Section'").select("seq", "id", level_of(F.col("attributes")).alias("level"))
    return last_values(rows.filter("level is not null"), "level")


def figure_scan(nodes: DataFrame) -> DataFrame:
    return last_by_id(nodes.filter("type = 'Figure'"), "text")


def chunk_scan(nodes: DataFrame) -> DataFrame:
    """Chunks that are no page numbers; an absent text is empty."""
    rows = nodes.filter("type = 'Chunk'").filter(~is_page_number(F.col("text")))
    return last_by_id(rows.select("seq", "id", F.coalesce("text", F.lit("")).alias("text")), "text").withColumn("node_type", F.lit("chunk"))


def page_number_chunks(nodes: DataFrame) -> DataFrame:
    return nodes.filter("type = 'Chunk'").filter(is_page_number(F.col("text"))).select("seq", "id", "text")


def node_kinds(nodes: DataFrame) -> DataFrame:
    """What becomes of the rows of each type."""
    fate = (
        F.when(F.col("type") == "Section", F.when(level_of(F.col("attributes")).isNotNull(), "section").otherwise("dropped"))
        .when(F.col("type") == "Figure", "figure")
        .when(F.col("type") == "Chunk", F.when(is_page_number(F.col("text")), "dropped").otherwise("text_node"))
        .otherwise("dropped")
    )
    return nodes.groupBy("type", fate.alias("fate")).agg(F.count("*").alias("n_rows"))


def adjacency(edges: DataFrame) -> DataFrame:
    """All edges, of any type, dangling or not, with their place among those of their source."""
    place = F.row_number().over(Window.partitionBy("from_id").orderBy("seq"))
    return edges.select("seq", "from_id", "to_id", "relation_type", place.alias("adj_ord"))


def _between(edges: DataFrame, relation: str, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges of one type whose ends both exist."""
    rows = edges.filter(F.col("relation_type") == relation).select("seq", "from_id", "to_id")
    rows = rows.join(sources.select(F.col("id").alias("from_id")), "from_id", "left_semi")
    return rows.join(targets.select(F.col("id").alias("to_id")), "to_id", "left_semi")


def section_links(sections: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sections with ``parent_id`` - the last edge wins; children in the order of the edges, all kept)."""
    links = _between(edges, "HAS_SUBSECTION", sections, sections)
    parents = links.groupBy(F.col("to_id").alias("id")).agg(F.max_by("from_id", "seq").alias("parent_id"))
    place = F.row_number().over(Window.partitionBy("from_id").orderBy("seq"))
    children = links.select(F.col("from_id").alias("parent_id"), F.col("to_id").alias("child_id"), place.alias("child_ord"))
    return sections.join(parents, "id", "left").select("seq", "id", "level", "parent_id"), children


def chunk_links(chunks: DataFrame, sections: DataFrame, edges: DataFrame) -> DataFrame:
    """Text nodes with ``section_id``: the last HAS_CHUNK edge from a real section."""
    owner = _between(edges, "HAS_CHUNK", sections, chunks).groupBy(F.col("to_id").alias("id")).agg(F.max_by("from_id", "seq").alias("section_id"))
    return chunks.join(owner, "id", "left").select("seq", "id", "section_id", "node_type", "text")


def caption_retype(text_nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Text nodes that any CAPTIONS edge starts from become captions, whether or not its end exists."""
    sources = edges.filter("relation_type = 'CAPTIONS'").select(F.col("from_id").alias("id")).distinct().withColumn("__caption", F.lit(True))
    kind = F.when(F.col("__caption"), "caption").otherwise(F.col("node_type"))
    return text_nodes.join(sources, "id", "left").withColumn("node_type", kind).drop("__caption")


def load_ontology(nodes: DataFrame, edges: DataFrame) -> Ontology:
    sections = section_scan(nodes)
    linked, children = section_links(sections, edges)
    texts = caption_retype(chunk_links(chunk_scan(nodes), sections, edges), edges)
    return Ontology(linked, children, texts, edges.select("seq", "from_id", "to_id", "relation_type"))
