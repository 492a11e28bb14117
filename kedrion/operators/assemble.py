"""Section candidates with their full texts, the graph context and the result document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kedrion.functions.text import first_line, joined, ordinal, stripped


def section_texts(text_nodes: DataFrame) -> DataFrame:
    """``section_id``, ``text``: all text nodes of each section by the number in their ids, then file order."""
    order = F.struct(ordinal(F.col("id")).alias("n"), F.col("seq").alias("s"))
    rows = text_nodes.filter("section_id is not null").withColumn("__o", order)
    return rows.groupBy("section_id").agg(stripped(joined(F.col("text"), F.col("__o"))).alias("text"))


def section_candidates(ranked: DataFrame, sections: DataFrame, text_nodes: DataFrame) -> DataFrame:
    """``query_id``, ``section_id``, ``title``, ``text``, ``score``, ``node_ids``, ``rank`` of the sections of the ranked nodes.

    Only the text nodes of candidate sections are gathered.
    """
    known = ranked.filter("section_id is not null")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "node_id"))), lambda x: x["node_id"])
    found = known.groupBy("query_id", "section_id").agg(F.max("score").alias("score"), ids.alias("node_ids"), F.min("rank").alias("first_rank"))
    wanted = text_nodes.join(found.select("section_id").distinct(), "section_id", "left_semi")
    titles = sections.select(F.col("id").alias("section_id"), F.coalesce(first_line(F.col("local_text")), F.lit("")).alias("title"))
    rows = found.join(section_texts(wanted), "section_id", "left").join(titles, "section_id", "left")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), ordinal(F.col("section_id")), "first_rank")
    return rows.select("query_id", "section_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"), "score", "node_ids", F.row_number().over(order).alias("rank"))


def graph_context(reached: DataFrame, traversed: DataFrame) -> DataFrame:
    """``query_id``, ``nodes``, ``edges``, each in the order they were met.  Both ends of an edge that ``expand`` emits are reached."""
    drawn = F.transform(
        F.array_sort(F.collect_list(F.struct("ord", "from_id", "to_id", "relation_type"))),
        lambda x: F.struct(x["from_id"].alias("from"), x["to_id"].alias("to"), x["relation_type"].alias("type")),
    )
    nodes = reached.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("nodes"))
    return nodes.join(traversed.groupBy("query_id").agg(drawn.alias("edges")), "query_id", "left").withColumn(
        "edges", F.coalesce("edges", F.array().cast("array<struct<from:string,to:string,type:string>>"))
    )


def result_documents(queries: DataFrame, ranked: DataFrame, candidates: DataFrame, context: DataFrame) -> DataFrame:
    """One row for each query: ``query_id``, ``query``, ``section_candidates``, ``text_nodes``, ``graph_context``."""
    nodes = ranked.groupBy("query_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "node_id", "section_id", F.col("node_type").alias("type"), "text", "score"))), lambda x: x.dropFields("rank")
    ).alias("text_nodes"))
    parts = candidates.groupBy("query_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "section_id", "title", "text", "score", "node_ids"))), lambda x: x.dropFields("rank")
    ).alias("section_candidates"))
    rows = queries.select("query_id", "query").join(parts, "query_id", "left").join(nodes, "query_id", "left")
    graph = context.select("query_id", F.struct("nodes", "edges").alias("graph_context"))
    rows = rows.join(graph, "query_id", "left")
    kinds = {f.name: f.dataType for f in rows.schema}
    return rows.select(
        "query_id", "query",
        F.coalesce("section_candidates", F.array().cast(kinds["section_candidates"])).alias("section_candidates"),
        F.coalesce("text_nodes", F.array().cast(kinds["text_nodes"])).alias("text_nodes"),
        F.coalesce("graph_context", F.struct(F.array().cast("array<string>").alias("nodes"), F.array().cast("array<struct<from:string,to:string,type:string>>").alias("edges"))).alias("graph_context"),
    )
