"""Seed selection: threshold-guided descent of the section tree, level by level, for all queries at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kedrion.functions.text import is_blank
from kedrion.functions.vectors import cosine, nearest
from kedrion.session import staged, staged_with


@dataclass(frozen=True)
class DrillConfig:
    tau_local: float = 0.35
    tau_child: float = 0.45
    margin: float = 0.05
    top_k: int = 2


def root_ranking(queries: DataFrame, sections: DataFrame, top_r: int) -> DataFrame:
    """The ``top_r`` level-1 sections of each query by the similarity of their subtree; ties keep file order."""
    roots = sections.filter("level = 1").select("id", "seq", F.col("e_subtree").alias("vector"))
    return nearest(queries, roots, top_r).select("query_id", F.col("id").alias("section_id"), "sim", "rank")


def known(sections: DataFrame) -> DataFrame:
    """What the descent needs of sections: ``id``, ``seq``, ``level``, ``e_local``, ``e_subtree``, ``blank``."""
    blank = F.col("blank") if "blank" in sections.columns else is_blank(F.col("local_text"))
    return sections.select("id", "seq", "level", "e_local", "e_subtree", blank.alias("blank"))


def child_scores(frontier: DataFrame, queries: DataFrame, sections: DataFrame, children: DataFrame) -> DataFrame:
    """``query_id``, ``section_id``, ``child_id``, ``child_ord``, ``sim``: every child of the frontier's sections, once for each link."""
    target = sections.select(F.col("id").alias("child_id"), F.col("e_subtree").alias("__v"))
    links = children.select(F.col("parent_id").alias("section_id"), "child_id", "child_ord")
    rows = frontier.join(links, "section_id").join(target, "child_id").join(queries.select("query_id", "q_emb"), "query_id")
    return rows.select("query_id", "section_id", "child_id", "child_ord", F.round(cosine(F.col("q_emb"), F.col("__v")), 9).alias("sim"))


def decide(frontier: DataFrame, queries: DataFrame, sections: DataFrame, children: DataFrame, cfg: DrillConfig) -> tuple[DataFrame, DataFrame]:
    """(decision of every frontier section, children ranked within their section); children are scored once."""
    scores = child_scores(frontier, queries, sections, children)
    order = Window.partitionBy("query_id", "section_id").orderBy(F.desc("sim"), "child_ord")
    ranked = staged(scores.withColumn("child_rank", F.row_number().over(order)), "drill")
    best = ranked.filter("child_rank = 1").select("query_id", "section_id", F.col("sim").alias("best"))
    own = known(sections).select(F.col("id").alias("section_id"), "e_local", "blank")
    rows = frontier.join(own, "section_id").join(queries.select("query_id", "q_emb"), "query_id").join(best, ["query_id", "section_id"], "left")
    rows = rows.withColumn("best", F.coalesce("best", F.lit(-1.0))).withColumn("local", F.round(cosine(F.col("q_emb"), F.col("e_local")), 9))
    seed = ~F.col("blank") & (F.col("local") >= F.col("best") - cfg.margin) & (F.col("local") >= cfg.tau_local)
    outcome = F.when(seed, "seed").when(F.col("best") >= cfg.tau_child, "drill").otherwise("prune")
    return rows.withColumn("outcome", outcome).drop("q_emb", "e_local"), ranked


def select_seeds(queries: DataFrame, sections: DataFrame, children: DataFrame, cfg: DrillConfig = DrillConfig(), top_r: int = 3) -> DataFrame:
    """``query_id``, ``section_id``, ``rank``: the distinct seeds of every query, in the order they are met.

    A section once visited for a query is not visited again: what follows from it is the same, so the
    seeds are too, and cycles of child links end.  ``rank`` follows (level, root, place among the
    children drilled into).
    """
    sections, children = staged(known(sections), "drill-sections"), staged(children.select("parent_id", "child_id", "child_ord"), "drill-children")
    frontier = root_ranking(queries, sections, top_r).select("query_id", "section_id", F.array(F.col("rank").cast("int")).alias("way"))
    frontier = staged(frontier, "drill")
    visited, seeds, level = frontier.select("query_id", "section_id"), None, 0
    while True:
        decided, ranked = decide(frontier, queries, sections, children, cfg)
        decided = staged(decided, "drill")
        found = decided.filter("outcome = 'seed'").select("query_id", "section_id", F.lit(level).alias("level"), "way")
        seeds = found if seeds is None else seeds.unionByName(found)
        open_ = decided.filter("outcome = 'drill'").select("query_id", "section_id", "way")
        step = open_.join(ranked.filter(F.col("child_rank") <= cfg.top_k), ["query_id", "section_id"])
        step = step.select("query_id", F.col("child_id").alias("section_id"), F.concat("way", F.array(F.col("child_rank").cast("int"))).alias("way"))
        step = step.groupBy("query_id", "section_id").agg(F.min("way").alias("way")).join(visited, ["query_id", "section_id"], "left_anti")
        frontier, seen = staged_with(step, "drill", rows=F.count("*"))
        if not seen["rows"]:
            break
        visited = visited.unionByName(frontier.select("query_id", "section_id"))  # parts that are each staged
        level += 1
    order = Window.partitionBy("query_id").orderBy("level", "way")
    return seeds.select("query_id", "section_id", F.row_number().over(order).alias("rank"))
