"""Linear score of reached text nodes and the best k of each query."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kedrion.functions.vectors import cosine

FAR = 999


def _types() -> dict[str, float]:
    return {"list_item": 1.0, "chunk": 0.6, "section_title": 0.8, "caption": 0.2}  # fixed values


def _levels() -> dict[int, float]:
    return {1: 0.1, 2: 0.2, 3: 0.3}  # fixed values


@dataclass(frozen=True)
class ScoreConfig:
    w_text: float = 1.0
    w_type: float = 0.3
    w_level: float = 0.15
    w_dist: float = 0.2
    type_bonus: dict[str, float] = field(default_factory=_types)
    level_bonus: dict[int, float] = field(default_factory=_levels)


def _bonus(values: dict, of: Column) -> Column:
    if not values:
        return F.lit(0.0)
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.try_element_at(table, of), F.lit(0.0))


def node_scores(reached: DataFrame, queries: DataFrame, text_nodes: DataFrame, sections: DataFrame, cfg: ScoreConfig = ScoreConfig()) -> DataFrame:
    """``query_id``, ``node_id``, ``seq``, ``section_id``, ``node_type``, ``text``, ``sim``, ``dist``, ``score`` of reached text nodes.

    No embedding counts as similarity -1; a node without a known section as level 1.
    """
    nodes = text_nodes.select(F.col("id").alias("node_id"), "seq", "section_id", "node_type", "text", "embedding")
    levels = sections.select(F.col("id").alias("section_id"), "level")
    rows = reached.select("query_id", F.col("id").alias("node_id"), "dist").join(nodes, "node_id").join(levels, "section_id", "left")
    rows = rows.join(queries.select("query_id", "q_emb"), "query_id")
    sim = cosine(F.col("q_emb"), F.col("embedding"))
    score = (
        cfg.w_text * sim
        + cfg.w_type * _bonus(cfg.type_bonus, F.col("node_type"))
        + cfg.w_level * _bonus(cfg.level_bonus, F.coalesce("level", F.lit(1)))
        - cfg.w_dist * F.coalesce("dist", F.lit(FAR))
    )
    return rows.select("query_id", "node_id", "seq", "section_id", "node_type", "text", sim.alias("sim"), "dist", F.round(score, 9).alias("score"))


def top_nodes(scores: DataFrame, top_k: int = 20) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "seq")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)
