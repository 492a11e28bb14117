"""Bounded breadth-first expansion over typed edges from several seeds, for all queries at once.

Level-synchronous, and equal to the walk by a queue: new targets of a level are ordered by (rank of the
node they are first met from, place of the edge), and the node budget cuts that order exactly, edges
included.  Work starts from the frontier: of the edge table only the edges of its nodes are taken (a semi join
with the broadcast nodes, before any shuffle), so what is shuffled and written grows with what the queries reach,
not with the table.  A node of very many edges costs no more than the budget: beyond the edge that meets the
budget-th distinct target nothing of it can be reached or emitted, so its edges are cut there first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kedrion.session import staged, staged_with

# The relations that are followed.
ALLOWED_RELATIONS = ("HAS_SUBSECTION", "HAS_CHUNK", "HAS_ITEM", "CAPTIONS", "LINKS_TO")
#: Frontiers of so many rows are broadcast (bounded by queries x budget, and checked).
FEW_NODES = 200_000


@dataclass(frozen=True)
class ExpandConfig:
    max_depth: int = 3
    max_nodes: int = 200


def edges_of(nodes: DataFrame, few: bool, edges: DataFrame, max_nodes: int, relations: tuple[str, ...] | None = ALLOWED_RELATIONS) -> DataFrame:
    """Edges from ``nodes`` (distinct ``from_id``; ``few``: they may be broadcast) of the relations followed, without those behind a node's ``max_nodes``-th distinct target."""
    small = F.broadcast if few else (lambda df: df)
    rows = edges.select("seq", "from_id", "to_id", "relation_type").filter("from_id is not null and to_id is not null")
    if relations is not None:
        rows = rows.filter(F.col("relation_type").isin(*relations))
    rows = rows.join(small(nodes), "from_id", "left_semi")
    first = rows.groupBy("from_id", "to_id").agg(F.min("seq").alias("s"))
    order = Window.partitionBy("from_id").orderBy("s")
    last = first.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= max_nodes).filter(F.col("n") == max_nodes)
    last = last.select("from_id", F.col("s").alias("last"))  # at most one row a node
    return rows.join(small(last), "from_id", "left").filter("last is null or seq <= last").drop("last")


def expand(seeds: DataFrame, edges: DataFrame, cfg: ExpandConfig = ExpandConfig(), relations: tuple[str, ...] | None = ALLOWED_RELATIONS) -> tuple[DataFrame, DataFrame]:
    """(``reached``: query_id, id, dist, rank; ``traversed``: query_id, seq, from_id, to_id, relation_type, ord).

    ``seeds``: query_id, id, rank.  Seeds are all kept, even beyond the budget.
    """
    seeds = seeds.groupBy("query_id", "id").agg(F.min("rank").alias("rank"))
    by_rank = Window.partitionBy("query_id").orderBy("rank")
    first = seeds.select("query_id", "id", F.lit(0).alias("dist"), F.row_number().over(by_rank).cast("bigint").alias("rank"))
    reached, seen = staged_with(first, "expand", rows=F.count("*"))
    frontier, emitted = reached, None
    for depth in range(cfg.max_depth):
        if not seen["rows"]:
            break
        state = reached.groupBy("query_id").agg(F.count("*").alias("held"), F.max("rank").alias("base")).filter(F.col("held") < cfg.max_nodes)
        active = frontier.join(state, "query_id").select("query_id", F.col("id").alias("from_id"), F.col("rank").alias("from_rank"), (F.lit(cfg.max_nodes) - F.col("held")).alias("left"), "base")
        few = seen["rows"] <= FEW_NODES
        own = edges_of(active.select("from_id").distinct(), few, edges, cfg.max_nodes, relations)
        step = staged(own.join(F.broadcast(active) if few else active, "from_id"), "expand")
        met = step.groupBy("query_id", F.col("to_id").alias("id")).agg(F.min(F.struct("from_rank", "seq")).alias("key"), F.min("left").alias("left"), F.min("base").alias("base"))
        met = met.join(reached.select("query_id", "id"), ["query_id", "id"], "left_anti")
        place = Window.partitionBy("query_id").orderBy("key")
        met = met.withColumn("n", F.row_number().over(place)).filter(F.col("n") <= F.col("left"))
        met, seen = staged_with(met.select("query_id", "id", F.lit(depth + 1).alias("dist"), (F.col("base") + F.col("n")).alias("rank"), "key", "n", "left"), "expand", rows=F.count("*"))
        stop = met.filter(F.col("n") == F.col("left")).select("query_id", F.col("key").alias("stop"))
        go = step.join(stop, "query_id", "left").filter(F.col("stop").isNull() | (F.struct("from_rank", "seq") <= F.col("stop")))
        emit = go.select("query_id", "seq", "from_id", "to_id", "relation_type", F.lit(depth).alias("depth"), "from_rank")
        emitted = emit if emitted is None else emitted.unionByName(emit)
        frontier = met.select("query_id", "id", "dist", "rank")
        reached = reached.unionByName(frontier)  # parts that are each staged
    if emitted is None:
        none = edges.filter("false").join(seeds.select("query_id").filter("false"), F.lit(True))  # only the columns
        emitted = none.select("query_id", "seq", "from_id", "to_id", "relation_type", F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("from_rank"))
    order = Window.partitionBy("query_id").orderBy("from_rank", "seq")
    traversed = emitted.withColumn("ord", F.row_number().over(order)).drop("depth", "from_rank")
    return reached, traversed


def khop(start: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """``id``, ``dist``: all nodes within ``hops`` edges of any type of the nodes of ``start``."""
    links = edges.filter("from_id is not null and to_id is not null").select("from_id", "to_id")
    found, seen = staged_with(start.select("id", F.lit(0).alias("dist")).distinct(), "khop", rows=F.count("*"))
    for hop in range(1, hops + 1):
        edge = found.filter(F.col("dist") == hop - 1).select(F.col("id").alias("from_id"))
        edge = F.broadcast(edge) if seen["rows"] <= FEW_NODES else edge
        step = links.join(edge, "from_id", "left_semi").select(F.col("to_id").alias("id")).distinct().join(found.select("id"), "id", "left_anti")
        more, seen = staged_with(step.withColumn("dist", F.lit(hop)), "khop", rows=F.count("*"))
        found = found.unionByName(more)  # parts that are each staged
    return found
