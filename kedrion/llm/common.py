"""Shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kedrion.session import staged, staged_with

#: A table is broadcast while its keys take up to so many bytes.
FEW_BYTES = 16 << 20


def kept_small(df: DataFrame, key: str, label: str) -> DataFrame:
    """``df`` written to the shared folder, to be broadcast if its keys are few: their bytes are added up while it is written."""
    table, seen = staged_with(df, label, size=F.coalesce(F.sum(F.octet_length(F.col(key).cast("string")) + 24), F.lit(0)))
    return F.broadcast(table) if (seen["size"] or 0) <= FEW_BYTES else table


def first_rows(df: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """``df`` with, of the rows of one key, only that of the least ``order``; null keys are dropped.

    Only (key, order) is shuffled.  The keys that do have several rows are taken out by an anti join:
    broadcast while they are few, else a shuffled join.  No other column crosses the network for it
    in the usual case.
    """
    df = df.filter(F.col(key).isNotNull())
    repeated = (
        df.groupBy(F.col(key).alias("__key")).agg(F.min(order).alias("__first"), F.count("*").alias("__n"))
        .filter("__n > 1").drop("__n")
    )
    repeated = kept_small(repeated, "__key", "repeated-ids")
    return df.join(repeated, (F.col(key) == F.col("__key")) & (F.col(order) > F.col("__first")), "left_anti")


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node``, ``root``: the smallest node of the connected component of every node of ``edges``.

    Alternating large-star and small-star rounds (logarithmic in the size of a component); every round
    is an aggregate with map-side combining and a join on the node, and is written to the shared folder.
    """
    now = staged(edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).filter("lo <> hi").distinct(), "cc")
    while True:
        ways = now.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(now.select("hi", "lo"))
        least = ways.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = ways.join(least, "u").filter("v > u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).filter("lo <> hi").distinct()
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(down, "hi").select("m", "hi", "lo")
        step = small.select(F.col("m").alias("lo"), "hi").union(small.filter("m <> lo").select("m", F.col("lo").alias("hi"))).distinct()
        step = staged(step, "cc")
        if _digest(step) == _digest(now):
            return step.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(step.select("lo", "lo").distinct())
        now = step


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("lo", "hi"), F.lit(1 << 40)))).first()
    return tuple(row)
