"""The offline index as Parquet: sections, children, text nodes, edges and a small file of facts.

Pickles are neither written nor read.  The vectors' dimension is found, and checked, before anything is
written.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kedrion.operators.embed import Encoder

TABLES = ("sections", "children", "text_nodes", "edges")


@dataclass(frozen=True)
class Index:
    """``sections`` with texts and vectors, ``children`` (parent_id, child_id, child_ord), ``text_nodes`` with vectors, ``edges``."""

    sections: DataFrame
    children: DataFrame
    text_nodes: DataFrame
    edges: DataFrame


def dimension(sections: DataFrame) -> int:
    """Length of the first subtree vector in file order."""
    row = sections.filter("e_subtree is not null").select("seq", F.size("e_subtree").alias("dim")).orderBy("seq").first()
    if row is None:
        raise RuntimeError("no section has a subtree vector: the index has no dimension")
    return row["dim"]


def save_index(index: Index, folder: str, encoder: str = "") -> int:
    """Write the index to ``folder``, with the name of its encoder, and return the dimension of its vectors."""
    dim = dimension(index.sections)
    for name in TABLES:
        rows: DataFrame = getattr(index, name)
        if name == "edges":  # neighbours of a node lie together, so expansion reads few row groups
            rows = rows.repartition("from_id").sortWithinPartitions("from_id", "seq")
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")
    facts = index.sections.sparkSession.createDataFrame([(dim, encoder)], "dim int, encoder string")
    facts.write.mode("overwrite").json(f"{folder}/dim")
    return dim


def load_index(spark: SparkSession, folder: str, encoder: Encoder | None = None) -> Index:
    """The index of ``folder``.  Its vectors must have the dimension it states, and be those of ``encoder`` if one is given."""
    index = Index(*[spark.read.parquet(f"{folder}/{name}") for name in TABLES])
    dim, name = saved_facts(spark, folder)
    if dimension(index.sections) != dim:
        raise ValueError(f"the index states {dim} dimensions, its vectors have {dimension(index.sections)}")
    if encoder is not None and (encoder.dim != dim or (name and encoder.name != name)):
        raise ValueError(f"the index was built by {name or 'an encoder'} of {dim} dimensions, not by {encoder.name} of {encoder.dim}")
    return index


def saved_facts(spark: SparkSession, folder: str) -> tuple[int, str]:
    """(dimension, name of the encoder) as saved."""
    row = spark.read.schema("dim int, encoder string").json(f"{folder}/dim").first()
    return row["dim"], row["encoder"] or ""


def saved_dimension(spark: SparkSession, folder: str) -> int:
    return saved_facts(spark, folder)[0]
