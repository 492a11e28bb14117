"""Texts of sections and subtrees, roots and ancestor paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kedrion.functions.text import joined, stripped
from kedrion.operators import tree_paths
from kedrion.session import staged, staged_with


def local_text(sections: DataFrame, text_nodes: DataFrame) -> DataFrame:
    """Sections with the texts of their nodes in file order, joined by line feeds and stripped."""
    own = text_nodes.filter("section_id is not null").groupBy(F.col("section_id").alias("id")).agg(stripped(joined(F.col("text"), F.col("seq"))).alias("local_text"))
    return sections.join(own, "id", "left").withColumn("local_text", F.coalesce("local_text", F.lit("")))


def endless(sections: DataFrame, children: DataFrame) -> DataFrame:
    """``id`` of the sections from which a cycle of child links can be reached: their subtree has no end."""
    links = staged(children.select(F.col("parent_id").alias("u"), F.col("child_id").alias("v")).distinct(), "subtree-links")
    nodes = sections.select("id").join(links.groupBy(F.col("v").alias("id")).agg(F.min("u").alias("parent")), "id", "left")
    core = tree_paths.forest(nodes, links).filter("core").select("id")
    near = links.join(core.toDF("a"), F.col("u") == F.col("a"), "left_semi").join(core.toDF("b"), F.col("v") == F.col("b"), "left_semi")
    found = staged(tree_paths.on_cycles(near).select("id"), "subtree-endless")
    while True:  # upwards: parents of what is endless
        above = links.join(found.toDF("e"), F.col("v") == F.col("e"), "left_semi").select(F.col("u").alias("id")).distinct()
        above, seen = staged_with(above.join(found, "id", "left_anti"), "subtree-endless", rows=F.count("*"))
        if not seen["rows"]:
            return found
        found = found.union(above)  # parts that are each staged


def closure(children: DataFrame) -> DataFrame:
    """``ancestor``, ``descendant``, ``path`` (places among siblings on the way down), one row a way; acyclic links only.

    Ways of up to ``2**k`` steps are joined from halves, so the rounds are the logarithm of the depth.
    """
    every = children.select(F.col("parent_id").alias("ancestor"), F.col("child_id").alias("descendant"), F.array("child_ord").alias("path"))
    every, seen = staged_with(every, "closure", rows=F.count("*"))
    exact = every  # ways of exactly 2**k steps
    while seen["rows"]:
        upper = exact.select("ancestor", F.col("descendant").alias("m"), F.col("path").alias("p"))

        def below(ways: DataFrame, upper: DataFrame = upper) -> DataFrame:
            lower = ways.select(F.col("ancestor").alias("m"), "descendant", "path")
            return upper.join(lower, "m").select("ancestor", "descendant", F.concat("p", "path").alias("path"))

        every = every.unionByName(staged(below(every), "closure"))  # parts that are each staged
        exact, seen = staged_with(below(exact), "closure", rows=F.count("*"))
    return every


def subtree_text(sections: DataFrame, children: DataFrame) -> DataFrame:
    """Sections (with ``local_text``) and ``subtree_text``: own text, then the children's subtrees in order; empty texts are skipped.

    Where a cycle of child links can be reached the text has no end; it is null there.
    """
    lost = endless(sections, children)
    finite = children.join(lost.withColumnRenamed("id", "parent_id"), "parent_id", "left_anti")
    ways = closure(finite)
    own = sections.select(F.col("id").alias("ancestor"), F.col("id").alias("descendant"), F.array().cast("array<int>").alias("path"))
    texts = sections.filter("local_text <> ''").select(F.col("id").alias("descendant"), "local_text")
    gathered = ways.unionByName(own).join(texts, "descendant").groupBy(F.col("ancestor").alias("id")).agg(stripped(joined(F.col("local_text"), F.col("path"))).alias("subtree_text"))
    flag = lost.withColumn("__endless", F.lit(True))
    text = F.when(F.col("__endless").isNull(), F.coalesce("subtree_text", F.lit("")))
    return sections.join(gathered, "id", "left").join(flag, "id", "left").withColumn("subtree_text", text).drop("__endless")


def root_sections(sections: DataFrame) -> DataFrame:
    """Roots are the sections of level 1, whether or not they have a parent."""
    return sections.filter("level = 1")


def section_paths(sections: DataFrame) -> DataFrame:
    """``id``, ``path`` from the root (or from below a missing parent) down to the section; null above a cycle."""
    nodes = sections.select("id", F.col("parent_id").alias("parent"))
    links = sections.filter("parent_id is not null").select(F.col("parent_id").alias("u"), F.col("id").alias("v"))
    trees = tree_paths.forest(nodes, links)
    found = tree_paths.paths(trees)
    tops = nodes.join(sections.select(F.col("id").alias("k")), F.col("parent") == F.col("k"), "left").filter("k is null").select(F.col("id").alias("t"))
    return found.join(tops, F.col("root") == F.col("t"), "left").select("id", F.when(F.col("t").isNotNull(), F.col("path")).alias("path"))
