"""Parent-child links to full hierarchies: paths, depths, roots and descendants of forests of any depth.

Heavy-path decomposition, built with joins and aggregates only:

1. **Cycle separation** - pointer doubling over the parent links resolves every node that arrives at a
   root, in ``log2(depth)`` rounds, and carries subtree sizes along: in round ``k`` a node adds what the nodes
   ``2**k`` below it have gathered.  Nodes that have arrived and are no longer pointed at take no part in later rounds.  Nodes that never arrive lead into a cycle of parent links; those
   cycles are cut above their least node and the rest is resolved the same way;
2. **Chains** - the heavy child of a node is that of the largest subtree; maximal runs of heavy links are
   the chains, labelled by doubling along heavy links with their head and place;
3. **Paths** - the path of a node is the path to the parent of its chain's head, then the chain's segment down to
   the node.  A root path meets at most ``log2(n)`` chains, so segments are concatenated by doubling over
   chains in ``log2(log2(n))`` rounds; depths and numbers are added up in the same way;
4. **Descendants** - nodes are numbered heavy child first, so a chain is an interval and the descendants
   of a node are one: ``sub_lo + 1 .. sub_hi`` of its tree's numbers.

Cycles through other links (several parents, lists of children that disagree): a cycle needs a link
outside the forest, so only nodes with a source of such a link below and a target of one above them
can lie on one.  Both are carried along by the doubling of step 1; on the few nodes left the strongly
connected components are found - in one task while their links are at most ``LOCAL_LINKS``, by
distributed colouring above that.

Nothing is gathered by node: the children of one parent may be a third of all rows (sums have map-side
combining, numbers of siblings are taken in parts of bounded size).

Defined results: null ids are left out; of rows with one id that of the least ``seq`` counts; a parent that is no
id is a *dangling* parent, its children are tops of their trees but not rooted; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kedrion.session import staged, staged_with

LOCAL_LINKS = 500_000
SPAN = 10_000  # numbers of an interval that are listed at once
SIBLINGS = 50_000  # children of one parent that are numbered in one part


def single(df: DataFrame, key: str = "id", order: str = "seq", *columns: str) -> DataFrame:
    """``key`` and ``columns`` of the row of least ``order`` of each key."""
    rows = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("__row"))
    return rows.select(key, *[F.col("__row")[c].alias(c) for c in columns])


def _doubled(state: DataFrame, left: int) -> tuple[DataFrame, int]:
    """Resolve ``state`` (id, up, top, size, out, into; ``left`` rows with ``up``); rows whose ``up`` stays set lead into a cycle.

    Only rows that are open or pointed at go on to the next round: what no open row points at is never pointed at later.
    """
    final = None
    while left:
        ahead = state.filter("up is not null")
        target = state.select(F.col("id").alias("t"), F.col("up").alias("t_up"), F.col("top").alias("t_top"), F.col("into").alias("t_into"))
        below = ahead.groupBy(F.col("up").alias("b")).agg(F.sum("size").alias("b_size"), F.sum("out").alias("b_out"))
        moved = ahead.join(target, ahead["up"] == target["t"]).select("id", F.col("t_up").alias("up"), F.coalesce("t_top", "top").alias("top"), "size", "out", (F.col("into") | F.col("t_into")).alias("into"))
        step = moved.unionByName(state.filter("up is null")).join(below, F.col("id") == F.col("b"), "left")
        table, seen = staged_with(step.select(
            "id", "up", "top", (F.col("size") + F.coalesce("b_size", F.lit(0))).alias("size"), (F.col("out") + F.coalesce("b_out", F.lit(0))).alias("out"),
            "into", (F.col("up").isNotNull() | F.col("b").isNotNull()).alias("kept"),
        ), "tree-doubling", left=F.count("up"))
        settled, state = table.filter("not kept").drop("kept"), table.filter("kept").drop("kept")
        final = settled if final is None else final.unionByName(settled)  # parts that are each staged
        now = seen["left"]
        if now == left:
            break
        left = now
    return (state if final is None else final.unionByName(state)), left


def _resolved(start: DataFrame, key: str, label: str, **add: Callable[[Column, Column], Column]) -> DataFrame:
    """Follow ``jump`` of ``start`` by doubling until it is null; ``add`` says how a field takes up that of the row jumped to.

    Rows that have arrived stay where they are written; only the others are joined and written again.
    """
    table, seen = staged_with(start, label, left=F.count("jump"))
    done, ahead = table.filter("jump is null"), table.filter("jump is not null")
    while seen["left"]:
        target = done.unionByName(ahead).select(F.col(key).alias("__t"), F.col("jump").alias("__jump"), *[F.col(c).alias(f"__{c}") for c in add])
        step = ahead.join(target, F.col("jump") == F.col("__t"))
        step = step.select(key, F.col("__jump").alias("jump"), *[f(F.col(c), F.col(f"__{c}")).alias(c) for c, f in add.items()])
        table, seen = staged_with(step, label, left=F.count("jump"))
        done, ahead = done.unionByName(table.filter("jump is null")), table.filter("jump is not null")
    return done.drop("jump")


def _started(nodes: DataFrame, outside: DataFrame) -> tuple[DataFrame, int]:
    """State of round 0 of ``nodes`` (id, up) and its rows with ``up``; ``outside``: the links (u, v) outside the forest."""
    out = outside.groupBy(F.col("u").alias("o")).agg(F.count("*").alias("o_n"))
    into = outside.select(F.col("v").alias("i")).distinct()
    rows = nodes.join(out, F.col("id") == F.col("o"), "left").join(into, F.col("id") == F.col("i"), "left")
    state, seen = staged_with(rows.select(
        "id", "up", F.when(F.col("up").isNull(), F.col("id")).alias("top"),
        F.lit(1).cast("bigint").alias("size"), F.coalesce("o_n", F.lit(0)).alias("out"), F.col("i").isNotNull().alias("into"),
    ), "tree-start", left=F.count("up"))
    return state, seen["left"]


def _cuts(nodes: DataFrame) -> DataFrame:
    """Of ``nodes`` (id, up) that all lead into cycles, the least id of each cycle."""
    state = staged(nodes.select("id", "up", F.col("id").alias("least")), "tree-cycles")
    width = -1
    while True:
        there = state.agg(F.countDistinct("up")).first()[0]
        if there == width:  # the images of the jumps no longer shrink: they are the cycles' nodes
            on = state.select(F.col("up").alias("c")).distinct()
            ring = state.join(on, F.col("id") == F.col("c"), "left_semi").select("id", "least")
            step = nodes.select(F.col("id").alias("a"), F.col("up").alias("b")).join(ring.toDF("a", "la"), "a").join(ring.toDF("b", "lb"), "b")
            if not step.filter("la <> lb").limit(1).count():  # the same all around: the least of the cycle
                return ring.filter("id = least").select("id")
        width = there
        target = state.select(F.col("id").alias("t"), F.col("up").alias("t_up"), F.col("least").alias("t_least"))
        state = staged(state.join(target, state["up"] == target["t"]).select("id", F.col("t_up").alias("up"), F.least("least", "t_least").alias("least")), "tree-cycles")


def forest(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``id``, ``up`` (parent in the forest), ``top``, ``size``, ``rooted``, ``core``.

    ``nodes``: ``id``, ``parent`` (one row an id).  ``links``: distinct (u, v), ``u`` a parent of ``v``, beside ``parent``.
    ``rooted``: the way up ends at a node whose parent is null.  ``core``: may lie on a cycle of all links.
    """
    known = nodes.select(F.col("id").alias("p")).withColumn("__known", F.lit(True))
    nodes = staged(nodes.join(known, nodes["parent"] == known["p"], "left").select(
        "id", F.when(F.col("__known"), F.col("parent")).alias("up"), F.col("parent").isNull().alias("is_root")
    ), "tree-nodes")
    ids = nodes.select("id")
    outside = links.join(ids.toDF("a"), F.col("u") == F.col("a"), "left_semi").join(ids.toDF("a"), F.col("v") == F.col("a"), "left_semi")
    inner = nodes.select(F.col("id").alias("c"), F.col("up").alias("q"))
    outside = staged(outside.join(inner, (F.col("v") == F.col("c")) & (F.col("u") == F.col("q")), "left_anti"), "tree-outside")
    state, left = _doubled(*_started(nodes.select("id", "up"), outside))
    up = nodes.select("id", "up")
    if left:
        lost = staged(state.filter("up is not null").select(F.col("id").alias("l")).join(nodes, F.col("l") == F.col("id")).select("id", "up"), "tree-lost")
        cut = _cuts(lost)
        cut = staged(cut.join(lost, "id").select("id", "up"), "tree-cut")
        outside = outside.unionByName(cut.select(F.col("up").alias("u"), F.col("id").alias("v")))
        open_ = lost.join(cut.select(F.col("id").alias("k")), F.col("id") == F.col("k"), "left").select("id", F.when(F.col("k").isNull(), F.col("up")).alias("up"))
        again, _ = _doubled(*_started(open_, outside))
        state = state.filter("up is null").unionByName(again)
        up = up.join(cut.select(F.col("id").alias("k")), F.col("id") == F.col("k"), "left").select("id", F.when(F.col("k").isNull(), F.col("up")).alias("up"))
    tops = nodes.filter("is_root").select(F.col("id").alias("r"))
    found = state.select(F.col("id").alias("s"), "top", "size", ((F.col("out") > 0) & F.col("into")).alias("core"))
    found = up.join(found, F.col("id") == F.col("s")).join(tops, F.col("top") == F.col("r"), "left")
    return staged(found.select("id", "up", "top", "size", F.col("r").isNotNull().alias("rooted"), "core"), "tree-forest")


def _tarjan(links: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Nodes of components of two or more, of all links in one task (their number is checked before)."""
    ahead: dict = {}
    for batch in links:
        for u, v in zip(batch["u"], batch["v"]):
            ahead.setdefault(u, []).append(v)
    number: dict = {}
    low: dict = {}
    stack, on, found = [], set(), []
    for start in ahead:
        if start in number:
            continue
        work = [(start, iter(ahead[start]))]
        number[start] = low[start] = len(number)
        stack.append(start)
        on.add(start)
        while work:
            node, rest = work[-1]
            for nxt in rest:
                if nxt not in number:
                    number[nxt] = low[nxt] = len(number)
                    stack.append(nxt)
                    on.add(nxt)
                    work.append((nxt, iter(ahead.get(nxt, ()))))
                    break
                if nxt in on:
                    low[node] = min(low[node], number[nxt])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == number[node]:
                    part = []
                    while True:
                        member = stack.pop()
                        on.discard(member)
                        part.append(member)
                        if member == node:
                            break
                    if len(part) > 1:
                        found += part
    yield pd.DataFrame({"id": found}, dtype=object)


def _reach(start: DataFrame, links: DataFrame) -> DataFrame:
    """``n``, ``colour``: the greatest colour that reaches each node along ``links`` (u, v)."""
    state, last = start, None
    while True:
        come = links.join(state.toDF("w", "c"), F.col("u") == F.col("w")).select(F.col("v").alias("n"), F.col("c").alias("colour"))
        state, now = staged_with(
            state.unionByName(come).groupBy("n").agg(F.max("colour").alias("colour")), "tree-reach",
            rows=F.count("*"), digest=F.sum(F.pmod(F.xxhash64("n", "colour"), F.lit(1 << 40))),
        )
        if now == last:
            return state
        last = now


def on_cycles(links: DataFrame, local_links: int = LOCAL_LINKS) -> DataFrame:
    """``id`` of the nodes on a cycle of ``links`` (u, v): self-links, and components of two or more."""
    found = links.filter("u = v").select(F.col("u").alias("id")).distinct()
    rest, seen = staged_with(links.filter("u <> v").select("u", "v").distinct(), "tree-core", rows=F.count("*"))
    size = seen["rows"]
    kind = rest.schema["u"].dataType.simpleString()
    while size > local_links:
        nodes = rest.select("u").union(rest.select("v")).distinct().toDF("n")
        colour = _reach(nodes.select("n", F.col("n").alias("colour")), rest)
        same = rest.join(colour.toDF("a", "ca"), F.col("u") == F.col("a")).join(colour.toDF("b", "cb"), F.col("v") == F.col("b")).filter("ca = cb").select("u", "v")
        same = staged(same, "tree-core")
        back = _reach(colour.filter("n = colour"), same.select(F.col("v").alias("u"), F.col("u").alias("v")))
        many = back.groupBy("colour").agg(F.count("*").alias("k")).filter("k > 1").select("colour")
        found = staged(found.union(back.join(many, "colour").select(F.col("n").alias("id"))), "tree-cyclic")
        done = back.select(F.col("n").alias("d"))
        rest, seen = staged_with(same.join(done, F.col("u") == F.col("d"), "left_anti").join(done, F.col("v") == F.col("d"), "left_anti"), "tree-core", rows=F.count("*"))
        size = seen["rows"]
    if size:
        found = found.union(rest.coalesce(1).mapInPandas(_tarjan, f"id {kind}"))
    return found.distinct()


def chains(trees: DataFrame) -> DataFrame:
    """``id``, ``up``, ``top``, ``size``, ``rooted``, ``head``, ``place``, ``off``: chains of the forest.

    ``off``: subtree sizes of the siblings numbered before the node (heavy child first).
    """
    under = trees.filter("up is not null")
    kids = under.groupBy(F.col("up").alias("hp")).agg(F.max(F.struct("size", "id"))["id"].alias("heavy"), F.count("*").alias("kids"))
    rows = under.join(kids, F.col("up") == F.col("hp")).withColumn("is_heavy", F.col("id") == F.col("heavy"))
    part = F.when(F.col("is_heavy"), -1).otherwise(F.pmod(F.xxhash64("id"), F.ceil(F.col("kids") / SIBLINGS)))
    rows = rows.withColumn("part", part).drop("hp", "heavy", "kids")
    before = Window.partitionBy("bu").orderBy("bp").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(F.col("up").alias("bu"), F.col("part").alias("bp")).agg(F.sum("size").alias("s"))
    parts = parts.withColumn("base", F.coalesce(F.sum("s").over(before), F.lit(0))).drop("s")
    inside = Window.partitionBy("up", "part").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    off = rows.join(parts, (F.col("up") == F.col("bu")) & (F.col("part") == F.col("bp")))
    off = off.withColumn("off", F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0))).drop("bu", "bp", "base", "part")
    tops = trees.filter("up is null").withColumn("is_heavy", F.lit(False)).withColumn("off", F.lit(0).cast("bigint"))  # no siblings
    off = staged(off.unionByName(tops), "tree-offsets")
    heavy = F.col("is_heavy")
    start = off.select("id", F.when(heavy, F.col("up")).alias("jump"), F.when(heavy, 1).otherwise(0).cast("bigint").alias("place"), F.when(~heavy, F.col("id")).alias("head"))
    labels = _resolved(start, "id", "tree-heads", place=lambda a, b: a + b, head=F.coalesce).withColumnRenamed("id", "l")
    return staged(off.drop("is_heavy").join(labels, F.col("id") == F.col("l")).drop("l"), "tree-labels")


def paths(trees: DataFrame, with_path: bool = True) -> DataFrame:
    """``id``, ``parent`` (in the forest), ``root``, ``rooted``, ``depth``, ``chain``, ``chain_pos``, ``n_descendants``, ``sub_lo``, ``sub_hi``
    and, on request, ``path``.

    All of it comes from the chains: what lies above the head of a chain is added up over the chains above.
    """
    rows = chains(trees)
    at = rows.select(F.col("id").alias("pi"), F.col("head").alias("ph"), F.col("place").alias("pp"))
    heads = rows.filter("id = head and up is not null").select("head", "up", "off").join(at, F.col("up") == F.col("pi"))
    above, number = (F.col("pp") + 1).alias("above"), (F.col("pp") + 1 + F.col("off")).alias("number")
    tops = rows.filter("up is null").select("head", F.lit(None).cast(rows.schema["head"].dataType).alias("jump"), F.lit(0).cast("bigint").alias("above"), F.lit(0).cast("bigint").alias("number"))
    add = {"above": lambda a, b: a + b, "number": lambda a, b: a + b}
    if with_path:
        listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"])
        segment = staged(rows.groupBy(F.col("head").alias("h")).agg(listed.alias("segment")), "tree-segments")
        heads = heads.join(segment, F.col("ph") == F.col("h")).select("head", F.col("ph").alias("jump"), above, number, F.slice("segment", F.lit(1), F.col("pp").cast("int") + 1).alias("prefix"))
        tops = tops.withColumn("prefix", F.array().cast(segment.schema["segment"].dataType))
        add["prefix"] = lambda a, b: F.concat(b, a)
    else:
        heads = heads.select("head", F.col("ph").alias("jump"), above, number)
    whole = _resolved(heads.unionByName(tops), "head", "tree-prefixes", **add).withColumnRenamed("head", "c")
    lo = F.col("number") + F.col("place")
    found = rows.join(whole, F.col("head") == F.col("c"))
    columns = [
        "id", F.col("up").alias("parent"), F.col("top").alias("root"), "rooted", (F.col("above") + F.col("place") + 1).cast("int").alias("depth"),
        F.col("head").alias("chain"), F.col("place").cast("int").alias("chain_pos"), (F.col("size") - 1).alias("n_descendants"),
        lo.alias("sub_lo"), (lo + F.col("size") - 1).alias("sub_hi"),
    ]
    if with_path:
        found = found.join(segment, F.col("head") == F.col("h"))
        columns.append(F.concat("prefix", F.slice("segment", F.lit(1), F.col("place").cast("int") + 1)).alias("path"))
    return found.select(*columns)


def descendants(found: DataFrame) -> DataFrame:
    """``id``, ``descendant``: all pairs, from the intervals of ``paths``.

    The numbers of an interval are listed in spans of ``SPAN`` and looked up by (root, number), so no node's
    descendants are gathered, and no two nodes are compared.
    """
    spans = found.filter("sub_hi > sub_lo").select("id", "root", "sub_hi", F.explode(F.sequence(F.col("sub_lo") + 1, F.col("sub_hi"), F.lit(SPAN).cast("bigint"))).alias("low"))
    numbers = spans.select("id", "root", F.explode(F.sequence("low", F.least(F.col("low") + (SPAN - 1), "sub_hi"))).alias("number"))
    at = found.select("root", F.col("sub_lo").alias("number"), F.col("id").alias("descendant"))
    return numbers.join(at, ["root", "number"]).select("id", "descendant")


def faults(nodes: DataFrame, links: DataFrame, trees: DataFrame | None = None, local_links: int = LOCAL_LINKS) -> DataFrame:
    """``id``, ``kind``: the first fault of a node that applies - ``cycle``, ``rootless``, ``level``.

    ``nodes``: ``id``, ``parent``, ``level``; ``links``: distinct (u, v) of all sources.  Cycles are those of the
    separation; the depth is that of the chains.
    """
    trees = trees if trees is not None else forest(nodes, links)
    every = links.union(nodes.filter("parent is not null").select(F.col("parent").alias("u"), F.col("id").alias("v"))).distinct()
    core = trees.filter("core").select("id")
    near = every.join(core.toDF("a"), F.col("u") == F.col("a"), "left_semi").join(core.toDF("b"), F.col("v") == F.col("b"), "left_semi")
    cyclic = on_cycles(near, local_links).select(F.col("id").alias("y"))
    found = paths(trees, with_path=False)
    rows = found.join(nodes.select(F.col("id").alias("n"), "level"), F.col("id") == F.col("n")).join(cyclic, F.col("id") == F.col("y"), "left")
    kind = F.when(F.col("y").isNotNull(), "cycle").when(~F.col("rooted"), "rootless").when(~F.col("level").eqNullSafe(F.col("depth")), "level")
    return rows.select("id", kind.alias("kind")).filter("kind is not null")


def section_links(sections: DataFrame, edges: DataFrame, relation: str = "HAS_SUBSECTION") -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of the sections: parents from ``parent_id``; links from ``children_ids`` and edges."""
    rows = staged(single(sections, "id", "seq", "parent_id", "level", "children_ids"), "tree-sections")
    nodes = rows.select("id", F.col("parent_id").alias("parent"), "level")
    listed = rows.select(F.col("id").alias("u"), F.explode("children_ids").alias("v")).filter("v is not null")
    drawn = edges.filter(F.col("relation_type") == relation).select(F.col("from_id").alias("u"), F.col("to_id").alias("v")).filter("u is not null and v is not null")
    return nodes, listed.union(drawn).distinct()
