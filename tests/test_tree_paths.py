import random
import zlib

import pytest

from kedrion.operators import tree_paths as tp

NODES = "id string, parent string, level int, size int, top string"


def brute_forest(parent):
    """Paths in the forest: cycles are cut above their least node."""
    out = {}
    for v in parent:
        way, seen = [v], {v}
        while (p := parent[way[-1]]) is not None and p in parent and p not in seen:
            way.append(p)
            seen.add(p)
        p = parent[way[-1]]
        rooted = p is None
        if p is not None and p in parent:  # a cycle: from p to the end of the way
            ring = way[way.index(p) :]
            way = way[: way.index(min(ring)) + 1]
        out[v] = (rooted, way[::-1])
    return out


def brute_cycles(links):
    ahead = {}
    for u, v in links:
        ahead.setdefault(u, set()).add(v)
    out = set()
    for s in ahead:
        seen, stack = set(), list(ahead[s])
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                stack += ahead.get(x, ())
        if s in seen:
            out.add(s)
    return out


def tree_case(seed, n, links_n, chain=False):
    rng = random.Random(seed)
    ids = [f"n{i:03d}" for i in range(n)]
    parent = {}
    for i, v in enumerate(ids):
        r = rng.random()
        parent[v] = None if i == 0 or r < 0.05 else "gone" if r < 0.08 else rng.choice(ids) if r < 0.12 else ids[i - 1] if chain and r < 0.95 else ids[rng.randrange(i)]
    links = {(rng.choice(ids), rng.choice(ids)) for _ in range(links_n)} | {("zzz", ids[0])}
    return ids, parent, links


@pytest.mark.parametrize("seed,n,links,chain,local", [(2, 80, 8, True, 1000), (4, 40, 40, False, 0)])
def test_paths_and_faults_against_brute_force(spark, seed, n, links, chain, local):
    ids, parent, more = tree_case(seed, n, links, chain)
    truth = brute_forest(parent)
    level = {v: len(truth[v][1]) + (zlib.crc32(v.encode()) % 7 == 0) for v in ids}
    nodes = spark.createDataFrame([(v, parent[v], level[v], 1, "x") for v in ids], NODES)
    frame = spark.createDataFrame(sorted(more), "u string, v string")
    trees = tp.forest(nodes, frame)
    rows = {r.id: r for r in tp.paths(trees).collect()}
    assert {v: (r.rooted, r.path) for v, r in rows.items()} == truth
    below = {v: {w for w in ids if v in truth[w][1]} for v in ids}
    for v, r in rows.items():
        assert r.depth == len(r.path) and r.root == r.path[0] and r.n_descendants == len(below[v]) - 1
        inside = {w for w, q in rows.items() if q.root == r.root and r.sub_lo <= q.sub_lo <= r.sub_hi}
        assert inside == below[v]
        on = [q.id for q in sorted(rows.values(), key=lambda q: q.chain_pos) if q.chain == r.chain]
        assert on[r.chain_pos] == v and on[0] == r.chain
    every = {(u, v) for u, v in more if u in parent and v in parent} | {(p, v) for v, p in parent.items() if p in parent}
    cyclic = brute_cycles(every)
    kinds = {r.id: r.kind for r in tp.faults(nodes, frame, trees, local_links=local).collect()}
    want = {v: "cycle" if v in cyclic else "rootless" if not truth[v][0] else "level" if level[v] != len(truth[v][1]) else None for v in ids}
    assert kinds == {v: k for v, k in want.items() if k}


def test_long_chain_and_star(spark):
    chain = [(f"c{i:04d}", f"c{i - 1:04d}" if i else None, i + 1, 0, "") for i in range(300)]
    star = [(f"s{i:04d}", "s0000" if i else None, 2 if i else 1, 0, "") for i in range(500)]
    nodes = spark.createDataFrame(chain + star, NODES)
    none = spark.createDataFrame([], "u string, v string")
    trees = tp.forest(nodes, none)
    rows = {r.id: r for r in tp.paths(trees).collect()}
    assert rows["c0299"].depth == 300 and rows["c0299"].path[0] == "c0000" and rows["s0000"].n_descendants == 499
    assert len({r.chain for v, r in rows.items() if v[0] == "c"}) == 1
    assert sorted(r.sub_lo for v, r in rows.items() if v[0] == "s") == list(range(500))
    assert tp.faults(nodes, none, trees).count() == 0


def test_empty_and_null(spark):
    none = spark.createDataFrame([], "u string, v string")
    empty = spark.createDataFrame([], NODES)
    assert tp.paths(tp.forest(empty, none)).count() == 0
    assert tp.faults(empty, none).count() == 0
    schema = "seq bigint, id string, parent_id string, level int, children_ids array<string>, extra int"
    rows = spark.createDataFrame([(0, "a", None, 1, ["b", None], 1), (1, "b", "a", None, None, 2), (2, "b", None, 9, [], 3), (3, None, "a", 1, [], 4)], schema)
    edges = spark.createDataFrame([(None, "a", "HAS_SUBSECTION"), ("b", None, "HAS_SUBSECTION"), ("a", "b", None)], "from_id string, to_id string, relation_type string")
    nodes, links = tp.section_links(rows, edges)
    assert {(r.id, r.parent, r.level) for r in nodes.collect()} == {("a", None, 1), ("b", "a", None)}
    assert {(r.u, r.v) for r in links.collect()} == {("a", "b")}
    assert {(r.id, r.kind) for r in tp.faults(nodes, links).collect()} == {("b", "level")}


def test_many_roots_lie_in_no_common_group(spark):
    """Nodes without a parent take no part in the numbering of siblings."""
    nodes = spark.range(20_000).selectExpr("cast(id as string) id", "case when id % 100 = 1 then cast(id - 1 as string) end parent", "1 level", "0 size", "'' top")
    trees = tp.forest(nodes, spark.createDataFrame([], "u string, v string"))
    numbered = []
    keep = tp.staged

    def staged(df, label="stage"):
        if label == "tree-offsets":
            numbered.append(df._jdf.queryExecution().optimizedPlan().toString())
        return keep(df, label)

    tp.staged = staged
    try:
        found = tp.paths(trees, with_path=False)
    finally:
        tp.staged = keep
    windows = [part for part in numbered[0].split("Union")[1:] if "Window" in part]
    assert windows and all("isnotnull(up" in part for part in windows)
    assert found.filter("depth = 1 and n_descendants = 0").count() == 19_600 and found.filter("depth = 2").count() == 200
    assert {(r.id, r.descendant) for r in tp.descendants(found).collect()} == {(str(i - 1), str(i)) for i in range(1, 20_000, 100)}
