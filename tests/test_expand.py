"""Expansion against a walk by a queue, on random multigraphs."""

import random
from collections import deque

import pytest

from kedrion.operators import expand as module
from kedrion.operators.expand import ALLOWED_RELATIONS, ExpandConfig, expand


def walk(edges, seeds, depth, budget):
    ahead = {}
    for e in edges:
        ahead.setdefault(e[1], []).append(e)
    seen, order, out, dist, queue = set(), [], [], {}, deque()
    for s in seeds:
        seen.add(s)
        order.append(s)
        dist[s] = 0
        queue.append(s)
    while queue and len(seen) < budget:
        v = queue.popleft()
        if dist[v] >= depth:
            continue
        for e in ahead.get(v, []):
            if e[3] not in ALLOWED_RELATIONS:
                continue
            out.append(e[0])
            if e[2] not in seen:
                seen.add(e[2])
                order.append(e[2])
                dist[e[2]] = dist[v] + 1
                if len(seen) >= budget:
                    break
                queue.append(e[2])
    return order, dist, out


@pytest.mark.parametrize("seed,depth,budget", [(1, 3, 12), (3, 2, 1000), (5, 5, 25)])
def test_equals_the_queue(spark, seed, depth, budget):
    rng = random.Random(seed)
    kinds = [*ALLOWED_RELATIONS, "MENTIONS"]
    edges = [(i, f"n{min(rng.randrange(30), rng.randrange(30))}", f"n{rng.randrange(40)}", rng.choice(kinds)) for i in range(150)]
    edges += [(200 + i, "n1", f"n{rng.randrange(3)}", "LINKS_TO") for i in range(60)]
    starts = {"q1": ["n3"], "q2": ["n1", "n7", "n9"], "q3": ["nowhere"], "q4": [f"n{i}" for i in range(10)]}
    rows = [(q, s, k) for q, many in starts.items() for k, s in enumerate(many)]
    seeds = spark.createDataFrame(rows, "query_id string, id string, rank int")
    frame = spark.createDataFrame(edges, "seq bigint, from_id string, to_id string, relation_type string").repartition(5)
    reached, traversed = expand(seeds, frame, ExpandConfig(depth, budget))
    reached, traversed = reached.orderBy("rank").collect(), traversed.orderBy("ord").collect()
    for q, many in starts.items():
        order, dist, out = walk(edges, many, depth, budget)
        assert [r.id for r in reached if r.query_id == q] == order
        assert {r.id: r.dist for r in reached if r.query_id == q} == dist
        assert [r.seq for r in traversed if r.query_id == q] == out


def test_work_follows_the_frontier(spark, monkeypatch):
    """What is written does not grow with edges that no query reaches."""
    written = []
    for size in (1_000, 20_000):
        edges = spark.range(size).selectExpr("id seq", "concat('a', id % 500) from_id", "concat('a', id % 499 + 500) to_id", "'LINKS_TO' relation_type")
        near = spark.createDataFrame([(size + k, "s", f"b{k}", "HAS_CHUNK") for k in range(30)], "seq bigint, from_id string, to_id string, relation_type string")
        seeds = spark.createDataFrame([("q", "s", 1)], "query_id string, id string, rank int")
        total = 0
        kept, staged_ = module.staged_with, module.staged

        def count(df, *rest):
            nonlocal total
            table = staged_(df, *rest)
            total += table.count()
            return table

        monkeypatch.setattr(module, "staged", count)
        reached, _ = expand(seeds, edges.unionByName(near), ExpandConfig(2, 100))
        monkeypatch.setattr(module, "staged", staged_)
        assert reached.count() == 31 and kept is module.staged_with
        written.append(total)
    assert written[0] == written[1] == 30
