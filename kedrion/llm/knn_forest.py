"""The k most similar vectors (cosine) of every vector: a forest of random-projection trees.

1. **Classes** - ids with several rows count once; equal unit vectors are one class, searched once;
2. **Forest** - ``TREES`` trees.  A node's direction is a random one drawn towards the spread of its own vectors,
   its threshold the median of their projections.  The upper levels are fitted on a sample of at most
   ``SAMPLE`` vectors (those under a bound of their hash); further levels on the executors, a sample for each node.
   Every vector is indexed: it falls into one cell of each tree;
3. **Search** - every vector is also a query.  All trees share one priority queue a query, keyed by the
   greatest margin by which the query lies on the other side on the way to a node; it is emptied down to
   one margin for all queries, whose order within the queue then needs no keeping.  The margin is
   calibrated: of ``PROBES`` queries the true neighbours among *all* vectors are found exactly, and
   the margin is the least that reaches a share ``TARGET`` of them.  So recall holds as the table grows, and the work
   is what the data ask for;
4. **Cells** - a cell holds the vectors of one node (up to ``CELL_ROWS``) and takes the queries that open it as a stream.
   In it the tree goes on down to leaves of some ``LEAF_ROWS`` vectors, fitted and calibrated
   (``CELL_TARGET``) in the same way on the vectors of the cell.  A target of 1 opens everything;
5. **Exact reranking** - cosines of a query with the vectors of its leaves are exact, and the best ``k`` over all its
   cells are kept.

The number of cells a query opens does not grow while ``FEW_CELLS`` cells a tree hold the vectors, only
the leaves within them do; beyond, trees get deeper.  Thresholds are medians, so cells do not depend on how
frequent a topic is; a cell that still outgrows ``CELL_ROWS`` (vectors that no plane parts, or trees of
``DEEPEST`` levels) is cut into blocks, each with leaves of its own, that all its queries meet: none is left out.

Measured recall against brute force is in the tests and the README.

Defined results: null vectors, zero vectors, vectors of another dimension or with a null or non-finite
number never count; null ids are left out; a vector with fewer than ``k`` others has fewer neighbours;
ties in cosine go to the smaller id (copies of one vector too); an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kedrion.llm.common import first_rows, kept_small
from kedrion.session import staged

K, DIM, TREES = 10, 64, 3
TARGET, CELL_TARGET = 0.975, 0.985
FEW_CELLS, CELL_ROWS, LEAST_CELL, LEAF_ROWS = 16, 131_072, 500, 640
SAMPLE, PROBES, DEEPEST = 4096, 300, 16
FIT_ROWS = 64  # of a sample, for each node that is split
CHUNK = 2048  # queries answered at once


def grown(points: np.ndarray, levels: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Directions and thresholds of ``levels`` levels over ``points``, nodes in heap order from 1."""
    dim = points.shape[1]
    directions, thresholds = np.zeros((1 << levels, dim), np.float32), np.zeros(1 << levels, np.float32)
    parts = {1: np.arange(len(points))}
    for node in range(1, 1 << levels):
        own = points[parts[node]]
        d = rng.standard_normal(dim).astype(np.float32)
        if len(own) > 2:  # towards the spread: planes along it part fewer neighbours
            spread = own - own.mean(axis=0)
            for _ in range(3):
                d = spread.T @ (spread @ d)
                size = np.linalg.norm(d)
                if not size > 1e-12:
                    d = rng.standard_normal(dim).astype(np.float32)
                    break
                d /= size
        d /= np.linalg.norm(d)
        p = own @ d
        directions[node], thresholds[node] = d, np.median(p) if len(p) else 0
        right = p > thresholds[node]
        parts[2 * node], parts[2 * node + 1] = parts[node][~right], parts[node][right]
    return directions, thresholds


class Forest:
    """Directions (trees, nodes, dim) and thresholds (trees, nodes), nodes in heap order; ``margin`` down to which the queue is emptied."""

    def __init__(self, sample: np.ndarray, levels: int, trees: int, seed: int = 11):
        self.levels = max(0, min(levels, int(math.log2(max(1, len(sample)) / FIT_ROWS)) if len(sample) >= FIT_ROWS else 0))
        both = [grown(sample, self.levels, np.random.default_rng((seed, t))) for t in range(trees)]
        self.directions, self.thresholds = np.stack([d for d, _ in both]), np.stack([t for _, t in both])
        self.margin = np.float32(np.inf)

    def deepened(self, more: int, parts: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]) -> None:
        """``more`` further levels: below each cell (tree, node) the levels of ``parts``."""
        trees, _, dim = self.directions.shape
        d = np.zeros((trees, 1 << (self.levels + more), dim), np.float32)
        t = np.zeros((trees, 1 << (self.levels + more)), np.float32)
        d[:, : 1 << self.levels], t[:, : 1 << self.levels] = self.directions, self.thresholds
        for (tree, cell), (directions, thresholds) in parts.items():
            for level in range(more):
                at, to = 1 << level, ((1 << self.levels) + cell) << level
                d[tree, to : to + at], t[tree, to : to + at] = directions[at : 2 * at], thresholds[at : 2 * at]
        self.directions, self.thresholds, self.levels = d, t, self.levels + more

    def _margins(self, unit: np.ndarray, tree: int, node: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", unit, self.directions[tree, node]) - self.thresholds[tree, node]

    def cell(self, unit: np.ndarray) -> np.ndarray:
        """The cell of each vector in each tree: (rows, trees)."""
        out = np.ones((len(unit), len(self.directions)), np.int64)
        for t in range(out.shape[1]):
            for _ in range(self.levels):
                out[:, t] = 2 * out[:, t] + (self._margins(unit, t, out[:, t]) > 0)
        return out - (1 << self.levels)

    def opened(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, tree, cell) of all cells within the margin."""
        found = []
        for t in range(len(self.directions)):
            row, node, key = np.arange(len(unit)), np.ones(len(unit), np.int64), np.zeros(len(unit), np.float32)
            for _ in range(self.levels):
                p = self._margins(unit[row], t, node)
                far = np.maximum(key, np.abs(p))
                go = far <= self.margin
                side = (p > 0).astype(np.int64)
                row, key = np.concatenate([row, row[go]]), np.concatenate([key, far[go]])
                node = np.concatenate([2 * node + side, 2 * node[go] + 1 - side[go]])
            found.append((row, np.full(len(row), t), node - (1 << self.levels)))
        return tuple(np.concatenate(c) for c in zip(*found))

    def needed(self, queries: np.ndarray, others: np.ndarray) -> np.ndarray:
        """The margin at which each query meets its other vector in some tree."""
        least = np.full(len(queries), np.inf, np.float32)
        for t in range(len(self.directions)):
            node, key = np.ones(len(queries), np.int64), np.zeros(len(queries), np.float32)
            for _ in range(self.levels):
                p, side = self._margins(queries, t, node), self._margins(others, t, node) > 0
                key = np.where((p > 0) == side, key, np.maximum(key, np.abs(p)))
                node = 2 * node + side
            least = np.minimum(least, key)
        return least


def _blob(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


def units(df: DataFrame, vector: str, key: str = "id", order: str = "seq", dim: int = DIM) -> DataFrame:
    """``id``, ``unit`` (bytes of the unit vector) of the vectors that count."""
    kind = df.schema[key].dataType.simpleString()
    v = F.col(vector)
    fit = v.isNotNull() & (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            norm = np.linalg.norm(m, axis=1)
            ok = np.flatnonzero(norm > 0)
            unit = (m[ok] / norm[ok, None]).astype(np.float32)
            unit += np.float32(0)  # one zero only: equal vectors have equal bytes
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ok)), pa.array([u.tobytes() for u in unit], pa.binary())], ["id", "unit"])

    return first_rows(df, key, order).filter(fit).select(F.col(key).alias("id"), v.alias("v")).mapInArrow(run, f"id {kind}, unit binary")


def classes(every: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the row of the smallest id of each vector; ``rep``, ``id`` of all members of vectors of several ids).

    Vectors are told apart by their hashes; only those whose hash occurs again are grouped by their bytes.
    """
    again = kept_small(every.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash"), "hash", "knn-again")
    some = every.join(again, "hash", "left_semi")
    groups = some.groupBy("unit").agg(F.min("id").alias("rep"), F.count("*").alias("n")).filter("n > 1").drop("n")
    copies = staged(some.join(groups, "unit").select("rep", "id"), "knn-copies")
    others = kept_small(copies.filter("id <> rep").select(F.col("id").alias("__copy")), "__copy", "knn-others")
    return every.join(others, F.col("id") == F.col("__copy"), "left_anti"), copies


def _under(rate: float) -> F.Column:
    """Rows whose hash lies under a share ``rate`` of all hashes."""
    return F.pmod("hash", F.lit(1 << 40)) < int(min(1.0, rate) * (1 << 40))


def _fit(levels: int, dim: int):
    def fit(group):
        own = np.frombuffer(b"".join(group["unit"].sort_values()), np.float32).reshape(-1, dim)
        tree, cell = int(group["tree"].iloc[0]), int(group["cell"].iloc[0])
        d, t = grown(own, levels, np.random.default_rng((tree, cell, levels)))
        return pd.DataFrame({"tree": [tree], "cell": [cell], "directions": [d.tobytes()], "thresholds": [t.tobytes()]})

    return fit


def fitted(firsts: DataFrame, n: int, levels: int, trees: int, sample: int, k: int, dim: int, target: float) -> tuple[Forest, np.ndarray]:
    """The forest and the vectors of its probes."""
    drawn = firsts.filter(_under(1.25 * sample / max(1, n))).select("hash", "unit").toPandas() if n else pd.DataFrame({"hash": [], "unit": []})
    drawn = drawn.sort_values(["hash", "unit"])["unit"].iloc[:sample]
    points = np.frombuffer(b"".join(drawn), np.float32).reshape(-1, dim)
    forest = Forest(points, levels, trees)
    sc = firsts.sparkSession.sparkContext
    while len(points) >= 4 * FIT_ROWS and forest.levels < levels:
        more = min(levels - forest.levels, max(1, int(math.log2(sample / FIT_ROWS / 2))))
        model = sc.broadcast(forest)

        def placed(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell = model.value.cell(_blob(batch.column(0), dim))
                for t in range(cell.shape[1]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), t, np.int32)), pa.array(cell[:, t]), batch.column(0)], ["tree", "cell", "unit"])

        rows = firsts.filter(_under(sample * (1 << forest.levels) / n)).select("unit").mapInArrow(placed, "tree int, cell bigint, unit binary")
        parts = rows.groupBy("tree", "cell").applyInPandas(_fit(more, dim), "tree int, cell bigint, directions binary, thresholds binary").toPandas()
        forest.deepened(more, {
            (p.tree, p.cell): (np.frombuffer(p.directions, np.float32).reshape(-1, dim), np.frombuffer(p.thresholds, np.float32)) for p in parts.itertuples()
        })
    probes = points[:PROBES]
    if forest.levels and target < 1:
        forest.margin = np.float32(np.quantile(forest.needed(*_true(firsts, probes, k, dim)), target, method="higher"))
    return forest, probes


def _true(firsts: DataFrame, probes: np.ndarray, k: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, neighbour) for the ``k`` nearest of each probe among all vectors, exactly: the probes meet all rows in blocks."""
    shared = firsts.sparkSession.sparkContext.broadcast(probes)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        cos, unit = np.full((len(queries), k), -2, np.float32), np.zeros((len(queries), k, dim), np.float32)
        for batch in batches:
            for s in range(0, batch.num_rows, 10_000):
                x = _blob(batch.column(0).slice(s, 10_000), dim)
                c = queries @ x.T
                c[(queries[:, None, :2] == x[None, :, :2]).all(axis=2) & (c > 0.999)] = -2  # itself
                m = min(k, len(x))
                top = np.argpartition(c, len(x) - m, axis=1)[:, len(x) - m :]
                both = np.concatenate([cos, np.take_along_axis(c, top, 1)], axis=1)
                order = np.argsort(-both, axis=1)[:, :k]
                unit = np.take_along_axis(np.concatenate([unit, x[top]], axis=1), order[:, :, None], 1)
                cos = np.take_along_axis(both, order, 1)
        q, j = np.nonzero(cos > -1.5)
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(cos[q, j]), pa.array([u.tobytes() for u in unit[q, j]], pa.binary())], ["q", "cos", "unit"])

    order = Window.partitionBy("q").orderBy(F.desc("cos"), "unit")
    found = firsts.select("unit").mapInArrow(best, "q int, cos float, unit binary").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k)
    found = found.select("q", "unit").toPandas()
    return probes[found["q"].to_numpy(np.int64)], np.frombuffer(b"".join(found["unit"]), np.float32).reshape(-1, dim)


def _entries(batches: Iterator[pa.RecordBatch], forest, blocks, dim: int) -> Iterator[pa.RecordBatch]:
    """A row for each (cell, block) a vector lies in (``role`` 0: it is searched and asks) or opens (1: it asks)."""
    model, counts = forest.value, blocks.value
    for batch in batches:
        for start in range(0, batch.num_rows, 4000):
            piece = batch.slice(start, 4000)
            unit = _blob(piece.column(1), dim)
            own = model.cell(unit)
            row, tree, cell = model.opened(unit)
            home = own[row, tree] == cell
            place = (tree << model.levels) + cell
            times = counts[place]
            copy = np.repeat(np.arange(len(row)), times)
            block = np.arange(len(copy)) - np.repeat(np.cumsum(times) - times, times)
            mine = np.frombuffer(unit.tobytes(), np.uint32).reshape(-1, dim)[:, :2].astype(np.uint64)
            mine = ((mine[:, 0] * np.uint64(2654435761) + mine[:, 1])[row[copy]] % times[copy].astype(np.uint64)).astype(np.int64)
            role = np.where(home[copy] & (block == mine), 0, 1)
            for s in range(0, len(copy), 20_000):
                e = slice(s, s + 20_000)
                r = pa.array(row[copy[e]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(place[copy[e]].astype(np.int32)), pa.array(block[e].astype(np.int32)), pa.array(role[e].astype(np.int8)), piece.column(0).take(r), piece.column(1).take(r)],
                    ["cell", "block", "role", "id", "unit"],
                )


class Cell:
    """The vectors of one cell (or block of it), in order of their ids, with leaves of their own."""

    def __init__(self, ids: pa.Array, unit: np.ndarray, k: int, least: float, leaf_rows: int, target: float):
        self.ids, self.k, self.least = ids, k, least
        n = len(unit)
        self.levels = max(0, round(math.log2(n / leaf_rows))) if n > leaf_rows else 0
        self.directions, self.thresholds = grown(unit[:: max(1, n // (FIT_ROWS << self.levels))], self.levels, np.random.default_rng(5))
        leaf = np.ones(n, np.int64)
        for _ in range(self.levels):
            leaf = 2 * leaf + (np.einsum("ij,ij->i", unit, self.directions[leaf]) > self.thresholds[leaf])
        leaf -= 1 << self.levels
        self.order = np.argsort(leaf, kind="stable")
        self.unit = unit[self.order]
        self.ends = np.searchsorted(leaf[self.order], np.arange((1 << self.levels) + 1))
        self.margin = np.float32(np.inf)
        if self.levels and target < 1:
            at = np.arange(0, n, max(1, n // 96))
            cos = unit[at] @ unit.T
            cos[np.arange(len(at)), at] = -2
            top = np.argpartition(cos, n - min(k, n - 1), axis=1)[:, n - min(k, n - 1) :]
            self.margin = np.float32(np.quantile(np.take_along_axis(self.keys(unit[at]), leaf[top], 1), target, method="higher"))

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """The margin of every leaf for every query."""
        p = unit @ self.directions.T - self.thresholds
        key = np.zeros((len(unit), 1), np.float32)
        for level in range(self.levels):
            g = p[:, 1 << level : 2 << level]
            key = np.stack([np.maximum(key, g), np.maximum(key, -g)], axis=2).reshape(len(unit), -1)
        return key

    def best(self, unit: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place, cosine) of the ``k`` best of every query; ``own``: the places of the queries themselves."""
        k, q = self.k, len(unit)
        cos, at = np.full((q, k), -2, np.float32), np.full((q, k), -1)
        open_ = self.keys(unit) <= self.margin
        for leaf in range(1 << self.levels):
            a, b = self.ends[leaf], self.ends[leaf + 1]
            rows = np.flatnonzero(open_[:, leaf])
            if not len(rows) or a == b:
                continue
            c = unit[rows] @ self.unit[a:b].T
            place = self.order[a:b]
            if own is not None:  # a vector is no neighbour of its own
                j = np.searchsorted(place, own[rows])
                same = np.flatnonzero((j < b - a) & (place[np.minimum(j, b - a - 1)] == own[rows]))
                c[same, j[same]] = -2
            better = np.flatnonzero(c.max(axis=1) >= np.maximum(cos[rows].min(axis=1), self.least))
            if not len(better):
                continue
            rows, c = rows[better], c[better]
            m = min(k, b - a)
            top = np.argpartition(c, b - a - m, axis=1)[:, b - a - m :]
            value = np.take_along_axis(c, top, 1)
            for r in np.flatnonzero(np.count_nonzero(c >= value.min(axis=1)[:, None], axis=1) > m):  # ties: the smaller ids
                top[r] = np.lexsort((np.arange(b - a), -c[r]))[:m]
                value[r] = c[r, top[r]]
            both, where = np.concatenate([cos[rows], value], axis=1), np.concatenate([at[rows], place[top]], axis=1)
            order = np.lexsort((where, -both), axis=1)[:, :k]
            cos[rows], at[rows] = np.take_along_axis(both, order, 1), np.take_along_axis(where, order, 1)
        i, j = np.nonzero((at >= 0) & (cos >= self.least) & (cos > -1.5))
        return i, at[i, j], cos[i, j]

    def answers(self, ids: pa.Array, unit: np.ndarray, own: bool) -> Iterator[pa.RecordBatch]:
        for s in range(0, len(unit), CHUNK):
            e = slice(s, s + CHUNK)
            i, place, cos = self.best(unit[e], np.arange(len(unit))[e] if own else None)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(i + s)), self.ids.take(pa.array(place)), pa.array(cos)], ["id", "other", "cos"])


def _reranked(batches: Iterator[pa.RecordBatch], k: int, least: float, dim: int, leaf_rows: int, target: float) -> Iterator[pa.RecordBatch]:
    """For rows sorted by (cell, block, role, id): the best ``k`` of every query of each cell.  Only the searched vectors of one cell are held."""
    now, held, cell = None, [], None

    def ready() -> Iterator[pa.RecordBatch]:
        nonlocal cell
        ids, unit = pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held])
        held.clear()
        cell = Cell(ids, unit, k, least, leaf_rows, target)
        yield from cell.answers(ids, unit, True)

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in range(3)], axis=1)
        starts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1))))
        for a, b in zip(starts, np.append(starts[1:], len(keys))):
            key, role = (keys[a, 0], keys[a, 1]), keys[a, 2]
            ids, unit = batch.column(3).slice(a, b - a), _blob(batch.column(4).slice(a, b - a), dim)
            if key != now:
                if held:
                    yield from ready()
                now, cell = key, None
            if role == 0:
                held.append((ids, unit))
                continue
            if held:
                yield from ready()
            if cell is not None:
                yield from cell.answers(ids, unit, False)
    if held:
        yield from ready()


def neighbours(
    df: DataFrame, vector: str, k: int = K, least: float = -1.0, key: str = "id", order: str = "seq", dim: int = DIM, trees: int = TREES,
    target: float = TARGET, cell_target: float = CELL_TARGET, few_cells: int = FEW_CELLS, cell_rows: int = CELL_ROWS, least_cell: int = LEAST_CELL,
    leaf_rows: int = LEAF_ROWS, sample: int = SAMPLE, deepest: int = DEEPEST,
) -> DataFrame:
    """``id``, ``other``, ``cos``, ``rank``: the ``k`` most similar others of every vector, of cosine ``least`` or more."""
    every = staged(units(df, vector, key, order, dim).withColumn("hash", F.xxhash64("unit")), "knn-units")
    kind = every.schema["id"].dataType.simpleString()
    firsts, copies = classes(every)

    n = every.count()
    wanted = max(min(math.log2(few_cells), math.ceil(math.log2(max(1.0, n / least_cell)))), math.ceil(math.log2(max(1.0, n / cell_rows))))
    model, _ = fitted(firsts, n, min(int(wanted), deepest), trees, sample, k, dim, target)
    sc = df.sparkSession.sparkContext
    forest = sc.broadcast(model)
    size = trees << model.levels

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = forest.value, np.zeros(size, np.int64)
        for batch in batches:
            place = (np.arange(trees) << held.levels) + held.cell(_blob(batch.column(0), dim))
            total += np.bincount(place.ravel(), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["cell", "rows"])

    counted = firsts.select("unit").mapInArrow(count, "cell int, rows bigint").groupBy("cell").agg(F.sum("rows").alias("rows")).toPandas()
    rows = np.zeros(size, np.int64)
    rows[counted["cell"].to_numpy()] = counted["rows"].to_numpy()
    blocks = np.maximum(1, -(-rows // cell_rows))

    entries = firsts.select("id", "unit").mapInArrow(
        functools.partial(_entries, forest=forest, blocks=sc.broadcast(blocks), dim=dim), f"cell int, block int, role tinyint, id {kind}, unit binary"
    )
    tasks = int(blocks.sum()) * (2 if blocks.sum() <= 500 else 1)  # few cells share a task
    near = entries.repartition(tasks, "cell", "block").sortWithinPartitions("cell", "block", "role", "id").mapInArrow(
        functools.partial(_reranked, k=k, least=least, dim=dim, leaf_rows=leaf_rows, target=cell_target), f"id {kind}, other {kind}, cos float"
    )
    best = Window.partitionBy("id").orderBy(F.desc("cos"), "other")
    near = near.groupBy("id", "other").agg(F.max("cos").alias("cos")).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).drop("rank")

    # copies: the k + 1 smallest ids of a class are all that can be among the k best of anything
    nth = Window.partitionBy("rep").orderBy("id")
    some = staged(copies.withColumn("nth", F.row_number().over(nth)).filter(F.col("nth") <= k + 1).select("rep", F.col("id").alias("copy")), "knn-few")
    targets = near.join(some.withColumnRenamed("rep", "other"), "other", "left").select("id", F.coalesce("copy", "other").alias("other"), "cos")
    queries = targets.withColumnRenamed("id", "rep").join(copies, "rep", "left").select(F.coalesce("id", "rep").alias("id"), "other", "cos")
    own = copies.join(some, "rep").filter(F.col("id") != F.col("copy")).select("id", F.col("copy").alias("other"), F.lit(1.0).cast("float").alias("cos"))
    return queries.unionByName(own).filter(F.col("cos") >= least).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
