"""Vector functions: cosine as an expression, and exact search in blocks."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries of one broadcast block.
QUERY_BLOCK = 4096


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; -1 if a vector is null, of length zero, or of another dimension."""
    size = norm(a) * norm(b)
    return F.coalesce(F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size), F.lit(-1.0))


def _cosines(queries: list, vectors: list) -> np.ndarray:
    """Cosines in double precision, -1 where either vector has none."""
    out = np.full((len(queries), len(vectors)), -1.0)
    by_size: dict[int, list[int]] = {}
    for j, v in enumerate(vectors):
        if v is not None and len(v):
            by_size.setdefault(len(v), []).append(j)
    for size, at in by_size.items():
        own = [i for i, q in enumerate(queries) if q is not None and len(q) == size]
        if not own:
            continue
        x = np.array([vectors[j] for j in at], np.float64)
        q = np.array([queries[i] for i in own], np.float64)
        nx, nq = np.linalg.norm(x, axis=1), np.linalg.norm(q, axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            c = (q @ x.T) / nq[:, None] / nx[None, :]
        out[np.ix_(own, at)] = np.where((nq[:, None] > 0) & (nx[None, :] > 0), c, -1.0)
    return out


def _best(batches: Iterator[pd.DataFrame], queries, k: int) -> Iterator[pd.DataFrame]:
    ids, vectors = queries.value
    held: list[tuple] = []  # of each query: similarities, places and ids of its best so far
    for batch in batches:
        c = np.round(_cosines(vectors, list(batch["vector"])), 9)
        rows, seqs = batch["id"].to_numpy(), batch["seq"].to_numpy()
        m = min(k, len(rows))
        if not m:
            continue
        bound = np.partition(c, len(rows) - m, axis=1)[:, len(rows) - m]
        for i in range(len(ids)):
            near = np.flatnonzero(c[i] >= bound[i])  # ties are settled by ``seq``
            sim, seq, row = c[i, near], seqs[near], rows[near]
            if i < len(held):
                sim, seq, row = (np.concatenate(pair) for pair in zip(held[i], (sim, seq, row)))
            top = np.lexsort((seq, -sim))[:k]
            best = (sim[top], seq[top], row[top])
            if i < len(held):
                held[i] = best
            else:
                held.append(best)
    if held:
        sizes = [len(h[0]) for h in held]
        sim, seq, row = (np.concatenate([h[c] for h in held]) for c in range(3))
        yield pd.DataFrame({"query_id": np.repeat(np.array(ids, dtype=object), sizes), "id": row, "seq": seq, "sim": sim})


def nearest(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """The ``k`` rows most similar to each query: ``query_id``, ``id``, ``seq``, ``sim`` (9 digits), ``rank``.

    ``queries``: ``query_id``, ``q_emb``; ``rows``: ``id``, ``seq``, ``vector``.  The stated queries meet all
    rows in blocks of ``QUERY_BLOCK`` by matrix products; each partition sends on ``k`` rows a query, so
    the shuffle does not grow with the vectors.  Ties go to the smaller ``seq``.
    """
    spark = rows.sparkSession
    kind = rows.schema["id"].dataType.simpleString()
    q_kind = queries.schema["query_id"].dataType.simpleString()
    total = queries.count()
    blocks = max(1, -(-total // QUERY_BLOCK))
    out = None
    for b in range(blocks):
        block = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).select("query_id", "q_emb").toPandas()
        shared = spark.sparkContext.broadcast((list(block["query_id"]), [v if v is not None else None for v in block["q_emb"]]))
        part = rows.select("id", "seq", "vector").mapInPandas(functools.partial(_best, queries=shared, k=k), f"query_id {q_kind}, id {kind}, seq bigint, sim double")
        out = part if out is None else out.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("sim"), "seq")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
