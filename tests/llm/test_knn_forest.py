import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from kedrion.llm import knn_forest as kf

ROWS = "seq bigint, id string, v array<float>, unit string, rank int"


def brute(rows, k, dim):
    first = {}
    for seq, i, v, *_ in sorted(rows, key=lambda r: r[0]):
        if i is not None:
            first.setdefault(i, v)
    ok = {i: np.array(v, np.float64) for i, v in first.items() if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = sorted(ok)
    x = np.array([ok[i] / np.linalg.norm(ok[i]) for i in ids]).astype(np.float32)
    out = {}
    for a, i in enumerate(ids):
        c = np.round(x @ x[a], 5)
        order = sorted((b for b in range(len(ids)) if b != a), key=lambda b: (-c[b], ids[b]))[:k]
        out[i] = [(ids[b], c[b]) for b in order]
    return out


def data(n, dim, seed=0, topics=6):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((topics, dim))
    which = rng.choice(topics, n, p=[0.5] + [0.5 / (topics - 1)] * (topics - 1))
    return [(k, f"v{k:05d}", [float(t) for t in centre[w] + 0.3 * rng.standard_normal(dim)], "x", 1) for k, w in enumerate(which)]


def test_exact_when_everything_is_opened_with_dirt(spark):
    rows = data(300, 8)
    rows += [(1000 + k, r[1], [1.0] * 8, "", 0) for k, r in enumerate(rows[:5])]  # later rows of known ids
    rows += [(2000 + k, f"copy{k:02d}", rows[7][2], "", 0) for k in range(15)]  # more copies than k
    rows += [(3000, "null", None, "", 0), (3001, "zero", [0.0] * 8, "", 0), (3002, "dim", [1.0] * 7, "", 0), (3003, "nan", [float("nan")] + [1.0] * 7, "", 0), (3004, None, [1.0] * 8, "", 0), (3005, "gap", [None] + [1.0] * 7, "", 0)]
    truth = brute(rows, 10, 8)
    for sizes in ({"least_cell": 40}, {"least_cell": 40, "cell_rows": 20, "deepest": 1, "leaf_rows": 8}):  # cells with leaves; cells cut into blocks
        got = {}
        for r in kf.neighbours(spark.createDataFrame(rows, ROWS).repartition(3), "v", dim=8, trees=2, target=1.0, cell_target=1.0, **sizes).collect():
            got.setdefault(r.id, {})[r.rank] = (r.other, r.cos)
        assert set(got) == set(truth)
        for i, near in truth.items():
            mine = [got[i][r] for r in range(1, len(near) + 1)]
            assert [round(float(c), 4) for _, c in mine] == pytest.approx([c for _, c in near], abs=2e-4)
            if near[0][1] >= 0.9999:  # copies come first, in order of their ids
                assert [o for o, _ in mine] == [o for o, _ in near]


def recall(spark, df, field, ids, x, **settings):
    """Shares of the 10 nearest, and of those of cosine 0.9 and more, found for every fiftieth row against all rows."""
    asked = np.flatnonzero(np.arange(len(x)) % 50 == 0)
    cos = x[asked] @ x.T
    cos[np.arange(len(asked)), asked] = -2
    best = np.argpartition(-cos, 10, axis=1)[:, :10]
    ranked = kf.neighbours(df, field, **settings)
    names = spark.createDataFrame([(str(ids[a]),) for a in asked], "id string")
    got = {(r.id, r.other): r.cos for r in ranked.join(names, "id", "left_semi").collect()}
    bound = {str(ids[a]): np.sort(cos[q])[-10] for q, a in enumerate(asked)}
    tens = np.mean([sum(c >= bound[i] - 1e-5 for (i, _), c in got.items()) / (10 * len(asked))])
    near = [(str(ids[a]), str(ids[b])) in got for q, a in enumerate(asked) for b in best[q] if cos[q, b] >= 0.9]
    return min(1.0, tens), np.mean(near) if near else 1.0


def vectors(folder, table, field):
    rows = pq.read_table(f"{folder}/{table}.parquet", columns=["id", "seq", field]).to_pandas().sort_values("seq").drop_duplicates("id")
    rows = rows[[v is not None and len(v) == 64 and np.isfinite(v).all() and np.any(v) for v in rows[field]]]
    x = np.stack(rows[field].to_numpy()).astype(np.float64)
    return rows["id"].to_numpy(), (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
@pytest.mark.parametrize("table,field", [("text_nodes", "embedding"), ("sections", "e_local"), ("sections", "e_subtree")])
def test_recall_on_the_tables(spark, folder, table, field):
    at = f"/root/testdata/{folder}"
    tens, near = recall(spark, spark.read.parquet(f"{at}/{table}.parquet"), field, *vectors(at, table, field))
    assert tens >= 0.95 and near >= 0.99


def test_recall_in_a_hot_topic_and_deeper_trees(spark, tmp_path):
    """A third of all vectors in one topic of cosines around 0.9, where the ten nearest do bind; levels fitted on executors."""
    rng = np.random.default_rng(3)
    n, dim = 30_000, 64
    centre = rng.standard_normal((100, dim))
    centre /= np.linalg.norm(centre, axis=1, keepdims=True)
    topic = np.where(rng.random(n) < 1 / 3, 0, rng.integers(1, 100, n))
    x = centre[topic] + np.where(topic == 0, 0.333, 0.6)[:, None] / np.sqrt(dim) * rng.standard_normal((n, dim))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    ids = np.array([f"v{i:06d}" for i in range(n)])
    pq.write_table(pa.table({"seq": np.arange(n), "id": ids, "v": pa.FixedSizeListArray.from_arrays(x.ravel(), dim).cast(pa.list_(pa.float32()))}), tmp_path / "v.parquet")
    df = spark.read.parquet(str(tmp_path / "v.parquet"))
    for settings in ({}, {"sample": 512, "cell_rows": 1000, "leaf_rows": 200}):
        tens, near = recall(spark, df, "v", ids, x, **settings)
        assert tens >= 0.93 and near >= 0.9, (settings, tens, near)


def test_small_and_empty(spark):
    assert kf.neighbours(spark.createDataFrame([], ROWS), "v", dim=4).count() == 0
    two = spark.createDataFrame([(0, "a", [1.0, 0.0, 0.0, 0.0], "", 0), (1, "b", [1.0, 1.0, 0.0, 0.0], "", 0)], ROWS)
    got = sorted((r.id, r.other, round(r.cos, 3), r.rank) for r in kf.neighbours(two, "v", dim=4).collect())
    assert got == [("a", "b", 0.707, 1), ("b", "a", 0.707, 1)]
    assert kf.neighbours(two, "v", dim=4, least=0.9).count() == 0


def test_ties_go_to_the_smaller_id(spark):
    """Sixty vectors, all at one cosine from each other."""
    rows = [(k, f"v{k:02d}", [1.0 if j == k else 0.0 for j in range(60)], "", 0) for k in range(60)]
    got = {}
    for r in kf.neighbours(spark.createDataFrame(rows, ROWS), "v", dim=60).collect():
        got.setdefault(r.id, []).append((r.rank, r.other))
    for i, found in got.items():
        assert [o for _, o in sorted(found)] == [f"v{k:02d}" for k in range(60) if f"v{k:02d}" != i][:10]


def test_cells_opened_are_those_within_the_margin():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1000, 6)).astype(np.float32)
    forest = kf.Forest(x, 3, 3)
    assert forest.levels == 3
    forest.margin = np.float32(0.4)
    row, tree, cell = forest.opened(x[:50])
    seen = set(zip(row.tolist(), tree.tolist(), cell.tolist()))
    assert len(seen) == len(row)
    own = forest.cell(x)
    for q in range(50):
        for t in range(3):
            for end in range(8):
                key = 0.0
                for level in range(3):
                    node, child = (8 + end) >> (3 - level), (8 + end) >> (2 - level)
                    p = float(x[q] @ forest.directions[t, node] - forest.thresholds[t, node])
                    key = max(key, -p if child & 1 else p)
                assert ((q, t, end) in seen) == (key <= 0.4) or abs(key - 0.4) < 1e-4
    pairs = rng.integers(0, 1000, (200, 2))
    need = forest.needed(x[pairs[:, 0]], x[pairs[:, 1]])
    for (a, b), margin in zip(pairs, need):
        forest.margin = margin
        row, tree, cell = forest.opened(x[[a]])
        assert any(own[b, t] == c for t, c in zip(tree, cell))
