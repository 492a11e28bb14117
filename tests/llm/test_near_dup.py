import collections
import random
import re

import pytest

from kedrion.llm import near_dup as nd
from kedrion.llm.common import connected

ROWS = "seq bigint, id string, text string, n int, elems string, same string"


def words(t):
    return collections.Counter(re.findall(r"[^\W_]+", t.lower()))


def brute(rows, num, den, least):
    first = {}
    for seq, i, t, *_ in sorted(rows, key=lambda r: r[0]):
        if i is not None:
            first.setdefault(i, t)
    bags = {i: words(t) for i, t in first.items() if t and sum(words(t).values()) >= least}
    ids = sorted(bags)
    out = set()
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common, every = sum((bags[a] & bags[b]).values()), sum((bags[a] | bags[b]).values())
            if common * den >= num * every:
                out.add((a, b))
    return out


def sample(seed, n, vocabulary):
    rng = random.Random(seed)
    vocab = [f"слово{i}" for i in range(vocabulary)]
    texts = []
    while len(texts) < n:
        base = [rng.choice(vocab) for _ in range(rng.randint(18, 70))]
        for _ in range(rng.choice([1, 1, 2, 4])):
            copy = list(base)
            for _ in range(rng.randint(0, 12)):
                k = rng.randrange(len(copy))
                copy[k : k + 1] = rng.choice([[], [rng.choice(vocab)], [copy[k], rng.choice(vocab)]])
            if rng.random() < 0.3:
                rng.shuffle(copy)
            texts.append(rng.choice([" ", ", ", "\n", "_"]).join(copy))
    return [(k, f"id{k:04d}", t, 1, "x", None) for k, t in enumerate(texts)]


@pytest.mark.parametrize("seed,vocabulary,chunk,ratio", [(1, 400, 8192, (7, 10)), (2, 25, 8192, (7, 10)), (3, 60, 5, (7, 10)), (4, 200, 8192, (8, 10)), (5, 60, 40, (5, 10))])
def test_pairs_equal_brute_force(spark, monkeypatch, seed, vocabulary, chunk, ratio):
    rows = sample(seed, 160, vocabulary)
    rows += [(1000 + k, *r[1:]) for k, r in enumerate(rows[:10])]  # ids with several rows
    rows += [(2000, None, rows[0][2], 1, "", ""), (2001, "null", None, 1, "", ""), (2002, "empty", "", 1, "", ""), (2003, "short", "три слова тут", 1, "", "")]
    rows += [(2004, "same-a", rows[3][2], 1, "", ""), (2005, "same-b", rows[3][2].upper(), 1, "", ""), (2006, "long", "тест " * 30_000, 1, "", ""), (2007, "long2", "тест " * 29_000 + "иное", 1, "", "")]
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    firsts, members = nd.classes(df)
    truth = brute(rows, *ratio, 20)
    monkeypatch.setattr(nd, "CHUNK", chunk)
    got = [tuple(r) for r in nd.similar_pairs(df, num=ratio[0], den=ratio[1]).collect()]
    assert len(got) == len(set(got)) and set(got) == truth
    if chunk < 100:  # trees split in slots
        inner = {tuple(r) for r in nd.class_pairs(firsts, *ratio, chunk=chunk).collect()}
        reps = {r.id for r in firsts.collect()}
        assert inner == {p for p in truth if p[0] in reps and p[1] in reps}


def test_groups_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(nd, "COPIES_IN_FULL", 3)
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(k, f"c{k}", text, 0, "", "") for k in range(8)] + [(20, "near", text + " extra", 0, "", ""), (21, "far", " ".join(f"v{i}" for i in range(30)), 0, "", "")]
    df = spark.createDataFrame(rows, ROWS)
    pairs = {tuple(r) for r in nd.similar_pairs(df).collect()}
    assert pairs == {("c0", f"c{k}") for k in range(1, 8)} | {("c0", "near")}
    got = {r.id: r for r in nd.groups(df).collect()}
    assert set(got) == {f"c{k}" for k in range(8)} | {"near"}
    assert {r.group_id for r in got.values()} == {"c0"} and got["near"].n_links == 8 and got["c5"].n_links == 8 and got["c5"].class_id == "c0"


def test_large_classes_of_different_texts(spark, monkeypatch):
    """Texts of the same words in another order are no exact copies: all their pairs are written."""
    monkeypatch.setattr(nd, "COPIES_IN_FULL", 50)
    monkeypatch.setattr(nd, "BLOCK", 20, raising=False)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(30)]
    other = base[:-1] + ["other"]
    texts = [" ".join(rng.sample(words, 30)) for words in (base, other) for _ in range(51)]
    rows = [(k, f"v{k:03d}", t, 0, "", "") for k, t in enumerate(texts)] + [(200 + k, f"w{k:03d}", texts[0], 0, "", "") for k in range(60)]
    got = [tuple(r) for r in nd.similar_pairs(spark.createDataFrame(rows, ROWS)).collect()]
    ids = [f"v{k:03d}" for k in range(102)]
    assert len(got) == len(set(got))
    assert set(got) == {(a, b) for a in ids for b in ids if a < b} | {("v000", f"w{k:03d}") for k in range(60)}


def test_empty(spark):
    df = spark.createDataFrame([], ROWS)
    assert nd.similar_pairs(df).count() == 0 and nd.groups(df).count() == 0


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(40)] + [(200, i) for i in range(201, 260)]
    label = {}
    find = lambda x: x if label.setdefault(x, x) == x else find(label[x])
    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            label[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()}
    assert got == {x: find(x) for x in list(label)}
