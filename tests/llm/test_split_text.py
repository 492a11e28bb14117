import itertools
import random
import re
import unicodedata

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kedrion.llm import split_text as sp

PIECES = st.lists(st.sampled_from(["слово ", "a. ", "\n", "\n\n", "x" * 40, "длинное-слово", " ", "\r\n", "Конец! ", "é"]), max_size=120).map("".join)


def check(text, limit, overlap):
    found = sp.pieces(text, limit, overlap)
    assert found[0][0] == 0 and found[-1][1] == len(text)
    assert all(0 < b - a <= limit for a, b, _ in found) or not text
    assert all(n[0] == p[1] - overlap and n[1] > p[1] for p, n in zip(found, found[1:]))
    assert text[: found[0][1]] + "".join(text[a + overlap : b] for a, b, _ in found[1:]) == text  # round trip
    return found


@settings(max_examples=150, deadline=None)
@given(PIECES, st.sampled_from([(60, 10), (100, 0), (200, 60), (2000, 200)]))
def test_pieces_hold_to_limit_and_overlap(text, sizes):
    if text:
        check(text, *sizes)


def cost(text, ends, limit, overlap, marks):
    count = 1 + -(-(len(text) - limit) // (limit - overlap))
    even = (len(text) + (count - 1) * overlap) / count
    total, before = 0.0, None
    for e in ends:
        length = e if before is None else e - before + overlap
        total += ((length - even) / even) ** 2 + 1 + sp.PENALTY[marks[e]]
        before = e
    return total


def test_cuts_cost_the_least(monkeypatch):
    monkeypatch.setattr(sp, "GRID", 1)
    rng = random.Random(4)
    for _ in range(40):
        text = "".join(rng.choice(["аб ", "где. ", "\n", "жзик "]) for _ in range(14))
        limit, overlap = 20, 4
        if len(text) <= limit:
            continue
        marks = dict(zip(*map(list, sp.boundaries(text, limit - overlap))))
        inner = [p for p in marks if 0 < p < len(text)]
        best = min(
            cost(text, [*c, len(text)], limit, overlap, marks)
            for r in range(1, 6)
            for c in itertools.combinations(inner, r)
            if overlap < c[0] <= limit and all(b - a <= limit - overlap for a, b in zip(c, [*c[1:], len(text)]))
        )
        ends = [b for _, b, _ in sp.pieces(text, limit, overlap)]
        assert abs(cost(text, ends, limit, overlap, marks) - best) < 1e-9


def plain(text, limit, overlap, at, kind):
    """Least cost over the given boundaries, one position after another."""
    step = limit - overlap
    count = 1 + -(-(len(text) - limit) // step)
    even = (len(text) + (count - 1) * overlap) / count
    best = np.full(len(at), np.inf)
    for j in range(1, len(at)):
        if overlap < at[j] <= limit:
            best[j] = ((at[j] - even) / even) ** 2
        i = np.arange(max(1, np.searchsorted(at, at[j] - step)), j)
        if len(i):
            best[j] = min(best[j], (best[i] + ((at[j] - at[i] + overlap - even) / even) ** 2).min())
        best[j] += 1 + sp.PENALTY[kind[j]]
    return best[-1]


@pytest.mark.parametrize("table,field", [("text_nodes", "text"), ("sections", "subtree_text")])
def test_no_split_over_all_boundaries_is_cheaper(table, field):
    """All texts of sf0.01: every end of a paragraph, line, sentence and word is open to the plain programme."""
    rows = pq.read_table(f"/root/testdata/sf0.01/{table}.parquet", columns=[field]).column(0).to_pylist()
    some = [t for t in rows if t and len(t) > sp.LIMIT]
    assert some
    for text in some:
        marks = {m.end(): 3 for m in re.finditer(r"\s+", text)}
        marks |= {m.end(): 2 for m in re.finditer(r"[.!?…][)»\"”']*\s+", text)}
        marks |= {m.end(): 1 for m in re.finditer(r"\n", text)}
        marks |= {m.end(): 0 for m in re.finditer(r"(?<=\n)\r?\n", text)}
        marks[len(text)] = 0
        at = sorted(marks)
        for a, b in zip([0, *at], at):
            if b - a > 1800:
                marks |= {p: 4 for p in range(a + sp.GRID, b, sp.GRID) if not unicodedata.combining(text[p])}
        at = np.array([0, *sorted(marks)])
        kind = np.array([0, *(marks[p] for p in at[1:])])
        mine = sp.pieces(text)
        assert cost(text, [b for _, b, _ in mine], sp.LIMIT, sp.OVERLAP, marks) <= plain(text, sp.LIMIT, sp.OVERLAP, at, kind) + 1e-6


def test_cuts_inside_words_that_fit_are_never_cheapest():
    rng = random.Random(9)
    for _ in range(60):
        text = "".join(rng.choice(["а", "бв", " ", "где. ", "\n"]) for _ in range(60))
        limit, overlap = 24, rng.choice([0, 4, 8])
        at, kind = sp.boundaries(text, limit - overlap)
        every = np.arange(len(text) + 1)
        kinds = np.full(len(every), 4)
        kinds[at] = kind
        if len(text) > limit and not (kind == 4).any():
            assert sp.programme(at, kind, limit, overlap)[0][-1] <= plain(text, limit, overlap, every, kinds) + 1e-9


def test_natural_boundaries_are_taken():
    text = "\n".join("Строка номер %d. " % i + "слово " * 20 for i in range(100))
    assert {k for *_, k in check(text, 2000, 200)[:-1]} == {1}
    assert {k for *_, k in check("слово " * 2000, 2000, 200)[:-1]} == {3}
    assert {k for *_, k in check("я" * 9000, 2000, 200)[:-1]} == {4}


def test_paragraphs_are_kept_among_short_lines():
    text = "ab\n" * 5 + "cd\n\n" + "ef\n" * 20
    text = text * 60
    found = dict(zip(*map(list, sp.boundaries(text, 1800))))
    ends = [i + 2 for i in range(len(text)) if text.startswith("\n\n", i)]
    assert all(found.get(p) == 0 for p in ends)
    assert {k for *_, k in check(text, 2000, 200)} == {0}


@pytest.mark.parametrize("text,kind", [("a\n" * 1500, "line"), ("б " * 1500, "word"), ("в" * 2001, "none"), ("г" * 2000 + "\n" + "д" * 2000, "line"), (" ".join(["е" * 1500] * 2), "word")])
def test_coarsest_boundary(text, kind):
    assert sp.coarsest(text) == kind


def test_operator_with_dirt(spark):
    long = "\n".join("Длинная строка с номером %d и словами." % i for i in range(50_000))
    rows = [(1, None, "x", 1), (2, "", "y", 2), (3, "кратко", None, 3), (4, long, "z", 4), (4, long, "z", 4), (5, "😀" * 2000, "w", 5), (6, "😀" * 2001, None, 6)]
    df = spark.createDataFrame(rows, "id bigint, text string, boundary string, piece int")
    got = sp.split(df.withColumnRenamed("piece", "n"), "text", ["id"], with_text=True).collect()
    assert {r.id for r in got} == {4, 6}
    four = sorted((r.piece, r.piece_text) for r in got if r.id == 4)
    assert len(four) == 2 * four[-1][0] + 2 and all(len(t) <= 2000 for _, t in four)
    assert four[0][1] + "".join(t[200:] for _, t in four[2::2]) == long
    assert {r.id for r in sp.split(df, "text", ["id"], whole=True).collect()} == {3, 4, 5, 6}
    assert sp.split(df.limit(0), "text", ["id"]).count() == 0
