import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kedrion.operators.orphan_refs import Reference, orphans, pack, positions, summary, unpack

T = dt.datetime
ROWS = "seq bigint, ref string, loaded_at timestamp, removed_at timestamp, bits string, range int"
PARENTS = "seq bigint, id string, loaded_at timestamp, removed_at timestamp, period string, key string"


def brute(refs, parents):
    out = set()
    for seq, ref, at, *_ in refs:
        if ref is None:
            continue
        rows = [p for p in parents if p[1] == ref]
        live = [p[2] or T.min for p in rows if p[3] is None]
        period = at.strftime("%Y-%m") if at else None
        if not rows:
            out.add((seq, "missing", period))
        elif not live:
            out.add((seq, "removed", period))
        elif at and min(live) > at:
            out.add((seq, "late", period))
    return out


def found(spark, refs, parents):
    rows = spark.createDataFrame(refs, ROWS)
    frame = spark.createDataFrame(parents, PARENTS)
    return orphans([Reference("t", "ref", rows, "p")], {"p": frame}, fill=60)


def test_against_brute_force_with_dirt(spark):
    rng = random.Random(5)
    day = lambda: T(2024, rng.randint(1, 4), rng.randint(1, 28), rng.randint(0, 23))
    parents = [(i, rng.choice([f"k{rng.randint(0, 40)}", None]), rng.choice([day(), day(), None]), rng.choice([None, day()]), "x", "y") for i in range(120)]
    refs = [(i, rng.choice([f"k{rng.randint(0, 55)}", "k1", None, ""]), rng.choice([day(), day(), day(), None]), None, "b", 1) for i in range(400)]
    refs += refs[:20]
    got = found(spark, refs, parents).collect()
    assert {(r.seq, r.reason, r.period) for r in got} == brute(refs, parents)
    failing = {seq for seq, *_ in brute(refs, parents)}
    assert len(got) == sum(1 for r in refs if r[0] in failing)
    assert set(found(spark, refs, parents).columns) == {"ref_table", "ref_field", "seq", "reason", "period"}


def test_late_within_the_month_is_exact(spark):
    parents = [(0, "a", T(2024, 3, 10), None, None, None)]
    refs = [(1, "a", T(2024, 3, 9), None, None, None), (2, "a", T(2024, 3, 10), None, None, None), (3, "a", T(2024, 2, 1), None, None, None), (4, "a", T(2024, 4, 1), None, None, None)]
    assert {(r.seq, r.reason) for r in found(spark, refs, parents).collect()} == {(1, "late"), (3, "late")}


@pytest.mark.parametrize("refs,parents,n", [([], [], 0), ([], [(0, "a", None, None, None, None)], 0), ([(1, "a", T(2024, 1, 1), None, None, None)], [], 1), ([(1, None, None, None, None, None)], [], 0)])
def test_empty_tables(spark, refs, parents, n):
    assert found(spark, refs, parents).count() == n


def test_hot_key_and_summary(spark):
    refs = [(i, "hot", T(2024, 1 + i % 2, 1), None, None, None) for i in range(3000)]
    got = summary(found(spark, refs, [(0, "other", T(2024, 1, 1), None, None, None)])).collect()
    assert {(r.period, r.reason, r.n_refs) for r in got} == {("2024-01", "missing", 1500), ("2024-02", "missing", 1500)}


@settings(max_examples=50, deadline=None)
@given(st.sets(st.integers(0, (1 << 15) - 1), max_size=200), st.booleans())
def test_bitmaps_round_trip(at, dense):
    import numpy as np

    bits = np.zeros(1 << 15, bool)
    bits[list(at)] = True
    if dense:
        bits[::3] = True
    packed = pack(np.packbits(bits, bitorder="little").tobytes())
    assert (positions(unpack(packed)) == np.flatnonzero(bits)).all()
    assert dense or len(packed) <= 1 + 2 * len(at)
