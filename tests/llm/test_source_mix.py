import pathlib
import random

import pytest
from pyspark.sql import functions as F

from kedrion.llm import source_mix as sm
from kedrion.llm.queries import TOKENIZER

DOCS = "doc_id bigint, source string, weight double, tokens bigint"
TARGETS = "source string, target_share double, max_repeats int, needed string"


def documents(spark, seed=1, n=4000):
    rng = random.Random(seed)
    sources = ["big"] * 6 + ["mid"] * 3 + ["small"] + [None]
    rows = [(i, rng.choice(sources), 1.0, rng.choice([0, 5, 50, 90, 400])) for i in range(n)]
    return rows, spark.createDataFrame(rows, DOCS)


def test_shares_are_met_within_one_document(spark):
    rows, df = documents(spark)
    total = sum(r[3] for r in rows)
    have = {s: sum(r[3] for r in rows if r[1] == s) for s in ("big", "mid", "small")}
    targets = [("big", 0.2, 1, ""), ("mid", 0.5, 3, ""), ("small", 0.3, 2, ""), ("none", 0.0, 1, ""), (None, 0.1, 1, "")]
    chosen, report = sm.mix(df, spark.createDataFrame(targets, TARGETS))
    got = chosen.collect()
    assert len(got) == len(rows) and all(r.repeats == 0 for r in got if r.source is None)
    told = {r.source: r for r in report.collect()}
    cap = {"big": 1, "mid": 3, "small": 2}
    for s, share in (("big", 0.2), ("mid", 0.5), ("small", 0.3)):
        given = sum(r.tokens * r.repeats for r in got if r.source == s)
        need = min(share * total, cap[s] * have[s])
        assert abs(given - need) <= 200.5 and given == told[s].given and max(r.repeats for r in got if r.source == s) <= cap[s]
        assert told[s].short == (cap[s] * have[s] < share * total) and told[s].available == have[s]
        levels = {r.repeats for r in got if r.source == s and r.tokens}
        assert max(levels) - min(levels) <= 1  # certain whole copies, and one more for some
    assert told["none"].given == 0 and not told["none"].short and abs(sum(r.actual_share for r in told.values()) - 1) < 1e-9
    again = {r.doc_id: r.repeats for r in sm.mix(df.repartition(7), spark.createDataFrame(targets, TARGETS))[0].collect()}
    assert again == {r.doc_id: r.repeats for r in got}
    other = {r.doc_id: r.repeats for r in sm.mix(df, spark.createDataFrame(targets, TARGETS), seed=8)[0].collect()}
    assert other != again


def test_inclusion_follows_the_weights(spark):
    rows = [(i, "s", 3.0 if i % 2 else 1.0, 10) for i in range(8000)] + [(10_000, "s", 0.0, 10), (10_001, "s", 50.0, 10), (10_002, "t", 1.0, 80_000)]
    df = spark.createDataFrame(rows, DOCS)
    chosen, _ = sm.mix(df, spark.createDataFrame([("s", 0.2, 2, ""), ("t", 0.5, 1, "")], TARGETS))
    got = {r.doc_id: r.repeats for r in chosen.filter("source = 's'").collect()}
    odd, even = sum(got[i] for i in range(1, 8000, 2)), sum(got[i] for i in range(0, 8000, 2))
    assert 2.6 < odd / even < 3.4 and got[10_000] == 0 and got[10_001] == 2
    assert abs(sum(got.values()) * 10 - 0.2 * 160_030) <= 10


@pytest.mark.parametrize("rows", [[], [(1, "s", 1.0, 0)], [(1, None, 1.0, 5)]])
def test_empty_and_nothing_to_take(spark, rows):
    df = spark.createDataFrame(rows, DOCS)
    for targets in ([], [("s", None, None, None), ("S", 0.5, 2, "")]):
        chosen, report = sm.mix(df, spark.createDataFrame(targets, TARGETS))
        assert chosen.count() == len(rows) and report.count() == len(targets)
        assert all(r.repeats == 0 for r in chosen.collect())


def test_token_counts(spark):
    texts = ["Привет, мир!", "", None, "one two  three\n", "слово " * 50_000, "<|endoftext|>"]
    df = spark.createDataFrame([(i, t, " A-b ", "x") for i, t in enumerate(texts)], "doc_id bigint, text string, source string, tokens string")
    got = {r.doc_id: r for r in sm.sized(df, F.lower("source"), TOKENIZER).collect()}
    encode = sm.encoder(pathlib.Path(TOKENIZER).read_bytes(), sm.PATTERN)
    assert got[1].tokens == got[2].tokens == 0 and got[4].tokens >= 50_000 and got[0].source == " a-b "
    for i in (0, 3, 5):
        ids = encode.encode_ordinary(texts[i])
        assert got[i].tokens == len(ids) and encode.decode(ids) == texts[i]  # an exact round trip
    assert sm.sized(df.limit(0), F.lower("source"), TOKENIZER).count() == 0


def test_many_spellings_that_are_no_target(spark):
    """Sums, cuts and shares have one row for each target, however many other spellings there are."""
    df = spark.range(60_000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 6 == 0, "s").otherwise(F.concat(F.lit("x"), "id")).alias("source"), F.lit(1.0).alias("weight"), F.lit(10).cast("bigint").alias("tokens")
    )
    chosen, report = sm.mix(df, spark.createDataFrame([("s", 0.1, 3, "")], TARGETS))
    row = report.collect()[0]
    assert row.given == 60_000 and row.available == 100_000 and not row.short
    got = chosen.groupBy("repeats").count().collect()
    assert {r.repeats: r["count"] for r in got} == {0: 54_000, 1: 6_000}


def test_short_follows_from_the_draw(spark):
    df = spark.createDataFrame([(i, "s" if i < 10 else "t", 1.0, 100) for i in range(100)], DOCS)
    told = {r.source: r for r in sm.mix(df, spark.createDataFrame([("s", 0.3, 2, ""), ("t", 0.7, 1, ""), ("u", 0.1, 5, ""), ("v", 0.0, 5, "")], TARGETS))[1].collect()}
    assert told["s"].short and told["s"].given == 2000 and not told["t"].short and told["t"].given == 7000
    assert told["u"].short and not told["v"].short
