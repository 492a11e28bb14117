"""Mixing sources to target shares of the total tokens, by Pareto order sampling.

1. every document is sized in tokens of a public tokenizer (its file is a parameter);
2. a source with target share ``s`` needs ``s x total`` tokens; each of its documents is expected in
   ``e`` copies, ``e`` in proportion to its weight (1 unless a weight column is given) and at most
   ``max_repeats``.  ``floor(e)`` copies are certain;
3. what is left of ``e`` is the inclusion probability ``p`` of one more copy: documents are ranked by
   random odds over inclusion odds, ``(u / (1-u)) / (p / (1-p))`` (Pareto order sampling), and
   taken in that order until the source's tokens come closest to what it needs.  ``u`` is a hash of
   the document's key and the seed, so the sample is the same on every run and cluster.

The cut in a source's order is found without sorting the source: tokens are summed in
``BUCKETS`` buckets of the rank (a map-side aggregate), the bucket that holds the cut is found on
those sums, and only documents of that one bucket are ordered.  A source that holds a third of all
rows is thus never gathered in one task.  Sources short of tokens give ``max_repeats`` copies of all
their documents; the report tells their actual share.

Defined results: null or empty texts have 0 tokens and are still listed; a null or unlisted source
counts in the total and gets no copies; repeated targets of one source add their shares and take the
larger ``max_repeats``; null shares are 0, null ``max_repeats`` are 1; null or negative weights are
0; repeated document rows are documents of their own; empty tables give empty results.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kedrion.session import staged

#: How the vocabulary's texts are cut before merging.  Fixed value: the published byte-level pattern.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BUCKETS = 4096
#: Targets are joined by broadcast while their names take up to so many bytes.
FEW_BYTES = 4 << 20


@functools.lru_cache(maxsize=2)
def encoder(vocabulary: bytes, pattern: str):
    """The tokenizer of a vocabulary file (a token in base64 and its rank in each line)."""
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in vocabulary.splitlines() if line.strip())}
    return tiktoken.Encoding("mix", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def sized(documents: DataFrame, source: Column, tokenizer: str, pattern: str = PATTERN, doc_id: str = "doc_id", text: str = "text", weight: str | None = None) -> DataFrame:
    """``doc_id``, ``source``, ``weight`` and ``tokens`` of every document row.

    ``tokenizer`` is the path of a vocabulary file on the driver; its content (about a MB) is sent to the executors.
    """
    kind = documents.schema[doc_id].dataType.simpleString()
    with open(tokenizer, "rb") as file:
        vocabulary = documents.sparkSession.sparkContext.broadcast(file.read())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(vocabulary.value, pattern).encode_ordinary
        for batch in batches:
            tokens = [len(encode(t)) if t else 0 for t in batch["__text"]]
            yield batch.drop(columns="__text").assign(tokens=tokens)

    rows = documents.select(F.col(doc_id).alias("doc_id"), source.alias("source"), _weight(weight).alias("weight"), F.col(text).alias("__text"))
    return rows.mapInPandas(count, f"doc_id {kind}, source string, weight double, tokens bigint")


def _weight(column: str | None) -> Column:
    return F.greatest(F.coalesce(F.col(column).cast("double"), F.lit(0.0)), F.lit(0.0)) if column else F.lit(1.0)


def measured(documents: DataFrame, source: Column, size: Column, doc_id: str = "doc_id", weight: str | None = None) -> DataFrame:
    """As ``sized``, by any other measure of size than tokens (characters, bytes, rows)."""
    return documents.select(F.col(doc_id).alias("doc_id"), source.alias("source"), _weight(weight).alias("weight"), F.coalesce(size.cast("bigint"), F.lit(0)).alias("tokens"))


def uniform(key: str, seed: int) -> Column:
    """A number between 0 and 1 from the md5 of the key and the seed."""
    digits = F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("bigint") + 0.5) / float(1 << 52)


def mix(docs: DataFrame, targets: DataFrame, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(documents with ``repeats``, report by source) for the sized documents ``docs``.

    ``targets``: ``source``, ``target_share``, ``max_repeats``; sources are compared exactly.
    Documents: ``doc_id``, ``source``, ``tokens``, ``repeats``.  Report: ``source``,
    ``target_share``, ``max_repeats``, ``available``, ``needed``, ``given``, ``actual_share`` (of the
    mix), ``given_share`` (of the tokens of all documents) and ``short``: every document of the source was
    drawn as often as allowed, and what they gave is less than needed.
    """
    docs = staged(docs, "mix-sized")
    goals = (
        targets.filter("source is not null").groupBy("source")
        .agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).cast("double").alias("cap"))
    )
    total = docs.agg(F.sum("tokens")).first()[0] or 0
    few = (goals.agg(F.sum(F.octet_length("source") + 64)).first()[0] or 0) <= FEW_BYTES

    def small(df: DataFrame) -> DataFrame:
        """A table with one row for each source of the targets."""
        return F.broadcast(df) if few else df

    listed = docs.join(small(goals.select("source")), "source", "left_semi")  # spellings that are no target end here
    sums = listed.groupBy("source").agg(F.sum("tokens").alias("available"), F.sum(F.col("weight") * F.col("tokens")).alias("weighed"), F.max(F.col("weight") != 1).alias("weighted"))
    plan = goals.join(sums, "source", "left").select(
        "source", "target_share", "cap", "weighted",
        F.coalesce("available", F.lit(0)).alias("available"),
        F.coalesce("weighed", F.lit(0.0)).alias("weighed"),
        (F.col("target_share") * float(total)).alias("needed"),
    )
    plan = staged(plan.withColumn("rate", F.when(F.col("weighed") > 0, F.col("needed") / F.col("weighed")).otherwise(0.0)), "mix-plan")
    if plan.filter("weighted").limit(1).count():
        plan = _level(listed, plan, small)

    known = listed.join(small(plan.select("source", "cap", "needed", "rate")), "source")
    copies = F.least(F.col("cap"), F.col("rate") * F.col("weight"))
    known = known.withColumn("__e", F.when((F.col("tokens") > 0) & copies.isNotNull(), copies).otherwise(0.0))
    known = known.withColumn("__whole", F.floor(F.col("__e") + 1e-12))
    p = F.col("__e") - F.col("__whole")
    u = uniform("doc_id", seed)
    odds = (u / (1 - u)) * ((1 - p) / p)
    known = known.withColumn("__rank", F.when(p > 1e-12, odds / (1 + odds)))
    known = known.withColumn("__bucket", F.when(F.col("__rank").isNotNull(), F.least(F.floor(F.col("__rank") * BUCKETS), F.lit(BUCKETS - 1))))

    in_order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    tokens = F.sum(F.when(F.col("__bucket").isNotNull(), F.col("tokens")).otherwise(0))
    sums = known.groupBy("source", F.coalesce("__bucket", F.lit(-1)).alias("bucket")).agg(tokens.alias("t"), F.sum(F.col("__whole") * F.col("tokens")).alias("sure"))
    cuts = (
        sums.withColumn("before", F.coalesce(F.sum("t").over(in_order), F.lit(0))).withColumn("sure", F.sum("sure").over(Window.partitionBy("source")))
        .join(small(plan.select("source", "needed")), "source")
        .withColumn("open", F.col("needed") - F.col("sure") - F.col("before"))
        .filter((F.col("open") > 0) & (F.col("open") <= F.col("t")))
        .select("source", F.col("bucket").alias("cut"), "open")
    )
    cuts = staged(cuts, "mix-cuts")
    known = known.join(small(cuts), "source", "left")
    upto = Window.partitionBy("source").orderBy("__rank", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = F.col("__bucket") == F.col("cut")
    #: without a cut the whole order is taken: the source's tokens do not exceed what is left to give
    inside = F.col("__bucket").isNotNull() & (F.col("cut").isNull() | (F.col("__bucket") < F.col("cut")))
    columns = ["doc_id", "source", "tokens"]
    plain = known.filter(~F.coalesce(edge, F.lit(False))).select(*columns, "cap", (F.col("__whole") + F.when(inside, 1).otherwise(0)).cast("int").alias("repeats"))
    taken = F.sum("tokens").over(upto) - F.col("tokens") / 2 <= F.col("open")  # the nearer total
    close = known.filter(edge).withColumn("__more", F.when(taken, 1).otherwise(0)).select(*columns, "cap", (F.col("__whole") + F.col("__more")).cast("int").alias("repeats"))
    drawn = staged(plain.unionByName(close), "mix-drawn")
    unlisted = docs.join(small(goals.select("source")), "source", "left_anti").select(*columns, F.lit(0).alias("repeats"))

    full = F.min(F.when(F.col("tokens") > 0, F.col("repeats") >= F.col("cap")).otherwise(True))
    given = drawn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("given"), full.alias("full"))
    report = plan.join(small(given), "source", "left").withColumn("given", F.coalesce("given", F.lit(0)))
    whole = report.agg(F.sum("given").alias("__mix"))
    report = report.crossJoin(F.broadcast(whole)).select(  # one row
        "source", "target_share", F.col("cap").cast("int").alias("max_repeats"), "available", "needed", "given",
        F.when(F.col("__mix") > 0, F.col("given") / F.col("__mix")).alias("actual_share"),
        (F.col("given") / F.lit(float(total or 1))).alias("given_share"),
        (F.coalesce("full", F.lit(True)) & (F.col("given") < F.col("needed"))).alias("short"),
    )
    return drawn.drop("cap").unionByName(unlisted), report


def _level(docs: DataFrame, plan: DataFrame, small: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Raise the rates of sources whose heaviest documents meet their cap, until nothing changes."""
    before = -1.0
    while True:
        rows = docs.join(small(plan), "source")
        capped = F.col("rate") * F.col("weight") >= F.col("cap")
        state = rows.groupBy("source").agg(
            F.sum(F.when(capped, F.col("tokens") * F.col("cap")).otherwise(0.0)).alias("full"),
            F.sum(F.when(~capped, F.col("tokens") * F.col("weight")).otherwise(0.0)).alias("free"),
        )
        left = F.col("needed") - F.col("full")
        rate = F.when((F.col("free") > 0) & (left > 0), F.greatest(F.col("rate"), left / F.col("free"))).otherwise(F.col("rate"))
        plan = staged(plan.join(state, "source", "left").withColumn("rate", F.coalesce(rate, "rate")), "mix-plan")
        now = plan.agg(F.sum("full")).first()[0] or 0.0
        plan = plan.drop("full", "free")
        if now <= before:
            return plan
        before = now
