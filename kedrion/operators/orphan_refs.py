"""References to records that do not exist, by compressed bitmaps of dictionary-coded keys.

1. **Dictionary** - the keys of all referring fields and parent tables get integer codes: keys are
   hashed to buckets of about one bitmap's keys and numbered within their bucket in order, so codes are
   dense in their ranges and need no global order;
2. **Bitmaps** - for each key range: one bitmap a referring field and period of the keys referred to, one
   a parent table of the keys that have any row, and one a period of the keys whose first live row falls
   in it.  Bits are set by a map-side aggregate, so a key that a third of all rows refer to costs one
   bit a partition; finished bitmaps are packed (array of positions, or zlib-compressed bits);
3. **AND-NOT** - per key range, on packed bitmaps only: ``missing = refs AND NOT any``,
   ``removed = refs AND any AND NOT live``, ``late = refs AND live AND NOT live up to the period``; keys first
   live in the very period of the reference are *close*: their rows are told apart by the exact time;
4. **Decoding** - surviving bits become (field, key, period, reason) and are joined back to the rows.

Reasons, the first that applies: ``missing`` no row has the id; ``removed`` no live row has it; ``late``
the earliest time of its live rows is after that of the referring row.

Defined results: null keys are not references; a referring row without a time has a null period and is
never late; parent rows without a time are live from the beginning; repeated rows are reported each;
empty tables give an empty result; extra columns, also of the names used here, are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kedrion.session import staged, staged_with

RANGE_BITS = 15  # keys of one bitmap: 2**15, the size of the built-in bitmap aggregate
FILL = 24_000  # rows (keys by field, period or table) for which a bucket is made
_FEW = 2048  # positions up to which a bitmap is kept as an array


@dataclass(frozen=True)
class Reference:
    """One referring field: the rows' table, the field, and the parent table whose ``id`` it names."""

    table: str
    field: str
    rows: DataFrame
    parent: str


def pack(bits: bytes) -> bytes:
    """A compressed bitmap: ``a`` + 2-byte positions, or ``z`` + compressed bits, whichever is smaller."""
    at = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little"))
    if len(at) <= _FEW:
        array = b"a" + at.astype(np.uint16).tobytes()
        if len(at) <= 64:
            return array
        dense = b"z" + zlib.compress(bits, 1)
        return min(array, dense, key=len)
    return b"z" + zlib.compress(bits, 1)


def unpack(packed: bytes) -> np.ndarray:
    """Packed bitmap -> its 2**RANGE_BITS bits, eight a byte."""
    if packed[:1] == b"z":
        return np.frombuffer(zlib.decompress(packed[1:]), np.uint8)
    out = np.zeros(1 << RANGE_BITS, bool)
    out[np.frombuffer(packed[1:], np.uint16)] = True
    return np.packbits(out, bitorder="little")


def positions(bits: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bits, bitorder="little"))


def _period(column: str) -> F.Column:
    return F.date_format(column, "yyyy-MM")


def _referring(refs: list[Reference], seq: str, loaded: str) -> DataFrame:
    """``ref``, ``key``, ``seq``, ``at``, ``period`` of every reference that is not null; each table is read once for all its fields."""
    tables: dict[int, list[int]] = {}
    for k, r in enumerate(refs):
        tables.setdefault(id(r.rows), []).append(k)
    out = None
    for own in tables.values():
        named = F.explode(F.array(*[F.struct(F.lit(k).alias("ref"), F.col(refs[k].field).alias("key")) for k in own])).alias("r")
        rows = refs[own[0]].rows.select(F.col(seq).alias("seq"), F.col(loaded).cast("timestamp").alias("at"), _period(loaded).alias("period"), named)
        rows = rows.select("r.ref", "r.key", "seq", "at", "period").filter("key is not null")
        out = rows if out is None else out.unionByName(rows)
    return out


def _coded(refs: list[Reference], parents: dict[str, DataFrame], id_: str, seq: str, loaded: str, removed: str, fill: int) -> DataFrame:
    """Referred keys by field and period, and parents' keys, with their codes: ``range``, ``pos``."""
    live = F.when(F.col(removed).isNull(), F.coalesce(F.col(loaded).cast("timestamp"), F.lit("0001-01-01").cast("timestamp")))
    union = None
    for name, df in parents.items():
        rows = df.filter(F.col(id_).isNotNull()).groupBy(F.col(id_).alias("key")).agg(F.min(live).alias("since")).select(
            F.lit(name).alias("parent"), F.lit(None).cast("int").alias("ref"), "key", F.lit(None).cast("string").alias("period"), "since"
        )
        union = rows if union is None else union.unionByName(rows)
    parent = F.element_at(F.array(*[F.lit(r.parent) for r in refs]), F.col("ref") + 1)
    rows = _referring(refs, seq, loaded).select("ref", "key", "period").distinct().select(
        parent.alias("parent"), "ref", "key", "period", F.lit(None).cast("timestamp").alias("since")
    )
    union = rows if union is None else union.unionByName(rows)
    union, seen = staged_with(union, "orphan-marks", rows=F.count("*"))
    buckets = max(1, -(-seen["rows"] // fill))
    union = union.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    number = F.dense_rank().over(Window.partitionBy("bucket").orderBy("key")) - 1
    return (
        union.withColumn("number", number)
        .withColumn("range", F.col("bucket") * (1 << 32) + F.shiftright("number", RANGE_BITS))
        .withColumn("pos", F.col("number").bitwiseAND((1 << RANGE_BITS) - 1))
        .drop("number", "bucket")
    )


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        batch["bits"] = [pack(bytes(b)) for b in batch["bits"]]
        yield batch


#: What a bitmap holds.
_REFERRED, _ANY, _LIVE = 0, 1, 2


def _and_not(group: pd.DataFrame) -> pd.DataFrame:
    """The surviving bits of one key range."""
    out = {"range": [], "pos": [], "ref": [], "period": [], "reason": []}
    where = group["range"].iloc[0]
    nothing = np.zeros(1 << (RANGE_BITS - 3), np.uint8)
    for _, of in group.groupby("parent", sort=False):
        every = nothing.copy()
        for b in of.loc[of["kind"] == _ANY, "bits"]:
            every |= unpack(b)
        lives = {p: unpack(b) for p, b in of.loc[of["kind"] == _LIVE, ["period", "bits"]].itertuples(index=False)}
        months, upto, live = sorted(lives), [], nothing
        for p in months:  # live up to and with each period
            live = live | lives[p]
            upto.append(live)
        for ref, period, bits in of.loc[of["kind"] == _REFERRED, ["ref", "period", "bits"]].itertuples(index=False):
            referred = unpack(bits)
            known = period is not None and period == period
            found = {"missing": referred & ~every, "removed": referred & every & ~live}
            if known:
                k = bisect.bisect_right(months, period)
                found["late"] = referred & live & ~(upto[k - 1] if k else nothing)
                found["close"] = referred & lives.get(period, nothing)
            for reason, mask in found.items():
                if mask.any():
                    at = positions(mask)
                    out["pos"].append(at)
                    for name, value in (("range", where), ("ref", int(ref)), ("period", period if known else None), ("reason", reason)):
                        out[name] += [value] * len(at)
    out["pos"] = np.concatenate(out["pos"]) if out["pos"] else np.zeros(0, np.int64)
    return pd.DataFrame(out)


def orphans(refs: list[Reference], parents: dict[str, DataFrame], id_: str = "id", seq: str = "seq", loaded: str = "loaded_at", removed: str = "removed_at", fill: int = FILL) -> DataFrame:
    """``ref_table``, ``ref_field``, ``seq``, ``reason``, ``period``: one row for each failing reference."""
    coded = staged(_coded(refs, parents, id_, seq, loaded, removed, fill), "orphan-codes")
    marks = (
        coded.filter("ref is not null").select("range", "pos", "parent", "ref", F.lit(_REFERRED).alias("kind"), "period")
        .unionByName(coded.filter("ref is null").select("range", "pos", "parent", F.lit(None).cast("int").alias("ref"), F.lit(_ANY).alias("kind"), F.lit(None).cast("string").alias("period")))
        .unionByName(coded.filter("ref is null and since is not null").select("range", "pos", "parent", F.lit(None).cast("int").alias("ref"), F.lit(_LIVE).alias("kind"), _period("since").alias("period")))
    )
    bitmaps = marks.groupBy("range", "parent", "ref", "kind", "period").agg(F.bitmap_construct_agg(F.col("pos").cast("bigint")).alias("bits"))
    bitmaps = bitmaps.mapInPandas(_packed, bitmaps.schema)
    left = bitmaps.groupBy("range").applyInPandas(_and_not, "range bigint, pos bigint, ref int, period string, reason string")
    keys = coded.filter("ref is not null").select(
        F.col("range").alias("k_range"), F.col("pos").alias("k_pos"), F.col("ref").alias("k_ref"), F.col("period").alias("k_period"), "parent", "key"
    )
    same = (F.col("range") == F.col("k_range")) & (F.col("pos") == F.col("k_pos")) & (F.col("ref") == F.col("k_ref"))
    left = left.join(keys, same & F.col("period").eqNullSafe(F.col("k_period"))).select("ref", "key", "period", "parent", "reason")
    since = coded.filter("ref is null and since is not null").select("parent", "key", "since")
    left = left.join(since, ["parent", "key"], "left").select("ref", F.col("key").alias("__key"), F.col("period").alias("__period"), "reason", F.when(F.col("reason") == "close", F.col("since")).alias("since"))
    left = staged(left, "orphan-keys")
    rows, own = _referring(refs, seq, loaded), left.withColumnRenamed("ref", "__ref")
    hit = rows.join(own, (F.col("ref") == F.col("__ref")) & (F.col("key") == F.col("__key")) & F.col("period").eqNullSafe(F.col("__period")))

    def of(values: list[str]) -> F.Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("ref") + 1)

    return hit.filter((F.col("reason") != "close") | (F.col("since") > F.col("at"))).select(
        of([r.table for r in refs]).alias("ref_table"), of([r.field for r in refs]).alias("ref_field"), "seq",
        F.when(F.col("reason") == "close", "late").otherwise(F.col("reason")).alias("reason"), "period",
    )


def summary(found: DataFrame) -> DataFrame:
    """Failing references by table, field, period and reason."""
    return found.groupBy("ref_table", "ref_field", "period", "reason").agg(F.count("*").alias("n_refs"))
