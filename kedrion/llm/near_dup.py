"""Near-duplicate records with small edits: exact similarity join by signature trees.

Similarity of two texts: words in common over words in either, repeated words counted as often as
they occur, order ignored.  A text is the set of its (word, n-th occurrence) *elements*, so that is
the Jaccard similarity of sets.  All pairs of at least ``num/den`` are found; none is missed.

1. **Elements** - one pass over the texts; ids with several rows count once; texts of the same words
   form one *class*, of which only the member of the smallest id goes on.
2. **Routing** - elements are ordered by how many texts hold them (counted in ``2**BITS`` buckets: a
   table of fixed size, whatever the vocabulary).  Two similar texts share one of their rarest
   ``n - ceil(n num/den) + 1`` elements; each text is sent to the trees of those of them that any
   other text may be sent for.
3. **Signature trees** - the texts sent for one element, in order of size, are the leaves of a tree.
   Every node holds the OR of its texts' bitmaps, their range of sizes, the largest number
   of bits they lost to collisions and their longest remainder after the shared element.
4. **Dual traversal** - pairs of nodes are opened from the root down, level by level; a pair whose
   greatest possible overlap (common bits + lost bits, and the remainders) is below what the smallest
   sizes need, or whose sizes are too far apart, is dropped with all pairs below it.
5. **Exact check** - the pairs of leaves that survive are compared element by element.

An element sent for by more than ``CHUNK`` texts is split: its texts fall in slots, and each
pair of slots is a tree of its own, so no task holds more than two slots.  A partition's trees are built and
traversed together with array operations, whatever their number.

Defined results: null or empty texts and texts of fewer than ``min_words`` words are in no pair and no
group; repeated rows of an id count once (the first by ``seq``); null ids are left out; ties do not
occur (a pair is in or out); empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kedrion.llm.common import connected, first_rows
from kedrion.session import staged

NUM, DEN, MIN_WORDS = 7, 10, 20
BITS = 22  # buckets of the element counts: a broadcast of 2**BITS 4-byte numbers
WIDTH = 512  # bits of a signature
FAN = 8
CHUNK = 8192
BATCH_ROWS = 60_000
OPEN_PAIRS = 400_000
#: Up to so many exact copies of a text are written as all their pairs, more as pairs with their first.
COPIES_IN_FULL = 50
#: Members of a class that meet those of another, or their own, in one block.
BLOCK = 1000

_WORD = re.compile(r"[^\W_]+")
_CACHE = 1_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= _CACHE:
            self.clear()
        self[word] = value = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _elements(texts: list[str | None], min_words: int, cache: _Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which texts have enough words, their numbers of words, their elements one after another, sorted)."""
    found = [_WORD.findall(t.lower()) if t else () for t in texts]
    kept = np.array([i for i, w in enumerate(found) if len(w) >= min_words], dtype=np.int64)
    sizes = np.array([len(found[i]) for i in kept], dtype=np.int64)
    flat = np.fromiter((cache[w] for i in kept for w in found[i]), np.uint64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(kept)), sizes)
    flat = flat[np.lexsort((flat, doc))]
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != flat[:-1]) | (doc[1:] != doc[:-1])
    at = np.arange(len(flat))
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    flat = _mixed(flat + nth.astype(np.uint64) * _STEP)
    return kept, sizes, flat[np.lexsort((flat, doc))]


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)


def elements(df: DataFrame, key: str = "id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``id``, ``n``, ``same`` (a digest of the multiset of words), ``exact`` (of the text) and ``elems`` of the texts with enough words."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Hashes()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            kept, sizes, flat = _elements(texts, min_words, cache)
            ends = _offsets(sizes)
            same = [hashlib.blake2b(flat[a:b].tobytes(), digest_size=16).digest() for a, b in zip(ends, ends[1:])]
            exact = [hashlib.blake2b(texts[i].encode("utf-8", "surrogatepass"), digest_size=16).digest() for i in kept]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept)), pa.array(sizes, pa.int32()), pa.array(same, pa.binary()), pa.array(exact, pa.binary()), lists], ["id", "n", "same", "exact", "elems"])

    return df.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, n int, same binary, exact binary, elems array<bigint>")


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, values) of a column of lists of numbers."""
    lists = batch.column(batch.schema.get_field_index(name))
    values = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    return np.diff(np.asarray(lists.offsets)), values


def prefix(n: np.ndarray, num: int, den: int) -> np.ndarray:
    return n - -(-n * num // den) + 1


def _rarest(sizes: np.ndarray, flat: np.ndarray, counts: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, element, place) of the elements each text may be sent for, in order of their counts."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    how = counts[(flat & np.uint64(len(counts) - 1)).astype(np.int64)]
    order = np.lexsort((flat, how, doc))
    place = np.arange(len(flat)) - np.repeat(_offsets(sizes)[:-1], sizes)
    near = place < np.repeat(prefix(sizes, num, den), sizes)
    return doc[near], flat[order][near], place[near]


def _histogram(df: DataFrame, pick) -> np.ndarray:
    """Rows of each bucket over the whole of ``df``: summed on the executors, of fixed size on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            total += np.bincount((pick(batch) & np.uint64((1 << BITS) - 1)).astype(np.int64), minlength=1 << BITS)
        at = np.flatnonzero(total)
        for k in range(0, len(at), 100_000):
            part = at[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], ["bucket", "rows"])

    sums = df.mapInArrow(run, "bucket int, rows bigint").groupBy("bucket").agg(F.sum("rows").alias("rows")).toPandas()
    out = np.zeros(1 << BITS, np.int32)
    out[sums["bucket"].to_numpy()] = np.minimum(sums["rows"].to_numpy(), np.iinfo(np.int32).max)
    return out


def signatures(sizes: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bitmap, bits lost to collisions) of each text."""
    bits = np.zeros((len(sizes), WIDTH), bool)
    bits[np.repeat(np.arange(len(sizes)), sizes), ((flat >> np.uint64(32)) % np.uint64(WIDTH)).astype(np.int64)] = True
    return np.packbits(bits, axis=1), (sizes - bits.sum(axis=1)).astype(np.int32)


def routed(texts: DataFrame, num: int = NUM, den: int = DEN, chunk: int = CHUNK) -> DataFrame:
    """A row for each tree a text is a leaf of."""
    sc = texts.sparkSession.sparkContext
    kind = texts.schema["id"].dataType.simpleString()
    only = texts.select("elems")
    counts = sc.broadcast(_histogram(only, lambda b: _lists(b, "elems")[1]))
    sent = sc.broadcast(_histogram(only, lambda b: _rarest(*_lists(b, "elems"), counts.value, num, den)[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, flat = _lists(batch, "elems")
            sig, lost = signatures(sizes, flat)
            doc, elem, place = _rarest(sizes, flat, counts.value, num, den)
            many = sent.value[(elem & np.uint64((1 << BITS) - 1)).astype(np.int64)]
            use = many > 1
            doc, elem, place, many = doc[use], elem[use], place[use], many[use]
            slots = -(-many // chunk)
            first = np.zeros(len(sizes), np.uint64)
            np.bitwise_xor.at(first, np.repeat(np.arange(len(sizes)), sizes), flat)
            slot = (_mixed(first)[doc] % slots.astype(np.uint64)).astype(np.int64)
            copy = np.repeat(np.arange(len(doc)), slots)
            other = np.arange(len(copy)) - np.repeat(_offsets(slots)[:-1], slots)
            own = slot[copy]
            cell = np.minimum(own, other) * slots[copy] + np.maximum(own, other)
            doc, elem, place = doc[copy], elem[copy], place[copy]
            for k in range(0, len(doc), 50_000):
                s = slice(k, k + 50_000)
                d = doc[s]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(elem[s].view(np.int64)),
                        pa.array(cell[s]),
                        pa.array(own[s] != other[s]),
                        pa.array(own[s] > other[s]),
                        pa.array(sizes[d].astype(np.int32)),
                        pa.array((sizes[d] - place[s]).astype(np.int32)),
                        pa.array(lost[d]),
                        pa.array([v.tobytes() for v in sig[d]], pa.binary()),
                        batch.column(0).take(pa.array(d)),
                    ],
                    ["elem", "cell", "mixed", "side", "n", "rest", "lost", "sig", "id"],
                )

    return texts.select("id", "elems").mapInArrow(run, f"elem bigint, cell bigint, mixed boolean, side boolean, n int, rest int, lost int, sig binary, id {kind}")


class Forest:
    """Signature trees over rows sorted by tree and size; all trees are held level by level in arrays."""

    def __init__(self, tree: np.ndarray, n: np.ndarray, rest: np.ndarray, lost: np.ndarray, sig: np.ndarray):
        self.levels = [(sig, n, n, lost, rest)]
        self.children: list[np.ndarray] = []
        group = tree
        while True:
            count = len(group)
            new = np.ones(count, bool)
            new[1:] = group[1:] != group[:-1]
            starts = np.flatnonzero(new)
            if len(starts) == count:
                break
            within = np.arange(count) - np.repeat(starts, np.diff(np.append(starts, count)))
            first = np.flatnonzero(within % FAN == 0)
            bits, low, high, gone, left = self.levels[-1]
            self.levels.append((
                np.bitwise_or.reduceat(bits, first, axis=0), np.minimum.reduceat(low, first), np.maximum.reduceat(high, first),
                np.maximum.reduceat(gone, first), np.maximum.reduceat(left, first),
            ))
            self.children.append(np.append(first, count))
            group = group[first]

    def _kept(self, level: int, a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
        """Whether a pair of nodes may hold a pair of similar texts."""
        bits, low, high, lost, rest = self.levels[level]
        need = -(-(low[a] + low[b]) * num // (num + den))
        ok = (high[a] * den >= num * low[b]) & (high[b] * den >= num * low[a]) & (np.minimum(rest[a], rest[b]) >= need)
        at = np.flatnonzero(ok)
        if len(at):
            a, b = a[at], b[at]
            common = np.bitwise_count(bits[a] & bits[b]).sum(axis=1, dtype=np.int64)
            ok[at] = common + np.minimum(lost[a], lost[b]) >= need[at]
        return ok

    def pairs(self, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows (first < second, of one tree) that survive the dual traversal."""
        roots = np.arange(len(self.levels[-1][1]))
        stack = [(len(self.levels) - 1, roots, roots)]
        while stack:
            level, a, b = stack.pop()
            if not level:
                yield a, b
                continue
            ends = self.children[level - 1]
            many = (ends[a + 1] - ends[a]) * (ends[b + 1] - ends[b])
            if len(a) > 1 and many.sum() > OPEN_PAIRS:  # open a bounded number of pairs at once
                half = len(a) // 2
                stack += [(level, a[:half], b[:half]), (level, a[half:], b[half:])]
                continue
            of = np.repeat(np.arange(len(a)), many)
            k = np.arange(len(of)) - np.repeat(_offsets(many)[:-1], many)
            wide = (ends[b + 1] - ends[b])[of]
            x, y = ends[a][of] + k // wide, ends[b][of] + k % wide
            ok = x < y if level == 1 else x <= y
            x, y = x[ok], y[ok]
            ok = self._kept(level - 1, x, y, num, den)
            if ok.any():
                stack.append((level - 1, x[ok], y[ok]))


def _joined(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Pairs of ids from rows sorted by (elem, cell, n)."""
    held: list[pa.RecordBatch] = []

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        column = {c: table.column(c).combine_chunks() for c in table.column_names}
        elem, cell = column["elem"].to_numpy(), column["cell"].to_numpy()
        new = np.ones(len(elem), bool)
        new[1:] = (elem[1:] != elem[:-1]) | (cell[1:] != cell[:-1])
        tree = np.cumsum(new)
        lone = new & np.append(new[1:], True)
        row = np.flatnonzero(~lone)
        if not len(row):
            return
        sig = column["sig"].take(pa.array(row))
        sig = np.frombuffer(b"".join(sig.to_pylist()), np.uint64).reshape(len(row), WIDTH // 64)
        number = {c: column[c].to_numpy().astype(np.int64)[row] for c in ("n", "rest", "lost")}
        mixed, side = (column[c].to_numpy(zero_copy_only=False)[row] for c in ("mixed", "side"))
        forest = Forest(tree[row], number["n"], number["rest"], number["lost"], sig)
        for a, b in forest.pairs(num, den):
            ok = ~mixed[a] | (side[a] != side[b])
            x, y = column["id"].take(pa.array(row[a[ok]])), column["id"].take(pa.array(row[b[ok]]))
            yield pa.RecordBatch.from_arrays([x, y], ["x", "y"])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= BATCH_ROWS:
            table = pa.Table.from_batches(held)
            elem, cell = table.column("elem").to_numpy(), table.column("cell").to_numpy()
            new = np.flatnonzero((elem[1:] != elem[:-1]) | (cell[1:] != cell[:-1])) + 1
            if len(new):
                yield from solve(table.slice(0, int(new[-1])))
                held = table.slice(int(new[-1])).combine_chunks().to_batches()
    if held:
        yield from solve(pa.Table.from_batches(held))


def class_pairs(texts: DataFrame, num: int = NUM, den: int = DEN, chunk: int = CHUNK) -> DataFrame:
    """All pairs (``x`` < ``y``) of ids of ``texts`` (``id``, ``n``, ``elems``) of at least the similarity."""
    kind = texts.schema["id"].dataType.simpleString()
    rows = routed(texts, num, den, chunk).repartition("elem", "cell").sortWithinPartitions("elem", "cell", "n")
    found = rows.mapInArrow(functools.partial(_joined, num=num, den=den), f"x {kind}, y {kind}")
    found = staged(found.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).filter("x <> y").distinct(), "near-candidates")
    needed = found.select(F.col("x").alias("id")).union(found.select("y")).distinct()
    own = staged(texts.select("id", "elems").join(needed, "id", "left_semi"), "near-elements")
    both = found.join(own.select(F.col("id").alias("x"), F.col("elems").alias("ex")), "x").join(own.select(F.col("id").alias("y"), F.col("elems").alias("ey")), "y")
    shared = F.size(F.array_intersect("ex", "ey"))
    return both.filter(shared * (num + den) >= (F.size("ex") + F.size("ey")) * num).select("x", "y")


def classes(df: DataFrame, key: str = "id", text: str = "text", order: str = "seq", min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """(one text of each class: ``id``, ``n``, ``elems``; members of classes of several: ``id``, ``rep``, ``copies``, ``exact``)."""
    every = staged(elements(first_rows(df, key, order), key, text, min_words), "near-texts")
    firsts = first_rows(every, "same", "id").select("id", "n", "elems")
    groups = every.groupBy("same").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).filter("copies > 1")
    members = staged(every.select("id", "same", "exact").join(groups, "same").select("id", "rep", "copies", "exact"), "near-members")
    return firsts, members


def similar_pairs(df: DataFrame, key: str = "id", text: str = "text", order: str = "seq", num: int = NUM, den: int = DEN, min_words: int = MIN_WORDS) -> DataFrame:
    """Pairs (``id_a`` < ``id_b``) of similar records.

    More than ``COPIES_IN_FULL`` exact copies of a text are written as pairs of their first with each other
    one, and stand by it in pairs with other texts; nothing else is left out.  Members of large classes
    meet in blocks of ``BLOCK``.
    """
    firsts, members = classes(df, key, text, order, min_words)
    pairs = class_pairs(firsts, num, den)
    alike = members.groupBy("rep", "exact").agg(F.min("id").alias("first"), F.count("*").alias("alike")).filter(F.col("alike") > COPIES_IN_FULL)
    marked = members.join(alike, ["rep", "exact"], "left")
    standing = marked.filter("first is null or id = first").select("id", "rep")
    slots = standing.groupBy("rep").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("slots"))
    standing = standing.join(slots, "rep").withColumn("slot", F.pmod(F.xxhash64("id"), F.col("slots")).cast("int"))
    standing = staged(standing, "near-standing")
    large = slots.filter("slots > 1")

    def opened(pairs: DataFrame, side: str) -> DataFrame:
        """A pair of classes for each member of one; the pair of slots is part of the key."""
        one = standing.select(F.col("rep").alias(side), F.col("slot").alias(f"__{side}"), F.col("id").alias("__member"))
        rows = pairs.join(one, [side, f"__{side}"], "left").filter(f"__member is not null or __slots_{side} is null")
        return rows.withColumn(side, F.coalesce("__member", side)).drop("__member")

    for side in ("x", "y"):
        pairs = pairs.join(large.select(F.col("rep").alias(side), F.col("slots").alias(f"__slots_{side}")), side, "left")
        pairs = pairs.withColumn(f"__{side}", F.explode(F.sequence(F.lit(0), F.coalesce(f"__slots_{side}", F.lit(1)) - 1)))
    between = opened(opened(pairs, "x"), "y")
    every = F.explode(F.sequence(F.lit(0), F.col("slots") - 1))
    left = standing.select("rep", F.col("id").alias("x"), F.col("slot").alias("i"), every.alias("j"))
    right = standing.select("rep", F.col("id").alias("y"), every.alias("i"), F.col("slot").alias("j"))
    within = left.join(right, ["rep", "i", "j"]).filter("x < y").select("x", "y")
    star = marked.filter("id <> first").select(F.col("first").alias("x"), F.col("id").alias("y"))
    every = between.select("x", "y").union(within).union(star)
    return every.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def groups(df: DataFrame, key: str = "id", text: str = "text", order: str = "seq", num: int = NUM, den: int = DEN, min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each record with a similar one: ``id``, ``group_id`` (smallest id of its connected group), ``class_id``, ``n_links``."""
    firsts, members = classes(df, key, text, order, min_words)
    pairs = staged(class_pairs(firsts, num, den), "near-pairs")
    sizes = members.filter("id = rep").select("rep", "copies")
    ends = pairs.select("x", "y").union(pairs.select("y", "x")).toDF("rep", "other")
    links = (
        ends.join(sizes.toDF("other", "copies"), "other", "left").groupBy("rep").agg(F.sum(F.coalesce("copies", F.lit(1))).alias("links"))
    )
    label = connected(pairs, "x", "y")  # node, root
    reps = links.join(sizes, "rep", "full").join(label.toDF("rep", "root"), "rep", "left").select(
        "rep", F.coalesce("root", "rep").alias("group_id"), (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links")
    )
    return reps.join(members.select("rep", "id"), "rep", "left").select(F.coalesce("id", "rep").alias("id"), "group_id", F.col("rep").alias("class_id"), "n_links")
