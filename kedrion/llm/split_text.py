"""Splitting oversized texts at natural boundaries, by dynamic programming.

A text longer than ``limit`` characters (code points) is cut into pieces of at most ``limit``;
each piece but the first begins exactly ``overlap`` characters before the end of the one before.
So the pieces are given by their ends ``e1 < e2 < ... = len(text)`` with ``e1 <= limit`` and steps of at
most ``limit - overlap``.

* **boundary positions** - every end of a paragraph (blank line), line, sentence and word of the whole text.  A
  stretch without white space that is longer than a step has no boundary inside; only there cuts lie on a
  grid of ``GRID`` characters.  (In a shorter one a cut is never cheapest: two cuts at ends of words take its
  place for less.);
* **cost** - of a cut, the penalty of its kind and one for the piece; of a piece, the square of its
  relative distance from the even size;
* **dynamic programme** - least cost to end a piece at each position, over all positions one step
  before; the pieces follow from the kept predecessors.  Positions are solved in blocks of ``BLOCK``, from
  the positions before the block at once; two steps in a row that together fit in one are never cheapest,
  so within a block one more step is all there can be.

``boundary`` tells, of the whole text, the coarsest boundary that suffices.  It is the bottleneck of
the same programme without overlap: the least kind (``line``, ``word``, ``none``) whose boundaries alone lead to
the end in pieces of at most ``limit``, where a line end or white space may itself lie on either side of a cut.

Only texts over the limit reach Python, each as one row; the work is linear in the text.

Defined results: null, empty and short texts give no row (or themselves as one piece with
``whole=True``); repeated rows give repeated pieces; ties go to the later predecessor; other columns
are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP, GRID = 2000, 200, 50
KINDS = ("paragraph", "line", "sentence", "word", "none")
PENALTY = np.array((0.0, 0.25, 1.0, 4.0, 16.0))
BLOCK = 64

_SENTENCE = re.compile(r"[.!?…][)»\"”']*\s+")
_SPACE = np.zeros(1 << 16, bool)
_SPACE[[c for c in range(1 << 16) if chr(c).isspace()]] = True  # none lies beyond


def _characters(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(code points, whether white space) of the text."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return code, _SPACE[np.minimum(code, 0xFFFF)]


def _solvable(at: np.ndarray, n: int, limit: int) -> bool:
    """Whether a programme without overlap over the boundaries ``at`` reaches the end: no two neighbours are too far apart."""
    return bool(np.diff(at, prepend=0, append=n).max() <= limit)


def coarsest(text: str, limit: int = LIMIT) -> str:
    code, space = _characters(text)
    line = np.flatnonzero(code == 10)
    if _solvable(np.stack([line, line + 1], axis=1).ravel(), len(text), limit):
        return "line"
    word = np.flatnonzero(space)
    return "word" if _solvable(np.stack([word, word + 1], axis=1).ravel(), len(text), limit) else "none"


def boundaries(text: str, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, kinds) in order, from 0 to the end, no two further apart than ``step``."""
    n = len(text)
    code, space = _characters(text)
    kind = np.full(n + 1, 9, np.int8)
    kind[1:n][space[:-1] & ~space[1:]] = 3
    kind[np.array([m.end() for m in _SENTENCE.finditer(text)], np.int64)] = 2
    line = np.flatnonzero(code == 10) + 1
    kind[line] = 1
    bare = line - 1 - (code[np.maximum(line - 2, 0)] == 13) * (line > 1)  # where the line before the break ends
    kind[line[(bare > 0) & (code[np.maximum(bare - 1, 0)] == 10)]] = 0
    kind[[0, n]] = 0
    at = np.flatnonzero(kind < 9)
    if (np.diff(at) > step).any():
        for k in np.flatnonzero(np.diff(at) > step):
            for p in range(at[k] + GRID, at[k + 1], GRID):
                kind[p - 1 if unicodedata.combining(text[p]) or text[p - 1 : p + 1] == "\r\n" else p] = 4
        at = np.flatnonzero(kind < 9)
    return at, kind[at]


def programme(at: np.ndarray, kind: np.ndarray, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """(least cost to end a piece, predecessor) of each boundary."""
    n, step = int(at[-1]), limit - overlap
    count = 1 + -(-(n - limit) // step)
    even = (n + (count - 1) * overlap) / count  # size of a piece
    p = at / even
    base = overlap / even - 1
    own = 1 + PENALTY[kind]
    cost, come = np.full(len(at), np.inf), np.full(len(at), -1)
    first = np.searchsorted(at, at - step)  # the earliest predecessor of each
    start = 1
    while start < len(at):
        end = min(start + BLOCK, int(np.searchsorted(at, at[start] + step, "right")), len(at))
        block = np.arange(start, end)
        head = (at[block] <= limit) & ((at[block] > overlap) | (block == len(at) - 1))
        best = np.where(head, (p[block] - 1) ** 2, np.inf)
        origin = np.where(head, 0, -1)
        cost[block] = best + own[block]
        for low, high in ((max(1, first[start]), start), (start, end)):  # from before the block, then within it
            if low >= high:
                continue
            before = np.arange(high - 1, low - 1, -1)  # ties go to the later one
            c = (p[block][:, None] - (p[before] - base)[None, :]) ** 2 + cost[before]
            c[(before[None, :] < first[block][:, None]) | (before[None, :] >= block[:, None])] = np.inf
            least = c.argmin(axis=1)
            value = c[np.arange(len(block)), least]
            better = (value < best) | ((value == best) & np.isfinite(value))
            best, origin = np.where(better, value, best), np.where(better, before[least], origin)
            cost[block] = best + own[block]
        come[block] = origin
        start = end
    return cost, come


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, end, kind of the cut at the end) of each piece."""
    n = len(text)
    if n <= limit:
        return [(0, n, 0)]
    at, kind = boundaries(text, limit - overlap)
    _, come = programme(at, kind, limit, overlap)
    out, j = [], len(at) - 1
    while j > 0:
        i = int(come[j])
        out.append((int(at[i]) - overlap if i > 0 else 0, int(at[j]), int(kind[j])))
        j = i
    return out[::-1]


def split(df: DataFrame, text: str, keys: list[str], limit: int = LIMIT, overlap: int = OVERLAP, whole: bool = False, with_text: bool = False) -> DataFrame:
    """One row for each piece: ``keys``, ``piece``, ``n_pieces``, ``start``, ``end``, ``cut``, ``boundary`` and, on request, ``piece_text``.

    ``cut`` is the kind of boundary at the piece's end (``end`` for the last), ``boundary`` that of
    the whole text.  ``keys`` must not have the names of the other columns.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be less than limit")
    fields = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join([*(f"`{k}` {fields[k]}" for k in keys), "piece int, n_pieces int, `start` int, `end` int, cut string, boundary string"])
    schema += ", piece_text string" * with_text

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for *key, t in batch.itertuples(index=False, name=None):
                found = pieces(t, limit, overlap)
                boundary = coarsest(t, limit)
                for k, (a, b, kind) in enumerate(found):
                    row = (*key, k, len(found), a, b, KINDS[kind] if k + 1 < len(found) else "end", boundary)
                    rows.append((*row, t[a:b]) if with_text else row)
            columns = [*keys, "piece", "n_pieces", "start", "end", "cut", "boundary", *["piece_text"] * with_text]
            yield pd.DataFrame(rows, columns=columns)

    rows = df.select(*[F.col(k) for k in keys], F.col(text).alias("__text"))
    rows = rows.filter("__text is not null and length(__text) > 0" if whole else f"length(__text) > {int(limit)}")
    return rows.mapInPandas(run, schema)
