"""Evaluation passages inside corpus documents: Wu-Manber search over normalised words.

The unit of the alphabet is the *word*, not the character.  Patterns are all windows of
``min_words`` consecutive words of the test items, so the shortest pattern length ``m`` equals
``min_words`` for all of them:

* **shift table** - blocks of ``BLOCK`` words; the shift of a block is how far the search window may
  move when its last ``BLOCK`` words are that block.  A block in no pattern moves it by
  ``m - BLOCK + 1`` words, so most of a clean document is never looked at.
* **suffix buckets** - patterns whose last block has shift 0, keyed by that block.
* **direct comparison** - the window is compared word by word with the patterns of its bucket.

The items are a fixed, small table (its size is checked before it is broadcast; beyond the bound the
items are searched in several passes, each with its own broadcast).  The corpus is read once per
pass, is never shuffled before the search, and only hits leave the scan.

Normalisation (typography, markup, line breaking, encoding) is the same for both sides: HTML
entities and tags, quoting and table marks, Markdown emphasis, soft hyphens and zero-width
characters, words split at line ends, stress marks and accents, compatibility forms, letter case,
``ё``/``е`` and look-alike letters of the other script (folded word by word, at looked-at places only).

Defined results: null or empty texts and items never match; items shorter than ``min_words`` words
never match; repeated rows give one row per (document, item); empty tables give an empty result;
other columns of the inputs are ignored.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 3
#: Items of one broadcast pass, in characters of their texts: tables of some 200 MB in a worker.
PASS_CHARS = 2_000_000

_WORD = re.compile(r"[^\W_]+")
_ODD = re.compile("[\u0300-\u036f\xaa\xb2\xb3\xb9\xba\xbc-\xbe\xc0-\u024f\u1e00-\u1eff\u2070-\u209f\u2100-\u214f\u2460-\u24ff\ufb00-\ufb06\uff00-\uffef]")
_MARKS = re.compile("[\u0300-\u0305\u0307\u0309-\u036f]")  # not the breve of й and the dots of ё
_HIDDEN = re.compile("[\xad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff\ufffe]")
_TAG = re.compile(r"</?(?:[a-zA-Z][^<>]*|!--[^<>]*--)/?>")
_INLINE_TAG = re.compile(r"</?(?:b|i|u|em|strong|span|font|a|sup|sub|mark|code|wbr|small|big)(?:\s[^<>]*)?/?>", re.I)
_BROKEN = re.compile(r"([^\W\d_])[-‐‑¬][ \t]*\r?\n[ \t>|*]*(?=[^\W\d_])")
_BREAK = re.compile(r"[-‐‑¬][ \t]*\r?\n")
_INWORD_MARK = re.compile(r"(?<=[^\W_])(?:\*{1,3}|~~|__|`)(?=[^\W_])")
_INWORD = ("*", "~~", "__", "`")
# Cyrillic letters (small or capital) and the Latin letters they look like, small.
_CYR, _LAT = "асеорхуктмнвіјѕ", "aceopxyktmhbijs"
_TO_LATIN, _TO_CYRILLIC = str.maketrans(_CYR, _LAT), str.maketrans(_LAT, _CYR)
_ASCII = re.compile("[a-z]")
_FOLD_CACHE = 1_000_000


class _Fold(dict):
    """word -> the word in one script: look-alikes of the other script are taken for the letters they imitate.

    Words made of look-alikes alone read the same in both scripts and become Latin.
    """

    def __missing__(self, word: str) -> str:
        folded = word
        if not word.isascii():
            latin = word.translate(_TO_LATIN)
            if latin.isascii():
                folded = latin
            elif _ASCII.search(word):
                folded = word.translate(_TO_CYRILLIC)
        if len(self) >= _FOLD_CACHE:
            self.clear()
        self[word] = folded
        return folded


def normal_words(text: str | None) -> list[str]:
    """The words of a text, in order, free of typography, markup, line breaking and encoding."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", _INLINE_TAG.sub("", text))
    if not text.isascii():
        text = _HIDDEN.sub("", text)
        if _ODD.search(text):
            text = unicodedata.normalize("NFKC", _MARKS.sub("", unicodedata.normalize("NFKD", text)))
    if _BREAK.search(text):
        text = _BROKEN.sub(r"\1", text)
    if any(mark in text for mark in _INWORD):
        text = _INWORD_MARK.sub("", text)
    text = text.lower()
    if "ё" in text:
        text = text.replace("ё", "е")
    return _WORD.findall(text)


class WuManber:
    """Search tables over the windows of the items' words."""

    def __init__(self, items: Iterable[tuple[int, str | None]], min_words: int = 12):
        if min_words < 2:
            raise ValueError("min_words must be at least 2")
        self.m = min_words
        self.block = min(BLOCK, min_words)
        self.default = self.m - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.bucket: dict[tuple, dict[tuple, set]] = {}
        self.fold = _Fold()
        for item_id, text in items:
            words = [self.fold[w] for w in normal_words(text)]
            for k in range(len(words) - self.m + 1):
                pattern = tuple(words[k : k + self.m])
                for end in range(self.block, self.m + 1):
                    gram, room = pattern[end - self.block : end], self.m - end
                    if room < self.shift.get(gram, self.default):
                        self.shift[gram] = room
                self.bucket.setdefault(pattern[self.m - self.block :], {}).setdefault(pattern, set()).add(item_id)

    def hits(self, words: list[str]) -> set:
        """Ids of the items of which ``words`` (of ``normal_words``) contains a window."""
        found: set = set()
        m, block, default, shift, bucket, fold = self.m, self.block, self.default, self.shift, self.bucket, self.fold
        at, n = m, len(words)
        while at <= n:
            gram = tuple([fold[w] for w in words[at - block : at]])
            move = shift.get(gram, default)
            if move:
                at += move
                continue
            ids = bucket[gram].get(tuple([fold[w] for w in words[at - m : at]]))
            if ids:
                found |= ids
            at += 1
        return found


def leaked_items(
    documents: DataFrame,
    items: DataFrame,
    min_words: int = 12,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row (``doc_id``, ``item_id``) for each document that holds ``min_words`` consecutive words of an item."""
    spark = documents.sparkSession
    table = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).filter("i is not null and t is not null")
    schema = f"doc_id {documents.schema[doc_id].dataType.simpleString()}, item_id {items.schema[item_id].dataType.simpleString()}"
    corpus = documents.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("text")).filter(
        "doc_id is not null and text is not null"
    )
    parts: list[DataFrame] = []
    total = table.agg(F.sum(F.length("t"))).first()[0] or 0
    passes = max(1, -(-total // PASS_CHARS))
    for p in range(passes):
        rows = table.filter(F.pmod(F.xxhash64("i"), F.lit(passes)) == p).collect()
        shared = spark.sparkContext.broadcast([(r["i"], r["t"]) for r in rows])

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            tables = None
            for batch in batches:
                tables = tables or WuManber(shared.value, min_words)
                docs, ids = [], []
                for d, t in zip(batch["doc_id"], batch["text"]):
                    for i in tables.hits(normal_words(t)):
                        docs.append(d)
                        ids.append(i)
                yield pd.DataFrame({"doc_id": docs, "item_id": ids})

        parts.append(corpus.mapInPandas(search, schema))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.distinct()
