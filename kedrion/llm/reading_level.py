"""Reading level of documents: classic readability formulas, combined by the median of their grades.

Per document, in one Arrow pass over the text:

1. *prose* - markup, quoting, short lines of headings, list items, tables and code are set aside;
   words broken at line ends are joined;
2. *sentences* - ended by ``. ! ? ...`` before a capital, quote or the end, but not after an
   abbreviation or inside numbers; their length is the plain mean of words a sentence;
3. *syllables* - hyphenation-style rules.  A word is parted between two vowels that are no pair, and
   before the last consonant of those between two vowels, so it has as many syllables as nuclei: in Russian every
   vowel is one; in English a vowel, or a pair that is written for one, is - silent endings are none, a final
   consonant + ``le`` is one, and ``y`` before a vowel is a consonant.  Names, codes and numbers are not counted;
4. *formulas* - Flesch-Kincaid, Gunning fog, SMOG, automated readability and Coleman-Liau.  Their
   published constants are adapted to each language (the script of the text, not the ``lang`` column) by least
   squares on at most ``max_labels`` labelled documents, as the published Russian adaptations were
   made; the fit is drawn towards the published constants as by ``PRIOR`` labels, so few labels move them little;
5. *grades* - each formula's score becomes an estimate on the label scale through a monotone curve
   (isotonic regression) on the same labels; the grade is the rounded median of the estimates.
   ``published`` is the grade in the same way with the published constants as they are.

Only the fit sees a bounded sample; every document is scored from its whole text.  Labels are
averaged per document over its distinct raters before fitting; those of the other script count ``OTHER`` of one
in a curve, so a language without labels has the curve of all.

Defined results: a null, empty or word-less text has a null grade; a text without sentence ends is
one sentence; without any label the formulas' school grades are scaled linearly (grade 12 and above = 5).
Repeated document rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORMULAS = ("kincaid", "fog", "smog", "ari", "coleman")
MAX_LABELS = 50_000
PRIOR, OTHER = 5.0, 1e-3

# Abbreviations that do not end a sentence.
_ABBREVIATIONS = frozenset(
    "т е п д др пр напр см ср ред рис табл стр гл г гг в вв руб тыс млн им ул "
    "e.g i.e e i g approx cf sec ver fig vs etc no nos mr mrs ms dr st vol ch pp p ed al".split()
)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_HIDDEN = re.compile("[\xad\u200b-\u200f\u2060\ufeff\u0300-\u0305\u0307\u0309-\u036f]")
_BROKEN = re.compile(r"([^\W\d_])[-‐‑]\n[> \t]*(?=[^\W\d_])")
_QUOTE = re.compile(r"(?m)^[ \t]*(?:>[ \t]?)+")
_ASIDE = re.compile(r"(?m)^(?:[ \t]*(?:#+ |={2,}|[-*•+] |\d+[.)] |\||```|~~~|\{|\})|    ).*$")
_EMPHASIS = re.compile(r"[*~`]+")
_PARAGRAPH = re.compile(r"\n\s*\n")
_ENDED = re.compile(r"[.!?…][)»\"”'\]]*$")
_TRIM = re.compile(r"^[^\w]+|[^\w]+$")
_WORD = re.compile(r"[^\W\d_]+(?:[-’'][^\W\d_]+)*$")
_RU_VOWEL = re.compile("[аеёиоуыэюя]")
# Pairs of vowels written for one nucleus; i before a vowel is part of the consonant after c, g, s, t, x.
# A pair is parted in cre-ate, ide-a, sci-ence, muse-um, be-ing and their like.
_EN_NUCLEUS = re.compile(r"(?<=r)e(?=a[ct])|e(?=a$|um|ing)|i(?=e[nt])|eo(?=p)|(?<=[cgstx])i[aou]u?|ueue|eau|a[iuwy]|e[aeiuwy]|i[e]|o[aeiouwy]|u[ei]|[aeiou]|(?<!^)y(?![aeiou])|^y(?=[^aeiou])")
_EN_SILENT = re.compile(r"(?:[^aeiouy]e|[^aeiouydt]ed|[^aeiouysxz]es)$")
_EN_LE = re.compile(r"[^aeiouy]les?$")
_CYRILLIC = re.compile("[а-яё]")
_CACHE = 500_000


def syllables(word: str) -> int:
    """Nuclei of a lower-case word, one at least."""
    if _CYRILLIC.search(word):
        return max(1, len(_RU_VOWEL.findall(word)))
    n = len(_EN_NUCLEUS.findall(word))
    if n > 1 and _EN_SILENT.search(word) and not _EN_LE.search(word):
        n -= 1
    return max(1, n)


class _Tokens(dict):
    """token -> (word, counted, syllables, letters, Cyrillic, ends a sentence, may begin one).

    Tokens with digits, underscores or inner signs are no words; only words that begin small are
    counted for their syllables and letters.
    """

    def __missing__(self, token: str) -> tuple:
        if len(self) >= _CACHE:
            self.clear()
        core = _TRIM.sub("", token)
        word = bool(_WORD.match(core))
        small = core.lower()
        counted = word and core[0] == small[0]
        ends = bool(_ENDED.search(token)) and not ("." in token and small in _ABBREVIATIONS)
        first = token.lstrip("«\"“(*_'")[:1]
        begins = not first or first.isupper() or not (first.isalnum() or token[0] in "(")
        self[token] = value = (word, counted, syllables(small) if word else 0, len(core), bool(_CYRILLIC.search(small)), ends, begins)
        return value


def prose(text: str) -> str:
    if "&" in text:
        text = html.unescape(text)
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    text = _HIDDEN.sub("", text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if ">" in text:
        text = _QUOTE.sub("", text)
    text = _BROKEN.sub(r"\1", text)
    text = _ASIDE.sub("\n", text)
    return _EMPHASIS.sub("", text)


def measures(text: str | None, cache: _Tokens) -> tuple | None:
    """(Cyrillic, words a sentence, syllables a word, letters a word, share of long words) of the prose."""
    if not text:
        return None
    return _measures(prose(text), cache) or _measures(text, cache)


def _measures(body: str, cache: _Tokens) -> tuple | None:
    lengths: list[int] = []
    words: list[tuple] = []
    for paragraph in _PARAGRAPH.split(body):
        tokens = [cache[t] for t in paragraph.split()]
        last, length = len(tokens) - 1, 0
        for i, token in enumerate(tokens):
            if token[0]:
                length += 1
                words.append(token)
            if token[5] and length and (i == last or tokens[i + 1][6]):
                lengths.append(length)
                length = 0
        if length:
            lengths.append(length)
    if not words:
        return None
    cyrillic = 2 * sum([t[4] for t in words]) >= len(words)
    long_word = 4 if cyrillic else 3
    used = [t for t in words if t[1]] or words
    n = len(used)
    return (
        cyrillic,
        sum(lengths) / len(lengths),
        sum([t[2] for t in used]) / n,
        sum([t[3] for t in used]) / n,
        sum([t[2] >= long_word for t in used]) / n,
    )


def predictors(m: np.ndarray) -> list[np.ndarray]:
    """The two sides of each formula, in the order of FORMULAS; m: words a sentence, syllables, letters, long words."""
    wps, spw, lpw, hard = m.T
    one = np.ones(len(m))
    return [np.column_stack(c) for c in ((wps, spw, one), (wps, hard, one), (np.sqrt(hard * wps), one), (wps, lpw, one), (lpw, 1 / wps, one))]


# The formulas' published constants (for Russian, the published adaptations).
PUBLISHED = {
    True: ((0.5, 8.4, -15.59), (0.4, 40.0, 0.0), (8.841, 0.05), (0.2805, 6.26, -31.04), (5.5, -35.0, -20.33)),
    False: ((0.39, 11.8, -15.59), (0.4, 40.0, 0.0), (5.713, 3.1291), (0.5, 4.71, -21.43), (5.88, -29.6, -15.8)),
}


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, knots: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing curve of least squares through (x, y)."""
    order = np.argsort(x, kind="stable")
    level: list[list[float]] = []  # mean, weight, first x, last x
    for a, b, w in zip(x[order], y[order], weight[order]):
        level.append([b, w, a, a])
        while len(level) > 1 and level[-2][0] >= level[-1][0]:
            b2, w2, _, hi = level.pop()
            b1, w1, lo, _ = level.pop()
            level.append([(b1 * w1 + b2 * w2) / (w1 + w2), w1 + w2, lo, hi])
    xs = np.array([(v[2] + v[3]) / 2 for v in level])
    ys = np.array([v[0] for v in level])
    if len(xs) > knots:
        at = np.unique(np.linspace(0, len(xs) - 1, knots).round().astype(int))
        xs, ys = xs[at], ys[at]
    return xs, ys


def adapted(x: np.ndarray, y: np.ndarray, published: np.ndarray) -> np.ndarray:
    """Constants of least squares on (x, y), drawn towards the published ones on the label scale."""
    start = published / 3  # school grades 0 to 12 on 1 to 5
    start[-1] += 1
    if not len(y):
        return start
    pull = PRIOR * np.diag(np.mean(x * x, axis=0) + 1e-9)
    return start + np.linalg.solve(x.T @ x + pull, x.T @ (y - x @ start))


class Curves:
    """Measures -> estimates on the label scale, for each script and formula; ``fit``: with adapted constants, else the published ones."""

    def __init__(self, cyrillic: np.ndarray, m: np.ndarray, labels: np.ndarray, fit: bool = True):
        self.constants: dict[tuple[bool, int], np.ndarray] = {}
        self.knots: dict[tuple[bool, int], tuple[np.ndarray, np.ndarray]] = {}
        for script in (True, False):
            own = cyrillic == script
            weight = np.where(own, 1.0, OTHER)
            for f, x in enumerate(predictors(m)):
                c = np.array(PUBLISHED[script][f])
                if fit:
                    c = adapted(x[own], labels[own], c)
                self.constants[script, f] = c
                plain = (np.array([1.0, 5.0]),) * 2 if fit else (np.array([0.0, 12.0]), np.array([1.0, 5.0]))
                self.knots[script, f] = isotonic(x @ c, labels, weight) if len(labels) else plain

    def estimates(self, cyrillic: np.ndarray, m: np.ndarray) -> np.ndarray:
        """The median of the formulas' estimates for each row."""
        out = np.full(len(m), np.nan)
        for script in (True, False):
            own = cyrillic == script
            if own.any():
                out[own] = np.median([np.interp(x @ self.constants[script, f], *self.knots[script, f]) for f, x in enumerate(predictors(m[own]))], axis=0)
        return out


_MEASURES = ("wps", "spw", "lpw", "hard")


def _measured(df: DataFrame) -> DataFrame:
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = _Tokens()
        for batch in batches:
            rows = [(d, *m) for d, t in zip(batch["doc_id"], batch["text"]) if (m := measures(t, cache))]
            yield pd.DataFrame(rows, columns=["doc_id", "cyrillic", *_MEASURES])

    return df.mapInPandas(run, f"doc_id {kind}, cyrillic boolean, " + ", ".join(f"{c} double" for c in _MEASURES))


def fit(documents: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS, doc_id: str = "doc_id", text: str = "text", rater: str = "rater", grade: str = "grade") -> tuple[Curves, Curves]:
    """Curves (with adapted, with published constants) from at most ``max_labels`` labelled documents: those of the smallest hashes."""
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    keys = labels.filter(F.col(doc_id).isNotNull() & F.col(grade).isNotNull()).agg(F.count("*")).first()[0]  # rows: at least the documents
    few = hashed < int(min(1.0, 2.0 * max_labels / max(1, keys)) * (1 << 40))  # so that one task need not order all of them
    rated = (
        labels.select(F.col(doc_id).alias("doc_id"), F.col(rater).alias("rater"), F.col(grade).cast("double").alias("grade"))
        .filter("doc_id is not null and grade is not null")
        .filter(few)
        .groupBy("doc_id", "rater").agg(F.avg("grade").alias("grade"))
        .groupBy("doc_id").agg(F.avg("grade").alias("grade"))
        .orderBy(hashed, "doc_id").limit(max_labels)
    )
    # at most ``max_labels`` keys: the documents' texts stay where they are
    texts = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(rated.select("doc_id")), "doc_id", "left_semi")
    found = _measured(texts).dropDuplicates(["doc_id"]).join(rated, "doc_id").toPandas().sort_values("doc_id")
    seen = found["cyrillic"].to_numpy(bool), found[list(_MEASURES)].to_numpy(float), found["grade"].to_numpy(float)
    return Curves(*seen), Curves(*seen, fit=False)


def _grade(estimate: float) -> int | None:
    return None if math.isnan(estimate) else int(min(5, max(1, math.floor(estimate + 0.5))))


def reading_levels(documents: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS, doc_id: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row for each document row: ``doc_id``, ``grade`` and ``published`` (1 to 5, or null), ``estimate`` and the carried columns."""
    carry = [c for c in (carry or []) if c not in ("doc_id", "grade", "estimate", "published")]
    curves = documents.sparkSession.sparkContext.broadcast(fit(documents, labels, max_labels, doc_id, text))
    fields = {f.name: f.dataType.simpleString() for f in documents.schema}
    schema = ", ".join([f"doc_id {fields[doc_id]}", *(f"`{c}` {fields[c]}" for c in carry), "grade int, estimate double, published int"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, model = _Tokens(), curves.value
        for batch in batches:
            rows = [measures(t, cache) for t in batch["__text"]]
            known = np.array([m is not None for m in rows], bool)
            estimate, plain = np.full(len(rows), np.nan), np.full(len(rows), np.nan)
            if known.any():
                m = np.array([r for r in rows if r], dtype=float)
                estimate[known], plain[known] = (c.estimates(m[:, 0] > 0.5, m[:, 1:]) for c in model)
            out = batch.drop(columns="__text")
            out["grade"] = pd.array([_grade(e) for e in estimate], dtype="Int32")
            out["estimate"] = pd.array([None if math.isnan(e) else e for e in estimate], dtype="Float64")
            out["published"] = pd.array([_grade(e) for e in plain], dtype="Int32")
            yield out

    return documents.select(F.col(doc_id).alias("doc_id"), *[F.col(f"`{c}`") for c in carry], F.col(text).alias("__text")).mapInPandas(run, schema)


def spread(levels: DataFrame, *by: str | Column) -> DataFrame:
    """Grades by group: documents, mean estimate, and the number of each grade."""
    return levels.groupBy(*by).agg(
        F.count("*").alias("n_docs"),
        F.round(F.avg("estimate"), 4).alias("mean_estimate"),
        *[F.count(F.when(F.col("grade") == g, 1)).alias(f"grade_{g}") for g in range(1, 6)],
    )
