import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kedrion.llm.leak_scan import WuManber, leaked_items, normal_words

DOCS = "doc_id bigint, text string, item_id string, lang string"
ITEMS = "item_id bigint, text string, doc_id string"
PASSAGE = "Старый сервер хранит важную карту в тёмной папке и быстро открывает каждый новый отчёт для группы"


def brute(docs, items, m):
    out = set()
    fold = WuManber([], m).fold
    windows = {}
    for i, t in items:
        w = [fold[x] for x in normal_words(t)]
        for k in range(len(w) - m + 1):
            windows.setdefault(tuple(w[k : k + m]), set()).add(i)
    for d, t in docs:
        w = [fold[x] for x in normal_words(t)]
        for k in range(len(w) - m + 1):
            out |= {(d, i) for i in windows.get(tuple(w[k : k + m]), ())}
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("a b c d e".split()), max_size=30), max_size=4), st.lists(st.lists(st.sampled_from("a b c d e".split()), max_size=60), max_size=4), st.integers(2, 7))
def test_search_equals_brute_force(items, docs, m):
    items = [(i, " ".join(w)) for i, w in enumerate(items)]
    docs = [(d, " ".join(w)) for d, w in enumerate(docs)]
    search = WuManber(items, m)
    assert {(d, i) for d, t in docs for i in search.hits(normal_words(t))} == brute(docs, items, m)


@pytest.mark.parametrize(
    "changed",
    [
        PASSAGE.upper(),
        PASSAGE.replace("ё", "е"),
        PASSAGE.replace("ё", "ё").replace("й", "й"),
        PASSAGE.replace("сервер", "сер­вер").replace(" карту", " ​карту"),
        PASSAGE.replace("сервер", "сер-\nвер").replace("открывает", "откры-\r\n> вает"),
        PASSAGE.replace("важную", "**важную**").replace("новый", "<b>но</b>вый").replace(" в ", "&nbsp;<br>в "),
        "> " + PASSAGE.replace(" и ", "\n> и "),
        PASSAGE.replace("о", "o").replace("а", "a"),
        PASSAGE.replace("Старый", "Ста́рый").replace(" хранит", ", хранит —"),
    ],
)
def test_typography_is_set_aside(changed):
    assert WuManber([(1, PASSAGE)], 12).hits(normal_words("Ещё слова. " + changed + ". И ещё.")) == {1}


def test_eleven_words_or_rewording_do_not_count():
    words = PASSAGE.split()
    search = WuManber([(1, PASSAGE)], 12)
    assert not search.hits(words[:11]) and search.hits(normal_words(" ".join(words[:12]))) == {1}
    assert not search.hits(normal_words(" ".join(w if k % 6 else "иное" for k, w in enumerate(words))))


def test_operator_with_dirt(spark):
    rng = random.Random(3)
    long = " ".join(rng.choice("сад дом лес река поле".split()) for _ in range(200_000)) + " " + PASSAGE
    docs = [(1, PASSAGE, "x", None), (1, PASSAGE, "x", None), (2, None, None, "ru"), (3, "", "", ""), (4, long, "y", "ru"), (None, PASSAGE, None, None), (5, "нет", "1", "ru")]
    items = [(7, "Выберите ответ. " + PASSAGE, "a"), (8, PASSAGE, "b"), (8, PASSAGE, "b"), (9, None, None), (10, "коротко", None), (None, PASSAGE, None)]
    got = leaked_items(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert sorted(map(tuple, got)) == [(1, 7), (1, 8), (4, 7), (4, 8)]


def test_items_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr("kedrion.llm.leak_scan.PASS_CHARS", 300)
    words = PASSAGE.split()
    items = [(i, f"начало{i} " + " ".join(words[i % 4 :]), None) for i in range(9)]
    docs = [(d, f"текст{d} " + PASSAGE + " и конец", None, None) for d in range(3)]
    got = leaked_items(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert {tuple(r) for r in got} == {(d, i) for d in range(3) for i in range(9)} and len(got) == 27


def test_empty_tables(spark):
    none, items = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, PASSAGE, None)], ITEMS)
    assert leaked_items(none, items).count() == 0
    assert leaked_items(spark.createDataFrame([(1, PASSAGE, None, None)], DOCS), items.limit(0)).count() == 0
