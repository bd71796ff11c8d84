import random

import numpy as np

from lodespark.llm import reading


def test_sentences_leave_out_what_is_no_prose():
    text = "# Head\n\nRun it first. It works `code here` now!\nThis goes\non.\n```py\nx = 1. y = 2\n```\n- one item\n- two items here\n| a | b | c |\n1. third"
    assert list(reading.sentences(text)) == [["run", "it", "first"], ["it", "works", "now"], ["this", "goes", "on"], ["one", "item"], ["two", "items", "here"], ["third"]]
    assert list(reading.sentences("")) == []


def test_fit_is_not_moved_by_slips():
    rnd = np.random.default_rng(1)
    y = np.repeat([0, 1, 2], 200)
    x = np.c_[rnd.random(600) * 0.05, np.array([7, 16, 40])[y] + rnd.normal(0, 1, 600)]
    y[rnd.choice(600, 12, replace=False)] = rnd.integers(0, 3, 12)
    f = reading.fit(x, y)
    assert 8.5 < f.cuts[0] < 14 and 18 < f.cuts[1] < 38 and f.accuracy > 0.97
    assert reading.fit(np.zeros((0, 2)), np.zeros(0, int)).cuts == (11.0, 22.0)


def make(spark, n=120):
    rnd = random.Random(2)
    lengths = {"basic": 6, "intermediate": 16, "advanced": 40}
    docs, labels = [], []
    for i in range(n):
        band = list(lengths)[i % 3]
        text = " ".join(" ".join(rnd.choice(["the", "run", "log", "report"]) for _ in range(lengths[band])) + "." for _ in range(12))
        docs.append((i, text, rnd.choice(["en", "English", "EN_gb", " eng "]), "note", len(text) + 400, "x"))
        if i % 2:
            labels.append((i, rnd.choice([band, band.upper(), f" {band} "]), "g1"))
    docs += [(900, "Kurz.", "de", "note", 500, "x"), (901, "x = 1", "en", "code", 500, "x"), (902, None, "en", "note", 500, "x"), (903, "Short.", "en", "note", 10, "x"), (904, "", None, "note", 900, "x")]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, lang string, doc_kind string, n_chars long, word string"),
        spark.createDataFrame([*labels, (None, None, None), (1, "odd", "g2")], "doc_id long, band string, grader string"),
    )


def test_bands(spark):
    docs, labels = make(spark)
    got = {r.doc_id: r.band for r in reading.reading_levels(docs.unionByName(docs.limit(5)), labels).collect()}
    assert all(got[i] == reading.BANDS[i % 3] for i in range(120))
    assert set(got) == {*range(120), 902}


def test_empty(spark):
    docs, labels = make(spark, 6)
    assert reading.reading_levels(docs.limit(0), labels.limit(0)).count() == 0


def test_familiar_words_are_counted_over_all_documents(spark):
    docs = spark.createDataFrame([(i, "common word." if i % 10 else "common rare.") for i in range(100)], "doc_id long, text string")
    words = reading.word_table(docs)
    assert {r.word for r in reading.familiar_words(words, 100, 0.12).collect()} == {"common", "word"}
    f = {r.doc_id: r.unfamiliar for r in reading.features(docs).collect()}
    assert f[0] == 0.5 and f[1] == 0.0


def test_short_documents_count_for_the_familiar_words(spark):
    docs = spark.createDataFrame([(i, "often here." if i < 10 else "seldom.", "en", "note", 900 if i < 10 else 10) for i in range(100)], "doc_id long, text string, lang string, doc_kind string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, band string, grader string")
    got = reading.reading_levels(docs, labels).collect()
    assert {r.doc_id for r in got} == set(range(10)) and {r.unfamiliar for r in got} == {1.0}
