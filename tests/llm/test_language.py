import random

import numpy as np

from synthframe.llm import language
from synthframe.llm.queries import all_queries

SF = "/root/testdata/sf0.01"


def test_block_messages_equal_plain_forward_backward():
    rng = np.random.default_rng(0)
    lengths = np.array([1, 5, 64, 65, 130, 300])
    f, step, at = rng.random((lengths.sum(), 4)) + 0.01, np.exp(rng.normal(size=(4, 4))), 0
    got = language.marginals(f, lengths, step)
    for n in lengths:
        x = f[at:at + n]
        a, b = np.zeros((n, 4)), np.ones((n, 4))
        for i in range(n):
            a[i] = (a[i - 1] if i else np.ones(4)) @ step * x[i]
            a[i] /= a[i].sum()
        for i in range(n - 2, -1, -1):
            b[i] = step @ (b[i + 1] * x[i + 1])
            b[i] /= b[i].sum()
        p = a * b
        assert np.allclose(got[at:at + n], p / p.sum(1, keepdims=True))
        at += n


def test_held_out_accuracy_of_the_query(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = all_queries()["op6_crf_language"](spark, SF).collect()
    assert {r.doc_id for r in rows} == lang.keys() and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 100 and np.mean([r.lang_pred == lang[r.doc_id] for r in held]) >= 0.98


def test_code_switched_texts_and_texts_without_letters(docs):
    r = random.Random(1)
    def text(letters):
        return " ".join("".join(r.choice(letters) for _ in range(r.randint(3, 8))) for _ in range(60))
    model = language.train([(text("abcde"), "one") for _ in range(20)] + [(text("vwxyzé"), "two") for _ in range(20)])
    assert np.trace(model.transitions) > model.transitions.sum() - np.trace(model.transitions)
    texts = [None, "", "123 !?", text("abcde"), text("vwxyzé"), text("abcde") + " " + text("vwxyzé") * 3, "é" * 30000]
    got = {x.doc_id: x for x in language.predict_language(docs(texts), model).collect()}
    assert [got[i].lang_pred for i in range(7)] == ["und", "und", "und", "one", "two", "two", "two"]
    assert got[0].score == 0 and 0.1 < got[5].shares[0] < 0.5
    assert language.predict_language(docs(texts).filter("false"), model).count() == 0


def test_training_rows_are_bounded_and_may_be_missing(spark, docs):
    frame = docs(["alpha beta"] * 30 + [None, "123", ""])
    assert language.training_rows(frame, texts=5) == [("alpha beta", "en")]
    assert language.training_rows(frame.filter("false")) == []
    long = " ".join(f"w{'abcdefghij'[i % 10]}{'klmnop'[i // 10 % 6]}{'qrstuvw'[i // 60 % 7]}" for i in range(410))
    found = language.training_rows(docs([long] * 9 + ["one two"]))
    assert len(found) == 22 and {w for p, _ in found for w in p.split()} == set(long.split()) | {"one", "two"}
    assert len(language.training_rows(docs([long]), pieces=4)) == 4
    empty = language.train([])
    assert {r.lang_pred for r in language.predict_language(frame, empty).collect()} == {"und"}


def test_short_texts_are_learned():
    r = random.Random(2)
    fr, en = ["le chat mange une souris grise dehors", "nous allons au marché chaque lundi matin"], "the people of this town have always been known for their long walks in the hills"
    french = [" ".join(r.sample(" ".join(fr).split(), 7)) for _ in range(200)]
    english = [" ".join(r.choice(en.split()) for _ in range(60)) for _ in range(20)]
    model = language.train([(t, "fr") for t in french] + [(t, "en") for t in english])
    assert {label for label, *_ in language.label_texts(french, model)} == {"fr"} and {label for label, *_ in language.label_texts(english, model)} == {"en"}


def test_letters_are_letters_and_marks_stay_in_their_words():
    model = language.train([("abc def " * 20, "one"), ("हिन्दी भाषा " * 20, "two")])
    und = [x[0] for x in language.label_texts(["½ ² ①", "Ⅷ ٣ १२", "̀ ", "☃ 😀", "é", "हिन्दी"], model)]
    assert und[:4] == ["und"] * 4 and "und" not in und[4:]
    assert language.text_words("हिन्दी भाषा") == ["हिन्दी".encode(), "भाषा".encode()]
    assert language.text_words("l'été e\u0301té 3rd x²") == ["l'été".encode(), "e\u0301té".encode(), b"rd", b"x"]
