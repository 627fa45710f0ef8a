import zlib

import numpy as np
import pytest

from gridcast.llm import language
from gridcast.llm.catalog import op2_language_id

EN = "the house of the river and the stone with an old thing in it that was there for the other"
FR = "la maison de la rivière et une pierre avec le vieux truc dans les eaux qui était là pour eux"


@pytest.fixture(scope="module")
def model():
    return language.train([EN] * 30 + [FR] * 30, ["en"] * 30 + ["fr"] * 30)


@pytest.mark.parametrize("block", [2, 5, 64])
def test_marginals_match_plain_forward_backward(monkeypatch, block):
    monkeypatch.setattr(language, "BLOCK", block)
    rng = np.random.default_rng(block)
    moves, begin = rng.normal(0, 1, (3, 3)), rng.normal(0, 1, 3)
    lengths = np.array([1, 2, 5, 11, 3, 64, 130])
    psi = np.exp(rng.normal(0, 3, (lengths.sum(), 3)))
    got, at = language.marginals(psi, lengths, moves, begin), 0
    for n in lengths:
        p, m = psi[at : at + n], np.exp(moves)
        a, b = np.zeros((n, 3)), np.ones((n, 3))
        a[0] = np.exp(begin) * p[0]
        for t in range(1, n):
            a[t] = (a[t - 1] @ m) * p[t]
            a[t] /= a[t].sum()
        for t in range(n - 2, -1, -1):
            b[t] = m @ (p[t + 1] * b[t + 1])
            b[t] /= b[t].sum()
        want = a * b / (a * b).sum(axis=1, keepdims=True)
        assert np.abs(got[at : at + n] - want).max() < 1e-9
        at += n


def test_code_switched_words(model):
    (words, part), = language.label_words(model, [EN + " " + FR + " " + EN])
    labels = [model.labels[i] for i in part.argmax(axis=1)]
    n, m = len(EN.split()), len(FR.split())
    want = ["en"] * n + ["fr"] * m + ["en"] * n
    assert sum(a != b for a, b in zip(labels, want)) <= 3


def test_memory_of_words_changes_nothing(model, monkeypatch):
    texts = [EN, FR, "", EN + FR, "unseen wörds hère"] * 3
    want = [p for _, p in language.label_words(model, texts)]
    monkeypatch.setattr(language, "REMEMBERED", 5)
    monkeypatch.setattr(language, "AT_ONCE", 7)
    for a, (_, b) in zip(want, language.label_words(model, texts)):
        assert np.allclose(a, b)


def test_odd_texts(make_docs, model):
    rows = [(1, None), (2, ""), (3, "123 %% --"), (4, EN), (5, FR), (5, FR), (None, EN), (6, "x" * 100_000), (7, EN * 2000)]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(make_docs(rows, clash=True), model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    assert got[4][0] == got[7][0] == got[None][0] == "en" and got[5][0] == "fr"
    assert got[6][0] in ("en", "fr")
    assert all(0 <= s <= 1 for _, s in got.values())
    assert language.predict(make_docs([]), model).count() == 0


def test_nothing_to_learn_from(make_docs):
    empty = language.fit(make_docs([(1, None, "en", "s"), (2, "text", None, "s")]))
    assert [r["lang_pred"] for r in language.predict(make_docs([(1, "text")]), empty).collect()] == ["und"]


def test_held_out_accuracy(spark, sf_dir, given):
    found = op2_language_id(spark, sf_dir).join(given("documents").select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    tested = [r for r in found if r["held_out"] and r["lang"] is not None]
    assert len(tested) > 20
    assert sum(r["lang_pred"] == r["lang"] for r in tested) / len(tested) > 0.9


def test_signs_that_are_no_letters_have_no_language():
    assert [language.words_of(t) for t in ("\u00bd \u00b2 \u2460", "12 _", "\u0645\u064f")] == [[], [], ["\u0645\u064f"]]


def test_pair_marginals_match_enumeration():
    """Over all label sequences of a short chain, the share of every pair of neighbouring labels."""
    import itertools

    rng = np.random.default_rng(1)
    psi, moves, begin = np.exp(rng.normal(size=(4, 3))), rng.normal(size=(3, 3)), rng.normal(size=3)
    weight = np.zeros((4, 3, 3))
    for y in itertools.product(range(3), repeat=4):
        p = np.exp(begin[y[0]]) * psi[0, y[0]]
        for t in range(1, 4):
            p *= np.exp(moves[y[t - 1], y[t]]) * psi[t, y[t]]
        for t in range(1, 4):
            weight[t, y[t - 1], y[t]] += p
    alpha, beta = language.messages(psi, np.array([4]), moves, begin)
    here = np.arange(1, 4)
    got = language.pair_marginals(psi, alpha, beta, moves, here)
    assert np.allclose(got, weight[1:] / weight[1:].sum(axis=(1, 2), keepdims=True))
