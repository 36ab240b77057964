import itertools
import math
from decimal import Decimal, getcontext

import numpy as np
import pytest

from tokenframe.llm import langid as L
from tokenframe.llm.sentencepieces import default_model

from .fixtures import SCHEMA, documents, empty, rows

EN, FR = "the house and the garden of water", "la maison et le jardin avec de l'eau"


def test_forward_sums_all_segmentations():
    vocab = {"▁": 0, "a": 1, "b": 2, "ab": 3, "▁a": 4, "ba": 5}
    p = np.random.default_rng(1).random((7, 2))
    words = ["▁abab", "▁", "▁xa", "▁bba"]
    got = L.Lattice(words, L.Prefixes(vocab)).likelihood(p)
    for w, row in zip(words, got):
        total = np.zeros(2)
        for cuts in itertools.product([0, 1], repeat=len(w) - 1):
            at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(w)]
            parts = [w[i:j] for i, j in zip(at, at[1:])]
            if all(x in vocab or len(x) == 1 for x in parts):
                total += math.prod((p[vocab.get(x, 6)] for x in parts), start=np.ones(2))
        assert np.allclose(np.exp(row), total)


def test_expected_counts_match_numerical_gradient():
    vocab = {"▁": 0, "a": 1, "b": 2, "ab": 3, "▁a": 4}
    p = np.random.default_rng(2).random((6, 1))
    words, counts = ["▁abab", "▁ba"], np.array([2.0, 1.0])
    lattice = L.Lattice(words, L.Prefixes(vocab))
    got = lattice.expected(p, counts)
    for i in range(5):
        up = p.copy()
        up[i] *= 1 + 1e-6
        slope = (counts @ (lattice.likelihood(up) - lattice.likelihood(p))[:, 0]) / 1e-6
        assert abs(slope - got[i]) < 1e-3


def brute_sums(word, vocab, p):
    """Sum over the segmentations of each prefix, by the last piece; exact in 100-digit decimals."""
    getcontext().prec = 100
    a = [[Decimal(1)] * p.shape[1]]
    for e in range(1, len(word) + 1):
        row = [Decimal(0)] * p.shape[1]
        for b in range(max(0, e - 4), e):
            i = vocab.get(word[b:e], 6 if e - b == 1 else None)
            if i is not None:
                row = [r + a[b][k] * Decimal(float(p[i, k])) for k, r in enumerate(row)]
        a.append(row)
    return [float(x.ln()) for x in a[-1]]


def test_words_of_any_length_equal_brute_force():
    vocab = {"▁": 0, "a": 1, "b": 2, "ab": 3, "▁a": 4, "ba": 5}
    rng = np.random.default_rng(1)
    p = rng.random((7, 2)) * [1e-2, 1e-6]
    m = L.Model(["x", "y"], np.zeros(2), p, "")
    m.known = L.Prefixes(vocab)
    m.log_p = np.log(p)
    for n in (39, 40, 41, 100, 3000):
        w = "▁" + "".join(rng.choice(list("abc"), n, p=[0.49, 0.49, 0.02]))
        assert np.allclose(m._long(w), brute_sums(w, vocab, p), rtol=1e-9)
    for w in ("▁abab", "▁babbaabab"):
        one = L.Lattice([w], m.known)
        assert np.allclose(one.log_expected(np.log(p[:, :1]), 3.0), one.expected(p[:, :1], np.array([3.0])))
        assert np.allclose(one.log_likelihood(np.log(p)), one.likelihood(p)[0])


def test_only_letters_and_their_marks_make_words():
    assert L.words("A² ½ Ⅷ ① x_y 12 don't") == ["▁a", "▁x", "▁y", "▁don", "▁t"]
    assert L.words("e\u0301te\u0301 \u0301") == ["▁e\u0301te\u0301"]
    m = L.Model(["x"], np.zeros(1), np.ones((1, 1)), "")
    assert [m.score(t) for t in ("²", "½ ⅷ ①", "", "42")] == [("und", 0.0)] * 4


def test_learns_and_predicts(spark):
    base = [(i, f"{EN} {i}" if i % 2 else f"{FR} {i}", "en" if i % 2 else "fr") for i in range(80)]
    base += [(100, None, "en"), (101, "", None), (102, "123 !?", "fr"), (103, "x" * 5000, None), (1, "the house", "en")]
    d = spark.createDataFrame([(*r, "s", 0, 0, 0, "clash") for r in base], SCHEMA)
    got = L.identify(d).collect()
    assert len(got) == len(base)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert all(by[i][0].lang_pred == lang for i, _, lang in base[:80])
    assert [by[i][0].lang_pred for i in (100, 101, 102)] == ["und"] * 3
    assert all(0 <= r.score <= 1 for r in got) and len(by[1]) == 2
    assert by[103][0].lang_pred in ("en", "fr")


def test_odd_tables(spark):
    assert L.identify(empty(spark)).count() == 0
    assert L.identify(documents(spark)).count() == len(rows())
    unlabelled = documents(spark).withColumn("lang", L.F.lit(None).cast("string"))
    assert {r.lang_pred for r in L.identify(unlabelled).collect()} == {"und"}
    assert default_model().endswith(".model")


def test_ties_and_too_many_languages(spark):
    m = L.Model(["a", "b"], np.log([0.5, 0.5]), np.full((len(L.pieces(default_model())) + 1, 2), 1e-4), default_model()).ready()
    assert m.score("some words") == ("a", 0.5)
    d = spark.createDataFrame([(i, "word", f"l{i}") for i in range(5)], "id long, text string, lang string")
    with pytest.raises(ValueError, match="more than 4 languages"):
        L.fit(d, most_languages=4)
