import zlib

import numpy as np

from tokenframe.llm import quality as Q

from .fixtures import SCHEMA, documents, empty


def described(texts, terms=(64, 32)):
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    return Q.features(np.frombuffer(b"".join(texts), np.uint8), at, terms)


def test_blocks_agree_with_single_texts():
    texts = [b"", b"ab", "é ß".encode(), b"one one two", b"X" * 500, b"A- 12 a", b"x"]
    for t, row in zip(texts, described(texts)):
        assert np.array_equal(described([t])[0], row)


def test_terms_against_brute_force():
    """Texts of equal trigrams and equal shapes have equal rows, and others differ."""
    a, b = described([b"Abc de-f, 12 12", b"Xyz uv-w, 34 34"])
    assert np.array_equal(a[64:], b[64:]) and not np.array_equal(a[:64], b[:64])
    assert np.expm1(a[:64]).sum().round() == 13 and np.expm1(a[64:]).sum().round() == 4 + 3 + 3
    a, b = described([b"one one", b"one two"])
    assert not np.array_equal(a[64:], b[64:])
    assert [tuple(x) for x in Q.blocked(np.array([0, 5, 10, 1 << 22]), 1 << 20)] == [(0, 2), (2, 3)]
    assert Q.blocked(np.zeros(2 * Q.ROWS + 2, np.int64)) == [(0, Q.ROWS), (Q.ROWS, 2 * Q.ROWS), (2 * Q.ROWS, 2 * Q.ROWS + 1)]


def test_votes_against_brute_force():
    rng = np.random.default_rng(0)
    known = rng.standard_normal((200, 6)).astype(np.float32)
    known[50:60] = known[0]  # ties
    known /= np.linalg.norm(known, axis=1, keepdims=True)
    labels, balance = rng.integers(0, 2, 200).astype(float), rng.random(200)
    v = Q.Voter((6, 0), np.ones(6, np.float32), np.eye(6, dtype=np.float32), known, labels, balance, 0.25, 7, 3.0)
    rows = np.concatenate([np.abs(rng.standard_normal((40, 6))), known[:5], np.zeros((1, 6))]).astype(np.float32)
    for x, got in zip(rows, v.score(rows)):
        c = sorted(((round(float(np.float32(x / max(np.linalg.norm(x), 1e-9)) @ k), 5), y, b) for k, y, b in zip(known, labels, balance)), reverse=True)
        near = [(c_ ** 3 * b, y) for c_, y, b in c if c_ >= c[6][0] and c_ > 0]
        want = sum(w * y for w, y in near) / sum(w for w, _ in near) if near else 0.25
        assert abs(got - want) < 2e-3
    assert v.score(rows[-1:])[0] == 0.25


def test_held_out_accuracy(spark):
    rng = np.random.default_rng(3)
    words = np.array(["house", "garden", "water", "green", "walks", "slowly", "under", "stone"])
    r, labels = [], []
    for i in range(300):
        w = " ".join(rng.choice(words, 40))
        r.append((i, w if i % 4 else w.upper().replace(" ", "!! ***"), "en", "s", 0, 0, 0, "clash"))
        labels.append((i, int(i % 4 > 0)))
    r.append((900, None, None, None, 0, 0, 0, "clash"))
    d = spark.createDataFrame(r, SCHEMA)
    y = spark.createDataFrame([*labels, (0, None), (901, 1)], "doc_id long, quality int")
    got = {x.doc_id: x for x in Q.classify(d, y).collect()}
    assert len(got) == 301 and all(0 <= x.score <= 1 for x in got.values())
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(300))
    wrong = [i for i, q in labels if got[i].predicted != q]
    assert not wrong


def test_odd_tables(spark):
    y = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.classify(empty(spark), y).count() == 0
    assert {x.score for x in Q.classify(documents(spark), y).collect()} == {0.5}
    one = spark.createDataFrame([(0, 1), (1, 1), (2, 1)], "doc_id long, quality int")
    assert {round(x.score, 6) for x in Q.classify(documents(spark), one).collect()} == {1.0}


def test_text_ids_repeated_rows_and_long_texts(spark):
    base = [(f"d{i}", "good words in a row " * 8 if i % 2 else "BAD!! WORDS!! " * 8) for i in range(40)]
    d = spark.createDataFrame([*base, *base[:10], *[("d1", base[1][1])] * 50, (None, "x"), ("long", "good words in a row " * 30000), ("e", "")], "doc_id string, text string")
    y = spark.createDataFrame([(f"d{i}", i % 2) for i in range(40)], "doc_id string, quality int")
    got = Q.classify(d, y).collect()
    assert len(got) == 103
    assert all(r.predicted == int(r.doc_id[1:]) % 2 for r in got if r.doc_id and r.doc_id[0] == "d")
    assert {r.predicted for r in got if r.doc_id == "long"} == {1} and len({r.score for r in got if r.doc_id == "d1"}) == 1
