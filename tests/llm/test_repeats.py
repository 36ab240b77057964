import hashlib
import random
from collections import Counter

from tokenframe.llm import substring_dedup, suffix_dedup

from .fixtures import documents, empty, rows


def sha(b):
    return hashlib.sha256(b).hexdigest()


def brute_bytes(texts, span=200):
    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + span] for t in texts for i in range(len(t) - span + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - span + 1):
            if seen[t[i : i + span]] > 1:
                gone[i : i + span] = [True] * span
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), sha(kept)))
    return out


def brute_words(texts, window=20):
    seen, out = set(), []
    for t in texts:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if (key := tuple(w[i : i + window])) in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((len(w), sum(gone), sha(b" ".join(kept))))
    return out


def spliced(n=70, seed=5):
    rng = random.Random(seed)
    words = [f"w{i}é" if i % 5 == 0 else f"w{i}" for i in range(400)]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randint(15, 90))) for _ in range(8)]
    out = []
    for i in range(n):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(3)]
        parts.insert(rng.randrange(3), rng.choice(passages))
        if i % 4 == 0:
            p = rng.choice(passages)
            parts.append(p[rng.randrange(20) : len(p) - rng.randrange(20)])
        out.append(rng.choice([" ", "\n", "  "]).join(parts))
    return out + out[:3]


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_bytes_against_brute_force(spark):
    for texts in ([r[1] for r in rows()], spliced()):
        got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.digest(table(spark, texts)).collect()}
        assert [got[i] for i in range(len(texts))] == brute_bytes(texts)


def test_words_against_brute_force(spark):
    for texts in ([r[1] for r in rows()], spliced()):
        got = {r.doc_id: tuple(r)[1:] for r in substring_dedup.digest(table(spark, texts)).collect()}
        assert [got[i] for i in range(len(texts))] == brute_words(texts)


def test_clashing_columns_and_empty(spark):
    assert suffix_dedup.digest(empty(spark)).count() == 0
    assert substring_dedup.digest(empty(spark)).count() == 0
    assert suffix_dedup.clean(documents(spark)).count() == documents(spark).count()


def test_repeated_and_null_ids(spark):
    texts = spliced(10)
    rows_ = [(None, texts[0]), (1, texts[1]), (1, texts[1]), (2, texts[2]), (2, None)]
    d = spark.createDataFrame(rows_, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_removed) for r in suffix_dedup.digest(d).collect())
    want = sorted((i or -1, n, gone) for (i, _), (n, gone, _, _) in zip(rows_, brute_bytes([t for _, t in rows_])))
    assert got == want
    assert sorted(r.n_removed == r.n_words > 0 for r in substring_dedup.digest(d).where("doc_id = 1").collect()) == [False, True]


def test_names_with_many_neighbourhoods(spark, monkeypatch):
    from tokenframe.llm import repeats

    monkeypatch.setattr(repeats, "GATHERED", 1)
    texts = spliced()
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.digest(table(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_bytes(texts)
    got = {r.doc_id: tuple(r)[1:] for r in substring_dedup.digest(table(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_words(texts)
