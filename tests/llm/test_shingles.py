import random

import numpy as np

import corpus_pipeline as P
from tokenframe.llm import shingles as S
from tokenframe.llm.shingles import leaders

from .fixtures import SCHEMA, documents, empty


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def brute(texts):
    s, root = [shingle_set(t) for t in texts], list(range(len(texts)))
    near = [(i, j) for i in range(len(s)) for j in range(i) if 5 * len(s[i] & s[j]) >= 4 * len(s[i] | s[j])]
    changed = True
    while changed:
        changed = False
        for i, j in near:
            if root[i] != root[j]:
                root[i] = root[j] = min(root[i], root[j])
                changed = True
    return [i for i, r in enumerate(root) if i == r]


def test_near_copies_of_ordinary_length(spark):
    words = [f"w{i}" for i in range(120)]
    texts = [" ".join(words)] + [" ".join([*words[:k], "other", *words[k + 1 :]]) for k in range(10, 110, 2)]
    texts += [" ".join(words[:60] + [f"v{i}" for i in range(60)]), " ".join(words[:70])]
    d = spark.createDataFrame([(i, t, "en", "s", len(t), 0, 0, "clash") for i, t in enumerate(texts)], SCHEMA)
    assert sorted(r.doc_id for r in P.near_duplicates(spark, d, "").collect()) == brute(texts) == [0, 51, 52]


def test_against_brute_force(spark):
    d = documents(spark)
    texts = [r.text for r in d.orderBy("doc_id").collect()]
    assert sorted(r.id for r in leaders(d.select(d.doc_id.alias("id"), "text")).collect()) == brute(texts)
    assert leaders(empty(spark).selectExpr("doc_id id", "text")).count() == 0


def test_rows_of_repeated_and_null_ids(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(50)) for c in "ab")
    d = spark.createDataFrame([(k, t, "en", "s", len(t), 0, 0, "clash") for k, t in ((1, a), (1, b), (None, a), (None, a))], SCHEMA)
    assert sorted(r.text for r in P.near_duplicates(spark, d, "").collect()) == [a, b]


def families(seed=5):
    """Sets of fingerprints in families of 1 to 8 that differ in single bits here and there."""
    rng = np.random.default_rng(seed)
    out = []
    for size in [1, 2, 3, 8] * 6:
        base = rng.integers(0, 2, S.SKETCH)
        out += [base ^ (rng.random(S.SKETCH) < rng.choice([0.02, 0.1, 0.15])) for _ in range(size)]
    return np.array(out)


def test_candidates_share_positional_bytes_of_a_fingerprint(spark):
    bits = families()
    fps = [np.packbits(x[: 64 * S.FPS]) for x in bits]
    want = set()
    for a in range(len(fps)):
        for b in range(a + 1, len(fps)):
            off = np.bitwise_count(fps[a] ^ fps[b]).reshape(S.FPS, 8)
            tally, apart = (off == 0).sum(1), off.sum(1)
            if any(tally[f] >= S.TALLY and apart[f] + apart[(f + 1) % S.FPS] + apart[(f + 2) % S.FPS] <= S.BITS for f in range(S.FPS)):
                want.add((a, b))
    nodes = spark.createDataFrame([(i, i, bytearray(x.tobytes())) for i, x in enumerate(fps)], "id long, comp long, words binary")
    pairs, more = S._candidates(nodes, 0, False)
    assert {(r.a, r.b) for r in pairs.collect()} == want and len(want) > 50 and more.count() == 0
    want = {(a, b) for a, b in want if a % 3 != b % 3 and (bits[a] != bits[b]).sum() <= S.APART}
    rows = [(i, i % 3, bytearray(np.packbits(x).tobytes())) for i, x in enumerate(bits)]
    pairs, _ = S._candidates(spark.createDataFrame(rows, "id long, comp long, words binary"), 1, True)
    assert want and {(r.a, r.b) for r in pairs.collect()} >= want


def test_many_texts_that_stay_apart(spark):
    rng = random.Random(8)
    shared = [f"w{i}" for i in range(90)]
    texts = []
    for i in range(400):
        own = [f"x{i}_{k}" for k in range(14)]
        texts.append(" ".join(shared + own))
        if i % 4 == 0:  # a near copy of this text alone
            texts.append(" ".join(shared + own[:-1] + [f"y{i}"]))
    texts += [" ".join(shared[:k] + [f"z{k}"] + shared[k + 1 :]) for k in range(20, 70)]
    rng.shuffle(texts)
    d = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    assert sorted(r.id for r in leaders(d).collect()) == brute(texts)
