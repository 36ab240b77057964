import hashlib

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tokenframe.llm import minhash as M

from .fixtures import documents, empty, rows, texts


def shingles(t):
    w = (t or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def hashed(*values):
    """Spark's xxhash64 of several columns: each is the seed of the next."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else (v & (1 << 64) - 1).to_bytes(8, "little"), h)
    return h


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute_fingerprint(t):
    """Bins, densification and packing, one bin after another."""
    w = (t or "").encode().split()
    h = [hashed(*(hashed(x) for x in w[i : i + 5])) for i in range(len(w) - 4)] or [hashed(b" ".join(w))]
    least = {}
    for x in h:
        x &= (1 << 63) - 1
        b = x >> M.SHIFT
        least[b] = min(least.get(b, x), x)
    full = {b for b, x in least.items() if x & M.LOW != M.LOW}
    out = bytearray()
    for b in range(M.BINS):
        if b in full:
            out.append(least[b] & 0xFF)
            continue
        seed = hashed(b.to_bytes(4, "little"))
        tries = (signed(xxhash.xxh64_intdigest(i.to_bytes(4, "little"), seed)) % M.BINS for i in range(M.PROBES))
        found = next((i for i in tries if i in full), None)
        if found is None:
            rank = {j: signed(xxhash.xxh64_intdigest(b"rest", xxhash.xxh64_intdigest(j.to_bytes(4, "little"), seed))) for j in full}
            found = min(rank, key=rank.get)
        out.append(least[found] & 0xFF)
    return out.hex()


def test_fingerprint_against_brute_force(spark):
    t = texts(40)
    got = spark.createDataFrame([(x,) for x in t], "t string").select("t", M.hexadecimal(M.fingerprint(F.col("t"))).alias("fp")).collect()
    assert len(got) == len(t)
    plain = [r for r in got if "　" not in (r.t or "") and "\x00" not in (r.t or "")]
    assert all(r.fp == brute_fingerprint(r.t) for r in plain) and len(plain) > 50


def test_likeness_edits_and_next(spark):
    r = [(i, t or "") for i, t, *_ in rows(120)]
    got = {x.doc_id: x for x in M.edited_fingerprints(documents(spark, 120)).collect()}
    assert len(got) == len(r)
    errors = []
    for k, (i, t) in enumerate(r):
        following = r[k - 1][1] if k else r[-1][1]
        third = len(t) // 3
        edited = t[: len(t) - third] + following[:third]
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for near, other in ((got[i].near_edited, edited), (got[i].near_next, following)):
            a, b = shingles(t), shingles(other)
            errors.append(near - len(a & b) / len(a | b))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06
    by_text = {}
    for i, t in r:
        by_text.setdefault(t, set()).add(got[i].fingerprint)
    assert all(len(x) == 1 for x in by_text.values())
    assert all(len(x.fingerprint) == 256 for x in got.values())


def test_many_partitions_give_the_same(spark):
    want = sorted(map(tuple, M.edited_fingerprints(documents(spark)).collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "97")
    try:
        got = sorted(map(tuple, M.edited_fingerprints(documents(spark)).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == want


def test_no_python_on_the_main_path(spark):
    plan = M.edited_fingerprints(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_odd_tables(spark):
    assert M.edited_fingerprints(empty(spark)).count() == 0
    one = spark.createDataFrame([(5, "a b c d e f g")], "doc_id long, text string")
    x = M.edited_fingerprints(one).first()
    assert x.near_next == 1.0
    rows_ = [(None, "null id"), (None, "other"), (1, texts()[0]), (1, texts()[0]), (2, None)]
    d = spark.createDataFrame(rows_, "doc_id long, text string")
    assert M.edited_fingerprints(d).count() == 5


def test_repeated_rows_and_text_ids(spark):
    t = {"b": "one two three four five six", "a": "six five four three two one", "c": "x" * 30}
    d = spark.createDataFrame([("b", t["b"]), ("a", t["a"]), ("b", t["b"]), ("b", t["b"]), ("c", t["c"]), (None, "")], "doc_id string, text string")
    got = M.edited_fingerprints(d)
    assert got.columns[0] == "doc_id"
    made = {}
    for r in got.collect():
        made.setdefault(r.doc_id, []).append(r.edited_sha256)

    def sha(own, other):
        third = len(own) // 3
        return hashlib.sha256((own[: len(own) - third] + other[:third]).encode()).hexdigest()

    assert made == {"c": [sha(t["c"], t["b"])], "b": made["b"], "a": [sha(t["a"], "")], None: [sha("", "")]}
    assert sorted(made["b"]) == sorted([sha(t["b"], t["b"])] * 2 + [sha(t["b"], t["a"])])
