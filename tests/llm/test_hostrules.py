import random

import duckdb

from tokenframe.llm import hostrules as H
from tokenframe.llm.oracles import OP4

from .fixtures import SCHEMA, documents, empty, rows


def brute(text):
    text = text or ""
    sep = " \t\n\x0b\x0c\r"
    words = text.translate({ord(c): " " for c in sep}).split(" ")
    words = [w for w in words if w]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            hit |= set(range(i, i + 5))
    dup, seen = 0, set()
    for line in text.split("\n"):
        if line.strip(sep):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_measures_against_brute_force():
    rng = random.Random(4)
    texts = [r[1] for r in rows() if len(r[1] or "") < 4000]
    texts += ["".join(rng.choice("ab é\n\n*  ") for _ in range(rng.randint(0, 200))) for _ in range(200)]
    for t in texts:
        assert H.measures(t or "")[:5] == brute(t)


GOOD = " ".join(f"word{i}" for i in range(40))
SIGNS = " ".join(f"#{i}*" for i in range(40)) + GOOD


def planted():
    """Twelve ordinary hosts, one that fails each rule of its own kind, and a tiny one."""
    r = [(i, (f"{GOOD} {i}" if i % 30 else "short"), f"host{i % 12}") for i in range(600)]
    r += [(1000 + i, SIGNS if i % 5 < 3 else f"{GOOD} b{i}", "signs") for i in range(100)]
    r += [(2000 + i, "\n".join([GOOD[i:]] * 2 + [GOOD]) if i % 5 < 3 else f"{GOOD} c{i}", "lines") for i in range(100)]
    r += [(3000 + i, "few words" if i % 5 < 3 else f"{GOOD} d{i}", "short") for i in range(100)]
    r += [(4000, f"{GOOD} e", "tiny"), (4001, SIGNS, "tiny"), (4002, None, None), (4003, f"{GOOD} f", None), (4004, SIGNS, None)]
    return [(a, t, "en", h, 0, 0, 0, "clash") for a, t, h in r]


def test_hosts_are_rejected(spark, tmp_path):
    d = spark.createDataFrame(planted(), SCHEMA)
    rows_ = H.judge(d).collect()
    got = {x.doc_id: x for x in rows_}
    assert len(rows_) == len(planted())
    assert all(got[i].kept == bool(i % 30) and not got[i].host_rejected for i in range(600))
    assert all(x.host_rejected and not x.kept for x in rows_ if 1000 <= x.doc_id < 4000)
    assert {got[1003].base_failed, got[2003].base_failed, got[3003].base_failed} == {False}
    assert got[4000].kept and got[4001].kept and not got[4001].base_failed, "half of a tiny host's documents don't condemn it"
    assert got[4002].base_failed and got[4003].kept
    rates = {r.host: r for r in H.host_rates(spark.createDataFrame([("a", True)] * 2 + [("b", False)] * 98, "host string, x boolean"), ["x"]).collect()}
    assert 0.02 < rates["a"].x_rate < 1 and 0 < rates["b"].x_rate < 0.02
    d.coalesce(1).write.parquet(f"{tmp_path}/documents")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    names = H.judge(d).columns
    want = sorted(con.sql(f"SELECT {', '.join(names)} FROM ({OP4})").fetchall(), key=str)
    mine = sorted(map(tuple, rows_), key=str)
    assert [(a, b) for a, b in zip(mine, want, strict=True) if a != b] == []


def test_values_on_a_limit_pass(spark):
    on = "# # # " + " ".join(f"w{i}" for i in range(9))  # three symbols in twelve words
    lines = "\n".join("0123456024")  # three of ten lines
    d = spark.createDataFrame([(1, on), (2, lines), (3, "ten " + " ".join(f"w{i}" for i in range(9))), (4, "1 2 3 4 5 6 7 8 9")], "doc_id long, text string").selectExpr("*", "'s' source")
    got = {x.doc_id: x for x in H.judge(d).collect()}
    assert [got[i].base_failed for i in (1, 2, 3, 4)] == [False, False, False, True]
    assert not any(x.host_rejected for x in got.values()), "one host is no worse than the corpus"


def test_odd_tables(spark):
    assert H.judge(empty(spark)).count() == 0
    d = documents(spark)
    assert H.judge(d.union(d)).count() == 2 * len(rows())
    for x in H.judge(d).collect():
        assert x.base_failed == (x.n_words < 10 or 100 * x.n_repeat_words > 20 * x.n_words)
        assert not (x.base_failed and x.kept)
