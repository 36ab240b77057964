"""Every query of the catalogue against its SQL in DuckDB, over whole tables."""

import os

import duckdb
import pytest

from tokenframe.plans import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", Q.QUERIES)
def test_query(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = ordered(tuple(r[c] for c in columns) for r in df.collect())
    assert got
    if name not in Q.SQL:
        return
    cur = duck.execute(Q.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    assert got == ordered(tuple(r[names.index(c)] for c in columns) for r in cur.fetchall())


def test_compatible_pairs_always_can(spark):
    assert Q.QUERIES["compatible_pairs"](spark, SF).where("not can").count() == 0


def test_byte_level_prefix_space_spells_every_text(spark, tmp_path):
    import hashlib

    texts = ["Déjà vu", " né", "a\tb\r\n", "漢字 ✓", "", "plain"]
    spark.createDataFrame([(i, t, "s", "l") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n, r.digest) for r in Q.QUERIES["byte_level_prefix_space_hex"](spark, str(tmp_path)).collect()}
    pieces = [[" Déjà", " vu"], [" né"], [" a", "\t", "b", "\r\n"], [" 漢字", " ✓"], [], [" plain"]]
    assert set(got) == set(range(len(texts)))
    for i, want in enumerate(pieces):
        assert got[i] == (len(want), hashlib.md5(chr(31).join(x.encode().hex().upper() for x in want).encode()).hexdigest())
