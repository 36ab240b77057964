import hashlib

import sentencepiece

import corpus_pipeline as P
from tokenframe.llm.sentencepieces import default_model

from .fixtures import SCHEMA, documents, empty, rows
from .test_repeats import brute_bytes, spliced
from .test_shingles import brute


def test_stages_against_brute_force(spark, tmp_path):
    texts = [r[1] for r in rows(30)] + spliced(30)
    d = spark.createDataFrame([(i, t, ("en", "fr")[i % 2], f"s{i % 3}", len(t or ""), 0, 0, "clash") for i, t in enumerate(texts)], SCHEMA)
    kept = {r.doc_id: r for r in P.language(spark, d, "").collect()}
    assert set(kept) <= {i for i, t in enumerate(texts) if any(c.isalpha() for c in t or "")} and len(kept) > 60
    d = d.where(d.doc_id.isin(list(kept)))
    ids = sorted(kept)
    single = [ids[k] for k in brute([texts[i] for i in ids])]
    got = P.near_duplicates(spark, d, "")
    assert sorted(r.doc_id for r in got.collect()) == single and got.columns == d.columns
    d = d.where(d.doc_id.isin(single))
    want = {i: b for i, b in zip(single, brute_bytes([texts[i] for i in single]))}
    got = {r.doc_id: r for r in P.repeated_strings(spark, d, "").collect()}
    assert set(single) - set(got) == {i for i in single if want[i][0] - want[i][1] == 0 or not texts[i].split()} & set(single) - set(got)
    for i, r in got.items():
        assert r.n_chars == len(r.text)
        if r.text.isascii():
            assert hashlib.sha256(r.text.encode()).hexdigest() == want[i][3]
    mixed = P.mixture(spark, d, "")
    assert mixed.columns == d.columns and 0 < mixed.count() <= 3 * len(single)
    lib = sentencepiece.SentencePieceProcessor(model_file=default_model())
    for r in P.tokens(spark, mixed, "").collect():
        assert r.n_tokens == len(lib.encode(texts[r.doc_id]))


def test_run(spark, tmp_path):
    documents(spark, 20).write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() > 0
    assert [k for k, _ in P.STAGES] == ["language", "near_duplicates", "repeated_strings", "mixture", "tokens"]


def test_empty_table(spark):
    d = empty(spark)
    for _, stage in P.STAGES:
        assert stage(spark, d, "").count() == 0


def test_columns_of_any_name_and_repeated_ids(spark):
    names = "doc_id long, text string, lang string, source string, lang_id string, copies int, _copies int, copy string, id long, rest string, n int"
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in ("word", "other"))
    d = spark.createDataFrame([(i, t, "en", "s", f"x{(t or '-')[0]}", 7, 8, "y", 9, "z", 3) for i, t in ((1, a), (1, b), (None, a), (2, None))], names).withColumn("n_chars", P.F.length("text").cast("long"))
    kept = {1: 0, None: 0}
    for name, stage in P.STAGES[:4]:
        got = stage(spark, d, "")
        rows_ = got.collect()
        assert got.columns == d.columns, name
        assert all(r.lang_id == f"x{r.text[0]}" and (r.copies, r._copies, r.copy, r.id, r.rest, r.n) == (7, 8, "y", 9, "z", 3) for r in rows_ if r.text), name
        kept[name] = sorted(r.text for r in rows_ if r.text)
    assert kept["language"] == [b, a, a] and kept["near_duplicates"] == [b, a]
