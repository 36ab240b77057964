import hashlib

import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tokenframe.llm import sentencepieces as S

from .fixtures import documents, empty, rows

LIB = sentencepiece.SentencePieceProcessor(model_file=S.default_model())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab the\n\tésß▁漢字<0x>#*…\x00🙂 "), max_size=60))
def test_same_as_library(text):
    m = S.model(S.default_model())
    assert m.encode(text) == LIB.encode(text)
    assert m.decode(m.encode(text)) == LIB.decode(LIB.encode(text))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31999), st.integers(0, 262)), max_size=12))
def test_decode_any_ids(ids):
    assert S.model(S.default_model()).decode(ids) == LIB.decode(ids)


def test_digests(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {x.doc_id: x.d for x in documents(spark).select("doc_id", S.digests(F.col("text")).alias("d")).collect()}
    for i, t, *_ in rows():
        ids = LIB.encode(t or "")
        assert tuple(got[i]) == (len(ids), sha(",".join(map(str, ids))), sha(LIB.decode(ids)))
    assert empty(spark).select(S.digests(F.col("text"))).count() == 0


def test_round_trip_columns(spark):
    d = documents(spark).select("text", S.encode(F.col("text")).alias("ids"))
    for x in d.select("text", S.decode(F.col("ids")).alias("back")).collect():
        assert x.back == LIB.decode(LIB.encode(x.text or ""))
