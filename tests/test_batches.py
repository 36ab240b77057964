"""Batches of a worker: worked on in slices, whatever they hold, with little memory beside the result."""

import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tokenframe.operators import arrow, batch
from tokenframe.operators.tokenizer import Tokenizer
from tokenframe.plans import engine as engine_module
from tokenframe.plans.engine import Engine
from tokenframe.sources import samples

TEXTS = ["the thing", "", None, "é 漢字 " * 9, "x", None, "and then " * 40, ""]


def struct_of(e):
    return None if e is None else vars(e)


def test_encodings_of_empty_texts(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    for spec in (samples.byte_bpe(), samples.byte_bpe(template=True).with_truncation(5), samples.byte_bpe(specials=True).with_truncation(7, direction="left").with_padding(length=9, pad_id=3, pad_type_id=2, direction="left"), samples.byte_bpe().with_padding(pad_to_multiple_of=4)):
        t = Tokenizer(spec)
        for special in (True, False):
            for r in df.select("text", Engine(spec).encode(F.col("text"), special).alias("e")).collect():
                assert (r.e and r.e.asDict()) == struct_of(None if r.text is None else t.encode(r.text, special)), (r.text, special)


@pytest.mark.parametrize("few", [0, 9])
def test_batches_are_padded_to_their_longest(spark, monkeypatch, few):
    monkeypatch.setattr(engine_module, "FEW_BATCHES", few)
    rows = [(i, t, None if i % 3 == 2 else f"b{i % 3}") for i, t in enumerate(TEXTS)]
    spec = samples.byte_bpe(specials=True).with_padding(pad_id=300, direction="left")
    got = {r.i: r.encoding for r in Engine(spec).encode_batch(spark.createDataFrame(rows, "i int, text string, b string"), batch_col="b").collect()}
    assert set(got) == set(range(len(rows)))
    for b in {b for _, _, b in rows}:
        own = [(i, t) for i, t, x in rows if x == b]
        for i, t in own:
            assert t is not None or got[i] is None
        for (i, _), e in zip([x for x in own if x[1] is not None], Tokenizer(spec).encode_batch([t for _, t in own if t is not None]), strict=True):
            assert got[i].asDict() == vars(e)


def test_only_ids_leave_the_worker(spark):
    df = spark.createDataFrame([("a",)], "text string").select(Engine(samples.byte_bpe()).encode(F.col("text")).alias("e"))
    assert "truncated" in df._jdf.queryExecution().optimizedPlan().toString()
    udf = [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "ArrowEvalPython" in line]
    assert len(udf) == 1 and "attention_mask" not in udf[0]


def test_slices_give_what_the_batch_gives(monkeypatch):
    texts = pa.array(TEXTS, pa.string())
    t = Tokenizer(samples.byte_bpe(template=True))
    want = [None if x is None else t.ids(x) for x in TEXTS]
    back = [None if x is None else samples.BOS + x + samples.EOS for x in TEXTS]
    for size in (1, 7, 50, 1 << 20):
        monkeypatch.setattr(batch, "CHUNK", size)
        for column, shift in ((texts, 0), (texts.slice(1), 1), (texts.slice(2, 1), 2), (texts.slice(0, 0), 0)):
            ids = arrow.ids_of(column, t)
            assert ids.to_pylist() == want[shift : shift + len(column)]
            assert arrow.texts_of(ids, t).to_pylist() == back[shift : shift + len(column)]
            limits = arrow.limits_of(column, t, 2, "left", False).to_pylist()
            assert limits == [None if x is None else {"ids": x[0], "truncated": x[1]} for x in ((None if x is None else t.with_limit(x, 2, "left")) for x in TEXTS[shift : shift + len(column)])]


def test_memory_of_a_batch_is_bounded():
    t = Tokenizer(samples.byte_bpe())
    texts = pa.array([" ".join(f"{i * j % 97}the{j}" for j in range(400)) for i in range(6000)])
    t.content_lists(["warm"])
    tracemalloc.start()
    ids = arrow.ids_of(texts, t)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * ids.nbytes + (160 << 20), peak


def test_lists_of_long_pieces_are_sliced_by_their_text(monkeypatch):
    monkeypatch.setattr(batch, "CHUNK", 100)
    column = pa.array([["x" * 80], None, ["y" * 30, None, "z" * 30], [], ["w"] * 9], pa.list_(pa.string()))
    parts = list(batch.chunks(column))
    assert [x for p in parts for x in p.to_pylist()] == column.to_pylist()
    assert len(parts) == 2 and [len(p) for p in batch.chunks(column.slice(2))] == [3]
    t = Tokenizer(samples.byte_bpe())
    assert arrow.ids_of(pa.array([], pa.string()), t).to_pylist() == []


def test_pieces_unspelled_and_folded(spark):
    from tokenframe.functions import columns as C
    from tokenframe.functions.pretokenizers import byte_chars
    from tokenframe.plans import queries as Q

    rows = [["".join(map(chr, range(128)))], ["é", "漢字😀", "", "the"], [], None, ["".join(C.SEPARATORS), "then", "the", "n ing", "\x00é", "Ã©"], ["\\1$1", "th", "e"]]
    df = spark.createDataFrame([(i, r, None if r is None else [byte_chars(p) for p in r]) for i, r in enumerate(rows)], "i int, p array<string>, s array<string>")
    one = lambda p: C.bpe_fold(F.filter(F.split(C.byte_hex(p), "(?<=\\G..)"), lambda s: s != ""), Q.MERGES)
    got = df.select("p", F.transform("s", Q._unspelled).alias("hex"), C.bpe_fold_pieces(F.col("p"), Q.MERGES).alias("tokens"), F.flatten(F.transform("p", one)).alias("one")).collect()
    for r in got:
        assert r.hex == (None if r.p is None else [p.encode().hex().upper() for p in r.p])
        assert r.tokens == r.one
    plan = Q.QUERIES["bpe_tokens_catalyst"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "(?<=" not in plan, "merges go over whole texts, not over each piece"


def test_pairs_are_made_column_by_column():
    t = Tokenizer(samples.minimal(added_tokens=[{"id": 7, "content": "the", "single_word": True}]))
    got = arrow.pairs_of(pa.array(TEXTS, pa.string()), t.segments).to_pylist()
    assert got == [None if x is None else [{"text": s, "token_id": i} for s, i in t.segments(x)] for x in TEXTS]
    assert arrow.pairs_of(pa.array([None, None], pa.string()).slice(1), t.segments).to_pylist() == [None]
