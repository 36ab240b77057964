"""Byte fallback over whole batches against one piece, or one list of ids, at a time."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from tokenframe.errors import ModelError
from tokenframe.functions.models import Bpe
from tokenframe.operators import arrow
from tokenframe.operators.tokenizer import Tokenizer
from tokenframe.sources import samples
from tokenframe.sources.spec import TokenizerSpec

BYTES = [f"<0x{b:02X}>" for b in range(256)]
ATOMS = ["a", "b", "é", "e", "t", "h", "▁", "漢", "😀", "ü", "\x00", "ab" * 40, "the"]


def spec(vocab, merges, decoder=None, **model):
    doc = {"model": {"type": "BPE", "vocab": {t: i for i, t in enumerate(vocab)}, "merges": merges} | model}
    return TokenizerSpec.from_dict(doc | ({"decoder": decoder} if decoder else {}))


MODELS = {
    "sample": samples.char_bpe(),
    "across characters": spec([*BYTES, "<0xA9><0xC3>"], [["<0xA9>", "<0xC3>"]], byte_fallback=True),
    "bytes and characters": spec([*BYTES, "a", "b", "ab", "bb", "abb", "éa", "é"], [["b", "b"], ["a", "b"], ["a", "bb"], ["é", "a"]], byte_fallback=True),
    "some bytes": spec([*BYTES[:200], "a", "b", "ab", "<0xA9>a"], [["a", "b"], ["<0xA9>", "a"]], byte_fallback=True),
    "no bytes": spec(["a", "b", "ab", "é", "bé", "éa"], [["a", "b"], ["b", "é"], ["é", "a"]]),
    "whole": spec(["a", "b", "ab", "aba", "é", "the"], [["a", "b"]], ignore_merges=True),
}


@pytest.mark.parametrize("name", MODELS)
def test_parts_of_many_pieces_against_one_at_a_time(name):
    model, rng = Bpe(MODELS[name].model), random.Random(3)
    for _ in range(400):
        pieces = list(dict.fromkeys("".join(rng.choice(ATOMS) for _ in range(rng.randrange(9))) for _ in range(4)))
        try:
            want = [[i for p in model.pieces(x) for i in model._encode(p)] for x in pieces]
        except ModelError as e:
            with pytest.raises(ModelError) as said:
                model.encode_many(pieces)
            assert str(said.value) == str(e)
            continue
        ids, size = model.encode_many(pieces)
        assert [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] == want


def test_long_texts_take_time_in_proportion():
    """A text without any split, of bytes that hardly merge: in arrays, not character by character."""
    t = Tokenizer(MODELS["across characters"])
    text, began = "l'été é é ééé " * 60_000, time.process_time()
    ids = t.content(text)
    assert time.process_time() - began < 1.5
    assert len(ids) == len(text.encode()) - 2 * text.count("éé")


def test_decoding_by_bytes_against_the_chain():
    replace = {"type": "Replace", "pattern": {"String": "▁"}, "content": " "}
    empty = {"type": "Replace", "pattern": {"String": "a"}, "content": ""}
    rng = random.Random(5)
    for steps in ([replace, {"type": "ByteFallback"}, {"type": "Fuse"}], [{"type": "ByteFallback"}], [empty, {"type": "ByteFallback"}], [{"type": "Fuse"}]):
        t = Tokenizer(spec([*BYTES, "a", "▁b", "é"], [], {"type": "Sequence", "decoders": steps}, byte_fallback=True))
        assert (t.byte_table() is None) == (steps[0] is empty or steps[0]["type"] == "Fuse")
        rows = [[rng.choice([0xC3, 0xA9, 0x41, 0xE6, 0xBC, 0xA2, 256, 257, 258, 999, -1]) for _ in range(rng.randrange(7))] for _ in range(900)]
        assert arrow.texts_of(pa.array([*rows, None], arrow.IDS), t).to_pylist() == [*map(t.decode, rows), None]
