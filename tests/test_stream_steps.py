"""Steps of a stream: what is ahead of a cut is decoded alone, as if with all behind it."""

import random
import time

from tokenframe.operators.tokenizer import Tokenizer
from tokenframe.sources import samples
from tokenframe.streaming.decode import HOLE, Cut, advance, begun


def plainly(cut, new, t, skip):
    """The rule as it stands: all that is kept is decoded again."""
    cut.ahead.extend(new)
    now = t.decode(cut.behind + cut.ahead, skip)
    if now[-1:] == HOLE or len(now.encode()) <= len(cut.said.encode()):
        return None
    fresh = now.removeprefix(cut.said)
    assert not cut.said or fresh is not now
    cut.behind, cut.ahead = cut.ahead, []
    cut.said = t.decode(cut.behind, skip)
    return fresh


def test_steps_against_decoding_all():
    t, rng = Tokenizer(samples.byte_bpe(template=True)), random.Random(2)
    pool = [0xC3, 0xA9, 0xE6, 0xBC, 0xA2, 0xF0, 0x41, 0xEF, 0xBF, 0xBD, 0xFF, *range(256, 320), 70000, -1]
    for n in range(1500):
        skip, context = bool(n % 2), [rng.choice(pool) for _ in range(n % 4)]
        own, other = begun(context, t, skip), begun(context, t, skip)
        for _ in range(20):
            new = [rng.choice(pool) for _ in range(rng.randrange(4))]
            assert advance(own, new, t, skip) == plainly(other, new, t, skip)
            assert (own.behind, own.said, own.ahead) == (other.behind, other.said, other.ahead)


def test_steps_are_cheap():
    t = Tokenizer(samples.byte_bpe())
    ids = t.content("the naïve café sings of 漢字 and the " * 4000)
    advance(Cut(), ids[:1], t)
    began, cut = time.process_time(), Cut()
    said = [advance(cut, (i,), t) for i in ids]
    assert time.process_time() - began < 5e-6 * len(ids)
    assert "".join(x for x in said if x) == "the naïve café sings of 漢字 and the " * 4000
