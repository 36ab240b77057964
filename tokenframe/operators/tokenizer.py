"""The executable tokenizer of one process: what each worker runs over its Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import regex

from ..errors import UnsupportedError
from ..functions.added import AddedTokens
from ..functions.decoders import compile_decoder, speller
from ..functions.models import Bpe, Unigram
from ..functions.normalizers import compile_normalizer
from ..functions.grammars import EXHAUSTIVE, GRAMMARS, for_python, name_of
from ..functions.pretokenizers import byte_chars, compile_pre_tokenizer, ends_in_bytes
from ..functions.templates import compile_templates
from ..sources.spec import TokenizerSpec, Truncation, check_truncation
from .batch import ByteTable, Slots


# Members of an encoding that can be set but not read, and that can't be read at all.
SETTABLE = frozenset(["sequence_ids", "word_ids", "words"])
ABSENT = SETTABLE | {"tokens", "offsets", "char_to_token", "char_to_word", "token_to_chars", "token_to_sequence", "token_to_word", "word_to_chars", "word_to_tokens"}
LARGEST_TABLE = 1 << 22  # of ids, for tables that have a place for each


@dataclass
class Encoding:
    """One encoded row. The four lists are independent of each other."""

    ids: list[int]
    attention_mask: list[int] = field(default_factory=list)
    type_ids: list[int] = field(default_factory=list)
    special_tokens_mask: list[int] = field(default_factory=list)
    n_sequences: int = 1
    truncated: bool = False

    @classmethod
    def of(cls, ids: list[int], truncated: bool = False) -> Encoding:
        n = len(ids)
        return cls(list(ids), [1] * n, [0] * n, [0] * n, 1, truncated)

    def __len__(self) -> int:
        return len(self.ids)

    @property
    def num_tokens(self) -> int:
        return len(self.ids)

    def __repr__(self) -> str:
        return f"Encoding(num_tokens={len(self)}, n_sequences={self.n_sequences}, truncated={self.truncated})"

    def set_sequence_id(self, sequence_id: int) -> None:
        self._given["sequence_id"] = sequence_id

    def __setattr__(self, name: str, value: object) -> None:
        if name in SETTABLE:
            self._given[name] = value
        else:
            object.__setattr__(self, name, value)

    def __getattr__(self, name: str):
        """What maps ids to places in the text isn't kept, so that asking for it is an error."""
        if name == "_given":
            object.__setattr__(self, "_given", {})
            return self._given
        if name in ABSENT:
            raise UnsupportedError(f"{name} of an encoding")
        raise AttributeError(name)

    def _lists(self) -> tuple[str, ...]:
        return "ids", "attention_mask", "type_ids", "special_tokens_mask"

    def truncate(self, max_length: int, stride: int = 0, direction: str = "right") -> None:
        check_truncation(Truncation(max_length, stride, direction=direction))
        if max_length >= len(self.ids):
            return
        for name in self._lists():
            own = getattr(self, name)
            setattr(self, name, own[:max_length] if direction == "right" else own[len(own) - max_length :])
        self.truncated = True

    def pad(self, length: int, direction: str = "right", pad_id: int = 0, pad_type_id: int = 0) -> None:
        more = length - len(self.ids)
        if more <= 0:
            return
        for name, value in zip(self._lists(), (pad_id, 0, pad_type_id, 0), strict=True):
            own = getattr(self, name)
            setattr(self, name, own + [value] * more if direction == "right" else [value] * more + own)

    @classmethod
    def merge(cls, parts: Iterable[Encoding]) -> Encoding:
        parts = list(parts)
        whole = cls([], n_sequences=sum(p.n_sequences for p in parts), truncated=any(p.truncated for p in parts))
        for name in whole._lists():
            setattr(whole, name, [x for p in parts for x in getattr(p, name)])
        return whole

    @property
    def overflowing(self) -> list[Encoding]:
        if self.truncated:
            raise UnsupportedError("overflowing parts of a truncated encoding")
        return []


class Tokenizer:
    def __init__(self, spec: TokenizerSpec):
        self.spec = spec
        self.normalize = compile_normalizer(spec.normalizer)
        self.added = AddedTokens(spec.added_tokens, self.normalize)
        self.pre_tokenize = compile_pre_tokenizer(spec.pre_tokenizer)
        self.model = Bpe(spec.model, ends_in_bytes(spec.pre_tokenizer)) if spec.model.kind == "BPE" else Unigram(spec.model)
        self.raw_bytes = ends_in_bytes(spec.pre_tokenizer)
        self.find_raw = _raw_words(spec.pre_tokenizer)
        self.slots = Slots(self.encode_raw if self.find_raw is not None else self.model.encode_many)
        self.raw_slots = Slots(self.encode_raw)
        self.templates = compile_templates(spec.post_processor)
        self.decode_chain = compile_decoder(spec.decoder)
        self.speller = speller(spec.decoder)
        self.byte_tables: dict[bool, ByteTable | None] = {}

    def segments(self, text: str) -> list[tuple[str, int | None]]:
        """Normalized segments of text, in order, and the added tokens between them."""
        if not text:
            return []
        out: list[tuple[str, int | None]] = []
        for part, i in self.added.raw.segments(text):
            out += [(part, i)] if i is not None else self.added.normalized.segments(self.normalize(part))
        return out

    def pieces(self, text: str) -> list[tuple[str, int | None]]:
        """The pieces that the model encodes, and the added tokens between them."""
        return [x for part, i in self.segments(text) for x in ([(part, i)] if i is not None else [(p, None) for p in self.pre_tokenize(part) if p])]

    def encode_raw(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of text before their bytes are spelled as characters."""
        return self.model.encode_many([byte_chars(p) for p in pieces] if self.raw_bytes else pieces)

    def validate(self, text: str) -> None:
        """Raise what encoding text would raise, without merging."""
        for piece, i in self.pieces(text):
            if i is None:
                self.model.validate(piece)

    def _keys(self, text: str) -> list[str | tuple[int]]:
        """The pieces of text as the slots name them: added tokens by their id alone. Where one
        exhaustive grammar splits each segment and bytes are spelled last, pieces stay unspelled."""
        if self.find_raw is None:
            return [p if i is None else (i,) for p, i in self.pieces(text)]
        if not self.added.tokens and not self.spec.normalizer:
            return self.find_raw(text)
        out: list[str | tuple[int]] = []
        for part, i in self.segments(text):
            out += self.find_raw(part) if i is None else [(i,)]
        return out

    def content_lists(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of the contents of several texts; null has none."""
        keys: list[str | tuple[int]] = []
        ends = []
        for t in texts:
            if t:
                keys += self._keys(t)
            ends.append(len(keys))
        return self.slots.lists(keys, np.array(ends, np.int64))

    def content(self, text: str) -> list[int]:
        return self.content_lists([text])[1].tolist()

    def post_process(self, ids: list[int], add_special_tokens: bool = True) -> list[int]:
        for t in self.templates if add_special_tokens else ():
            ids = t.apply(ids)
        return ids

    def num_special_tokens_to_add(self, is_pair: bool = False) -> int:
        if is_pair:
            raise UnsupportedError("pairs of sequences")
        return len(self.post_process([]))

    def ids(self, text: str, add_special_tokens: bool = True) -> list[int]:
        return self.post_process(self.content(text), add_special_tokens)

    def with_limit(self, text: str, most: int, direction: str = "right") -> tuple[list[int], bool]:
        """The first (or last) `most` ids of the content, and whether any were left out. All of the
        text is encoded, so that what is wrong with it shows wherever it stands."""
        ids = self.content(text)
        return (ids, False) if len(ids) <= most else (ids[:most] if direction == "right" else ids[len(ids) - most :], True)

    def room(self, add_special_tokens: bool = True) -> int | None:
        """How many ids of a content truncation leaves beside the special tokens; None where there is none."""
        t = self.spec.truncation
        if t is None:
            return None
        check_truncation(t)
        room = t.max_length - (self.num_special_tokens_to_add() if add_special_tokens else 0)
        if room < 0:
            raise ValueError(f"truncation max_length {t.max_length} cannot fit {t.max_length - room} special tokens")
        return room

    def encode(self, text: str, add_special_tokens: bool = True, pad: bool = True) -> Encoding:
        """Truncate, post-process and pad as the specification says."""
        truncated, room = False, self.room(add_special_tokens)
        if room is None:
            ids = self.content(text)
        else:
            ids, truncated = self.with_limit(text, room, self.spec.truncation.direction)
        out = Encoding.of(self.post_process(ids, add_special_tokens), truncated)
        if pad:
            self.pad(out, len(out))
        return out

    def pad(self, encoding: Encoding, longest: int) -> None:
        p = self.spec.padding
        if p is not None:
            target = max(longest if p.length is None else p.length, len(encoding))
            if p.pad_to_multiple_of:
                target = -(-target // p.pad_to_multiple_of) * p.pad_to_multiple_of
            encoding.pad(target, p.direction, p.pad_id, p.pad_type_id)

    def encode_batch(self, texts: list[str], add_special_tokens: bool = True) -> list[Encoding]:
        out = [self.encode(t, add_special_tokens, pad=False) for t in texts]
        longest = max(map(len, out), default=0)
        for e in out:
            self.pad(e, longest)
        return out

    def id_to_token(self, i: int) -> str | None:
        return self.added.text_of.get(i, self.model.text_of.get(i))

    def token_to_id(self, token: str) -> int | None:
        return self.added.id_of.get(token, self.model.id_of.get(token))

    def is_special_token(self, i: int) -> bool:
        return i in self.added.special

    @property
    def vocab_size(self) -> int:
        """Tokens of the model and added ones; those that are both count twice."""
        return len(self.spec.model.vocab) + len(self.added)

    def vocab(self, with_added_tokens: bool = True) -> dict[str, int]:
        return dict(self.model.id_of) | (self.added.id_of if with_added_tokens else {})

    def decode_tokens(self, tokens: list[str]) -> str:
        return "".join(self.decode_chain(tokens))

    def byte_table(self, skip_special_tokens: bool = False) -> ByteTable | None:
        """Where the decoder only puts bytes together: the bytes of each id."""
        if self.speller is None or max(self.added.text_of, default=0) > LARGEST_TABLE:
            return None
        if skip_special_tokens not in self.byte_tables:
            spell, strict = self.speller
            spelled = {i: spell(t) for i, t in (self.model.text_of | self.added.text_of).items() if not (skip_special_tokens and i in self.added.special)}
            # a token of no bytes still ends a run of byte tokens
            self.byte_tables[skip_special_tokens] = None if strict and not all(spelled.values()) else ByteTable(spelled, strict)
        return self.byte_tables[skip_special_tokens]

    def decode(self, ids: Iterable[int], skip_special_tokens: bool = False) -> str:
        """Ids that nothing has are left out."""
        kept = (i for i in ids if not (skip_special_tokens and i in self.added.special))
        return self.decode_tokens([t for i in kept if (t := self.id_to_token(i)) is not None])


def _raw_words(config: dict | None):
    """findall of the grammar of a pre-tokenizer that is one exhaustive split and then byte level, or
    None. A prefix space, or any other step, needs the general path."""
    steps = config["pretokenizers"] if config and config["type"] == "Sequence" else [config] if config else []
    if not steps or steps[-1]["type"] != "ByteLevel" or steps[-1].get("add_prefix_space", True):
        return None
    own = steps[-1].get("use_regex", True)
    if len(steps) == 1 and own:
        return regex.compile(for_python(GRAMMARS["gpt2"])).findall
    if len(steps) == 2 and not own and steps[0]["type"] == "Split" and steps[0]["behavior"] == "Isolated" and not steps[0].get("invert"):
        pattern = steps[0]["pattern"].get("Regex")
        if pattern and name_of(pattern) in EXHAUSTIVE:
            return regex.compile(for_python(pattern)).findall
    return None
