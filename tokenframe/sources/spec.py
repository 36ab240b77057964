"""Tokenizer specifications: reading, checking and writing tokenizer.json documents."""

from __future__ import annotations

import copy
import json
import math
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

from ..errors import JsonError, ModelError, SpecIOError, UnsupportedError

MAX_ADDED_ID = 16 * 1024 * 1024
MAX_TOKEN_BYTES = 65_535
KNOWN = {
    "normalizer": {"NFC", "Replace", "Precompiled", "Sequence"},
    "pre_tokenizer": {"Split", "ByteLevel", "Metaspace", "WhitespaceSplit", "Sequence"},
    "post_processor": {"TemplateProcessing", "ByteLevel", "Sequence"},
    "decoder": {"ByteLevel", "ByteFallback", "Replace", "Metaspace", "Fuse", "Sequence"},
}


@dataclass(frozen=True)
class AddedToken:
    id: int
    content: str
    single_word: bool = False
    lstrip: bool = False
    rstrip: bool = False
    normalized: bool = False
    special: bool = False


@dataclass(frozen=True)
class BpeModel:
    vocab: dict[str, int]
    merges: list[tuple[str, str]]
    byte_fallback: bool = False
    ignore_merges: bool = False

    @property
    def kind(self) -> str:
        return "BPE"


@dataclass(frozen=True)
class UnigramModel:
    vocab: list[tuple[str, float]]
    unk_id: int | None = None
    byte_fallback: bool = False

    @property
    def kind(self) -> str:
        return "Unigram"


@dataclass(frozen=True)
class Truncation:
    max_length: int
    stride: int = 0
    strategy: str = "longest_first"
    direction: str = "right"


@dataclass(frozen=True)
class Padding:
    length: int | None = None  # null: the longest row of the batch
    direction: str = "right"
    pad_id: int = 0
    pad_type_id: int = 0
    pad_token: str = "[PAD]"
    pad_to_multiple_of: int | None = None


@dataclass(frozen=True)
class TokenizerSpec:
    """All that a tokenizer.json says; immutable, picklable, and cheap to derive others from."""

    model: BpeModel | UnigramModel
    added_tokens: tuple[AddedToken, ...] = ()
    normalizer: dict | None = None
    pre_tokenizer: dict | None = None
    post_processor: dict | None = None
    decoder: dict | None = None
    truncation: Truncation | None = None
    padding: Padding | None = None
    source: dict = field(default_factory=dict, compare=False, repr=False)

    @classmethod
    def from_dict(cls, doc: dict) -> TokenizerSpec:
        if not isinstance(doc, dict) or not isinstance(doc.get("model"), dict):
            raise JsonError("a tokenizer document needs a model object")
        for part, known in KNOWN.items():
            _check_tags(part, doc.get(part), known)
        return cls(
            _model(doc["model"]),
            tuple(_added(x) for x in doc.get("added_tokens") or ()),
            doc.get("normalizer"),
            doc.get("pre_tokenizer"),
            doc.get("post_processor"),
            doc.get("decoder"),
            _truncation(doc.get("truncation")),
            _padding(doc.get("padding")),
            doc,
        )

    @classmethod
    def from_json(cls, text: str | bytes) -> TokenizerSpec:
        try:
            doc = json.loads(text)
        except ValueError as e:
            raise JsonError(str(e)) from e
        return cls.from_dict(doc)

    @classmethod
    def from_file(cls, path: str | Path) -> TokenizerSpec:
        if str(path).lower().endswith(".model"):
            raise UnsupportedError("native SentencePiece files aren't read; convert to tokenizer.json")
        try:
            return cls.from_json(Path(path).read_bytes())
        except OSError as e:
            raise SpecIOError(str(e)) from e

    def to_dict(self) -> dict:
        """The source document with the live truncation, padding, normalizer and post-processor."""
        doc = copy.deepcopy(self.source)
        doc["normalizer"], doc["post_processor"] = self.normalizer, self.post_processor
        t, p = self.truncation, self.padding
        doc["truncation"] = t and {"max_length": t.max_length, "stride": t.stride, "strategy": _camel(t.strategy), "direction": t.direction.title()}
        doc["padding"] = p and {
            "strategy": "BatchLongest" if p.length is None else {"Fixed": p.length}, "direction": p.direction.title(), "pad_to_multiple_of": p.pad_to_multiple_of,
            "pad_id": p.pad_id, "pad_type_id": p.pad_type_id, "pad_token": p.pad_token,
        }
        return doc

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), ensure_ascii=False)

    def save(self, path: str | Path) -> None:
        Path(path).write_text(self.to_json())

    def with_normalizer(self, normalizer: dict | None) -> TokenizerSpec:
        _check_tags("normalizer", normalizer, KNOWN["normalizer"])
        return replace(self, normalizer=normalizer)

    def with_post_processor(self, processor: dict | str | None) -> TokenizerSpec:
        processor = json.loads(processor) if isinstance(processor, str) else processor
        _check_tags("post_processor", processor, KNOWN["post_processor"])
        return replace(self, post_processor=processor)

    def with_truncation(self, max_length: int | None, stride: int = 0, strategy: str = "longest_first", direction: str = "right") -> TokenizerSpec:
        """None for max_length turns truncation off."""
        if max_length is None:
            return replace(self, truncation=None)
        t = Truncation(max_length, stride, strategy, direction)
        check_truncation(t)
        return replace(self, truncation=t)

    def with_padding(self, enabled: bool = True, **options: Any) -> TokenizerSpec:
        return replace(self, padding=Padding(**options) if enabled else None)

    @property
    def model_tokens(self) -> dict[str, int]:
        return self.model.vocab if self.model.kind == "BPE" else {t: i for i, (t, _) in enumerate(self.model.vocab)}

    def explain(self) -> str:
        """The stages of the pipeline, one a line."""
        tag = lambda x: "none" if x is None else x["type"] + (f"[{', '.join(y['type'] for y in x.get('normalizers') or x.get('pretokenizers') or x.get('processors') or x.get('decoders'))}]" if x["type"] == "Sequence" else "")
        return "\n".join([
            f"added tokens: {len(self.added_tokens)}", f"normalizer: {tag(self.normalizer)}", f"pre-tokenizer: {tag(self.pre_tokenizer)}",
            f"model: {self.model.kind}, {len(self.model.vocab)} tokens", f"post-processor: {tag(self.post_processor)}", f"decoder: {tag(self.decoder)}",
        ])


def check_truncation(t: Truncation) -> None:
    if t.stride:
        raise UnsupportedError("truncation with a stride")
    if t.strategy == "only_second":
        raise UnsupportedError("truncation strategy only_second")
    if t.direction not in ("left", "right") or t.max_length < 0:
        raise ValueError(f"bad truncation: {t}")


def _camel(name: str) -> str:
    return "".join(x.title() for x in name.split("_"))


def _snake(name: str) -> str:
    return "".join("_" + c.lower() if c.isupper() and i else c.lower() for i, c in enumerate(name))


def _check_tags(part: str, config: Any, known: set[str]) -> None:
    if config is None:
        return
    if not isinstance(config, dict) or "type" not in config:
        raise JsonError(f"{part} needs a type")
    if config["type"] not in known:
        raise UnsupportedError(f"{part} {config['type']}")
    for nested in ("normalizers", "pretokenizers", "processors", "decoders"):
        for x in config.get(nested) or ():
            _check_tags(part, x, known)


def _added(x: dict) -> AddedToken:
    try:
        token = AddedToken(**{k: x[k] for k in AddedToken.__dataclass_fields__ if k in x})
    except TypeError as e:
        raise JsonError(f"bad added token: {e}") from e
    if not 0 <= token.id <= MAX_ADDED_ID:
        raise ModelError(f"added token id {token.id} is out of range")
    return token


def _model(m: dict) -> BpeModel | UnigramModel:
    kind = m.get("type")
    if kind is None:
        vocab = m.get("vocab")
        if isinstance(vocab, dict) and "merges" not in m or vocab is None:
            raise JsonError("a model without a type needs vocab and, for BPE, merges")
        kind = "Unigram" if isinstance(vocab, list) else "BPE"
    if kind == "BPE":
        return bpe(m.get("vocab") or {}, [_pair(x) for x in m.get("merges") or ()], bool(m.get("byte_fallback")), bool(m.get("ignore_merges")))
    if kind == "Unigram":
        return unigram([(t, float(s)) for t, s in m.get("vocab") or ()], m.get("unk_id"), bool(m.get("byte_fallback")))
    raise UnsupportedError(f"model {kind}")


def _pair(x: Any) -> tuple[str, str]:
    if isinstance(x, str):
        left, space, right = x.partition(" ")
        if not space:
            raise ModelError(f"merge {x!r} has no space")
        return left, right
    if len(x) != 2:
        raise ModelError(f"merge {x!r} isn't a pair")
    return x[0], x[1]


def bpe(vocab: dict[str, int], merges: list[tuple[str, str]], byte_fallback: bool = False, ignore_merges: bool = False) -> BpeModel:
    if not vocab:
        raise ModelError("the BPE vocabulary is empty")
    if sorted(vocab.values()) != list(range(len(vocab))):
        raise ModelError("BPE ids must be 0 to n - 1, each once")
    if any(len(t.encode()) > MAX_TOKEN_BYTES for t in vocab):
        raise ModelError(f"a token has more than {MAX_TOKEN_BYTES} bytes")
    for a, b in merges:
        for t in (a, b, a + b):
            if t not in vocab:
                raise ModelError(f"merge of {a!r} and {b!r}: {t!r} isn't in the vocabulary")
    return BpeModel(vocab, merges, byte_fallback, ignore_merges)


def unigram(vocab: list[tuple[str, float]], unk_id: int | None = None, byte_fallback: bool = False) -> UnigramModel:
    if unk_id is not None and not 0 <= unk_id < len(vocab):
        raise ModelError(f"unk_id {unk_id} is outside a vocabulary of {len(vocab)}")
    if not all(math.isfinite(s) for _, s in vocab):
        raise ModelError("a score isn't finite")
    return UnigramModel(vocab, unk_id, byte_fallback)


def _truncation(t: dict | None) -> Truncation | None:
    return t and Truncation(t["max_length"], t.get("stride") or 0, _snake(t.get("strategy") or "LongestFirst"), (t.get("direction") or "Right").lower())


def _padding(p: dict | None) -> Padding | None:
    if p is None:
        return None
    if "strategy" in p:
        s = p["strategy"]
        if s is None or not (s == "BatchLongest" or isinstance(s, dict) and set(s) == {"Fixed"}):
            raise JsonError(f"padding strategy {s!r}")
        length = None if s == "BatchLongest" else s["Fixed"]
    else:
        length = p.get("length")
    return Padding(length, (p.get("direction") or "Right").lower(), p.get("pad_id") or 0, p.get("pad_type_id") or 0, p.get("pad_token") or "[PAD]", p.get("pad_to_multiple_of"))
