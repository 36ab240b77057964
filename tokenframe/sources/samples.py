"""Small tokenizers made by rule, for queries, examples and tests. None is trained."""

from __future__ import annotations

from ..functions.pretokenizers import BYTE_CHAR
from . import charsmap
from .spec import TokenizerSpec

# Fragments in the order in which they merge; each joins two that stand before it.
PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea".split()
LONGER = [("th", "e"), ("in", "g"), ("an", "d"), ("en", "t"), ("io", "n"), ("h", "er"), ("v", "er"), (" ", "the"), (" ", "and"), ("ti", "on"), ("Ã", "©")]
EOS, BOS, PAD = "<|end|>", "<|begin|>", "<|pad|>"


def byte_merges() -> list[tuple[str, str]]:
    """Pairs of byte strings, in latin-1 text (one character for each byte)."""
    return [(x[0], x[1]) for x in PAIRS] + LONGER


def spelled(raw: str) -> str:
    return "".join(BYTE_CHAR[ord(c)] for c in raw)


def byte_bpe(ignore_merges: bool = False, specials: bool = False, template: bool = False, prefix: bool = False) -> TokenizerSpec:
    """Byte-level BPE: the id of byte b is b, that of merge r is 256 + r; specials come behind."""
    merges = byte_merges()
    vocab = {BYTE_CHAR[b]: b for b in range(256)} | {spelled(a + b): 256 + r for r, (a, b) in enumerate(merges)}
    doc = {
        "model": {"type": "BPE", "vocab": vocab, "merges": [[spelled(a), spelled(b)] for a, b in merges], "ignore_merges": ignore_merges},
        "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": prefix, "use_regex": True}, "decoder": {"type": "ByteLevel"},
    }
    if specials or template:
        doc["added_tokens"] = [{"id": len(vocab) + i, "content": t, "special": True} for i, t in enumerate((BOS, EOS, PAD))]
    if template:
        ids = {t: {"id": t, "ids": [len(vocab) + i], "tokens": [t]} for i, t in enumerate((BOS, EOS, PAD))}
        single = [{"SpecialToken": {"id": BOS, "type_id": 0}}, {"Sequence": {"id": "A", "type_id": 0}}, {"SpecialToken": {"id": EOS, "type_id": 0}}]
        doc["post_processor"] = {"type": "Sequence", "processors": [{"type": "ByteLevel"}, {"type": "TemplateProcessing", "single": single, "pair": [], "special_tokens": ids}]}
    return TokenizerSpec.from_dict(doc)


def char_bpe() -> TokenizerSpec:
    """BPE over characters with byte fallback: a-z, the word mark, <0x00> to <0xFF>, some merges."""
    letters = [chr(c) for c in range(97, 123)] + ["▁"]
    merges = [(x[0], x[1]) for x in PAIRS]
    tokens = letters + [f"<0x{b:02X}>" for b in range(256)] + [a + b for a, b in merges]
    return TokenizerSpec.from_dict({
        "model": {"type": "BPE", "vocab": {t: i for i, t in enumerate(tokens)}, "merges": [list(m) for m in merges], "byte_fallback": True},
        "normalizer": {"type": "Sequence", "normalizers": [{"type": "Replace", "pattern": {"String": " "}, "content": "▁"}]},
        "decoder": {"type": "Sequence", "decoders": [{"type": "Replace", "pattern": {"String": "▁"}, "content": " "}, {"type": "ByteFallback"}, {"type": "Fuse"}]},
    })


def unigram_vocab() -> list[tuple[str, float]]:
    """<unk>, the word mark, letters and fragments; scores are multiples of 1/8, so sums are exact."""
    pieces = ["▁", *[chr(c) for c in range(97, 123)], *PAIRS, "the", "ing", "and", "ent", "ion", "▁the", "▁de", "▁a"]
    return [("<unk>", 0.0)] + [(p, -(3 + (k * 7 % 32) / 8) - (len(p) == 1) * 2) for k, p in enumerate(pieces)]


def unigram() -> TokenizerSpec:
    return TokenizerSpec.from_dict({
        "model": {"type": "Unigram", "vocab": [list(x) for x in unigram_vocab()], "unk_id": 0},
        "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "Metaspace", "replacement": "▁", "prepend_scheme": "always", "split": True}]},
        "decoder": {"type": "Metaspace", "replacement": "▁", "prepend_scheme": "always"},
    })


def minimal(**parts) -> TokenizerSpec:
    """A one-letter BPE model with the given other parts, for stages before the model."""
    return TokenizerSpec.from_dict({"model": {"type": "BPE", "vocab": {"a": 0}, "merges": []}} | parts)


# What the sample character map folds.
FOLDS = {"é": "e", "è": "e", "à": "a", "ü": "u", "ö": "o", "ä": "a", "ß": "ss", "ñ": "n", "ç": "c"}


def folding() -> TokenizerSpec:
    return minimal(normalizer={"type": "Precompiled", "precompiled_charsmap": charsmap.build(FOLDS)})
