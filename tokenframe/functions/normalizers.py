"""Normalizers: functions from text to text, compiled from their configuration."""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Callable

import numpy as np
import regex

from ..errors import NormalizerError
from .grammars import for_python

Normalizer = Callable[[str], str]


def pattern_of(config) -> tuple[str, str]:
    """("String" or "Regex", pattern). A bare string is literal; with both kinds, String counts."""
    if isinstance(config, str):
        return "String", config
    for kind in ("String", "Regex"):
        if isinstance(config, dict) and config.get(kind) is not None:
            return kind, config[kind]
    raise NormalizerError(f"bad pattern {config!r}")


def replacer(config: dict) -> Normalizer:
    kind, pattern = pattern_of(config.get("pattern"))
    content = config["content"]
    if kind == "String":
        return lambda text: text.replace(pattern, content)
    try:
        compiled = regex.compile(for_python(pattern))
    except regex.error as e:
        raise NormalizerError(f"bad pattern {pattern!r}: {e}") from e
    return lambda text: compiled.sub(lambda _: content, text)


def nfc(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFC", text)


class CharsMap:
    """A precompiled character map: a double-array trie over UTF-8 and the texts its leaves point at."""

    GRAPHEME = regex.compile(r"\X")

    def __init__(self, packed: str):
        try:
            blob = base64.b64decode(packed, validate=True)
            size = int.from_bytes(blob[:4], "little")
            self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
            self.texts = blob[4 + size :]
        except (ValueError, TypeError) as e:
            raise NormalizerError(f"bad character map: {e}") from e
        self.known: dict[str, str | None] = {}

    def lookup(self, chunk: str) -> str | None:
        """The text of the shortest prefix of chunk that the map has."""
        if chunk in self.known:
            return self.known[chunk]
        units, found = self.units, None
        offset = lambda u: (u >> 10) << ((u & 512) >> 6)
        at = offset(units[0]) if units else 0
        for byte in chunk.encode():
            at ^= byte
            if not byte or at >= len(units) or units[at] & 0x800000FF != byte:
                break
            leaf = units[at] >> 8 & 1
            at ^= offset(units[at])
            if leaf:
                first = units[at] & 0x7FFFFFFF
                found = self.texts[first : self.texts.index(b"\0", first)].decode()
                break
        if len(self.known) < 1 << 16:
            self.known[chunk] = found
        return found

    def __call__(self, text: str) -> str:
        out = []
        for m in self.GRAPHEME.finditer(text):
            cluster = m[0]
            whole = self.lookup(cluster) if len(cluster.encode()) < 6 else None
            if whole is not None:
                out.append(whole)
            else:
                out += [c if (x := self.lookup(c)) is None else x for c in cluster]
        return "".join(out)


def compile_normalizer(config: dict | None) -> Normalizer:
    if config is None:
        return str
    kind = config["type"]
    if kind == "NFC":
        return nfc
    if kind == "Replace":
        return replacer(config)
    if kind == "Precompiled":
        return CharsMap(config["precompiled_charsmap"])
    steps = [compile_normalizer(x) for x in config["normalizers"]]

    def run(text: str) -> str:
        for step in steps:
            text = step(text)
        return text

    return run
