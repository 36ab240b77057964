"""Decoders: functions from a list of token strings to another, compiled from their configuration."""

from __future__ import annotations

import re
from collections.abc import Callable

from .normalizers import replacer
from .pretokenizers import CHAR_BYTE, metaspace_options

Decoder = Callable[[list[str]], list[str]]
HEX = re.compile(r"<0x([0-9A-Fa-f]{2})>\Z")


def bytes_of(token: str) -> bytes:
    return b"".join(bytes([CHAR_BYTE[c]]) if c in CHAR_BYTE else c.encode() for c in token)


def byte_level(tokens: list[str]) -> list[str]:
    return [b"".join(map(bytes_of, tokens)).decode("utf-8", "replace")]


def byte_fallback(tokens: list[str]) -> list[str]:
    """Runs of byte tokens become text; an invalid run one replacement character for each byte."""
    out: list[str] = []
    run = bytearray()

    def flush() -> None:
        if run:
            try:
                out.append(run.decode())
            except UnicodeDecodeError:
                out.extend("�" * len(run))
            run.clear()

    for t in tokens:
        if m := HEX.match(t):
            run.append(int(m[1], 16))
        else:
            flush()
            out.append(t)
    flush()
    return out


def speller(config: dict | None) -> tuple[Callable[[str], bytes], bool] | None:
    """(the bytes of a token, whether bytes that are no text need the decoder itself), for decoders that put bytes
    together wherever a token stands: byte level, or literal replacements and then byte fallback. Else None."""
    steps = config["decoders"] if config and config["type"] == "Sequence" else [config] if config else []
    kinds = [x["type"] for x in steps]
    if kinds == ["ByteLevel"]:
        return bytes_of, False
    n = kinds.index("ByteFallback") if "ByteFallback" in kinds else len(kinds)
    if n == len(kinds) or set(kinds[:n]) - {"Replace"} or set(kinds[n + 1 :]) - {"Fuse"}:
        return None
    replaces = [replacer(x) for x in steps[:n]]

    def spelled(token: str) -> bytes:
        for replace in replaces:
            token = replace(token)
        return bytes([int(m[1], 16)]) if (m := HEX.match(token)) else token.encode()

    return spelled, True


def compile_decoder(config: dict | None) -> Decoder:
    if config is None:
        return list
    kind = config["type"]
    if kind == "ByteLevel":
        return byte_level
    if kind == "ByteFallback":
        return byte_fallback
    if kind == "Fuse":
        return list
    if kind == "Replace":
        replace = replacer(config)
        return lambda tokens: [replace(t) for t in tokens]
    if kind == "Metaspace":
        mark, scheme, _ = metaspace_options(config)
        return lambda tokens: [t.replace(mark, "" if i == 0 and scheme != "never" else " ") for i, t in enumerate(tokens)]
    steps = [compile_decoder(x) for x in config["decoders"]]

    def run(tokens: list[str]) -> list[str]:
        for step in steps:
            tokens = step(tokens)
        return tokens

    return run
