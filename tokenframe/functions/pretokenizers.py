"""Pre-tokenizers: functions from a text to its pieces, compiled from their configuration."""

from __future__ import annotations

from collections.abc import Callable

import regex

from ..errors import PreTokenizerError
from .grammars import GRAMMARS, for_python

PreTokenizer = Callable[[str], list[str]]

_shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHAR = {b: chr(b) for b in _shown} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _shown)}
CHAR_BYTE = {c: b for b, c in BYTE_CHAR.items()}
_TO_CHARS = str.maketrans({chr(b): c for b, c in BYTE_CHAR.items()})


def byte_chars(text: str) -> str:
    """One printable character for each UTF-8 byte."""
    return text.encode().decode("latin-1").translate(_TO_CHARS)


def matches(pattern: regex.Pattern, text: str) -> list[tuple[int, int]]:
    """Spans of the matches; an empty one right behind another match isn't one."""
    out, last = [], -1
    for m in pattern.finditer(text):
        if m.end() > m.start() or m.start() != last:
            out.append(m.span())
            last = m.end()
    return out


def split_pieces(text: str, spans: list[tuple[int, int]], behavior: str, invert: bool = False) -> list[str]:
    """Pieces of text around the delimiters at spans; empty pieces are dropped."""
    marked, done = [], 0
    for start, end in spans:
        if start > done:
            marked.append((text[done:start], invert))
        marked.append((text[start:end], not invert))
        done = end
    if done < len(text):
        marked.append((text[done:], invert))
    if behavior == "Removed":
        return [t for t, is_delimiter in marked if not is_delimiter and t]
    if behavior == "Isolated":
        return [t for t, _ in marked if t]
    out: list[str] = []
    if behavior == "Contiguous":
        before = None
        for t, kind in marked:
            if kind is before:
                out[-1] += t
            else:
                out.append(t)
            before = kind
    elif behavior in ("MergedWithPrevious", "MergedWithNext"):
        back = behavior == "MergedWithNext"
        before = False
        for t, kind in reversed(marked) if back else marked:
            if kind and not before and out:
                out[-1] = t + out[-1] if back else out[-1] + t
            else:
                out.append(t)
            before = kind
        if back:
            out.reverse()
    else:
        raise PreTokenizerError(f"unknown split behavior {behavior}")
    return [t for t in out if t]


def splitter(config: dict) -> PreTokenizer:
    pattern = config.get("pattern")
    if not isinstance(pattern, dict) or len(pattern) != 1 or next(iter(pattern)) not in ("String", "Regex"):
        raise PreTokenizerError(f"bad split pattern {pattern!r}")
    (kind, source), = pattern.items()
    behavior, invert = config["behavior"], bool(config.get("invert"))
    split_pieces("", [], behavior)
    try:
        compiled = regex.compile(for_python(source)) if kind == "Regex" else regex.compile(regex.escape(source)) if source else None
    except regex.error as e:
        raise PreTokenizerError(f"bad pattern {source!r}: {e}") from e
    return lambda text: split_pieces(text, matches(compiled, text) if compiled else [], behavior, invert)


def byte_level(config: dict) -> PreTokenizer:
    prefix, use_regex = config.get("add_prefix_space", True), config.get("use_regex", True)
    words = regex.compile(for_python(GRAMMARS["gpt2"]))

    def run(text: str) -> list[str]:
        if prefix and not text.startswith(" "):
            text = " " + text
        return [byte_chars(t) for t in (words.findall(text) if use_regex else [text])]

    return run


def metaspace_options(config: dict) -> tuple[str, str, bool]:
    mark = config.get("replacement", "▁")
    scheme = config.get("prepend_scheme", "always")
    if len(mark) != 1:
        raise PreTokenizerError("the replacement must be one character")
    if scheme not in ("always", "never"):
        raise PreTokenizerError(f"prepend scheme {scheme}")
    if config.get("add_prefix_space") is False and scheme != "never":
        raise PreTokenizerError("add_prefix_space false needs prepend_scheme never")
    return mark, scheme, config.get("split", True)


def metaspace(config: dict) -> PreTokenizer:
    mark, scheme, split = metaspace_options(config)
    literal = regex.compile(regex.escape(mark))

    def run(text: str) -> list[str]:
        text = text.replace(" ", mark)
        if scheme == "always" and not text.startswith(mark):
            text = mark + text
        return split_pieces(text, matches(literal, text), "MergedWithNext") if split else [text]

    return run


def whitespace(text: str, blank=regex.compile(r"\p{White_Space}+")) -> list[str]:
    return [t for t in blank.split(text) if t]


def compile_pre_tokenizer(config: dict | None) -> PreTokenizer:
    if config is None:
        return lambda text: [text]
    kind = config["type"]
    if kind != "Sequence":
        return {"Split": splitter, "ByteLevel": byte_level, "Metaspace": metaspace, "WhitespaceSplit": lambda _: whitespace}[kind](config)
    steps = [compile_pre_tokenizer(x) for x in config["pretokenizers"]]

    def run(text: str) -> list[str]:
        pieces = [text]
        for step in steps:
            pieces = [q for p in pieces for q in step(p) if q]
        return pieces

    return run


def ends_in_bytes(config: dict | None) -> bool:
    """Whether the model sees one character for each byte."""
    while config and config["type"] == "Sequence" and config["pretokenizers"]:
        config = config["pretokenizers"][-1]
    return bool(config) and config["type"] == "ByteLevel"
