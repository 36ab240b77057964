"""Segmentation of text by added tokens."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import regex

from ..sources.spec import AddedToken

WORD = regex.compile(r"[\p{Alphabetic}\p{Join_Control}\p{M}\p{Nd}\p{Pc}_0-9]")
BLANK_END = regex.compile(r"\p{White_Space}+\Z")
BLANK = regex.compile(r"\p{White_Space}+")


class Matcher:
    """Leftmost-longest matcher of token contents."""

    def __init__(self, tokens: Iterable[AddedToken], spelled: Callable[[str], str] = str):
        self.by_text = {t: x for x in tokens if (t := spelled(x.content))}
        longest_first = sorted(self.by_text, key=lambda t: -len(t))
        self.find = regex.compile("|".join(map(regex.escape, longest_first))).finditer if longest_first else None

    def segments(self, text: str) -> Iterator[tuple[str, int | None]]:
        """(text, None) or (content, id) in order; empty texts are left out.

        A single-word token with a word character beside it stays text, and so does the whole of
        its match: no shorter token is tried there.
        """
        done = 0
        for m in self.find(text) if self.find else ():
            start, end = m.span()
            token = self.by_text[m[0]]
            if start < done or token.single_word and (start and WORD.match(text[start - 1]) or end < len(text) and WORD.match(text[end])):
                continue
            if token.lstrip and (blank := BLANK_END.search(text, done, start)):
                start = blank.start()
            if token.rstrip and (blank := BLANK.match(text, end)):
                end = blank.end()
            if start > done:
                yield text[done:start], None
            yield text[start:end], token.id
            done = end
        if done < len(text):
            yield text[done:], None


class AddedTokens:
    """Tokens matched in the raw text and those matched after normalization."""

    def __init__(self, tokens: Iterable[AddedToken], normalize: Callable[[str], str] = str):
        tokens = list(tokens)
        self.tokens = tokens
        self.raw = Matcher(t for t in tokens if not t.normalized)
        self.normalized = Matcher((t for t in tokens if t.normalized), normalize)
        self.text_of = {t.id: t.content for t in tokens}
        self.id_of = {t.content: t.id for t in tokens}
        self.special = frozenset(t.id for t in tokens if t.special)

    def __len__(self) -> int:
        return len(self.tokens)
