"""Column expressions for the stages that Catalyst can run itself.

Nothing here starts a Python worker. Splits mark the delimiters with a separator that the row's own
text doesn't hold (one of a few Unicode noncharacters) and split on it; the behaviours differ only in
where the separator goes. Patterns with matches of no width stay with the Arrow operators.
"""

from __future__ import annotations

import re
import re._parser as sre

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import PreTokenizerError
from .grammars import EXHAUSTIVE, GRAMMARS, for_java

SEPARATORS = [chr(c) for c in range(0xFDD0, 0xFDD8)]
OPEN, CLOSE = "\x02", "\x03"


def literal_pattern(text: str) -> str:
    """A Java pattern for exactly this text."""
    return "".join(f"\\x{{{ord(c):x}}}" if not c.isalnum() else c for c in text)


def literal_replacement(text: str) -> str:
    return text.replace("\\", "\\\\").replace("$", "\\$")


def has_width(pattern: str) -> bool:
    """Whether every match of the pattern has a character, and Java and Python read it alike: no
    look-behind, no back-reference."""
    plain = re.sub(r"\\[pP]\{[^}]*\}|&&\[\^?[^\]]*\]", "x", pattern)
    try:
        parsed = sre.parse(plain)
    except re.error:
        return False
    return parsed.getwidth()[0] > 0 and "(?<" not in pattern and not re.search(r"\\[1-9]", pattern)


def let(value: Column, f) -> Column:
    """f(value), where f may use its argument more than once."""
    return F.transform(F.array(value), f).getItem(0)


def separator(text: Column) -> Column:
    """A separator that the text doesn't hold."""
    return F.coalesce(*[F.when(~F.contains(text, F.lit(s)), F.lit(s)) for s in SEPARATORS], F.raise_error(F.lit("the text holds all separators")).cast("string"))


def not_empty(pieces: Column) -> Column:
    return F.filter(pieces, lambda p: p != "")


def split(text: Column, pattern: str, behavior: str, invert: bool = False, literal: bool = False) -> Column:
    """array<string>: the pieces of text around the matches of a pattern, under a split behaviour.

    An empty literal matches nothing. Null gives null, the empty text no pieces.
    """
    java = literal_pattern(pattern) if literal else for_java(pattern)
    if behavior not in ("Removed", "Isolated", "MergedWithPrevious", "MergedWithNext", "Contiguous"):
        raise PreTokenizerError(f"unknown split behavior {behavior}")
    if literal and not pattern:
        return not_empty(F.array(text)) if not (behavior == "Removed" and invert) else F.filter(F.array(text), lambda _: F.lit(False))
    if behavior == "Removed" and invert:
        return not_empty(F.regexp_extract_all(text, F.lit(java), F.lit(0)))
    if invert:
        behavior = {"MergedWithPrevious": "MergedWithNext", "MergedWithNext": "MergedWithPrevious"}.get(behavior, behavior)
        if behavior.startswith("Merged"):
            return _merged_gaps(text, java, behavior)

    def around(sep: Column) -> Column:
        put = {"Removed": sep, "Isolated": F.concat(sep, F.lit("$0"), sep), "Contiguous": F.concat(sep, F.lit("$0"), sep), "MergedWithPrevious": F.concat(F.lit("$0"), sep), "MergedWithNext": F.concat(sep, F.lit("$0"))}[behavior]
        marked = F.regexp_replace(text, F.lit(java), put)
        if behavior == "Contiguous":
            marked = F.replace(marked, F.concat(sep, sep), F.lit(""))
        return not_empty(F.split(marked, sep))

    return F.when(text.isNotNull(), let(separator(text), around))


def _merged_gaps(text: Column, java: str, behavior: str) -> Column:
    """Merging where the gaps are the delimiters: a gap joins the match before it (or after it, with
    MergedWithPrevious swapped), so the separator goes on the matches' other side."""

    def around(sep: Column) -> Column:
        put = F.concat(sep, F.lit("$0")) if behavior == "MergedWithNext" else F.concat(F.lit("$0"), sep)
        return not_empty(F.split(F.regexp_replace(text, F.lit(java), put), sep))

    return F.when(text.isNotNull(), let(separator(text), around))


def grammar(text: Column, name: str) -> Column:
    """array<string>: the pieces of one of the named grammars, delimiters isolated."""
    pattern = GRAMMARS[name]
    return F.regexp_extract_all(text, F.lit(for_java(pattern)), F.lit(0)) if name in EXHAUSTIVE else split(text, pattern, "Isolated")


def whitespace_split(text: Column) -> Column:
    return not_empty(F.split(text, F.lit(r"(?U)\s+")))


def whitespace_free(text: Column) -> Column:
    """array<string>: runs of white space and of other characters; joined they are the text again."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\s+|\S+"), F.lit(0))


def each(pieces: Column, f) -> Column:
    """f over each piece, flattened: a further pre-tokenizer of a sequence."""
    return F.flatten(F.transform(pieces, f))


def metaspace(text: Column, mark: str = "▁", scheme: str = "always", parts: bool = True) -> Column:
    marked = F.replace(text, F.lit(" "), F.lit(mark))
    if scheme == "always":
        marked = F.when(F.startswith(marked, F.lit(mark)), marked).otherwise(F.concat(F.lit(mark), marked))
    q = literal_pattern(mark)
    return F.regexp_extract_all(marked, F.lit(f"{q}[^{q}]*|[^{q}]+"), F.lit(0)) if parts else F.array(marked)


def byte_hex(piece: Column) -> Column:
    """Two hex digits for each UTF-8 byte: the symbols of byte-level models."""
    return F.hex(F.encode(piece, "UTF-8"))


def replace_literal(text: Column, needle: str, content: str) -> Column:
    """All occurrences, left to right; an empty needle stands between all characters and at both ends."""
    if needle:
        return F.replace(text, F.lit(needle), F.lit(content))
    chars = not_empty(F.split(text, F.lit("")))
    return F.concat(F.lit(content), F.array_join(F.transform(chars, lambda c: F.concat(c, F.lit(content))), ""))


def replace_regex(text: Column, pattern: str, content: str) -> Column:
    """All matches; the content is literal, whatever `$` or `\\` it holds."""
    return F.regexp_replace(text, F.lit(for_java(pattern)), F.lit(literal_replacement(content)))


def segments(text: Column, tokens: dict[str, int]) -> Column:
    """array<struct<text, token_id>>: text around added tokens that have no flags, leftmost-longest."""
    ids = F.create_map(*[F.lit(x) for t, i in tokens.items() for x in (t, i)])
    either = "|".join(literal_pattern(t) for t in sorted(tokens, key=lambda t: (-len(t), t)))
    parts = lambda sep: not_empty(F.split(F.regexp_replace(text, F.lit(either), F.concat(sep, F.lit("$0"), sep)), sep))
    return F.transform(let(separator(text), parts), lambda p: F.struct(p.alias("text"), F.element_at(ids, p).cast("int").alias("token_id")))


def is_rank_topological(merges: list[tuple[str, str]]) -> bool:
    """Whether folding over the merges in order equals merging by least rank: no pair occurs twice,
    and each operand that a merge makes is made before it is used."""
    made: dict[str, int] = {}
    for r, (a, b) in enumerate(merges):
        made.setdefault(a + b, r)
    ranks = {pair: r for r, pair in enumerate(merges)}
    return len(ranks) == len(merges) and len({a + b for a, b in merges}) == len(merges) and all(made.get(t, -1) < r for r, pair in enumerate(merges) for t in pair)


def bpe_fold(symbols: Column, merges: list[tuple[str, str]]) -> Column:
    """array<string>: the tokens of an array of symbols, by one pass over a short, rank-topological
    list of merges. A pass replaces from the left, as merging does on ties."""
    table = F.array(*[F.struct(F.lit(f"{OPEN}{a}{CLOSE}{OPEN}{b}{CLOSE}").alias("pair"), F.lit(f"{OPEN}{a}{b}{CLOSE}").alias("one")) for a, b in merges])
    wrapped = F.array_join(F.transform(symbols, lambda s: F.concat(F.lit(OPEN), s, F.lit(CLOSE))), "")
    merged = F.aggregate(table, wrapped, lambda text, m: F.replace(text, m["pair"], m["one"])) if merges else wrapped
    return F.filter(F.split(F.translate(merged, OPEN, ""), CLOSE), lambda t: t != "")


def bpe_fold_pieces(pieces: Column, merges: list[tuple[str, str]]) -> Column:
    """array<string>: the tokens, in hex, of the bytes of several pieces, by one pass over the merges for all of them.
    merges: pairs of bytes in hex, short and rank-topological as for bpe_fold. A byte is a character of
    latin-1 and each merge has a character behind them, so that a merge replaces two characters by one; a
    last one keeps the pieces apart."""
    code = {f"{b:02X}": b for b in range(256)} | {a + b: 256 + r for r, (a, b) in enumerate(merges)}
    apart = chr(256 + len(merges))
    text = F.array_join(F.transform(pieces, lambda p: F.decode(F.encode(p, "UTF-8"), "ISO-8859-1")), apart)
    table = F.array(*[F.struct(F.lit(chr(code[a]) + chr(code[b])).alias("pair"), F.lit(chr(code[a + b])).alias("one")) for a, b in merges])
    merged = F.aggregate(table, text, lambda t, m: F.replace(t, m["pair"], m["one"])) if merges else text
    names = F.array(*[F.lit(t) for t in code])
    return F.transform(not_empty(F.split(F.replace(merged, F.lit(apart), F.lit("")), F.lit(""))), lambda c: F.get(names, F.ascii(c)))


def template(ids: Column, parts) -> Column:
    """ids with the template's special ids around them; None stands for the content."""
    return F.concat(*[ids if p is None else F.array(*[F.lit(i) for i in p]).cast("array<int>") for p in parts if p is None or p]) if any(p is None or p for p in parts) else F.slice(ids, 1, 0)


def limit(ids: Column, most: Column | int, direction: str = "right") -> Column:
    """The first `most` ids, or with direction "left" the last ones."""
    most = F.lit(most) if isinstance(most, int) else most
    return F.slice(ids, F.lit(1), most) if direction == "right" else F.slice(ids, F.greatest(F.size(ids) - most, F.lit(0)) + 1, most)


def pad_target(size: Column, longest: Column | int | None, multiple: int | None = None) -> Column:
    """Length of the padded row: never under its own, rounded up to a multiple."""
    target = F.greatest(size, longest if isinstance(longest, Column) else F.lit(longest)) if longest is not None else size
    return (F.ceil(target / multiple) * multiple).cast("int") if multiple else target


def padded(values: Column, target: Column, value: int, direction: str = "right") -> Column:
    fill = F.array_repeat(F.lit(value).cast("int"), target - F.size(values))
    return F.concat(values, fill) if direction == "right" else F.concat(fill, values)


def encoding(ids: Column, truncated: Column) -> Column:
    """Struct of ids and the parallel lists: attention 1, type 0, special mask 0 for every id."""
    same = lambda v: F.array_repeat(F.lit(v), F.size(ids))
    return F.struct(ids.alias("ids"), same(1).alias("attention_mask"), same(0).alias("type_ids"), same(0).alias("special_tokens_mask"), F.lit(1).alias("n_sequences"), truncated.alias("truncated"))


def pad_encoding(e: Column, target: Column, direction: str = "right", pad_id: int = 0, pad_type_id: int = 0) -> Column:
    put = lambda name, value: padded(e[name], target, value, direction).alias(name)
    return F.struct(put("ids", pad_id), put("attention_mask", 0), put("type_ids", pad_type_id), put("special_tokens_mask", 0), e["n_sequences"].alias("n_sequences"), e["truncated"].alias("truncated"))


def metaspace_decode(tokens: Column, mark: str = "▁", scheme: str = "always") -> Column:
    """Marks become spaces; those of the first token go, unless the scheme is never."""
    head = F.lit("" if scheme != "never" else " ")
    return F.array_join(F.transform(tokens, lambda t, i: F.replace(t, F.lit(mark), F.when(i == 0, head).otherwise(F.lit(" ")))), "")
