"""Arrow UDFs over a tokenizer: for what built-in expressions can't say exactly.

A worker builds each specification's tokenizer once and keeps it; batches pass as Arrow arrays. Null
texts and null id lists give null. With `permissive`, a row whose text the model rejects gets null
ids and the message; otherwise it fails the query, as it fails a call of the reference behaviour.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import TokenizerError
from ..sources.spec import TokenizerSpec
from .batch import Lists, chunks, gather, in_chunks, list_array, rows_of
from .tokenizer import Tokenizer

IDS = pa.list_(pa.int32())
_built: dict[str, Tokenizer] = {}


def tokenizer_of(document: str) -> Tokenizer:
    """The tokenizer of a tokenizer.json text, one for each worker and document."""
    if document not in _built:
        _built[document] = Tokenizer(TokenizerSpec.from_json(document))
    return _built[document]


def _mapped(values: pa.Array, f: Callable) -> list:
    return [None if x is None else f(x) for x in values.to_pylist()]


def ids(text: Column, spec: TokenizerSpec, add_special_tokens: bool = True) -> Column:
    doc = spec.to_json()

    @F.arrow_udf("array<int>")
    def run(column: pa.Array) -> pa.Array:
        return ids_of(column, tokenizer_of(doc), add_special_tokens)

    return run(text)


def ids_of(column: pa.Array, t: Tokenizer, add_special_tokens: bool = True) -> pa.Array:
    """The ids of a batch of texts."""
    out = Lists()
    for part in chunks(column):
        offsets, found = t.content_lists(part.to_pylist())
        for template in t.templates if add_special_tokens else ():
            offsets, found = template.apply_all(offsets, found)
        out.add(offsets, found, np.asarray(part.is_null()))
    return out.array()


def ids_or_error(text: Column, spec: TokenizerSpec, add_special_tokens: bool = True) -> Column:
    """Struct (ids, error): one of them is null."""
    doc = spec.to_json()

    @F.arrow_udf("struct<ids:array<int>,error:string>")
    def run(column: pa.Array) -> pa.Array:
        t = tokenizer_of(doc)

        def of(part: pa.Array) -> pa.Array:
            got, said = [], []
            for x in part.to_pylist():
                try:
                    got.append(None if x is None else t.ids(x, add_special_tokens))
                    said.append(None)
                except TokenizerError as e:
                    got.append(None)
                    said.append(str(e))
            return pa.StructArray.from_arrays([pa.array(got, IDS), pa.array(said, pa.string())], ["ids", "error"])

        return in_chunks(column, of)

    return run(text)


def rejections(text: Column, spec: TokenizerSpec) -> Column:
    """The message of what the model rejects in each text, or null."""
    doc = spec.to_json()

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        t = tokenizer_of(doc)
        said = []
        for x in (x for part in chunks(column) for x in part.to_pylist()):
            try:
                said.append(None if x is None else t.validate(x))
            except TokenizerError as e:
                said.append(str(e))
        return pa.array(said, pa.string())

    return run(text)


def limited(text: Column, spec: TokenizerSpec, most: int, direction: str = "right") -> Column:
    """Struct (ids, truncated) of at most `most` ids of the content; all of the text is validated."""
    doc = spec.to_json()

    @F.arrow_udf("struct<ids:array<int>,truncated:boolean>")
    def run(column: pa.Array) -> pa.Array:
        return limits_of(column, tokenizer_of(doc), most, direction, False)

    return run(text)


def truncated(text: Column, spec: TokenizerSpec, add_special_tokens: bool = True) -> Column:
    """Struct (ids, truncated): truncated as the specification says, and post-processed."""
    doc = spec.to_json()

    @F.arrow_udf("struct<ids:array<int>,truncated:boolean>")
    def run(column: pa.Array) -> pa.Array:
        t = tokenizer_of(doc)
        return limits_of(column, t, t.room(add_special_tokens), t.spec.truncation.direction if t.spec.truncation else "right", add_special_tokens)

    return run(text)


def limits_of(column: pa.Array, t: Tokenizer, most: int | None, direction: str, add_special_tokens: bool) -> pa.Array:
    """At most `most` ids of each text of a batch, with the templates around them, and whether any were left out."""
    out, over = Lists(), []
    for part in chunks(column):
        offsets, found = t.content_lists(part.to_pylist())
        size = np.diff(offsets)
        kept = size if most is None else np.minimum(size, most)
        over.append(size > kept)
        found = gather(found, offsets[:-1] if direction == "right" else offsets[1:] - kept, kept)
        offsets = np.concatenate([[0], np.cumsum(kept)])
        for template in t.templates if add_special_tokens else ():
            offsets, found = template.apply_all(offsets, found)
        out.add(offsets, found, np.asarray(part.is_null()))
    over = np.concatenate(over) if over else np.zeros(0, bool)
    return pa.StructArray.from_arrays([out.array(), pa.array(over)], ["ids", "truncated"], mask=column.is_null())


def segments(text: Column, spec: TokenizerSpec) -> Column:
    """array<struct<text, token_id>>: normalized text and the added tokens in it."""
    return _listed(text, spec, "segments")


def pieces(text: Column, spec: TokenizerSpec) -> Column:
    """array<struct<text, token_id>>: what the model encodes, and the added tokens between."""
    return _listed(text, spec, "pieces")


def _listed(text: Column, spec: TokenizerSpec, method: str) -> Column:
    doc = spec.to_json()

    @F.arrow_udf("array<struct<text:string,token_id:int>>")
    def run(column: pa.Array) -> pa.Array:
        of = getattr(tokenizer_of(doc), method)
        return in_chunks(column, lambda part: pairs_of(part, of))

    return run(text)


def pairs_of(column: pa.Array, of: Callable[[str], list[tuple[str, int | None]]]) -> pa.Array:
    """array<struct<text, token_id>> of a batch of texts, column by column."""
    found, ends = [], [0]
    for x in column.to_pylist():
        if x:
            found += of(x)
        ends.append(len(found))
    said, own = zip(*found, strict=True) if found else ((), ())
    both = pa.StructArray.from_arrays([pa.array(said, pa.string()), pa.array(own, pa.int32())], ["text", "token_id"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), both, mask=column.is_null() if column.null_count else None)


def normalized(text: Column, spec: TokenizerSpec) -> Column:
    """The normalizer alone; the empty text stays empty whatever the rules."""
    doc = spec.to_json()

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        f = tokenizer_of(doc).normalize
        return in_chunks(column, lambda part: pa.array(_mapped(part, lambda x: f(x) if x else x), pa.string()))

    return run(text)


def pieces_ids(pieces: Column, spec: TokenizerSpec) -> Column:
    """ids of an array of pieces that Catalyst has split: the model alone."""
    doc = spec.to_json()

    @F.arrow_udf("array<int>")
    def run(column: pa.Array) -> pa.Array:
        out, slots = Lists(), tokenizer_of(doc).raw_slots
        for part in chunks(column):
            ends, flat, null = rows_of(part)
            words = flat.fill_null("").dictionary_encode()
            own, found = slots.lists(words.dictionary.to_pylist(), np.arange(1, len(words.dictionary) + 1))
            at = words.indices.to_numpy(zero_copy_only=False)
            size = np.diff(own)[at] if len(at) else np.zeros(0, np.int64)
            upto = np.concatenate([[0], np.cumsum(size)])
            out.add(np.concatenate([[0], upto[ends]]), gather(found, own[at], size), null)
        return out.array()

    return run(pieces)


def decoded(values: Column, spec: TokenizerSpec, skip_special_tokens: bool = False) -> Column:
    """The text of each id list; ids that nothing has are left out."""
    doc = spec.to_json()

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        return texts_of(column, tokenizer_of(doc), skip_special_tokens)

    return run(values)


def texts_of(column: pa.Array, t: Tokenizer, skip_special_tokens: bool = False) -> pa.Array:
    """The decoded texts of a batch of id lists."""
    table = t.byte_table(skip_special_tokens)
    if table is None:
        return in_chunks(column, lambda part: pa.array(_mapped(part, lambda x: t.decode(x, skip_special_tokens)), pa.string()))

    def run(part: pa.Array) -> pa.Array:
        ends, flat, null = rows_of(part)
        said = table.texts(ends, flat.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64))
        said = [t.decode(part[i].as_py() or (), skip_special_tokens) if x is None else x for i, x in enumerate(said)]
        return pa.array(said, pa.string(), mask=null)

    return in_chunks(column, run)


def decoded_tokens(values: Column, spec: TokenizerSpec) -> Column:
    """The decoder chain over token strings."""
    doc = spec.to_json()

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        t = tokenizer_of(doc)
        return in_chunks(column, lambda part: pa.array(_mapped(part, t.decode_tokens), pa.string()))

    return run(values)


def compatible(first: Column, second: Column, spec: TokenizerSpec) -> Column:
    """Whether two ids can stand side by side in the model's output."""
    doc = spec.to_json()

    @F.arrow_udf("boolean")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        f = tokenizer_of(doc).model.compatible
        return pa.array([None if x is None or y is None else f(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.bool_())

    return run(first, second)
