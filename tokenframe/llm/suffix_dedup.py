"""Removal of byte strings that occur more than once (suffix-array deduplication).

Which bytes go is decided by `repeats`: sampled substrings and then their neighbourhoods are named
by hash, at two fixed lengths, and windows of `span` bytes with equal names are grouped. There is no
recursion on names, no order of suffixes and no merge; the sample is a content-defined difference
cover in place of the positions that aren't multiples of three. The README says why.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, texts_of
from .repeats import covered, repeated, with_spans

SPAN, NAMED = 200, 101


def _removed(docs: DataFrame, span: int, named: int, fields: str, row: Callable) -> DataFrame:
    """rest of each row of docs (id, rest, text), and the fields that row(bytes, mask) gives."""
    spans = repeated(docs.select("id", "text"), "byte", named, span, keep_first=False)
    kinds = {"long": pa.int64(), "string": pa.string()}
    names, types = zip(*(f.split() for f in fields.split(", ")), strict=True)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = texts_of(batch.column(1))
            found = batch.column(2).to_pylist()
            rows = [row(own := data[at[i] : at[i + 1]], covered(len(own), found[i], span)) for i in range(len(at) - 1)]
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(c), kinds[t]) for c, t in zip(columns, types, strict=True)]], ["rest", *names])

    return with_spans(docs, spans, f"rest {docs.schema['rest'].dataType.simpleString()}, {fields}", apply)


def _measures(own: np.ndarray, gone: np.ndarray) -> tuple[int, int, int]:
    return len(own), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, named: int = NAMED) -> DataFrame:
    """id_col, text (what remains; bytes of a character that was cut apart are dropped), n_bytes,
    n_removed, n_spans. Every byte that a `span`-byte string covers which also starts anywhere else
    in the corpus goes. Null texts count as empty; texts under `span` bytes stay whole; repeated
    rows are documents of their own, so they remove each other."""

    def row(own: np.ndarray, gone: np.ndarray):
        return own[~gone].tobytes().decode("utf-8", "ignore"), *_measures(own, gone)

    own = numbered(docs.select(id_col, text_col), id_col, text_col)
    got = _removed(own, span, named, "text string, n_bytes long, n_removed long, n_spans long", row)
    return got.select(f"rest.{id_col}", F.col("text").alias(text_col), "n_bytes", "n_removed", "n_spans")


def rewrite(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, named: int = NAMED) -> DataFrame:
    """docs, all columns, with the text that `clean` leaves."""

    def row(own: np.ndarray, gone: np.ndarray):
        return (own[~gone].tobytes().decode("utf-8", "ignore"),)

    got = _removed(numbered(docs, id_col, text_col), span, named, "kept string", row)
    return got.select(*[F.col("kept").alias(c) if c == text_col else F.col(f"rest.`{c}`") for c in docs.columns])


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, named: int = NAMED) -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans, kept_sha256: `clean` with the remaining bytes' digest."""

    def row(own: np.ndarray, gone: np.ndarray):
        return *_measures(own, gone), hashlib.sha256(own[~gone].tobytes()).hexdigest()

    own = numbered(docs.select(id_col, text_col), id_col, text_col)
    got = _removed(own, span, named, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", row)
    return got.select(f"rest.{id_col}", "n_bytes", "n_removed", "n_spans", "kept_sha256")
