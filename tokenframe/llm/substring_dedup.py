"""Removal of repeated word windows by level-wise doubling.

The first level names substrings of a quarter of the final length (5 words), at the positions that
`repeats` samples: two or so in each window, the same in equal windows. Those that occur once end there.
The survivors are extended to twice the length (10 words) inside their windows; those whose extension
occurs once end in turn, and only what is left is compared at the full length (20 words). What
repeats at that length is removed but for its first occurrence.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, texts_of
from .repeats import covered, repeated, with_spans

WINDOW = 20


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """id_col, text (kept words joined by one space), n_words, n_removed, kept_sha256.

    Words are runs of characters other than ASCII white space, unchanged. A word goes if a window of
    `window` words covers it whose words also start earlier: in a document of lesser id, or before
    in the same one. Null texts have no words, shorter texts stay whole. Rows that repeat an id
    are documents in the order of their texts' hashes; null ids come first.
    """
    own = numbered(docs.select(id_col, text_col), id_col, text_col)
    doubling = window >= 4
    spans = repeated(own.select("id", "text"), "word", window // 4 if doubling else 1, window, keep_first=True, doubling=doubling)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = texts_of(batch.column(1))
            found = batch.column(2).to_pylist()
            rows = []
            for i in range(len(at) - 1):
                words = data[at[i] : at[i + 1]].tobytes().split()
                if found[i]:
                    gone = covered(len(words), found[i], window)
                    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                else:
                    kept = words
                said = b" ".join(kept)
                rows.append((said.decode(), len(words), len(words) - len(kept), hashlib.sha256(said).hexdigest()))
            text, n, gone, sha = (list(c) for c in zip(*rows, strict=True)) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], ["rest", "text", "n_words", "n_removed", "kept_sha256"])

    kind = own.schema["rest"].dataType.simpleString()
    got = with_spans(own, spans, f"rest {kind}, text string, n_words long, n_removed long, kept_sha256 string", apply)
    return got.select(f"rest.{id_col}", F.col("text").alias(text_col), "n_words", "n_removed", "kept_sha256")


def digest(docs: DataFrame, **options) -> DataFrame:
    """`clean` without the text."""
    return clean(docs, **options).drop("text")
