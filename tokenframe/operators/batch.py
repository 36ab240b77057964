"""Encoding and decoding of whole Arrow batches, in flat arrays.

A piece of text is encoded once and its ids are kept in one flat array, at a slot; a batch is a list
of slots, and its ids are gathered from that array at once. The slots are dropped when they are many, so a
worker's memory is bounded.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MOST_SLOTS, MOST_IDS = 1 << 18, 1 << 22
CHUNK = 1 << 20  # bytes of text, or items of lists, that are worked on at once


def gather(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[first[i] : first[i] + size[i]] of all i, one after another."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(first - (ends - size), size) + np.arange(total)]


class Slots:
    """The ids of pieces, by piece. Ids that stand for themselves are 1-tuples."""

    def __init__(self, encode_many: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.encode_many = encode_many
        self.forget()

    def forget(self) -> None:
        self.slot: dict[str | tuple[int], int] = {}
        self.first, self.size, self.values = array("q"), array("q"), array("q")

    def _add(self, pieces: list, ids: np.ndarray, size: np.ndarray) -> None:
        self.slot.update(zip(pieces, range(len(self.first), len(self.first) + len(pieces)), strict=True))
        self.first.frombytes((len(self.values) + np.cumsum(size) - size).astype(np.int64).tobytes())
        self.size.frombytes(size.astype(np.int64).tobytes())
        self.values.frombytes(ids.astype(np.int64).tobytes())

    def lists(self, pieces: list, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of rows whose pieces end at `ends`."""
        if len(self.slot) > MOST_SLOTS or len(self.values) > MOST_IDS:
            self.forget()
        new = list(set(pieces).difference(self.slot))
        single = [x for x in new if isinstance(x, tuple)]
        if single:
            new = [x for x in new if isinstance(x, str)]
            self._add(single, np.array([i for i, in single]), np.ones(len(single), np.int64))
        if new:
            self._add(new, *self.encode_many(new))
        slots = np.fromiter(map(self.slot.__getitem__, pieces), np.int64, len(pieces))
        first, size, values = (np.frombuffer(x, np.int64) if len(x) else np.zeros(0, np.int64) for x in (self.first, self.size, self.values))
        size = size[slots]
        ids = gather(values, first[slots], size)
        upto = np.concatenate([[0], np.cumsum(size)])
        return np.concatenate([[0], upto[ends]]), ids


def list_array(offsets: np.ndarray, ids: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """array<int>; rows of `null` have no list."""
    mask = pa.array(null) if null is not None and null.any() else None
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32, copy=False)), mask=mask)


def rows_of(column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The end of each row's items in the flat items of a list column, these, and which rows are null."""
    null = np.asarray(column.is_null())
    size = np.where(null, 0, np.diff(column.offsets.to_numpy()))
    return np.cumsum(size), column.flatten(), null


def chunks(column: pa.Array) -> Iterator[pa.Array]:
    """A batch in slices of about CHUNK: what is made of one slice goes before the next, so that a worker holds
    little beside the batch and its result, however many rows a batch has and however long they are."""
    if pa.types.is_list(column.type):
        upto, flat, _ = rows_of(column)
        if not pa.types.is_primitive(flat.type):
            upto = np.concatenate([[0], np.cumsum(_bytes_of(flat))])[upto] + upto
    else:
        upto = np.cumsum(_bytes_of(column))
    upto = upto + np.arange(1, len(column) + 1)
    cuts = np.searchsorted(upto, np.arange(CHUNK, upto[-1] if len(upto) else 0, CHUNK)) + 1
    ends = np.unique([0, *cuts.tolist(), len(column)]).tolist()
    yield from (column.slice(i, j - i) for i, j in zip(ends, ends[1:]))


def _bytes_of(texts: pa.Array) -> np.ndarray:
    return pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def in_chunks(column: pa.Array, f: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """f over the slices of a batch, put together."""
    parts = [f(x) for x in chunks(column)]
    return pa.concat_arrays(parts) if len(parts) > 1 else parts[0] if parts else f(column)


class Lists:
    """array<int> of a batch, put together slice by slice in one growing array."""

    def __init__(self):
        self.values, self.size, self.null = array("i"), [], []

    def add(self, offsets: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        self.values.frombytes(ids.astype(np.int32).view(np.uint8))
        self.size.append(np.diff(offsets))
        self.null.append(null)

    def array(self) -> pa.Array:
        size, null = (np.concatenate(x) if x else np.zeros(0, k) for x, k in ((self.size, np.int64), (self.null, bool)))
        return list_array(np.concatenate([[0], np.cumsum(size)]), np.frombuffer(self.values, np.int32) if len(self.values) else np.zeros(0, np.int32), null)


class ByteTable:
    """The bytes of every id, for decoders that only put bytes together. With `strict` a row whose bytes are no
    text comes out as None."""

    def __init__(self, spelled: dict[int, bytes], strict: bool = False):
        self.strict, self.spelled = strict, spelled
        n = max(spelled, default=-1) + 1
        self.size = np.zeros(n + 1, np.int64)  # the last is that of ids which nothing has
        for i, b in spelled.items():
            self.size[i] = len(b)
        self.first = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(spelled[i] for i in sorted(spelled)), np.uint8)

    def texts(self, ends: np.ndarray, ids: np.ndarray) -> list[str | None]:
        ids = np.where((ids >= 0) & (ids < len(self.size) - 1), ids, len(self.size) - 1)
        size = self.size[ids]
        raw = gather(self.data, self.first[ids], size).tobytes()
        upto = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], ends])].tolist()
        return [(_text if self.strict else _mended)(raw[i:j]) for i, j in zip(upto, upto[1:])]


def _mended(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


def _text(raw: bytes) -> str | None:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return None
