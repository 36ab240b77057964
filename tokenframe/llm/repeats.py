"""Repeated windows of a corpus, found through a content-defined difference cover.

The strings to compare are the windows of `span` units (bytes or words) of every document. A
difference cover is a set of sampled positions such that any two equal strings have a sampled
position at a common shift. Here the sample is the string synchronizing set of the corpus: the
sampled position of a window is that of its least `k`-unit substring (by hash, leftmost on ties)
among the `span - k + 1` that it holds. It depends on the window's content only, so equal windows
sample the same shift, and about 2 positions in `span - k + 2` are sampled instead of 2 in 3.

1. Sampled substrings of `k` units are named (by 64-bit hash) and sorted by name; names that occur
   once are dropped, and with them every window that they stand for.
2. The neighbourhood of each sampled position - the bytes of all windows which sample it - is
   named in turn, a name twice as long as the first. Equal neighbourhoods are one class: their
   windows are equal one by one, whatever the number of members.
3. Only one member of each class whose first name also heads another class remains. Its windows
   are named one by one and merged with those of the other classes under the name: in one place
   where the name has at most GATHERED classes; where it has more, by cells of CELL windows which
   are named and settled by class as in 2, and by a hash aggregation of what remains.
With `doubling` (word windows) the substrings are a quarter of the window, and each run of windows
that samples one is extended to twice the length inside all of its windows: to the right, or, for
windows that end too early, to the left. Only what repeats at the first length is looked up at
the second, and only what repeats there goes on to the full length.

4. Equal names are adjacent after the sort; each repeat is reported with its class's first place.

Every grouping is a hash aggregation with map-side combine or an equi-join that AQE may split; no
group of copies is collected. Windows are told apart by the 128 bits of two names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, claim, cut, texts_of

U = np.uint64
BLOCK = 1 << 19  # bytes that one round of array operations takes
GATHERED = 256  # members of different neighbourhood under one name that are compared in one place
CELL = 10  # windows that are compared together first where more are
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_powers = (np.ones(1, U), np.ones(1, U))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 2 * BLOCK)
        grown = []
        for b in (_BASE, _UNBASE):
            x = np.full(size, b, U)
            x[0] = 1
            grown.append(np.multiply.accumulate(x))
        _powers = (grown[0], grown[1])
    return _powers


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Hashes:
    """Hash of any range of a sequence of 64-bit values, by prefix sums modulo 2^64."""

    def __init__(self, values: np.ndarray):
        self.up, self.down = powers(len(values) + 1)
        self.prefix = np.zeros(len(values) + 1, U)
        np.cumsum(values * self.up[: len(values)], out=self.prefix[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.prefix[end] - self.prefix[start]) * self.down[start] + (end - start).astype(U))

    def all(self, k: int) -> np.ndarray:
        n = len(self.prefix) - k
        return mixed((self.prefix[k:] - self.prefix[:n]) * self.down[:n] + U(k))


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word (run of bytes other than ASCII white space, within its
    document), and the index of each document's first word."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    word = np.concatenate([[False], ~space, [False]])
    first = word[1:] & ~word[:-1]
    last = word[:-1] & ~word[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    cut_ = inner[word[inner] & word[inner + 1]]  # two documents meet inside a run
    first[cut_] = True
    last[cut_] = True
    start, end = np.flatnonzero(first[:-1]), np.flatnonzero(last)
    return start, end, np.searchsorted(start, offsets)


def word_values(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    start, end, at = words_of(data, offsets)
    if len(start) == 0:
        return np.zeros(0, U), at, start, end
    return Hashes(byte_values(data)).of(start, end), at, start, end


def sliding_least(v: np.ndarray, w: int) -> np.ndarray:
    n = len(v)
    whole = -(-n // w) * w
    padded = np.full(whole, np.iinfo(np.uint64).max, U)
    padded[:n] = v
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def runs(values: np.ndarray, at: np.ndarray, k: int, span: int, doubling: bool = False):
    """Runs of windows that sample the same position, in documents values[at[i]:at[i+1]]: arrays of
    document, first and last window start (in the document), first and second name; with `doubling`
    runs are parted by the side on which they are extended, and there are the name of twice the length and
    whether the run is the first of its position."""
    none = np.zeros(0, np.int64)
    nothing = (none, none, none, none.view(U), none.view(U), *((none.view(U), none.astype(bool)) if doubling else ()))
    if len(values) < span:
        return nothing
    h = Hashes(values)
    v = (h.all(k) & U(0xFFFFFFFF00000000)) | np.arange(len(values) - k + 1, dtype=U)
    sampled = (sliding_least(v, span - k + 1) & U(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(len(values) + 1, np.int32)
    long_ = np.flatnonzero(np.diff(at) >= span)
    np.add.at(inside, at[long_], 1)
    np.add.at(inside, at[long_ + 1] - span + 1, -1)
    p = np.flatnonzero(np.cumsum(inside)[: len(sampled)] > 0)
    if len(p) == 0:
        return nothing
    s = sampled[p]
    head = np.flatnonzero(np.diff(s, prepend=-1))
    tail = np.append(head[1:], len(p)) - 1
    lo, hi, s = p[head], p[tail], s[head]
    first = np.ones(len(s), bool)
    if doubling:  # windows that reach 2k units beyond the sampled position, and the others
        edge = s - (span - 2 * k)
        right, left = np.flatnonzero(hi >= edge), np.flatnonzero(lo < edge)
        longer = np.concatenate([mixed(h.of(s[right], s[right] + 2 * k) ^ U(1)), mixed(h.of(s[left] - k, s[left] + k) ^ U(2))])
        first = np.concatenate([np.ones(len(right), bool), hi[left] < edge[left]])
        lo, hi, s = np.concatenate([np.maximum(lo, edge)[right], lo[left]]), np.concatenate([hi[right], np.minimum(hi, edge - 1)[left]]), np.concatenate([s[right], s[left]])
    doc = np.searchsorted(at, lo, "right") - 1
    second = mixed(h.of(lo, hi + span) ^ mixed((s - lo).astype(U) << U(32) | (hi - lo).astype(U)))
    return doc, lo - at[doc], hi - at[doc], h.of(s, s + k), second, *((longer, first) if doubling else ())


def window_names(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and name of every window that starts in one of the ranges."""
    n = hi - lo + 1
    p = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    return p, Hashes(values).of(p, p + span)


def _cells(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, name: np.ndarray, many: np.ndarray, k: int, span: int):
    """First and last window, index of the range, name and wide name of each cell; a range that
    isn't `many` is one cell and keeps its name."""
    own = np.flatnonzero(many)
    if len(own) == 0:
        return lo, hi, np.arange(len(lo)), name, np.zeros(len(lo), U)
    h = Hashes(values)
    v = h.all(k) & U(0xFFFFFFFF00000000)
    rows = [(lo[i], hi[i], i, 0, 0) for i in np.flatnonzero(~many)]
    for i in own:
        s = lo[i] + int(np.argmin(v[lo[i] : lo[i] + span - k + 1]))
        for c in range((s - hi[i]) // CELL, (s - lo[i]) // CELL + 1):
            rows.append((max(lo[i], s - c * CELL - CELL + 1), min(hi[i], s - c * CELL), i, s, c))
    first, last, of, s, c = (np.array(x, np.int64) for x in zip(*rows, strict=True))
    title = name.view(U)[of] if len(name) else name
    split = many[of]
    start, end = np.where(split, s - c * CELL, 0), np.where(split, s - c * CELL - CELL + 1 + span, 0)
    core = mixed(h.of(start, end) ^ mixed(title + c.astype(U)))
    wide = mixed(h.of(first, last + span) ^ mixed((s - first).astype(U) << U(32) | (last - first).astype(U)))
    return first, last, of, np.where(split, core, title), wide


def _values(unit: str, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (byte_values(data), offsets) if unit == "byte" else word_values(data, offsets)[:2]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def sampled_runs(docs: DataFrame, unit: str, k: int, span: int, doubling: bool = False) -> DataFrame:
    """(id, lo, hi, name, wide) of all runs of windows, with `doubling` (longer, first) too; docs has
    (id, text)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(repeated)
        for batch in batches:
            data, offsets = texts_of(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j in blocks(offsets, BLOCK):
                own = offsets[i : j + 1]
                doc, lo, hi, name, wide, *more = runs(*_values(unit, data[own[0] : own[-1]], own - own[0]), k, span, doubling)
                columns = [pa.array(ids[i:j][doc], pa.int64()), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), _signed(name), _signed(wide)]
                if doubling:
                    columns += [_signed(more[0]), pa.array(more[1])]
                yield pa.RecordBatch.from_arrays(columns, ["id", "lo", "hi", "name", "wide", "longer", "first"][: len(columns)])

    return docs.select("id", "text").mapInArrow(scan, "id long, lo int, hi int, name long, wide long" + ", longer long, first boolean" * doubling)


def repeated(docs: DataFrame, unit: str, k: int, span: int, keep_first: bool, doubling: bool = False) -> DataFrame:
    """(id, spans array<struct<lo, hi>>): starts of the windows of `span` units which are repeats.

    With keep_first, a window is a repeat if an equal one starts earlier (less id, or same id and
    less start); else if an equal one starts anywhere else. docs: (id long, unique; text).
    With `doubling`, k is a quarter of span, and names double to half of it before windows compare.
    """
    scanned = sampled_runs(docs, unit, k, span, doubling)
    seen = F.count(F.when(F.col("first"), 1)) if doubling else F.count("*")  # positions that have the name
    names = cut(scanned.groupBy("name").agg(seen.alias("n")).where("n > 1").select(F.col("name").alias("name2")))
    found = scanned.join(names, F.col("name") == F.col("name2"), "left_semi")
    if doubling:
        found = cut(found.select("id", "lo", "hi", F.col("longer").alias("name"), "wide"))
        names = cut(found.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select(F.col("name").alias("name2")))
        found = found.join(names, F.col("name") == F.col("name2"), "left_semi")
    found = cut(found)
    place = F.struct("id", "lo", "hi")
    classes = cut(found.groupBy("name", "wide").agg(F.count("*").alias("n"), F.min(place).alias("first")))
    several = classes.groupBy(F.col("name").alias("name2")).agg(F.count("*").alias("k")).where("k > 1")
    ask = classes.join(several, F.col("name") == F.col("name2"))
    ask = ask.select("first.id", "first.lo", "first.hi", "name", (F.col("k") > GATHERED).alias("many"), (F.col("n") > 1).alias("settled"))
    asked = ask.groupBy(F.col("id").alias("id2")).agg(F.collect_list(F.struct("lo", "hi", "name", "many", "settled")).alias("ranges"))
    packed = docs.join(asked, F.col("id") == F.col("id2")).select("id", "text", "ranges")
    packed = cut(packed.mapInArrow(_windows(unit, k, span), "id long, lo int, name long, wide long, many boolean, settled boolean, xs array<long>"))
    few = packed.where("not many").groupBy("name").agg(F.collect_list(F.struct("id", "lo", "settled", "xs")).alias("reps"))
    hits = few.select("reps").mapInArrow(_equal_few(keep_first), "id long, lo int, hi int")
    hits = hits.union(_equal_many(packed.where("many").drop("many"), keep_first))

    members = classes.where("n > 1").select(F.col("name").alias("name2"), F.col("wide").alias("wide2"), "first")
    members = found.join(members, (F.col("name") == F.col("name2")) & (F.col("wide") == F.col("wide2")))
    if keep_first:
        members = members.where(place != F.col("first"))
    spans = hits.union(members.select("id", "lo", "hi"))
    return cut(spans.groupBy("id").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")))


def _equal_many(cells: DataFrame, keep_first: bool) -> DataFrame:
    """(id, lo, hi) of the repeats among windows whose name has any number of neighbourhoods.

    cells: a row for each few adjacent windows; name is of the units common to them, wide of all that
    they cover. What is equal as a whole is settled by class again, and only the first
    member of each class that shares its name with another is taken apart into windows.
    """
    place = F.struct("id", "lo")
    classes = cells.groupBy(F.col("name").alias("name2"), F.col("wide").alias("wide2")).agg(F.count("*").alias("n"), F.min(place).alias("first"))
    classes = cut(classes)
    several = classes.groupBy(F.col("name2").alias("name3")).agg(F.count("*").alias("k"))
    classes = classes.join(several, F.col("name2") == F.col("name3")).where("n > 1 or k > 1")
    cells = cut(cells.join(classes, (F.col("name") == F.col("name2")) & (F.col("wide") == F.col("wide2"))).select(*cells.columns, "n", "k", (place == F.col("first")).alias("is_first")))
    whole = cells.where("n > 1 and not is_first" if keep_first else "n > 1 and not settled")
    whole = whole.select("id", "lo", (F.col("lo") + F.size("xs") - 1).alias("hi"))
    windows = cells.where("k > 1 and is_first").select("id", "lo", "name", (F.col("settled") | (F.col("n") > 1)).alias("settled"), F.posexplode("xs").alias("i", "x"))
    windows = windows.select("id", (F.col("lo") + F.col("i")).alias("start"), "name", "settled", "x")
    at = F.struct("id", "start")
    equal = windows.groupBy(F.col("name").alias("name2"), F.col("x").alias("x2")).agg(F.count("*").alias("n"), F.min(at).alias("first")).where("n > 1")
    more = windows.join(equal, (F.col("name") == F.col("name2")) & (F.col("x") == F.col("x2")))
    more = more.where(at != F.col("first") if keep_first else ~F.col("settled"))
    return whole.union(more.select("id", F.col("start").alias("lo"), F.col("start").alias("hi")))


def _windows(unit: str, k: int, span: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The names of all windows in the ranges asked for: a row for each range, or where many compare a
    row for each cell of a grid of CELL window starts that is laid from the sampled position."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(repeated)
        for batch in batches:
            data, offsets = texts_of(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            ranges = batch.column(2)
            first = ranges.offsets.to_numpy()
            flat = ranges.values
            for i, j in blocks(offsets, BLOCK):
                own = offsets[i : j + 1]
                values, at = _values(unit, data[own[0] : own[-1]], own - own[0])
                part = flat.slice(first[i], first[j] - first[i])
                lo, hi = (part.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("lo", "hi"))
                doc = np.repeat(np.arange(j - i), np.diff(first[i : j + 1]))
                title, many, settled = (part.field(x).to_numpy(zero_copy_only=False) for x in ("name", "many", "settled"))
                lo, hi, of, title, wide = _cells(values, lo + at[doc], hi + at[doc], title, many, k, span)
                _, x = window_names(values, lo, hi, span)
                ends = np.concatenate([[0], np.cumsum(hi - lo + 1)]).astype(np.int32)
                xs = pa.ListArray.from_arrays(pa.array(ends), _signed(x))
                columns = [pa.array(ids[i:j][doc[of]], pa.int64()), pa.array((lo - at[doc[of]]).astype(np.int32)), _signed(title), _signed(wide), pa.array(many[of]), pa.array(settled[of]), xs]
                yield pa.RecordBatch.from_arrays(columns, ["id", "lo", "name", "wide", "many", "settled", "xs"])

    return name


def _equal_few(keep_first: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Repeats among the windows of the at most GATHERED members that each row holds."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(repeated)
        for batch in batches:
            groups = batch.column(0)
            per = np.diff(groups.offsets.to_numpy())
            reps = groups.flatten()
            if len(reps) == 0:
                continue
            id_, lo, settled, xs = (reps.field(x) for x in ("id", "lo", "settled", "xs"))
            n = np.diff(xs.offsets.to_numpy())
            x = xs.flatten().to_numpy(zero_copy_only=False)
            rep = np.repeat(np.arange(len(reps)), n)
            group = np.repeat(np.arange(len(groups)), per)[rep]
            ids = id_.to_numpy(zero_copy_only=False)[rep]
            start = lo.to_numpy(zero_copy_only=False)[rep].astype(np.int64) + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
            order = np.lexsort((start, ids, x, group))
            same = (x[order][1:] == x[order][:-1]) & (group[order][1:] == group[order][:-1])
            if keep_first:
                hit = order[1:][same]
            else:
                both = np.zeros(len(x), bool)
                both[order[1:][same]] = True
                both[order[:-1][same]] = True
                hit = np.flatnonzero(both & ~settled.to_numpy(zero_copy_only=False)[rep])
            hit = np.sort(hit)
            r, p = rep[hit], start[hit]
            head = np.flatnonzero((np.diff(r, prepend=-1) != 0) | (np.diff(p, prepend=-2) != 1))
            tail = np.append(head[1:], len(hit)) - 1 if len(hit) else head
            yield pa.RecordBatch.from_arrays([pa.array(ids[hit[head]], pa.int64()), pa.array(p[head].astype(np.int32)), pa.array(p[tail].astype(np.int32))], ["id", "lo", "hi"])

    return find


def covered(n: int, spans: list[dict] | None, span: int) -> np.ndarray:
    """Mask of the n units of a document that a window starting in the spans covers."""
    mark = np.zeros(n + 1, np.int32)
    if spans is not None and len(spans):
        lo = np.array([s["lo"] for s in spans])
        hi = np.array([s["hi"] for s in spans])
        np.add.at(mark, lo, 1)
        np.add.at(mark, hi + span, -1)
    return np.cumsum(mark[:n]) > 0


def with_spans(docs: DataFrame, spans: DataFrame, schema, apply: Callable) -> DataFrame:
    """docs (id, rest, text) joined with their spans; `apply` maps batches of (rest, text, spans)."""
    spans = spans.withColumnRenamed("id", "span_id")
    joined = docs.join(spans, F.col("id") == F.col("span_id"), "left").select("rest", "text", "spans")
    return joined.mapInArrow(apply, schema)
