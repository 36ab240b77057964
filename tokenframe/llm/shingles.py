"""Near-duplicates by SimHash and positional bytes, verified on whole sets of five-word shingles.

A text has FPS fingerprints of 64 bits. As in op3 the inverted index keys a fingerprint by sets of its
byte positions with their values, here by every TALLY of them: exactly the pairs whose tally of
shared positional bytes reaches TALLY in one fingerprint meet in a list. Those that differ in at most
BITS bits of this fingerprint and the next two are candidates, each verified on the whole sets (Jaccard
of 0.8 or more). At a likeness of 0.8 a bit differs with a chance of 0.15, and a pair is no candidate
with a chance of 0.0002. No candidate is left out, unless its two texts are already in one component,
or, where many texts stay apart in one list, unless sketches of 4,096 bits differ in more than APART.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import claim, cut, texts_of
from .components import connected_components

WIDTH, FPS, TALLY, BITS = 5, 8, 2, 40
POSITIONS = list(combinations(range(8), TALLY))
ROUND = 2  # fingerprints indexed at once
SMALL, GAIN, LONG, CHUNK, HEADS, BATCH = 8, 10, 256, 1 << 16, 8, 4096
SKETCH, APART = 4096, 725
_rng = np.random.default_rng(42)
XORS, ODDS = _rng.integers(0, 1 << 64, (2, SKETCH // 8), np.uint64) | np.array([[0], [1]], np.uint64)


def shingles(text: bytes) -> np.ndarray:
    """The distinct XXH64 of a text's runs of five words, ascending; words as in simhash."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    runs = zip(*(words[i:] for i in range(WIDTH)), strict=False) if len(words) > WIDTH else [words]
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(x), 42) for x in runs], np.uint64))


def simhash(hashes: np.ndarray, bits: int) -> bytes:
    """The SimHash of a set: each bit is the sign of the sum of its shingles' votes, which are bytes of
    their remixed hashes; votes of one size would tie in short texts."""
    total = np.zeros(bits, np.int64)
    for i in range(0, len(hashes), 1024):
        mixed = (hashes[i : i + 1024, None] ^ XORS[: bits // 8]) * ODDS[: bits // 8]
        total += (mixed ^ mixed >> np.uint64(32)).view(np.int8).sum(axis=0, dtype=np.int32)
    return np.packbits(2 * total + len(hashes) > 0).tobytes()


def sketches(hashes: Column) -> Column:
    @F.arrow_udf("binary")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([simhash(x.values.to_numpy(zero_copy_only=False).view(np.uint64), SKETCH) for x in column], pa.binary())

    return run(hashes)


def _each(column: pa.Array) -> Iterator[np.ndarray]:
    claim(shingles)
    data, at = texts_of(column)
    whole = data.tobytes()
    return (shingles(whole[at[i] : at[i + 1]]) for i in range(len(at) - 1))


def marks(text: Column) -> Column:
    """own: 128-bit hash of the shingle set; fps: its fingerprints."""

    @F.arrow_udf("own binary, fps binary")
    def run(column: pa.Array) -> pa.Array:
        own, fps = [], []
        for h in _each(column):
            own.append(xxhash.xxh128_digest(h.tobytes()))
            fps.append(simhash(h, 64 * FPS))
        return pa.StructArray.from_arrays([pa.array(own, pa.binary()), pa.array(fps, pa.binary())], ["own", "fps"])

    return run(text)


def sets(text: Column) -> Column:
    @F.arrow_udf("array<long>")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([h.view(np.int64) for h in _each(column)], pa.list_(pa.int64()))

    return run(text)


def _key(words: np.ndarray, table: int) -> np.ndarray:
    """The bytes of fingerprints that a table is keyed by."""
    octets = np.ascontiguousarray(words).view(np.uint8).reshape(-1, 8)
    return sum(octets[:, p].astype(np.uint16) << 8 * i for i, p in enumerate(reversed(POSITIONS[table % len(POSITIONS)])))


def _first(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least table in which rows of fingerprints meet; they meet in one."""
    same = (np.ascontiguousarray(a).view(np.uint8) == np.ascontiguousarray(b).view(np.uint8)).reshape(*a.shape, 8)
    place = np.full((8, 8), -1)
    for i, p in enumerate(POSITIONS):
        place[p] = i
    fp = (same.sum(axis=2) >= TALLY).argmax(axis=1)
    own = same[np.arange(len(a)), fp]
    low = own.argmax(axis=1)
    own[np.arange(len(a)), low] = False
    return fp * len(POSITIONS) + place[low, own.argmax(axis=1)]


def _entry(width: int) -> np.dtype:
    return np.dtype([("id", "<i8"), ("comp", "<i8"), ("w", "<u8", (width,))])


def _post(nodes: DataFrame, fps: range, wide: bool) -> DataFrame:
    """Packed entries of nodes (id, comp, words) for each table and value of its key's first bits.

    Nodes are gathered in parts of BATCH, and the fewer there are the fewer bits tell packs apart, so that the
    packs are few however many partitions hold the nodes.
    """
    n, spark = nodes.count(), nodes.sparkSession
    bits = min(6, max(0, (n >> 10).bit_length()))
    nodes = nodes.coalesce(max(spark.sparkContext.defaultParallelism, n // BATCH + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            words = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u8").reshape(batch.num_rows, -1)
            for fp in fps:
                own = words if wide else words[:, [fp, (fp + 1) % FPS, (fp + 2) % FPS]]
                entries = np.empty(len(own), _entry(own.shape[1]))
                entries["id"], entries["comp"], entries["w"] = batch.column(0).to_numpy(), batch.column(1).to_numpy(), own
                for table in range(fp * len(POSITIONS), (fp + 1) * len(POSITIONS)):
                    first = (_key(words[:, fp], table) >> 16 - bits).astype(np.uint8)
                    order = np.argsort(first, kind="stable")
                    heads, n = np.unique(first, return_counts=True)
                    ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32) * entries.itemsize
                    packed = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(entries[order].tobytes())])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), table, np.int32)), pa.array(heads.astype(np.int32)), packed], ["table", "head", "entries"])

    spread = nodes.select("id", "comp", "words").mapInArrow(run, "table int, head int, entries binary")
    return spread.repartition("table", "head").sortWithinPartitions("table", "head")


def _graph(w: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows of short lists within BITS bits, and each row's component over all such pairs."""
    starts = np.concatenate([[0], ends[:-1]])
    size = ends - starts
    last = np.repeat(np.where(size <= LONG, ends, starts), size)  # the end of an entry's list; none for a long one
    found, at = [], np.arange(len(w))
    step = 1
    while len(at := at[at + step < last[at]]):
        near = at[np.bitwise_count(w[at] ^ w[at + step]).sum(axis=1) <= BITS]
        found.append((near, near + step))
        step += 1
    i, j = (np.concatenate([x[k] for x in found] or [np.zeros(0, np.int64)]) for k in range(2))
    root = np.arange(len(w))
    while len(i) and (root[i] != root[j]).any():
        low = np.minimum(root[i], root[j])
        for x in (i, j):
            np.minimum.at(root, root[x], low)
            np.minimum.at(root, x, low)
        while (root[root] != root).any():
            root = root[root]
    for k in np.flatnonzero(size > LONG):
        left = np.arange(starts[k], ends[k])
        while len(left):
            seed, front, left = left[0], [left[0]], left[1:]
            while front and len(left):
                near = np.bitwise_count(w[left] ^ w[front.pop()]).sum(axis=1) <= BITS
                root[left[near]] = seed
                front.extend(left[near].tolist())
                left = left[~near]
    return i, j, root


def _some(e: np.ndarray, ends: np.ndarray, table: int, turn: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All candidates of the small components of lists; a pivot's of the others, whose entries are open."""
    fp, w = table // len(POSITIONS), np.ascontiguousarray(e["w"])
    wide = w.shape[1] > 3
    near = w[:, [fp, (fp + 1) % FPS, (fp + 2) % FPS]] if wide else w
    i, j, root = _graph(near, ends)
    n = np.bincount(root, minlength=len(e))
    ids, comp, own = e["id"], e["comp"], near[:, :1]

    def pairs(i: np.ndarray, j: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k = comp[i] != comp[j]
        if wide:
            k &= np.bitwise_count(w[i] ^ w[j]).sum(axis=1) <= APART
        i, j = i[k], j[k]
        k = _first(own[i], own[j]) == table % len(POSITIONS)
        return ids[i[k]], ids[j[k]], more

    k = n[root[i]] <= SMALL
    yield pairs(i[k], j[k], ids[:0])
    for r in np.flatnonzero(n > SMALL):
        at = np.flatnonzero(root == r)
        if (comp[at] != comp[r]).any():
            head = at[np.argmin((ids[at].view(np.uint64) ^ XORS[turn % len(XORS)]) * ODDS[turn % len(ODDS)])]
            tried = at if wide or fp == 0 else at[:0]  # without sketches one fingerprint's are enough
            yield pairs(np.full(len(tried), head), tried, ids[at])


def _every(e: np.ndarray, ends: np.ndarray, table: int, turn: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All candidates of different components whose sketches agree, in the first table they meet in."""
    ids, comp, w = e["id"], e["comp"], np.ascontiguousarray(e["w"])
    for i, end in enumerate(np.repeat(ends, np.diff(ends, prepend=0))):
        at = i + 1 + np.flatnonzero(comp[i + 1 : end] != comp[i])
        at = at[np.bitwise_count(w[at] ^ w[i]).sum(axis=1) <= APART]
        if len(at):
            at = at[_first(w[at, :FPS], np.repeat(w[i : i + 1, :FPS], len(at), axis=0)) == table]
            yield np.full(len(at), ids[i]), ids[at], ids[:0]


def _candidates(nodes: DataFrame, turn: int, every: bool) -> tuple[DataFrame, DataFrame]:
    """(a, b), a < b: candidates of different components; (id): open nodes, which have more in some list.

    A task hands on its open nodes in HEADS arrays.
    """
    wide = turn > 0
    entry = _entry(SKETCH // 64 if wide else 3)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("open", pa.list_(pa.int64()))])

    def found(table: int, parts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        e = np.frombuffer(b"".join(parts), entry)
        key = _key(e["w"][:, table // len(POSITIONS) if wide else 0], table)
        order = np.argsort(key, kind="stable")
        e, key = e[order], key[order]
        ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(e))
        return (_every if every else _some)(e, ends, table, turn)

    def flushed(got: list[np.ndarray], more: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if got:
            a, b = np.unique(np.concatenate(got), axis=0).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), schema.field(2).type)], schema=schema)
        if more:
            ids = np.unique(np.concatenate(more))
            heads = np.unique(ids % HEADS)
            yield pa.RecordBatch.from_arrays([pa.array(heads), pa.nulls(len(heads), pa.int64()), pa.array([ids[ids % HEADS == h] for h in heads], schema.field(2).type)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, more, n, last, parts = [], [], 0, None, []

        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)
            yield None, None, None

        for table, head, entries in rows():
            if last is not None and (table, head) != last:
                for a, b, others in found(last[0], parts):
                    got.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1))
                    more.append(others)
                    n += len(a) + len(others)
                    if n >= CHUNK:
                        yield from flushed(got, more)
                        got, more, n = [], [], 0
                parts = []
            last = (table, head)
            parts.append(entries)
        yield from flushed(got, more)

    out = None
    for fp in range(0, FPS, ROUND):
        part = cut(_post(nodes, range(fp, min(fp + ROUND, FPS)), wide).mapInArrow(run, "a long, b long, open array<long>"))
        out = part if out is None else out.union(part)
    pairs = cut(out.where("open is null").select("a", "b").distinct())
    more = out.where("open is not null").groupBy("a").agg(F.array_distinct(F.flatten(F.collect_list("open"))).alias("ids"))
    return pairs, cut(more.select(F.explode("ids").alias("id")))


def _alike(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """Pairs whose shingle sets have a likeness of 0.8 or more, in whole numbers."""
    right = pairs.join(whole.select(F.col("id").alias("b"), F.col("h").alias("hb")), "b")
    both = right.join(whole.select(F.col("id").alias("a"), F.col("h").alias("ha")), "a")
    common, total = F.size(F.array_intersect("ha", "hb")), F.size("ha") + F.size("hb")
    near = 5 * F.least(F.size("ha"), F.size("hb")) >= 4 * F.greatest(F.size("ha"), F.size("hb"))
    return both.where(near).where(9 * common >= 4 * total).select("a", "b")


def leaders(docs: DataFrame) -> DataFrame:
    """The least id of each component of docs (id long, unique; text), links at a likeness of 0.8.

    Texts of one shingle set are one node. Candidates that hang together in a list are all formed
    while they are few; where they are many, a pivot's are, again with other pivots while a turn links
    a tenth of its texts, and at last those of all texts that are still apart. Wordless texts are alike.
    """
    marked = docs.select("id", marks(F.col("text")).alias("m")).select("id", "m.own", "m.fps")
    nodes = cut(marked.groupBy("own").agg(F.min("id").alias("id"), F.first("fps").alias("words")))
    ids = nodes.select("id")
    nodes, whole, roots, turn, every = nodes.withColumn("comp", F.col("id")), None, None, 0, False
    while True:
        pairs, open_ = _candidates(nodes, turn, every)
        if whole is None:
            near = pairs.select(F.explode(F.array("a", "b")).alias("id")).union(open_).distinct()
            whole = cut(docs.join(near, "id", "left_semi").select("id", sets(F.col("text")).alias("h")))
        found = cut(_alike(pairs, whole))
        gain = found.count()
        if gain:
            roots = cut(connected_components(found if roots is None else found.union(roots.select("node", "root"))))
        n = open_.count()
        if every or not n:
            break
        turn, every = turn + 1, GAIN * gain < n
        own = nodes.select("id", "words").join(open_, "id", "left_semi")
        if turn == 1:
            own = whole.join(open_, "id", "left_semi").select("id", sketches(F.col("h")).alias("words"))
        own = own.withColumn("comp", F.col("id")) if roots is None else own.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("root", "id"))
        nodes = cut(own.select("id", "words", "comp"))
    if roots is None:
        return ids
    return ids.join(roots.where("node <> root").select(F.col("node").alias("id")), "id", "left_anti")
