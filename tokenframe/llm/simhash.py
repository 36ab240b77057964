"""SimHash near-duplicates by a positional byte index with count filtering.

Two 64-bit fingerprints at d <= 2 differing bits differ in at most two of their eight bytes, so at
least six positional bytes agree. The inverted index keys each distinct fingerprint by every set of
six byte positions with their values: exactly the pairs whose tally of shared positional bytes
reaches the guaranteed minimum of six meet in a posting list, and no other pair is formed. A list
holds distinct fingerprints that differ in two bytes only, so it has 65,536 entries at most at any
size of corpus. Each list is verified on exact bit counts and handed on as a spanning forest of
its links, never as all pairs.
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

BYTES, BITS = 8, 2
BIT_TABLE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: bytes, width: int = 3) -> int:
    """The SimHash of a text: bit set when over half of its shingles' XXH64 (seed 42) have it.

    A-Z is lower-cased; words are runs of bytes other than ASCII white space. A text of fewer
    words than `width` is one shingle; a text without words has fingerprint 0. Repeated shingles
    count as often as they occur.
    """
    words = text.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        h = [digest(b" ".join(words), 42)]
    else:
        h = [digest(b" ".join(x), 42) for x in zip(*(words[i:] for i in range(width)), strict=False)]
    octets = np.array(h, ">u8").view(np.uint8).reshape(-1, BYTES)
    ones = np.concatenate([np.bincount(octets[:, i], minlength=256) @ BIT_TABLE for i in range(BYTES)])
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(text: Column, width: int = 3) -> Column:
    """Signed 64-bit SimHash column; null counts as an empty text."""

    @F.arrow_udf("long")
    def run(column: pa.Array) -> pa.Array:
        claim(fingerprint)
        data, at = texts_of(column)
        whole = data.tobytes()
        return pa.array(np.array([fingerprint(whole[at[i] : at[i + 1]], width) for i in range(len(at) - 1)], np.uint64).view(np.int64))

    return run(text)


def _roots(fps: np.ndarray, bits: int) -> np.ndarray:
    """For each of the distinct fingerprints the least index it is linked to, by flipping the bits
    in which they may differ and looking the result up: the work grows with the list's length."""
    fps = np.sort(fps)
    parent = np.arange(len(fps))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    if len(fps) <= 64:
        i, j = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= bits, 1))
        found = [(i, j)]
    else:
        free = np.bitwise_or.reduce(fps ^ fps[0])
        ones = [np.uint64(1 << b) for b in range(64) if int(free) >> b & 1]
        found = []
        for r in range(1, bits + 1):
            for flip in combinations(ones, r):
                to = fps ^ np.bitwise_or.reduce(np.array(flip, np.uint64))
                at = np.minimum(np.searchsorted(fps, to), len(fps) - 1)
                i = np.flatnonzero((fps[at] == to) & (fps < to))
                found.append((i, at[i]))
    for i, j in found:
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    return fps, np.array([find(i) for i in range(len(fps))])


def links(distinct: DataFrame, bits: int = BITS) -> DataFrame:
    """Edges (a, b) that connect all fingerprints `fp` (distinct) within `bits` bits of each other."""
    sets = list(combinations(range(BYTES), BYTES - bits))
    masks = [sum(0xFF << 8 * p for p in s) for s in sets]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(i).cast("byte").alias("positions"), F.col("fp").bitwiseAND(F.lit(m)).alias("octets")) for i, m in enumerate(signed)])
    wide = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # small rows, but each becomes many
    lists = (
        distinct.repartition(wide, "fp").select("fp", F.explode(keys).alias("k"))
        .groupBy("k.positions", "k.octets")
        .agg(F.collect_list("fp").alias("fps"))
        .where(F.size("fps") > 1)
        .select("fps")
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for x in batch.column(0):
                fps, root = _roots(x.values.to_numpy(zero_copy_only=False).view(np.uint64), bits)
                i = np.flatnonzero(root != np.arange(len(fps)))
                a.append(fps[i].view(np.int64))
                b.append(fps[root[i]].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return lists.mapInArrow(verify, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, width: int = 3) -> DataFrame:
    """One row per document: id_col, fingerprint (16 hex digits), component_id, size of its class.

    component_id is the least id reachable over links of at most `bits` differing bits. Equal
    fingerprints are one node of the graph, so copies cost one row each. A null id is kept and
    belongs to the component of its fingerprint, without being its least id unless all are null;
    rows that repeat an id each get a row. Null, empty and wordless texts share fingerprint 0.
    """
    fps = cut(docs.select(F.col(id_col).alias("id"), fingerprints(F.col(text_col), width).alias("fp")))
    nodes = cut(fps.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("copies")))
    roots = connected_components(links(nodes.select("fp"), bits))
    labelled = cut(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", "copies", F.coalesce("root", "fp").alias("root")))
    whole = labelled.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("copies").alias("component_size"))
    by_fp = labelled.join(whole, "root").select(F.col("fp").alias("fp2"), "component_id", "component_size")
    return fps.join(by_fp, F.col("fp") == F.col("fp2"), "left").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component_size"
    )
