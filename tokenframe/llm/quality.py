"""Quality by nearest-neighbour voting on latent-semantic vectors.

The terms of a text are its byte trigrams, and its word shapes, alone and in pairs: a shape is the
run of character classes of a word (small letters, capitals, digits, each other character for itself), and a pair
also tells whether its words are equal. Both kinds of term are hashed, weighted by log count and
inverse document frequency, brought to unit length and reduced together by a truncated singular value
decomposition. The vectors of a bounded sample of labelled rows are broadcast; each document's
exact cosine products with all of them are computed in blocks, and its nearest neighbours' labels are
averaged by similarity, with votes balanced between the labels.

Bounds, all parameters: `sample` labelled rows (3,000), `trigrams` and `shapes` (2,048 and 1,024 terms), `rank`
(48); the broadcast is about (sample + terms) * rank * 4 bytes at any size of corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, texts_of
from .langid import fold
from .repeats import Hashes, byte_values, mixed, words_of

U = np.uint64
ROWS = 1024  # of a block of feature vectors, at most
CLASS = np.arange(256, dtype=np.uint8)  # small letters and bytes over 127 are one class, capitals and digits one each
CLASS[ord("a") : ord("z") + 1] = CLASS[128:] = ord("a")
CLASS[ord("A") : ord("Z") + 1] = ord("A")
CLASS[ord("0") : ord("9") + 1] = ord("0")


def trigram_counts(data: np.ndarray, offsets: np.ndarray, terms: int) -> np.ndarray:
    n = len(offsets) - 1
    if len(data) < 3:
        return np.zeros((n, terms), np.float32)
    b = data.astype(np.uint32)
    code = ((b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA6B)) ^ (b[2:] * np.uint32(0xC2B2AE35))) * np.uint32(0x27D4EB2F) >> np.uint32(16)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    whole = doc[:-2] == doc[2:]
    spot = doc[:-2][whole] * terms + (code[whole] % np.uint32(terms)).astype(np.int64)
    return np.bincount(spot, minlength=n * terms).reshape(n, terms).astype(np.float32)


def shape_counts(data: np.ndarray, offsets: np.ndarray, terms: int) -> np.ndarray:
    n = len(offsets) - 1
    start, end, first = words_of(data, offsets)
    if len(start) == 0:
        return np.zeros((n, terms), np.float32)
    own = np.repeat(np.arange(n), np.diff(first))
    kind = CLASS[data]
    opens = np.append(True, kind[1:] != kind[:-1])
    opens[start] = True
    at = np.append(0, np.cumsum(opens))
    shape = Hashes(byte_values(kind[opens])).of(at[start], at[end])
    word = Hashes(byte_values(data)).of(start, end)
    same = (word[1:] == word[:-1]).astype(U)
    pair = own[1:] == own[:-1]
    term = np.concatenate([mixed(shape + U(1)), mixed(shape[1:] * U(3) + shape[:-1] + U(2))[pair], mixed(same + U(3))[pair]])
    doc = np.concatenate([own, own[1:][pair], own[1:][pair]])
    return np.bincount(doc * terms + (term % U(terms)).astype(np.int64), minlength=n * terms).reshape(n, terms).astype(np.float32)


def features(data: np.ndarray, offsets: np.ndarray, terms: tuple[int, int]) -> np.ndarray:
    """Rows of log counts, first of trigrams, then of shapes; zeros for a text without either."""
    return np.log1p(np.hstack([trigram_counts(data, offsets, terms[0]), shape_counts(data, offsets, terms[1])]))


def weighted(rows: np.ndarray, weight: np.ndarray, trigrams: int) -> np.ndarray:
    """Rows times weights, both kinds of term brought to unit length."""
    x = rows * weight
    for part in (x[:, :trigrams], x[:, trigrams:]):
        part /= np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-9)
    return x


def blocked(offsets: np.ndarray, size: int = 1 << 20) -> list[tuple[int, int]]:
    """Ranges of rows of about `size` bytes and ROWS rows at most."""
    return [(k, min(k + ROWS, j)) for i, j in blocks(offsets, size) for k in range(i, j, ROWS)]


@dataclass
class Voter:
    terms: tuple[int, int]
    weight: np.ndarray  # of each term
    project: np.ndarray  # terms x rank
    vectors: np.ndarray  # labelled rows x rank, of unit length
    labels: np.ndarray
    balance: np.ndarray  # of the labelled rows' votes, so that both labels have as many in all
    base: float
    neighbours: int
    power: float

    def vector(self, rows: np.ndarray) -> np.ndarray:
        """Unit vectors; of zeros for a text without terms."""
        v = weighted(rows, self.weight, self.terms[0]) @ self.project
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """The vote of the `neighbours` nearest labelled rows, and of those as near as the last of them."""
        if not len(self.labels):
            return np.full(len(rows), self.base)
        cosine = np.round(self.vector(rows) @ self.vectors.T, 5)
        k = min(self.neighbours, cosine.shape[1])
        last = np.partition(cosine, cosine.shape[1] - k, axis=1)[:, -k, None]
        row, near = np.nonzero((cosine >= last) & (cosine > 0))
        w = cosine[row, near].astype(float) ** self.power * self.balance[near]
        total = np.bincount(row, w, minlength=len(rows))
        good = np.bincount(row, w * self.labels[near], minlength=len(rows))
        return np.where(total > 1e-30, np.clip(good / np.maximum(total, 1e-30), 0, 1), self.base)


def fit(labelled: DataFrame, trigrams: int = 2048, shapes: int = 1024, rank: int = 48, sample: int = 3000, neighbours: int = 25, power: float = 16.0, seed: int = 5) -> Voter:
    """Fit on (id, text, label) rows, of which about `sample` are used: those of least seeded hash.
    Rows that repeat an id and a text count once."""
    labelled = labelled.where("label is not null").dropDuplicates(["id", "text"])
    n = labelled.select("id").count()
    spot = F.pmod(F.xxhash64(F.lit(seed), F.col("id"), F.col("text")), F.lit(1 << 30))
    some = labelled.withColumn("spot", spot).where(F.col("spot") / float(1 << 30) < min(1.0, sample / max(n, 1))).select("spot", "text", "label")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = texts_of(batch.column(1))
            for i, j in blocked(at):
                f = features(data[at[i] : at[j]], at[i : j + 1] - at[i], (trigrams, shapes))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(list(f), pa.list_(pa.float32())), batch.column(2)[i:j].cast(pa.float64())], ["spot", "f", "label"])

    rows = some.mapInArrow(describe, "spot long, f array<float>, label double").toArrow()
    width = trigrams + shapes
    f = np.stack(rows["f"].to_numpy()) if len(rows) else np.zeros((0, width), np.float32)
    order = np.lexsort((f.sum(1), rows["label"].to_numpy(), rows["spot"].to_numpy()))
    f, labels = f[order], rows["label"].to_numpy()[order]
    weight = np.log((1 + len(f)) / (1 + (f > 0).sum(0))).astype(np.float32) + np.float32(0.1)
    x = weighted(f, weight, trigrams)
    good = labels > 0.5
    balance = np.where(good, (~good).sum(), good.sum()) / max(len(labels), 1) if 0 < good.sum() < len(good) else np.ones(len(labels))
    rank = min(rank, *x.shape) if len(x) else 1
    q = np.random.default_rng(seed).standard_normal((width, rank + 8)).astype(np.float32)
    for _ in range(4):  # randomised subspace iteration
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False) if len(x) else (0, 0, np.eye(rank + 8, dtype=np.float32))
    voter = Voter((trigrams, shapes), weight, (q @ v.T[:, :rank]).astype(np.float32), np.zeros((0, rank), np.float32), labels, balance, float(labels.mean()) if len(labels) else 0.5, neighbours, power)
    voter.vectors = voter.vector(f) if len(f) else voter.vectors
    return voter


def score(docs: DataFrame, voter: Voter, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with a double column `out`: the likelihood of label 1. Null counts as empty; a text
    that resembles no labelled row gets their mean label."""
    sent = docs.sparkSession.sparkContext.broadcast(voter)

    @F.arrow_udf("double")
    def run(column: pa.Array) -> pa.Array:
        v = sent.value
        data, at = texts_of(column)
        parts = [v.score(features(data[at[i] : at[j]], at[i : j + 1] - at[i], v.terms)) for i, j in blocked(at)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return docs.withColumn(out, run(F.col(text_col)))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3, **options) -> DataFrame:
    """Learn from labelled rows outside fold 0 of five, score every row: id, held_out, score, predicted.

    An id with several labels counts once, with the largest; null labels don't count. Repeated
    rows each get a row. Ids may be of any type. A neighbour as near as the last of those that vote votes too
    (cosines count to five digits). Texts are scored whole.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (fold(id_col, 5) == 0).alias("held_out"))
    known = labels.where(f"{label_col} is not null").groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label")).where(fold("id", 5) != 0)
    voter = fit_joined(own, known, **options)
    got = score(own, voter).select("id", "held_out", "score")
    return got.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def fit_joined(own: DataFrame, known: DataFrame, sample: int = 3000, seed: int = 5, **options) -> Voter:
    """Draw the sample from the labels alone, at most a few thousand ids, then fetch its texts."""
    n = known.count()
    point = F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(1 << 30)) / float(1 << 30)
    drawn = known.where(point < min(1.0, sample / max(n, 1))).orderBy("id").limit(2 * sample)
    return fit(own.where("not held_out").join(F.broadcast(drawn), "id").select("id", "text", "label"), sample=2 * sample, seed=seed, **options)
