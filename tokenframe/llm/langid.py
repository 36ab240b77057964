"""Language identification with segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's likelihood
in a language is the sum, over all its segmentations into pieces, of the product of their
probabilities; the forward algorithm gives it in time linear in the word. A text's score is the
posterior of its languages given all its words.

Words are runs of letters (Unicode category L) and the marks that follow them, lower-cased, with a
leading word mark. Words of up to SHORT letters are summed many at a time; longer ones, of any length,
one at a time on a logarithmic scale, after exact cuts where no piece spans both sides.
Probabilities are fitted by expectation maximisation (forward and backward sums) on a bounded sample:
about `per_language` labelled rows of each language, those of least seeded hash. Prediction uses
the text only.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, cut
from .repeats import mixed
from .sentencepieces import MARK, default_model

LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
SHORT, MEMO = 40, 1 << 20  # numbers that a worker's memo holds (it has two)
TOGETHER = 1 << 14  # words that are looked up together
U = np.uint64
UNKNOWN = 1e-7  # probability, in every language, of a character that no piece spells


def vocabulary(path: str) -> dict[str, int]:
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    own = (i for i in range(lib.get_piece_size()) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i)))
    spelled = dict.fromkeys(map(lib.id_to_piece, own))
    return {p: n for n, p in enumerate(p for p in spelled if p.lower() == p)}


_vocabularies: dict[str, dict[str, int]] = {}


def pieces(path: str) -> dict[str, int]:
    if path not in _vocabularies:
        _vocabularies[path] = vocabulary(path)
    return _vocabularies[path]


_prefixes: dict[str, Prefixes] = {}


def prefixes(path: str) -> Prefixes:
    if path not in _prefixes:
        _prefixes[path] = Prefixes(pieces(path))
    return _prefixes[path]


def words(text: str) -> list[str]:
    return [MARK + w for w in LETTERS.findall(text.lower())]


class Prefixes:
    """All prefixes of the pieces, as sorted 64-bit hashes, and the piece that each spells (or -1)."""

    def __init__(self, vocab: dict[str, int]):
        self.unknown = len(vocab)
        self.bridged = {pair for p in vocab for pair in zip(p, p[1:], strict=False)}
        own = {p[:n]: -1 for p in vocab for n in range(1, len(p))} | vocab
        h = np.zeros(len(own), U)
        spelled = list(own)
        for n in range(max(map(len, spelled), default=0)):
            some = [i for i, x in enumerate(spelled) if len(x) > n]
            h[some] = extended(h[some], np.array([ord(spelled[i][n]) for i in some], np.uint32))
        order = np.argsort(h)
        self.keys, self.ids = h[order], np.array(list(own.values()), np.int64)[order]

    def parts(self, word: str) -> list[str]:
        """word, cut between characters that no piece has side by side: every segmentation cuts there,
        so the sum over segmentations is the product of the parts' sums."""
        ends = [i for i, pair in enumerate(zip(word, word[1:], strict=False), 1) if pair not in self.bridged]
        return [word[i:j] for i, j in zip([0, *ends], [*ends, len(word)], strict=True)]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is a prefix's, and its piece."""
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return self.keys[at] == h, self.ids[at]


def extended(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Hashes of strings, from those of the strings without their last characters c."""
    return h * U(0x9E3779B97F4A7C15) + mixed(c.astype(U) + U(1))


class Lattice:
    """All pieces of a list of words, by the place where they end."""

    def __init__(self, own: list[str], known: Prefixes):
        self.sizes = np.array([len(w) for w in own], np.int64)
        self.width = int(self.sizes.max(initial=0)) + 1
        chars = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.cumsum(self.sizes) - self.sizes
        word = np.repeat(np.arange(len(own)), self.sizes)
        at = np.arange(len(chars))
        last = (first + self.sizes)[word]
        h, found = np.zeros(len(chars), U), []
        for n in range(1, self.width):
            h = extended(h, chars[at + n - 1])
            hit, piece = known.find(h)
            if n == 1:
                piece = np.where(hit & (piece >= 0), piece, known.unknown)
            spelled = (hit & (piece >= 0)) | (n == 1)
            found.append((at[spelled], np.full(int(spelled.sum()), n), piece[spelled]))
            more = hit & (at + n < last[at])
            at, h = at[more], h[more]
            if not len(at):
                break
        start, size, self.piece = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        self.word = word[start] if len(start) else start
        self.start = start - first[self.word]
        self.end = self.start + size

    def _sweep(self, p: np.ndarray, first: np.ndarray, into: np.ndarray, out_of: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Sums over paths, one step of position at a time for all words together."""
        total = np.zeros((len(self.sizes) * self.width, p.shape[1]))
        base = np.arange(len(self.sizes)) * self.width
        total[base + first] = 1
        at = self.word * self.width
        by = np.argsort(into if order[0] <= order[-1] else -into, kind="stable")
        cuts = np.flatnonzero(np.diff(into[by], prepend=-1))
        for i, j in zip(cuts, [*cuts[1:], len(by)], strict=True):
            e = by[i:j]
            np.add.at(total, at[e] + into[e], total[at[e] + out_of[e]] * p[self.piece[e]])
        return total

    def forward(self, p: np.ndarray) -> np.ndarray:
        return self._sweep(p, np.zeros_like(self.sizes), self.end, self.start, np.array([0, 1]))

    def backward(self, p: np.ndarray) -> np.ndarray:
        return self._sweep(p, self.sizes, self.start, self.end, np.array([1, 0]))

    def likelihood(self, p: np.ndarray) -> np.ndarray:
        """log of the sum over segmentations, by word and language."""
        return np.log(self.forward(p)[np.arange(len(self.sizes)) * self.width + self.sizes])

    def _log_sweep(self, log_p: np.ndarray, into: np.ndarray, out_of: np.ndarray, first: int) -> np.ndarray:
        """log of the sums over paths of a lattice of one word, from `first`, by position and language."""
        n = int(self.sizes[0])
        total = np.zeros((n + 1, log_p.shape[1]))
        by = np.argsort(into, kind="stable")
        cuts = np.searchsorted(into[by], np.arange(n + 2))
        for t in range(1, n + 1) if first == 0 else range(n - 1, -1, -1):
            e = by[cuts[t] : cuts[t + 1]]
            x = total[out_of[e]] + log_p[self.piece[e]]
            top = x.max(0)
            total[t] = top + np.log(np.exp(x - top).sum(0))
        return total

    def log_likelihood(self, log_p: np.ndarray) -> np.ndarray:
        """As `likelihood`, for a single word of any length."""
        return self._log_sweep(log_p, self.end, self.start, 0)[-1]

    def log_expected(self, log_p: np.ndarray, count: float) -> np.ndarray:
        """As `expected`, for a single word of any length."""
        a, b = self._log_sweep(log_p, self.end, self.start, 0), self._log_sweep(log_p, self.start, self.end, int(self.sizes[0]))
        share = np.exp(a[self.start, 0] + log_p[self.piece, 0] + b[self.end, 0] - a[-1, 0])
        return np.bincount(self.piece, share * count, minlength=len(log_p))

    def expected(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected number of each piece in one language; counts: of the words."""
        a, b = self.forward(p)[:, 0], self.backward(p)[:, 0]
        at = self.word * self.width
        z = a[np.arange(len(self.sizes)) * self.width + self.sizes]
        share = a[at + self.start] * p[self.piece, 0] * b[at + self.end] / z[self.word] * counts[self.word]
        return np.bincount(self.piece, share, minlength=len(p))


class Model:
    """Languages, their log priors and piece probabilities (pieces x languages, last row unknown)."""

    def __init__(self, languages: list[str], priors: np.ndarray, p: np.ndarray, path: str):
        self.languages, self.priors, self.p, self.path = languages, priors, p, path

    def ready(self) -> Model:
        self.known = prefixes(self.path)
        self.memo: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.most = max(1 << 10, MEMO // max(len(self.languages), 1))
        self.rows, self.old_rows = np.zeros((2, self.most, len(self.languages)))
        self.log_p = np.log(self.p)
        return self

    def forget(self) -> None:
        del self.memo, self.old, self.rows, self.old_rows

    def _remember(self, some: list[str]) -> None:
        """Put the likelihoods of words into the memo; a full memo becomes the old one."""
        missing = list({w for w in some if w not in self.memo})
        if len(self.memo) + len(missing) > self.most:
            self.old, self.memo = self.memo, {}
            self.rows, self.old_rows = self.old_rows, self.rows
            missing = list(set(some))
        recalled = [w for w in missing if w in self.old]
        first = len(self.memo)
        self.rows[first : first + len(recalled)] = self.old_rows[[self.old[w] for w in recalled]]
        self.memo.update(zip(recalled, range(first, self.most)))
        new = [w for w in missing if w not in self.old] if recalled else missing
        for j in range(0, len(new), 4096):
            part, first = new[j : j + 4096], len(self.memo)
            self.rows[first : first + len(part)] = Lattice(part, self.known).likelihood(self.p)
            self.memo.update(zip(part, range(first, self.most)))

    def _long(self, word: str) -> np.ndarray:
        parts = Counter(self.known.parts(word))
        short = [x for x in parts if len(x) <= SHORT]
        total = np.zeros(len(self.languages))
        for i in range(0, len(short), 512):
            some = short[i : i + 512]
            total += np.array([parts[x] for x in some], float) @ Lattice(some, self.known).likelihood(self.p)
        for x, n in parts.items():
            if len(x) > SHORT:
                total += n * Lattice([x], self.known).log_likelihood(self.log_p)
        return total

    def score(self, text: str) -> tuple[str, float]:
        """(language, its posterior); ("und", 0.0) for a text without a letter. Of languages that are equally
        likely the first by name is given."""
        return self._best(words(text))

    def scores(self, texts: Iterable[str]) -> Iterator[tuple[str, float]]:
        """`score` of each text; the new words of several are summed together."""
        waiting, n = [], 0
        for text in texts:
            own = words(text)
            waiting.append(own)
            n += len(own)
            if n >= TOGETHER:
                yield from self._all_best(waiting, n)
                waiting, n = [], 0
        yield from self._all_best(waiting, n)

    def _all_best(self, texts: list[list[str]], n: int) -> Iterator[tuple[str, float]]:
        if n <= self.most // 2 and self.languages:
            self._remember([w for own in texts for w in own if len(w) <= SHORT])
        yield from map(self._best, texts)

    def _best(self, own: list[str]) -> tuple[str, float]:
        if not own or not self.languages:
            return "und", 0.0
        total = self.priors.copy()
        if max(map(len, own)) > SHORT:
            for w in own:
                if len(w) > SHORT:
                    total += self._long(w)
            own = [w for w in own if len(w) <= SHORT]
        for i in range(0, len(own), self.most // 2):
            part = own[i : i + self.most // 2]
            if not all(map(self.memo.__contains__, part)):
                self._remember(part)
            total += self.rows[list(map(self.memo.__getitem__, part))].sum(0)
        best = int(total.argmax())
        return self.languages[best], float(1 / np.exp(np.maximum(total - total[best], -700)).sum())


def fit(labelled: DataFrame, path: str | None = None, per_language: int = 1000, rounds: int = 3, smoothing: float = 0.02, seed: int = 7, most_languages: int = 1000) -> Model:
    """Fit on (id, text, lang) rows; rows whose text or lang is null don't count.

    The sample holds at most about `per_language` rows of each language, whole texts; expected
    counts are summed on the executors, and languages x vocabulary numbers come to the driver and are
    broadcast: a table of more than `most_languages` is refused.
    """
    path = path or default_model()
    labelled = labelled.where("text is not null and lang is not null")
    of = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(most_languages + 1).collect()}
    if len(of) > most_languages:
        raise ValueError(f"more than {most_languages} languages: the model would be too large to broadcast")
    languages = sorted(of)
    if not languages:
        return Model([], np.zeros(0), np.zeros((len(pieces(path)) + 1, 0)), path)
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, per_language / of[k])))])
    point = F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(1 << 30)) / float(1 << 30)
    sample = cut(labelled.where(point < share[F.col("lang")]).select("lang", "text"))
    vocab = pieces(path)
    n = len(vocab) + 1
    p = np.full((n, len(languages)), 1 / n)
    p[-1] = UNKNOWN
    for _ in range(rounds):
        now = sample.sparkSession.sparkContext.broadcast(p)

        def expect(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            claim(words)
            own = prefixes(path)
            total = np.zeros((n, len(languages)))
            for batch in batches:
                counts: dict[str, Counter] = {}
                for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    counts.setdefault(lang, Counter()).update(words(text))
                for lang, c in counts.items():
                    k = languages.index(lang)
                    for w in [w for w in c if len(w) > SHORT]:
                        m = c.pop(w)
                        for x in own.parts(w):
                            c[x] += m
                    items = [(w, m) for w, m in c.items() if len(w) <= SHORT]
                    for i in range(0, len(items), 4096):
                        part = items[i : i + 4096]
                        lattice = Lattice([w for w, _ in part], own)
                        total[:, k] += lattice.expected(now.value[:, k : k + 1], np.array([x for _, x in part], float))
                    for w, m in c.items():
                        if len(w) > SHORT:
                            total[:, k] += Lattice([w], own).log_expected(np.log(now.value[:, k : k + 1]), m)
            i, k = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(k), pa.array(total[i, k])], ["piece", "k", "n"])

        new = np.full((n, len(languages)), smoothing)
        for r in sample.mapInArrow(expect, "piece long, k long, n double").groupBy("piece", "k").agg(F.sum("n").alias("n")).collect():
            new[r.piece, r.k] += r.n
        p = new / new[:-1].sum(0)
        p[-1] = UNKNOWN
    total = sum(of.values())
    return Model(languages, np.array([math.log(of[k] / total) for k in languages]), p, path)


def predict(docs: DataFrame, model: Model, text_col: str = "text", out: str = "lang_id") -> DataFrame:
    """docs with a struct column `out` (lang_pred, score); null texts and texts without a letter
    get ("und", 0.0). All other columns stay, but for one of the name `out`, which is replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def run(column: pa.Array) -> pa.Array:
        m = sent.value
        claim(m, m.forget)
        if not hasattr(m, "memo"):
            m.ready()
        rows = list(m.scores(t or "" for t in column.to_pylist()))
        return pa.StructArray.from_arrays([pa.array([x[0] for x in rows], pa.string()), pa.array([x[1] for x in rows], pa.float64())], ["lang_pred", "score"])

    # taken for nondeterministic, a filter on the result doesn't make Catalyst score each text twice
    return docs.withColumn(out, run.asNondeterministic()(F.col(text_col)))


def fold(id_col: str, folds: int):
    """crc32 of the id as text, modulo the number of folds; null ids count as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """Fit on the rows of folds 0 and 2 of three, predict every row: id, held_out, lang_pred, score."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), (fold(id_col, 3) == 1).alias("held_out"))
    model = fit(own.where("not held_out"), **options)
    got = predict(own.select("id", "held_out", "text"), model)
    return got.select(F.col("id").alias(id_col), "held_out", "lang_id.lang_pred", "lang_id.score")
