"""Exact subword models over one piece of text."""

from __future__ import annotations

import heapq
import re

import numpy as np

from ..errors import ModelError
from ..sources.spec import BpeModel, UnigramModel

HEX = re.compile(r"(?:<0x[0-9A-Fa-f]{2}>)+\Z")
PENALTY = 10.0
NEVER = (1 << 31) - 1  # the rank of what isn't a merge
MOST_SYMBOLS = 64  # of a part that is merged beside others


class Bpe:
    """Byte-pair merges: the pair of least rank first, the leftmost on ties."""

    def __init__(self, spec: BpeModel, raw_bytes: bool = False):
        self.spec, self.raw_bytes = spec, raw_bytes
        self.id_of = spec.vocab
        self.text_of = {i: t for t, i in spec.vocab.items()}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(spec.merges):
            self.rank[self.id_of[a], self.id_of[b]] = (r, self.id_of[a + b])
        self.bridges = None if spec.ignore_merges or raw_bytes else self._bridges()
        self.memo: dict[str, list[int]] = {}
        self._tables()

    def bytes_of(self, token: str) -> bytes:
        return bytes.fromhex(token.replace("<0x", "").replace(">", "")) if HEX.match(token) else token.encode()

    def _bridges(self) -> frozenset[tuple[int, int]]:
        return frozenset(pair for t in self.id_of for b in (t.encode(), self.bytes_of(t)) for pair in zip(b, b[1:], strict=False))

    def is_bridgeable(self, before: int, after: int) -> bool | None:
        """Whether some token has these two bytes side by side; None where whole pieces win."""
        return None if self.bridges is None else (before, after) in self.bridges

    def symbols(self, piece: str) -> list[int]:
        out: list[int] = []
        for c in piece:
            i = self.id_of.get(c)
            if i is not None:
                out.append(i)
                continue
            if self.raw_bytes:
                from .pretokenizers import CHAR_BYTE

                raise ModelError(f"byte {CHAR_BYTE.get(c, ord(c) & 255):#04x} has no token in vocabulary")
            some = [self.id_of.get(f"<0x{b:02X}>") for b in c.encode()] if self.spec.byte_fallback else [None]
            if None in some:
                raise ModelError(f"character {c!r} not in vocabulary")
            out += some
        return out

    def merge(self, ids: list[int]) -> list[int]:
        rank, n = self.rank, len(ids)
        ids = list(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r[0], i, r[1], ids[i + 1]) for i in range(n - 1) if (r := rank.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            r, i, merged, right = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ids[j] != right or rank.get((ids[i], right)) != (r, merged):
                continue
            ids[i], alive[j], after[i] = merged, False, after[j]
            if after[i] < n:
                before[after[i]] = i
                if x := rank.get((merged, ids[after[i]])):
                    heapq.heappush(heap, (x[0], i, x[1], ids[after[i]]))
            if (k := before[i]) >= 0 and (x := rank.get((ids[k], merged))):
                heapq.heappush(heap, (x[0], k, x[1], merged))
        return [x for x, a in zip(ids, alive, strict=True) if a]

    def _tables(self) -> None:
        """Ids of single characters by code point and of bytes, bridges by both bytes, and ranks and results of pairs, as sorted arrays."""
        single = sorted((ord(t), i) for t, i in self.id_of.items() if len(t) == 1)
        self.code, self.code_id = (np.array(x, np.int64) for x in zip(*single, strict=True)) if single else (np.zeros(0, np.int64),) * 2
        pairs = sorted((a << 32 | b, r, into) for (a, b), (r, into) in self.rank.items())
        some = [self.id_of.get(f"<0x{b:02X}>", -1) for b in range(256)]
        self.byte_id = np.array(some, np.int64) if self.spec.byte_fallback and not self.raw_bytes else None
        self.bridged = None if self.bridges is None else np.zeros(1 << 16, bool)
        for before, after in self.bridges or ():
            self.bridged[before << 8 | after] = True
        self.pair, self.pair_rank, self.pair_into = np.array(pairs or [(-1, NEVER, 0)], np.int64).T.copy()

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.pair_rank[at], NEVER), self.pair_into[at]

    def merge_many(self, ids: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge the symbols of many pieces side by side, one merge of each piece a step; own: the
        piece of each symbol, ascending. Gives what is left, and its pieces, ascending."""
        ids, rank, into = ids.copy(), np.full(len(ids), NEVER), np.zeros(len(ids), np.int64)
        i = np.flatnonzero(own[1:] == own[:-1])
        rank[i], into[i] = self._ranked(ids[i], ids[i + 1])
        ended = []
        while len(ids):
            first = np.flatnonzero(np.diff(own, prepend=-1))
            best = np.minimum.reduceat(rank << 32 | np.arange(len(rank)), first)
            over = best >> 32 >= NEVER
            best &= 0xFFFFFFFF
            if over.any():  # nothing is left to merge in these
                gone = np.repeat(over, np.diff(first, append=len(own)))
                ended.append((own[gone], ids[gone]))
                best = (np.cumsum(~gone) - 1)[best[~over]]
                own, ids, rank, into = own[~gone], ids[~gone], rank[~gone], into[~gone]
            if not len(best):
                break
            ids[best] = into[best]
            rank[best] = NEVER
            stays = np.ones(len(own), bool)
            stays[best + 1] = False
            own, ids, rank, into = own[stays], ids[stays], rank[stays], into[stays]
            best -= np.arange(len(best))  # each piece before has lost a symbol
            for i in (best[best > 0] - 1, best[best < len(own) - 1]):
                apart = i[own[i] != own[i + 1]]
                i = i[own[i] == own[i + 1]]
                rank[apart] = NEVER
                rank[i], into[i] = self._ranked(ids[i], ids[i + 1])
        if not ended:
            return ids, own
        own, ids = (np.concatenate(x) for x in zip(*ended, strict=True))
        order = np.argsort(own, kind="stable")
        return ids[order], own[order]

    def _symbols(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the symbols of characters one after another, how many each has): none where the model has none."""
        at = np.minimum(np.searchsorted(self.code, codes), max(len(self.code) - 1, 0))
        known = self.code[at] == codes if len(self.code) else np.zeros(len(codes), bool)
        width = known.astype(np.int64)
        if self.byte_id is None or known.all():
            return self.code_id[at[known]], width
        spelled = ~known & ((codes < 0xD800) | (codes > 0xDFFF))
        c = codes[spelled]
        size = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
        some = self.byte_id[np.frombuffer(c.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)]
        if (some < 0).any():  # a byte has no token: nor has its character
            whole = np.bincount(np.repeat(np.arange(len(c)), size), some < 0, len(c)) == 0
            some, size = some[np.repeat(whole, size)], np.where(whole, size, 0)
        width[spelled] = size
        out = np.empty(int(width.sum()), np.int64)
        own = np.repeat(known, width)
        out[own], out[~own] = self.code_id[at[known]], some
        return out, width

    def _begins(self, codes: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Whether a part begins at each character: a piece, or what no token bridges to the one before."""
        out = np.ones(len(codes), bool)
        out[1:] = own[1:] != own[:-1]
        if self.bridged is not None:
            last = np.where(codes < 0x80, codes, 0x80 | codes & 0x3F)[:-1]
            c = codes[1:]
            first = np.where(c < 0x80, c, np.where(c < 0x800, 0xC0 | c >> 6, np.where(c < 0x10000, 0xE0 | c >> 12, 0xF0 | c >> 18)))
            out[1:] |= ~self.bridged[last << 8 | first]
        return out

    def encode_many(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one after another, how many each has). Pieces are cut where no token bridges
        two characters, and the parts are merged together; long ones, and pieces that the model rejects
        or has as a whole, one by one."""
        codes = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        own = np.repeat(np.arange(len(pieces)), np.fromiter(map(len, pieces), np.int64, len(pieces)))
        symbols, width = self._symbols(codes)
        plain = np.bincount(own[width == 0], minlength=len(pieces)) == 0
        if self.spec.ignore_merges:
            plain &= ~np.fromiter(map(self.id_of.__contains__, pieces), bool, len(pieces))
        begins = self._begins(codes, own)
        part, of = np.repeat(np.cumsum(begins) - 1, width), own[begins]
        if not plain.all():
            inside = np.repeat(plain[own], width)
            symbols, part = symbols[inside], part[inside]
        size = np.bincount(part, minlength=len(of))
        ids, parts = [symbols[(size == 1)[part]]], [np.flatnonzero(size == 1)]
        several = ((size > 1) & (size <= MOST_SYMBOLS))[part]
        if several.any():
            got = self.merge_many(symbols[several], part[several])
            ids.append(got[0])
            parts.append(got[1])
        upto = np.cumsum(size)
        for i in np.flatnonzero(size > MOST_SYMBOLS).tolist():
            ids.append(np.array(self.merge(symbols[upto[i] - size[i] : upto[i]].tolist()), np.int64))
            parts.append(np.full(len(ids[-1]), i))
        rows = [of[x] for x in parts]
        for i in np.flatnonzero(~plain).tolist():
            ids.append(np.array(self.encode(pieces[i]), np.int64))
            parts.append(np.zeros(len(ids[-1]), np.int64))
            rows.append(np.full(len(ids[-1]), i))
        ids, parts, rows = (np.concatenate(x) for x in (ids, parts, rows))
        order = np.argsort(parts, kind="stable") if plain.all() else np.lexsort((parts, rows))
        return ids[order], np.bincount(rows, minlength=len(pieces))

    def pieces(self, piece: str) -> list[str]:
        """piece, cut where no token bridges two characters."""
        if self.bridges is None or len(piece) < 2:
            return [piece]
        out, first = [], 0
        for i in range(1, len(piece)):
            if (piece[i - 1].encode()[-1], piece[i].encode()[0]) not in self.bridges:
                out.append(piece[first:i])
                first = i
        return [*out, piece[first:]]

    def _encode(self, piece: str) -> list[int]:
        whole = self.id_of.get(piece)
        if whole is not None and self.spec.ignore_merges:
            return [whole]
        try:
            return self.merge(self.symbols(piece))
        except ModelError:
            if whole is not None and not self.spec.byte_fallback:
                return [whole]
            raise

    def encode(self, piece: str) -> list[int]:
        if (got := self.memo.get(piece)) is None:
            got = [i for p in self.pieces(piece) for i in self._encode(p)]
            if len(piece) <= 64:
                if len(self.memo) >= 1 << 17:
                    self.memo.clear()
                self.memo[piece] = got
        return got

    def validate(self, piece: str) -> None:
        """Raise what encoding the piece would raise."""
        if piece in self.id_of and (self.spec.ignore_merges or not self.spec.byte_fallback):
            return
        for part in self.pieces(piece):
            if part not in self.id_of or self.spec.byte_fallback:
                self.symbols(part)

    def compatible(self, first: int, second: int) -> bool:
        """Whether two tokens can stand side by side in this model's output."""
        a, b = self.text_of.get(first), self.text_of.get(second)
        try:
            return a is not None and b is not None and self.encode(a + b) == [first, second]
        except ModelError:
            return False


class Unigram:
    """The segmentation of best score; of equal ones, that whose last piece is longest."""

    def __init__(self, spec: UnigramModel):
        self.spec = spec
        self.id_of = {t: i for i, (t, _) in enumerate(spec.vocab)}
        self.text_of = {i: t for i, (t, _) in enumerate(spec.vocab)}
        self.piece = {t: (i, s) for i, (t, s) in enumerate(spec.vocab) if t}
        self.sizes: dict[str, list[int]] = {}  # of the pieces that begin with two characters, and of one
        for t in self.piece:
            self.sizes.setdefault(t[:2], []).append(len(t))
        self.sizes = {k: sorted(set(v)) for k, v in self.sizes.items()}
        self.unknown = min((s for _, s in spec.vocab), default=0.0) - PENALTY
        self.memo: dict[str, list[int]] = {}

    def _path(self, text: str) -> list[tuple[str, int | None]]:
        n = len(text)
        best = [float("-inf")] * (n + 1)
        best[0] = 0.0
        back: list[tuple[int, int | None]] = [(0, None)] * (n + 1)
        for i in range(n):
            here = best[i]
            if text[i] not in self.piece and here + self.unknown > best[i + 1]:
                best[i + 1], back[i + 1] = here + self.unknown, (i, None)
            for size in (*self.sizes.get(text[i], ()), *self.sizes.get(text[i : i + 2], ())) if i + 1 < n else self.sizes.get(text[i], ()):
                j = i + size
                found = self.piece.get(text[i:j]) if j <= n else None
                if found is not None and here + found[1] > best[j]:
                    best[j], back[j] = here + found[1], (i, found[0])
        out, end = [], n
        while end:
            start, i = back[end]
            out.append((text[start:end], i))
            end = start
        return out[::-1]

    def _unknown(self, text: str) -> list[int]:
        if text in self.piece:
            return [self.piece[text][0]]
        if self.spec.byte_fallback:
            some = [self.id_of.get(f"<0x{b:02X}>") for b in text.encode()]
            if None not in some:
                return some
        if self.spec.unk_id is None:
            raise ModelError(f"{text!r} needs an unknown token, and the model has none")
        return [self.spec.unk_id]

    def validate(self, piece: str) -> None:
        """Raise what encoding the piece would raise: only an unknown character can."""
        if self.spec.unk_id is None and any(c not in self.piece for c in piece):
            self.encode(piece)

    def encode_many(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one after another, how many each has)."""
        lists = list(map(self.encode, pieces))
        return np.array([i for x in lists for i in x], np.int64), np.fromiter(map(len, lists), np.int64, len(lists))

    def encode(self, piece: str) -> list[int]:
        if (got := self.memo.get(piece)) is not None:
            return got
        out: list[int] = []
        fused = ""
        for text, i in self._path(piece):
            if i is None:
                fused += text
                continue
            if fused:
                out += self._unknown(fused)
                fused = ""
            out.append(i)
        if fused:
            out += self._unknown(fused)
        if len(piece) <= 64:
            if len(self.memo) >= 1 << 17:
                self.memo.clear()
            self.memo[piece] = out
        return out
