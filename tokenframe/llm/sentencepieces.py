"""SentencePiece merge-type (BPE) encoding and decoding by a score-ordered agenda.

Adjacent symbol pairs whose concatenation is a piece wait in a heap ordered by score, then by
position; the best is merged and its new neighbours join the heap. No piece of the vocabulary holds
a word mark behind another character (checked at load; else whole texts are one unit), so merges
never cross the start of a run of marks: a text is the concatenation of independent units, and each
new unit is encoded once per worker. Every id that comes out is decoded again. With `verify`, all
that was newly encoded in an Arrow batch is compared with the sentencepiece library.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterable
from itertools import repeat
from operator import add

import pyarrow as pa
import sentencepiece
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import claim

MARK = "▁"
MEMO, MEMO_CHARS = 5 << 16, 64  # entries of a worker's memo (it has two), and the longest unit that it keeps
SHORT, NEVER = 48, float("inf")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceModel:
    """A merge-type vocabulary with byte fallback, as the sentencepiece library reads it."""

    def __init__(self, path: str):
        lib = self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        self.scores = [lib.get_score(i) for i in range(n)]
        self.silent = {i for i in range(n) if lib.is_control(i)}
        self.unk = lib.unk_id()
        self.byte_of = {i: int(self.pieces[i][3:-1], 16) for i in range(n) if lib.is_byte(i)}
        self.byte_id = {b: i for i, b in self.byte_of.items()}
        special = self.silent | {self.unk} | self.byte_of.keys()
        self.id_of = {p: i for i, p in enumerate(self.pieces) if i not in special}
        if any(lib.is_unused(i) for i in range(n)) or len(self.byte_id) != 256:
            raise ValueError("only merge-type models with byte fallback and without unused pieces are supported")
        inner = re.compile(f"[^{MARK}]{MARK}")
        self.units = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+") if not any(inner.search(p) for p in self.id_of) else re.compile(r"(?s).+")
        self.rank = {p: -self.scores[i] for p, i in self.id_of.items()}
        self.bridged = {pair for p in self.id_of for pair in zip(p, p[1:], strict=False)}
        self.said = {str(i): b"" if i in self.silent else " ⁇ ".encode() if i == self.unk else bytes([self.byte_of[i]]) if i in self.byte_of else x.replace(MARK, " ").encode() for i, x in enumerate(self.pieces)}
        self.memo: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self.unchecked: list[tuple[str, list[int]]] = []

    def encode_unit(self, unit: str) -> list[int]:
        """The agenda over one unit of normalized text: a heap, or for short units a list of the
        pairs' ranks in the order of the text, whose first least entry is the head."""
        symbols = self._merged_short(unit) if len(unit) <= SHORT else self._merged_long(unit)
        out: list[int] = []
        for s in symbols:
            i = self.id_of.get(s)
            out += [i] if i is not None else [self.byte_id[b] for b in s.encode()]
        return out

    def _merged_short(self, unit: str) -> list[str]:
        rank, symbol = self.rank.get, list(unit)
        agenda = list(map(rank, map(add, symbol, symbol[1:]), repeat(NEVER)))
        while agenda and (best := min(agenda)) != NEVER:
            i = agenda.index(best)
            del agenda[i]
            symbol[i] += symbol.pop(i + 1)
            if i:
                agenda[i - 1] = rank(symbol[i - 1] + symbol[i], NEVER)
            if i < len(agenda):
                agenda[i] = rank(symbol[i] + symbol[i + 1], NEVER)
        return symbol

    def _merged_long(self, unit: str) -> list[str]:
        rank = self.rank
        symbol: list[str | None] = list(unit)
        n = len(symbol)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda: list[tuple[float, int, int, str]] = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right < n and (r := rank.get(both := symbol[left] + symbol[right])) is not None:
                heapq.heappush(agenda, (r, left, right, both))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, left, right, both = heapq.heappop(agenda)
            if symbol[left] is None or symbol[right] is None or symbol[left] + symbol[right] != both or after[left] != right:
                continue
            symbol[left], symbol[right] = both, None
            after[left] = after[right]
            if after[right] < n:
                before[after[right]] = left
            offer(before[left], left)
            offer(left, after[left])
        return [s for s in symbol if s is not None]

    def forget(self) -> None:
        self.memo, self.old = {}, {}

    def normalized(self, text: str) -> str:
        return MARK + text.replace(" ", MARK) if text else ""

    def encode(self, text: str) -> list[int]:
        return [i for unit in self.units.findall(self.normalized(text)) for i in self.encode_unit(unit)]

    def _pieces(self, ids: Iterable[int]) -> str:
        out: list[str] = []
        pending = bytearray()

        def flush() -> None:
            at = 0
            while at < len(pending):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(pending[at : at + size].decode())
                        at += size
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    out.append("�")
                    at += 1
            pending.clear()

        for i in ids:
            if i in self.byte_of:
                pending.append(self.byte_of[i])
                continue
            flush()
            if i == self.unk:
                out.append(" ⁇ ")
            elif i not in self.silent:
                out.append(self.pieces[i].replace(MARK, " "))
        flush()
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: marks become spaces, the one that encoding put first goes, runs of byte
        pieces become characters (U+FFFD for each byte that is no part of one)."""
        text = self._pieces(ids)
        first = next((i for i in ids if i not in self.silent), None)
        return text[1:] if first is not None and first not in self.byte_of and text.startswith(" ") and first != self.unk else text

    def parts(self, unit: str) -> list[str]:
        """unit, cut between any two characters that no piece has side by side: no merge joins them."""
        bridged = self.bridged
        if bridged.issuperset(zip(unit, unit[1:], strict=False)):
            return [unit]
        cuts = [i for i, pair in enumerate(zip(unit, unit[1:], strict=False), 1) if pair not in bridged]
        return [unit[i:j] for i, j in zip([0, *cuts], [*cuts, len(unit)], strict=True)]

    def _whole(self, part: str) -> str:
        ids = self.encode_unit(part)
        self.unchecked.append((part, ids))
        return ",".join(map(str, ids))

    def _recalled(self, unit: str, make) -> str:
        if (x := self.old.get(unit)) is None:
            x = make(unit)
        if len(unit) <= MEMO_CHARS:
            if len(self.memo) >= MEMO:
                self.old, self.memo = self.memo, {}
            self.memo[unit] = x
        return x

    def _of_parts(self, unit: str) -> str:
        parts = self.parts(unit)
        if len(parts) == 1:
            return self._whole(unit)
        return ",".join([self.memo.get(p) or self._recalled(p, self._whole) for p in parts])

    def known(self, units: list[str]) -> list[str]:
        """The ids, joined by commas, of each unit."""
        got = list(map(self.memo.get, units))
        if None not in got:
            return got
        fresh: dict[str, str] = {}
        for i in [i for i, x in enumerate(got) if x is None]:
            u = units[i]
            if (x := fresh.get(u)) is None:
                x = fresh[u] = self._recalled(u, self._of_parts)
            got[i] = x
        return got

    def decoded(self, ids: list[str]) -> bytes:
        """The text of decimal ids in the middle of a text: marks are spaces, and bytes that make no
        character U+FFFD each."""
        raw = b"".join(map(self.said.__getitem__, ids))
        try:
            raw.decode()
        except UnicodeDecodeError:
            return self._pieces(map(int, ids)).encode()
        return raw

    def check(self) -> None:
        """Compare the parts encoded since the last call with the library. Behind a line break, of
        which no piece has one, each comes out as in the middle of a text."""
        parts, self.unchecked = self.unchecked, []
        for at in range(0, len(parts), 4096):
            some = parts[at : at + 4096]
            theirs = self.lib.encode(["\n" + p.replace(MARK, " ") for p, _ in some], num_threads=1)
            for (part, ids), x in zip(some, theirs, strict=True):
                if x[2:] != ids:
                    raise AssertionError(f"ids differ from the library's for {part!r}")

    def digest(self, text: str) -> tuple[int, str, str]:
        """(n_tokens, sha256 of the ids joined by commas, sha256 of the text that the ids decode to).

        No run of byte pieces crosses the end of a unit's ids, since a unit's first piece is a mark's.
        """
        ids, out, n = hashlib.sha256(), hashlib.sha256(), 0
        units = self.units.findall(self.normalized(text))
        for at in range(0, len(units), 1 << 14):
            own = ",".join(self.known(units[at : at + (1 << 14)]))
            each = own.split(",")
            n += len(each)
            ids.update((("," if at else "") + own).encode())
            said = self.decoded(each)
            out.update(said[1:] if not at and said[:1] == b" " else said)
        return n, ids.hexdigest(), out.hexdigest()


_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode(text: Column, path: str | None = None) -> Column:
    """Array of ids of each text; null and empty texts have none."""
    path = path or default_model()

    @F.arrow_udf("array<int>")
    def run(column: pa.Array) -> pa.Array:
        m = model(path)
        return pa.array([m.encode(t or "") for t in column.to_pylist()], pa.list_(pa.int32()))

    return run(text)


def decode(ids: Column, path: str | None = None) -> Column:
    """The text of each array of ids; a null array gives the empty text."""
    path = path or default_model()

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        m = model(path)
        return pa.array([m.decode(x or []) for x in column.to_pylist()], pa.string())

    return run(ids)


def digests(text: Column, path: str | None = None, verify: bool = True) -> Column:
    """Struct (n_tokens, ids_sha256, decoded_sha256) of each text's encoding and round trip.

    Null counts as empty: no ids, and the digests of the empty string. Equal texts give equal
    rows. With `verify` each newly encoded part is compared with the sentencepiece library.
    """
    path = path or default_model()

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(column: pa.Array) -> pa.Array:
        m = model(path)
        claim(m, m.forget)
        rows = []
        for t in column.to_pylist():
            rows.append(m.digest(t or ""))
            if len(m.unchecked) >= 1 << 14:
                m.check() if verify else m.unchecked.clear()
        m.check() if verify else m.unchecked.clear()
        n, ids, out = (list(x) for x in zip(*rows, strict=True)) if rows else ([], [], [])
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(out, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return run(text)
