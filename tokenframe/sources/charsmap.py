"""Building of precompiled character maps: a double-array trie over UTF-8, then the texts."""

from __future__ import annotations

import base64
import struct

LEAF, HAS_LEAF = 1 << 31, 1 << 8


def build(mapping: dict[str, str]) -> str:
    """The base64 form of a map from character sequences to texts."""
    texts, place = bytearray(), {}
    for source, target in sorted(mapping.items()):
        place[source.encode()] = len(texts)
        texts += target.encode() + b"\0"
    units: dict[int, int] = {0: 0}
    bases: set[int] = set()

    def settle(node: int, prefix: bytes) -> None:
        own = sorted({k[len(prefix)] for k in place if len(k) > len(prefix) and k.startswith(prefix)})
        slots = ([0] if prefix in place else []) + own
        base = next(b for b in range(1, 1 << 21) if b not in bases and all(b ^ s not in units for s in slots))
        bases.add(base)
        units[node] |= (base ^ node) << 10
        if prefix in place:
            units[node] |= HAS_LEAF
            units[base] = LEAF | place[prefix]
        for byte in own:
            units[base ^ byte] = byte
        for byte in own:
            settle(base ^ byte, prefix + bytes([byte]))

    if place:
        settle(0, b"")
    size = (max([*units, *bases]) | 0xFF) + 1  # a reader looks anywhere in a block of 256
    trie = struct.pack(f"<{size}I", *(units.get(i, 0xFF) for i in range(size)))
    return base64.b64encode(struct.pack("<I", len(trie)) + trie + bytes(texts)).decode()
