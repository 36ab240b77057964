"""Post-processing templates."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..errors import PostProcessorError


@dataclass(frozen=True)
class Template:
    """What goes around the content: None stands for the content, lists are special ids."""

    parts: tuple[tuple[int, ...] | None, ...] = (None,)

    def apply(self, ids: list[int]) -> list[int]:
        out: list[int] = []
        for p in self.parts:
            out += ids if p is None else p
        return out

    def apply_all(self, offsets: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The template around each list of a flat batch."""
        if self.is_identity:
            return offsets, ids
        size = np.diff(offsets)
        ends = np.concatenate([[0], np.cumsum(size * sum(p is None for p in self.parts) + self.added)])
        out = np.zeros(int(ends[-1]), np.int64)
        at = ends[:-1].copy()
        inside = np.arange(len(ids)) - np.repeat(offsets[:-1], size)
        for p in self.parts:
            if p is None:
                out[np.repeat(at, size) + inside] = ids
                at += size
            else:
                for x in p:
                    out[at] = x
                    at += 1
        return ends, out

    @property
    def added(self) -> int:
        return len(self.apply([]))

    @property
    def is_identity(self) -> bool:
        return self.parts == (None,)


def _part(item: dict, specials: dict[str, list[int]]) -> tuple[int, ...] | None:
    if len(item) != 1 or next(iter(item)) not in ("Sequence", "SpecialToken"):
        raise PostProcessorError(f"bad template item {item!r}")
    (kind, body), = item.items()
    if kind == "SpecialToken":
        return tuple(specials.get(body["id"], ()))
    return None if body["id"] == "A" else ()


def compile_templates(config: dict | None) -> list[Template]:
    """The templates to apply one after another."""
    if config is None or config["type"] == "ByteLevel":
        return []
    if config["type"] == "Sequence":
        return [t for x in config["processors"] for t in compile_templates(x)]
    specials = {v["id"]: v["ids"] for v in (config.get("special_tokens") or {}).values()}
    for item in config.get("pair") or ():
        _part(item, specials)
    return [Template(tuple(_part(x, specials) for x in config["single"]))]
