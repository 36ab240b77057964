"""Snapshots of compiled specifications, kept as Parquet beside their tokenizer.json.

A snapshot is a folder: `vocab.parquet`, `merges.parquet`, `added.parquet` and `head.json` with the
version, the rest of the document and the checksum of the tables. The path itself is a link to the
folder: a new folder is written and synced, and the link is replaced at once, so that a reader
always sees a whole snapshot. Whatever is wrong with one is a SnapshotError, and so is a size over
LARGEST bytes.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import uuid
from enum import Enum
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq

from ..errors import SnapshotError, TokenizerError
from .spec import TokenizerSpec

LARGEST = 512 << 20
SUFFIX, MAGIC, VERSION = ".tfs", "tokenframe-snapshot", 1


class LoadMode(Enum):
    JSON_ONLY = "json_only"
    SNAPSHOT = "snapshot"


def snapshot_path(path: str | Path) -> Path:
    return Path(path).with_suffix(SUFFIX)


def _tables(spec: TokenizerSpec) -> dict[str, pa.Table]:
    model = spec.model
    if model.kind == "BPE":
        vocab = pa.table({"token": list(model.vocab), "id": pa.array(model.vocab.values(), pa.int32()), "score": pa.nulls(len(model.vocab), pa.float64())})
    else:
        vocab = pa.table({"token": [t for t, _ in model.vocab], "id": pa.array(range(len(model.vocab)), pa.int32()), "score": pa.array([s for _, s in model.vocab], pa.float64())})
    merges = getattr(model, "merges", [])
    return {
        "vocab": vocab,
        "merges": pa.table({"left": pa.array([a for a, _ in merges], pa.string()), "right": pa.array([b for _, b in merges], pa.string())}),
        "added": pa.table({"token": pa.array([json.dumps(vars(t)) for t in spec.added_tokens], pa.string())}),
    }


def _checksum(folder: Path, head: dict) -> str:
    h = hashlib.blake2b(json.dumps({k: v for k, v in head.items() if k != "checksum"}, sort_keys=True).encode(), digest_size=32)
    for name in ("vocab", "merges", "added"):
        h.update((folder / f"{name}.parquet").read_bytes())
    return h.hexdigest()


def save(spec: TokenizerSpec, path: str | Path) -> None:
    """Write a snapshot at path, in place of an earlier one."""
    path = Path(path)
    temp = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    temp.mkdir(parents=True)
    try:
        for name, table in _tables(spec).items():
            pq.write_table(table, temp / f"{name}.parquet")
        doc = {k: v for k, v in spec.to_dict().items() if k not in ("model", "added_tokens")}
        model = {"type": spec.model.kind, "byte_fallback": spec.model.byte_fallback}
        model |= {"ignore_merges": spec.model.ignore_merges} if spec.model.kind == "BPE" else {"unk_id": spec.model.unk_id}
        head = {"magic": MAGIC, "version": VERSION, "model": model, "document": doc}
        head["checksum"] = _checksum(temp, head)
        (temp / "head.json").write_text(json.dumps(head))
        for file in temp.iterdir():
            _sync(file)
        _sync(temp)
        link = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
        link.symlink_to(temp.name, target_is_directory=True)
        if path.is_dir() and not path.is_symlink():  # of an earlier form: a folder can't be replaced at once
            os.replace(path, path.with_name(f"{temp.name}.old"))
        before = path.resolve() if path.is_symlink() else path.with_name(f"{temp.name}.old")
        os.replace(link, path)
        _sync(path.parent)
        shutil.rmtree(before, ignore_errors=True)
    except BaseException:
        shutil.rmtree(temp, ignore_errors=True)
        raise


def _sync(path: Path) -> None:
    handle = os.open(path, os.O_RDONLY)
    try:
        os.fsync(handle)
    finally:
        os.close(handle)


def load(path: str | Path) -> TokenizerSpec:
    """Read a snapshot; checks come in the order magic, version, checksum, content."""
    path = Path(path)
    try:
        path = path.resolve(strict=True)
        if sum(f.stat().st_size for f in path.iterdir()) > LARGEST:
            raise SnapshotError(f"{path} has more than {LARGEST} bytes")
        head = json.loads((path / "head.json").read_text())
        if head.get("magic") != MAGIC:
            raise SnapshotError(f"{path} isn't a snapshot")
        if head.get("version") != VERSION:
            raise SnapshotError(f"{path} has version {head.get('version')}; {VERSION} is read")
        if head.get("checksum") != _checksum(path, head):
            raise SnapshotError(f"{path} is damaged")
        vocab, merges, added = (pq.read_table(path / f"{n}.parquet").to_pydict() for n in ("vocab", "merges", "added"))
        model = dict(head["model"])
        if model["type"] == "BPE":
            model |= {"vocab": dict(zip(vocab["token"], vocab["id"], strict=True)), "merges": list(zip(merges["left"], merges["right"], strict=True))}
        else:
            model["vocab"] = list(zip(vocab["token"], vocab["score"], strict=True))
        return TokenizerSpec.from_dict(head["document"] | {"model": model, "added_tokens": [json.loads(x) for x in added["token"]]})
    except SnapshotError:
        raise
    except (OSError, ValueError, KeyError, TokenizerError, pa.ArrowException) as e:
        raise SnapshotError(f"{path}: {e}") from e


def load_or_create(path: str | Path, mode: LoadMode = LoadMode.SNAPSHOT, accept=None) -> TokenizerSpec:
    """The specification of a tokenizer.json, by its snapshot where there is a sound one.

    A path with the snapshot suffix is loaded as it is. Otherwise a missing, damaged or older
    snapshot is made anew from the JSON, after `accept(spec)`, if given, has taken the specification.
    """
    path = Path(path)
    if path.suffix == SUFFIX:
        return load(path)
    if mode is LoadMode.JSON_ONLY:
        return TokenizerSpec.from_file(path)
    cached = snapshot_path(path)
    if cached.exists() and (not path.exists() or cached.stat().st_mtime >= path.stat().st_mtime):
        try:
            return load(cached)
        except SnapshotError:
            pass
    spec = TokenizerSpec.from_file(path)
    if accept is not None:
        accept(spec)
    save(spec, cached)
    return spec
