"""Digests of what a result depends on: the engine's sources, a model's files, and the versions of libraries."""

from __future__ import annotations

import hashlib
import importlib.metadata
import os
from collections.abc import Iterable
from pathlib import Path

#: The variable that names a model's folder, and libraries whose versions may change spans.
WEIGHTS_VARIABLE = "QUILLVEIL_WEIGHTS"
LIBRARIES = ("pyspark", "pyarrow", "regex", "onnxruntime", "tokenizers")


def _digest(files: Iterable[tuple[str, Path]]) -> str:
    """Of names and contents, each with its length before it, in order of names."""
    whole = hashlib.sha256()
    for name, path in sorted(files):
        own = hashlib.sha256()
        with open(path, "rb") as f:
            while block := f.read(1 << 20):
                own.update(block)
        whole.update(len(name.encode()).to_bytes(8, "big") + name.encode() + own.digest())
    return whole.hexdigest()


def sources(root: str | Path | None = None) -> str:
    """Of the Python files of a package (this one, unless another is named)."""
    base = Path(__file__).parent if root is None else Path(root)
    return _digest((p.relative_to(base).as_posix(), p) for p in base.rglob("*.py"))


def weights_folder(default: str | None = None) -> Path | None:
    """Where a model's files are: the folder that the environment names, or the default, if it holds any."""
    at = os.environ.get(WEIGHTS_VARIABLE) or default
    return Path(at) if at and Path(at).is_dir() and any(p.is_file() for p in Path(at).rglob("*")) else None


def weights(folder: str | Path) -> str:
    """Of all files of a model; links count as what they lead to."""
    base = Path(folder)
    return _digest((p.relative_to(base).as_posix(), p) for p in base.rglob("*") if p.is_file())


def libraries(names: Iterable[str] = LIBRARIES) -> str:
    """Of the versions of libraries, those that are missing included."""

    def version(name: str) -> str:
        try:
            return importlib.metadata.version(name)
        except importlib.metadata.PackageNotFoundError:
            return "none"

    return hashlib.sha256("\n".join(f"{n}={version(n)}" for n in sorted(names)).encode()).hexdigest()
