"""A registry of named data sets on local or shared paths, with optional SHA-256 verification; nothing is downloaded."""

from __future__ import annotations

import hashlib
import os
from dataclasses import dataclass, field

#: Environment variable that names the folder which holds the data sets.
FOLDER_VARIABLE = "LUMENFRAME_DATA"


@dataclass(frozen=True)
class DataFile:
    name: str
    sha256: str | None = None


@dataclass(frozen=True)
class DataSet:
    name: str
    files: tuple[DataFile, ...] = field(default_factory=tuple)
    description: str = ""


_KNOWN: dict[str, DataSet] = {}


def register(data: DataSet) -> DataSet:
    _KNOWN[data.name] = data
    return data


def names() -> list[str]:
    return sorted(_KNOWN)


def folder() -> str:
    return os.environ.get(FOLDER_VARIABLE) or os.path.join(os.path.expanduser("~"), ".lumenframe")


def path(name: str) -> str:
    if name not in _KNOWN:
        raise KeyError(f"no data set {name!r}; there are {names()}")
    return os.path.join(folder(), name)


def fetch(name: str) -> list[str]:
    """Paths of a data set's files, which must exist and match their digests."""
    out = []
    for f in _KNOWN[name].files if name in _KNOWN else ():
        p = os.path.join(path(name), f.name)
        if not os.path.exists(p):
            raise FileNotFoundError(p)
        if f.sha256:
            h = hashlib.sha256()
            with open(p, "rb") as data:
                while block := data.read(1 << 20):
                    h.update(block)
            if h.hexdigest() != f.sha256:
                raise ValueError(f"{p} does not match its digest")
        out.append(p)
    if name not in _KNOWN:
        path(name)
    return out
