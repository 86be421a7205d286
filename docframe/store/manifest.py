"""Versions of a database: which files, collections and indexes are in force.

A version becomes visible by creating its file, which only one writer can; files that no
version names do not exist for readers.
"""

from __future__ import annotations

import copy
import json
import zlib
from dataclasses import dataclass, field

from docframe.errors import DocframeError
from docframe.store.files import Folder

FOLDER = "_manifests"


@dataclass
class Manifest:
    version: int = 0
    next_seq: int = 1
    #: name -> {"id", "files", "indexes", "changes", "changed", "sides"}: of its files those that change
    #: or delete earlier documents, how many operations these hold, and each file's index columns.
    collections: dict = field(default_factory=dict)
    serialization: str = "json"

    def copy(self) -> Manifest:
        return copy.deepcopy(self)

    def data_files(self) -> set[str]:
        return {f for c in self.collections.values() for f in c["files"]}


def load(folder: Folder) -> tuple[Manifest, bool]:
    """The last whole version, and whether a torn one came after it."""
    torn = False
    for name in reversed(folder.names(FOLDER)):
        try:
            line, check = folder.read(f"{FOLDER}/{name}").rsplit(b"\n", 1)
            if int(check) == zlib.crc32(line):
                return Manifest(**json.loads(line)), torn
        except ValueError:
            pass
        torn = True
    return Manifest(), torn


def commit(folder: Folder, manifest: Manifest, sync: bool = False) -> Manifest:
    """Make ``manifest`` the next version, or raise if another writer was first."""
    manifest.version += 1
    line = json.dumps(manifest.__dict__, sort_keys=True).encode()
    if not folder.create(f"{FOLDER}/{manifest.version:012d}.json", line + b"\n%d" % zlib.crc32(line), sync):
        raise DocframeError("Another writer has changed the database.")
    return manifest
