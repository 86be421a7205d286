"""A database: a folder with an append-only operation log and versioned manifests."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from docframe.collection import Collection
from docframe.errors import DocframeError
from docframe.store import manifest as manifests
from docframe.store.files import Folder
from docframe.store.lock import LEASE, Lock

SERIALIZATIONS = ("json", "bson", "amf3")


def open_db(spark: SparkSession, path: str = "docframe.db", **options) -> Database:
    """Open or create the database in folder ``path``."""
    return Database(spark, path, **options)


class Database:
    """All writes of a database go through one open handle; readers may be many.

    A version is always written and closed before it counts; with ``durability="strict"`` its
    manifest is also synced to the disk.  ``read_only`` opens without the lock.  ``serialization``
    names the payload format of a new database and is kept with it; documents are VARIANT values
    in every format.  ``lease`` is how many seconds another machine waits for a holder of the lock
    that gives no sign of life.
    """

    def __init__(self, spark: SparkSession, path: str, durability: str = "strict", read_only: bool = False, serialization: str = "json", lease: float = LEASE):
        if durability not in ("strict", "relaxed"):
            raise DocframeError("durability is strict or relaxed.")
        if serialization not in SERIALIZATIONS:
            raise DocframeError(f"Unsupported serialization format: {serialization}.")
        self.spark, self.path, self.read_only, self.durability = spark, path, read_only, durability
        self.folder = Folder(spark, path)
        self._lock = None if read_only else Lock(self.folder, lease)
        if self._lock:
            self._lock.take()
        self.manifest, torn = manifests.load(self.folder)
        if not self.manifest.version:
            self.manifest.serialization = serialization
        known = self.manifest.data_files()
        stray = [f for c in self.folder.names("_log") for b in self.folder.names(f"_log/{c}") if (f := f"_log/{c}/{b}") not in known]
        #: Whether something was left behind by a writer that did not finish.
        self.recovered = torn or bool(stray)
        if self._lock:
            for f in stray:
                # Whoever held the lock before, unseen from here, may still be writing a young batch.
                if not self._lock.expired or (self.folder.age(f) or 0) > lease:
                    self.folder.delete(f)
            if torn:
                for name in self.folder.names(manifests.FOLDER):
                    if name > f"{self.manifest.version:012d}.json":
                        self.folder.delete(f"{manifests.FOLDER}/{name}")
        self._open: dict[str, Collection] = {}

    def commit(self, change) -> None:
        """Apply ``change`` to a copy of the manifest and make it the next version."""
        if self.read_only:
            raise DocframeError("The database is open for reading only.")
        if not self._lock.held():
            raise DocframeError("Cannot write: the database is closed, or its lock was lost to another writer.")
        new = self.manifest.copy()
        change(new)
        self.manifest = manifests.commit(self.folder, new, self.durability == "strict")

    def collection(self, name: str) -> Collection:
        """The collection of that name, made if it does not exist."""
        if name not in self.manifest.collections:
            def add(m):
                m.collections[name] = {"id": uuid.uuid4().hex[:8], "files": [], "indexes": [], "changes": [], "changed": 0, "sides": {}}

            self.commit(add)
            self._open.pop(name, None)
        if name not in self._open:
            self._open[name] = Collection(self, name)
        return self._open[name]

    def get_collections(self) -> list[str]:
        return list(self.manifest.collections)

    @property
    def collections(self) -> dict[str, Collection]:
        return {name: self.collection(name) for name in self.manifest.collections}

    def exists_collection(self, name: str) -> bool:
        return name in self.manifest.collections

    def stats(self) -> dict:
        each = [self.collection(n).stats() for n in self.get_collections()]
        total = {k: sum(s[k] for s in each) for k in ("documentCount", "operationCount", "tombstoneCount", "liveBytes", "deadBytes", "sizeOnDisk")}
        return {"path": self.path, "collectionCount": len(each), **total}

    def compact(self) -> None:
        """Rewrite every collection as one batch of its live documents, then drop the old files."""
        old = self.manifest.data_files()
        new = {}
        for name in self.get_collections():
            new[name] = self.collection(name).snapshot()

        def swap(m):
            for name, files in new.items():
                m.collections[name] |= {"files": list(files), "changes": [], "changed": 0, "sides": files}

        self.commit(swap)
        for f in old - self.manifest.data_files():
            self.folder.delete(f)
        for name in self.folder.names(manifests.FOLDER)[:-1]:
            self.folder.delete(f"{manifests.FOLDER}/{name}")

    def close(self) -> None:
        if self._lock:
            self._lock.release()
