"""Documents kept on the driver by id, least recently used first to go."""

from __future__ import annotations

import json
from collections import OrderedDict

from docframe.errors import DocframeError


class DocumentCache:
    def __init__(self, max_bytes: int):
        self.resize(max_bytes)
        self.kept: OrderedDict[str, tuple[int, str]] = OrderedDict()
        self.bytes = self.hits = self.misses = self.evictions = 0

    def resize(self, max_bytes: int) -> None:
        if isinstance(max_bytes, bool) or not isinstance(max_bytes, int) or max_bytes < 1:
            raise DocframeError("DocumentCache maxBytes must be a positive integer.")
        self.max_bytes = max_bytes
        if hasattr(self, "kept"):
            self._evict()

    def get(self, key: str, version: int) -> dict | None:
        found = self.kept.get(key)
        if found is None or found[0] != version:
            self.misses += 1
            return None
        self.hits += 1
        self.kept.move_to_end(key)
        return json.loads(found[1])

    def put(self, key: str, version: int, document: dict) -> None:
        self.drop(key)
        text = json.dumps(document)
        if 2 * len(text) <= self.max_bytes:
            self.kept[key] = (version, text)
            self.bytes += 2 * len(text)
            self._evict()

    def drop(self, key: str) -> None:
        old = self.kept.pop(key, None)
        if old:
            self.bytes -= 2 * len(old[1])

    def _evict(self) -> None:
        while self.bytes > self.max_bytes:
            self.drop(next(iter(self.kept)))
            self.evictions += 1

    def stats(self) -> dict:
        return {"enabled": True, "maxBytes": self.max_bytes, "bytes": self.bytes, "documentCount": len(self.kept), "hits": self.hits, "misses": self.misses, "evictions": self.evictions}
