"""The writer's lock of a database: a small file that its holder renews while it is open.

On the holder's own machine its process number tells whether it lives.  Anywhere else only
time can: a lock that was not renewed for a lease is void, and its holder finds that out at
its next commit.
"""

from __future__ import annotations

import json
import os
import socket
import threading
import time
import uuid

from docframe.errors import DocframeError
from docframe.store.files import Folder

NAME = "_lock"
#: Seconds without renewal after which another machine may take the lock.
LEASE = 120.0


def machine() -> str:
    """Where a process number means something: the host and its space of processes."""
    try:
        return f"{socket.gethostname()} {os.readlink('/proc/self/ns/pid')}"
    except OSError:
        return socket.gethostname()


class Lock:
    def __init__(self, folder: Folder, lease: float = LEASE):
        self.folder, self.lease = folder, lease
        self.content = json.dumps({"machine": machine(), "pid": os.getpid(), "token": uuid.uuid4().hex}).encode()
        #: Whether it was taken from a holder that could not be asked whether it lives.
        self.expired = False
        self._stop, self._busy = threading.Event(), threading.Lock()

    def take(self) -> None:
        for _ in range(3):
            if self.folder.create(NAME, self.content):
                threading.Thread(target=self._renew, daemon=True).start()
                return
            age = self.folder.age(NAME)
            if age is None:
                continue  # released just now
            owner = self._owner()
            here = owner.get("machine") == machine() and os.path.exists("/proc")
            if os.path.exists(f"/proc/{owner['pid']}") if here else age < self.lease:
                raise DocframeError(f"Cannot open database: already in use by process {owner.get('pid', 'unknown')}.")
            self.expired = not here
            self.folder.delete(NAME)
        raise DocframeError("Cannot open database: failed to acquire lock.")

    def _owner(self) -> dict:
        try:
            owner = json.loads(self.folder.read(NAME))
            return owner if isinstance(owner, dict) and "pid" in owner else {}
        except ValueError:  # written at this moment
            return {}

    def held(self) -> bool:
        return self.folder.age(NAME) is not None and self.folder.read(NAME) == self.content

    def _renew(self) -> None:
        last = time.monotonic()
        while not self._stop.wait(self.lease / 4) and time.monotonic() - last < self.lease:
            try:
                with self._busy:
                    if self._stop.is_set() or not self.held():
                        return
                    self.folder.touch(NAME, self.content)
                last = time.monotonic()
            except Exception:  # noqa: BLE001, S112 - the file system may be back before the lease ends
                continue

    def release(self) -> None:
        self._stop.set()
        with self._busy:
            if self.held():
                self.folder.delete(NAME)
