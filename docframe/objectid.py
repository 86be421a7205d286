"""Document ids: 24 lower-case hex digits of seconds, a process's random part and a counter."""

from __future__ import annotations

import itertools
import os
import re
import time

from docframe.errors import DocframeError

FORMAT = re.compile(r"[0-9a-f]{24}")
_process = os.urandom(5).hex()
_counter = itertools.count(int.from_bytes(os.urandom(3), "big"))


def new_id() -> str:
    return f"{int(time.time()):08x}{_process}{next(_counter) % (1 << 24):06x}"


def check_id(value) -> str:
    if not isinstance(value, str):
        raise DocframeError("Document _id must be a string when provided.")
    if not FORMAT.fullmatch(value):
        raise DocframeError("Document _id must be a 24-character lowercase hex string.")
    return value
