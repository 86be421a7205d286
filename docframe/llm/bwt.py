"""Burrows-Wheeler transform of a collection of strings, built one column a round."""

from __future__ import annotations

import numpy as np


def collection_order(cat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Transform and suffix order of a collection.

    Round ``t`` inserts, for every string of at least ``t`` symbols, its suffix of ``t``
    symbols.  The suffix's row follows from the last round's transform alone: all rows of
    lesser first symbols, then the same symbols above the string's own row.  Each round reads
    the transform once from front to back and writes the next one likewise, so its arrays
    behave as sequential files; the caller bounds their size.  Where suffixes begin is found
    from the finished transform, so a round moves symbols only.  Returns the transform and, per
    row, the offset in ``cat`` of the suffix (an empty suffix has the string's end).
    """
    count = len(starts)
    ends = starts + lengths
    kind = np.uint8 if len(cat) == 0 or cat.max() < 255 else np.int16  # UTF-8 has no byte 255, so its symbols stay bytes
    symbol = np.append(cat, np.uint8(0)).astype(kind) + kind(1)  # 0 ends a string
    bwt = np.where(lengths > 0, symbol[ends - 1], 0).astype(kind)
    active = np.flatnonzero(lengths > 0)
    pos = active.copy()
    ended = count - len(active)
    t = 0
    while len(active):
        t += 1
        # Only the strings' own rows are ranked: their places in the sorted transform, in the order of symbol and row.
        mark = np.zeros(len(bwt), dtype=bool)
        mark[pos] = True
        new = np.empty(len(active), dtype=np.int64)
        new[np.argsort((bwt[pos].astype(np.int64) << 40) | pos)] = np.flatnonzero(mark.take(np.argsort(bwt, kind="stable"))) + (count - ended)
        more = lengths[active] > t
        before = np.where(more, symbol[ends[active] - t - 1], 0)
        old = np.ones(len(bwt) + len(active), dtype=bool)
        old[new] = False
        grown = np.empty(len(old), dtype=kind)
        grown[old], grown[new] = bwt, before
        bwt = grown
        ended += len(active) - int(np.count_nonzero(more))
        active, pos = active[more], new[more]
    return bwt, suffix_rows(bwt, ends, lengths)


def suffix_rows(bwt: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Offsets of the suffixes of a finished transform: every string is followed from its end to its front."""
    above = np.empty(len(bwt), dtype=np.int32)
    above[np.argsort(bwt, kind="stable")] = np.arange(len(bwt), dtype=np.int32)
    row = np.empty(len(bwt), dtype=np.int32)
    row[: len(ends)] = ends
    active = np.flatnonzero(lengths > 0)
    pos = active
    t = 0
    while len(active):
        t += 1
        pos = above[pos]
        row[pos] = ends[active] - t
        more = lengths[active] > t
        active, pos = active[more], pos[more]
    return row


def common_prefixes(cat: np.ndarray, rows: np.ndarray, k: int, block: int = 1 << 14) -> np.ndarray:
    """Whether each row's suffix shares its first ``k`` symbols with the row above, exactly."""
    same = np.zeros(len(rows), dtype=bool)
    if len(cat) < k:
        return same
    windows = np.lib.stride_tricks.sliding_window_view(cat, k)
    for at in range(1, len(rows), block):
        a = rows[at : at + block]
        b = rows[at - 1 : at - 1 + len(a)]
        same[at : at + len(a)] = (windows[a] == windows[b]).all(axis=1)
    return same


def window_classes(strings: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (in the joined strings) of all windows of ``k`` symbols, and their classes.

    Two windows have one class exactly if they are equal.
    """
    lengths = np.array([len(x) for x in strings], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    cat = np.frombuffer(b"".join(strings), dtype=np.uint8)
    _, rows = collection_order(cat, starts, lengths)
    end_of = np.repeat(starts + lengths, lengths)
    rows = rows[len(strings):]  # the first rows are the empty suffixes
    rows = rows[end_of[rows] - rows >= k]
    return rows, np.cumsum(~common_prefixes(cat, rows, k)) - 1
