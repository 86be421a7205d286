"""A SentencePiece BPE vocabulary as a max-plus lattice.

A segmentation is the model's own exactly if the model would leave every two neighbouring
pieces as they are.  So the lattice of pieces gets weight 0 where two neighbours are left
alone and minus infinity elsewhere; the best path has weight 0 and is unique for every prefix.
(Summed piece scores, the usual weights of a unigram model, give other segmentations than a
BPE model's.)  Weights add along a path and the best of several is taken, so the matrices of
consecutive chunks combine associatively.
"""

from __future__ import annotations

import re
from array import array
from operator import add

import numpy as np
import sentencepiece

MARK = "▁"
#: Numbers of characters without a piece begin here; all numbers are below 2 ** WIDTH.
NO_PIECE, WIDTH = 1 << 21, 22
#: Bytes of remembered words in a generation, by estimate.
MEMORY = 48 << 20
NEVER = float("-inf")


class Vocabulary:
    """Pieces of a model; ``model`` is the file's content."""

    def __init__(self, model: bytes, remember: int = 60_000, memory: int = MEMORY, many: int = 500_000):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.byte_ids = np.zeros(256, dtype=np.int32)
        self.text: list[bytes] = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.text.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.text.append(b"")
            else:
                self.ids[piece], self.score[piece] = i, sp.get_score(i)
                self.text.append(piece.replace(MARK, " ").encode())
        self.longest = max(map(len, self.ids))
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        #: Characters that no longer piece contains stand alone: a path breaks at both sides.
        self.alone = re.compile("([" + "".join(re.escape(c) for c in "\n\t\r\x0b\x0c" if c not in joined) + "])")
        self.lone = {c: self.numbers([c]) for c in "\n\t\r\x0b\x0c" if c not in joined}
        inside = [p for p in self.ids if MARK in p[1:] and p.strip(MARK)]
        if inside:
            raise ValueError("a piece holds a space after other characters, so units are not independent")
        self.reach: dict[str, int] = {}
        for p in self.ids:
            for k in (1, 2):
                self.reach[p[:k]] = max(self.reach.get(p[:k], 1), len(p))
        #: Lengths of the pieces that begin like a text, longest first, by its first 4, 3 or 2 characters.
        self.lengths: tuple[dict[str, tuple[int, ...]], ...] = ({}, {}, {})
        long: dict[str, set[int]] = {}
        for p in self.ids:
            if len(p) >= 4:
                long.setdefault(p[:4], set()).add(len(p))
        for table, k in zip(self.lengths, (4, 3, 2)):
            for begin in {p[:k] for p in self.ids if len(p) >= k}:
                known = long.get(begin, set()) if k == 4 else set()
                table[begin] = tuple(sorted(known | {n for n in range(2, min(k, 3) + 1) if begin[:n] in self.ids} | {1}, reverse=True))
        self.inner = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.remember, self.many = remember, many
        self.pairs: dict[int, bool] = {}
        self.units: dict[str, bytes] = {}
        #: Words between single spaces, in two generations of at most ``memory`` bytes each, about.
        self.memory, self.held = memory, 0
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """The model's segmentation of a short text: merge the best pair, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = NEVER, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1], NEVER)
                if s > best:
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def number(self, piece: str) -> int:
        """A number that tells pieces apart, also characters that are none."""
        known = self.ids.get(piece)
        return known if known is not None else NO_PIECE + ord(piece)

    def weight(self, left: str, right: str) -> bool:
        """Whether the edge between two neighbouring pieces has weight 0."""
        key = self.number(left) << WIDTH | self.number(right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= self.many:
                self.pairs.clear()
            known = self.pairs[key] = self.merged(left + right) == [left, right]
        return known

    def paths(self, text: str, begin: int, piece: str, stop: int) -> dict[int, tuple[str, int]]:
        """Best paths from ``piece`` (ending at ``begin``) to all ends; ``stop`` bounds the starts.

        Maps an end to its last piece and that piece's start.
        """
        found = {begin: (piece, -1)}
        size = len(text)
        for at in range(begin, min(stop, size)):
            here = found.get(at)
            if here is None:
                continue
            left = here[0]
            far = min(self.reach.get(text[at : at + 2], self.reach.get(text[at], 1) if at + 1 == size else 1), size - at)
            for end in range(at + 1, at + 1 + far):
                right = text[at:end]
                if (end == at + 1 or right in self.ids) and end not in found and (not left or self.weight(left, right)):
                    found[end] = (right, at)
        return found

    def only_path(self, text: str) -> list[str]:
        """The best path over a whole unit, walked depth first with the longest piece tried first.

        Every prefix has one path of weight 0, so an end that was entered once and led nowhere
        is never entered again.
        """
        numbers, pairs, size = self.ids.get, self.pairs, len(text)
        four, three, two = self.lengths
        at, left, above = 0, "", -1
        steps = iter(four.get(text[:4]) or three.get(text[:3]) or two.get(text[:2]) or ONE)
        taken, out, entered = [], [], set()
        while at < size:
            for length in steps:
                end = at + length
                if end > size or end in entered:
                    continue
                right = text[at:end]
                number = numbers(right)
                if number is None:
                    if length > 1:
                        continue
                    number = NO_PIECE + ord(right)
                if above >= 0:
                    known = pairs.get(above | number)
                    if known is None:
                        known = self.weight(left, right)
                    if not known:
                        continue
                break
            else:
                at, left, above, steps = taken.pop()
                out.pop()
                continue
            taken.append((at, left, above, steps))
            out.append(right)
            entered.add(end)
            at, left, above = end, right, number << WIDTH
            steps = iter(four.get(text[at : at + 4]) or three.get(text[at : at + 3]) or two.get(text[at : at + 2]) or ONE)
        return out

    @staticmethod
    def back(found: dict[int, tuple[str, int]], end: int, begin: int) -> list[str]:
        """The pieces from ``begin`` to ``end``."""
        out = []
        while end > begin:
            piece, end = found[end]
            out.append(piece)
        return out[::-1]

    def numbers(self, pieces: list[str]) -> bytes:
        """Piece numbers as packed 32-bit integers; a character without a piece goes as bytes."""
        try:
            return array("i", [self.ids[p] for p in pieces]).tobytes()
        except KeyError:
            each = ([self.ids[p]] if p in self.ids else self.byte_ids[list(p.encode())].tolist() for p in pieces)
            return array("i", [i for x in each for i in x]).tobytes()

    def parts(self, text: str) -> list[str]:
        """A unit cut between every two characters that no piece holds in a row.

        Every path breaks there, so the parts can be looked up by themselves.
        """
        inner = self.inner
        at = [i for i, pair in enumerate(map(add, text, text[1:]), 1) if pair not in inner]
        return [text[a:b] for a, b in zip([0, *at], [*at, len(text)])] if at else [text]

    def solve(self, text: str) -> bytes:
        """Numbers of a unit: marks, then other characters; no piece crosses its ends."""
        parts = self.parts(text)
        if len(parts) == 1:
            return self.numbers(self.only_path(text))
        return b"".join([self.units.get(p) or self.part(p) for p in parts])

    def part(self, text: str) -> bytes:
        """Numbers of a part of a unit, which has no break, remembered."""
        if len(self.units) >= self.remember:
            self.units.clear()
        known = self.units[text] = self.numbers(self.only_path(text))
        return known

    def units_of(self, text: str) -> list[bytes]:
        """Numbers of the units of a text whose spaces are marks."""
        out = []
        for line in self.alone.split(text):
            if line in self.lone:
                out.append(self.lone[line])
            elif line:
                out += [self.word(u[1:]) if u[:1] == MARK and u[1:2] != MARK else self.solve(u) for u in UNIT.findall(line)]
        return out

    def word(self, word: str) -> bytes:
        """Numbers of what stands between two spaces, without the mark; a leading line end has no mark."""
        known = self.words.get(word)
        if known is None:
            known = self.older.get(word)
            if known is None:
                known = self.solve(MARK + word) if word[:1] != "\n" or "\n" not in self.lone else self.lone["\n"] + (self.solve(word[1:]) if word[1:] else b"")
            self.held += 200 + 2 * len(word) + len(known)
            if self.held > self.memory:  # what is in use survives the change of generations
                self.older, self.words, self.held = self.words, {}, 0
            self.words[word] = known
        return known

    def encode(self, text: str) -> bytes:
        """Numbers of a whole text that is one chunk."""
        return b"".join(self.marked(MARK + text)) if text else b""

    def marked(self, text: str) -> list[bytes]:
        """Numbers by unit of a text that begins with a mark; its spaces may be marks or not.

        Where single spaces part all words, the words are looked up as they are.
        """
        body = text[1:].replace(MARK, " ")
        if "  " in body or " \n" in body or body[:1] == " " or "\n" not in self.lone:
            return self.units_of(text.replace(" ", MARK))
        words = body.replace("\n", " \n").split(" ")
        found = list(map(self.words.get, words))
        if None in found:
            found = [known if known is not None else self.word(w) for known, w in zip(found, words)]
        return found

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a sequence of numbers, without the mark that encoding puts in front."""
        whole = b"".join(map(self.text.__getitem__, ids.tolist()))
        return whole[1:] if whole[:1] == b" " else whole

    # -- chunks of giant texts ------------------------------------------------------------

    def states(self, text: str, cut: int) -> list[tuple[int, int]]:
        """Pieces ``(start, end)`` that could cover the character before ``cut``."""
        return [(a, b) for a in range(max(0, cut - self.longest), cut) for b in range(cut, min(len(text), a + self.longest) + 1) if b == a + 1 or text[a:b] in self.ids]

    def breaks(self, text: str, begin: int, end: int) -> tuple[int, int]:
        """First and last unit start in ``begin .. end``, or ``(-1, -1)``."""
        first = last = -1
        for m in EDGE.finditer(text, max(0, begin - 1), end + 1):
            at = m.start() + 1
            if begin <= at <= end:
                first, last = (at if first < 0 else first), at
        return first, last

    def transfer(self, text: str, begin: int, end: int) -> np.ndarray:
        """Max-plus matrix from the states at ``begin`` (one, the start, at 0) to those at ``end``.

        Units inside the chunk have one path each, so only the parts of a unit at either end
        are walked; a chunk without a unit start is walked from every state.
        """
        enter = self.states(text, begin) if begin else [(0, 0)]
        leave = self.states(text, end)
        first, last = self.breaks(text, begin + self.longest, end - self.longest)
        out = np.full((len(enter), len(leave)), NEVER)
        if first < 0:
            for i, (a, b) in enumerate(enter):
                got = self.paths(text, b, text[a:b], end)
                for j, (c, d) in enumerate(leave):
                    if (d in got and got[d][1] == c and c >= b) or (c, d) == (a, b):
                        out[i, j] = 0.0
            return out
        tail = self.paths(text, last, "", end)
        goes = np.array([0.0 if c >= last and d in tail and tail[d][1] == c else NEVER for c, d in leave])
        comes = np.array([0.0 if first in self.paths(text, b, text[a:b], first) else NEVER for a, b in enter])
        return comes[:, None] + goes[None, :]

    def backtrace(self, text: str, begin: int, end: int, enter: tuple[int, int], leave: tuple[int, int]) -> bytes:
        """Numbers of the pieces after ``enter`` up to and with ``leave``."""
        a, b = enter
        if (a, b) == leave:
            return b""
        first, last = self.breaks(text, begin + self.longest, end - self.longest)
        if first < 0:
            return self.numbers(self.back(self.paths(text, b, text[a:b], end), leave[1], b))
        head = self.numbers(self.back(self.paths(text, b, text[a:b], first), first, b))
        tail = self.numbers(self.back(self.paths(text, last, "", end), leave[1], last))
        return head + b"".join(self.marked(text[first:last]) if last > first else []) + tail


ONE = (1,)
UNIT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
EDGE = re.compile(f"[^{MARK}]{MARK}")


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1) if a.size and b.size else np.full((a.shape[0], b.shape[1]), NEVER)
