"""Plain single-machine versions of the corpus operators, for comparison only."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def words(text):
    return WORD.findall(text or "")


def op2(docs, k=50):
    first = {}
    for d, t in docs:
        w = words(t)
        for i in range(len(w) - k + 1):
            x = tuple(w[i : i + k])
            first[x] = min(first.get(x, d), d)
    out = []
    for d, t in docs:
        w = words(t)
        gone = set()
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] < d:
                gone.update(range(i, i + k))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return sorted(out)


def op6(docs, k=100):
    first = {}
    for d, t in docs:
        b = (t or "").encode()
        for i in range(len(b) - k + 1):
            x = b[i : i + k]
            first[x] = min(first.get(x, (d, i)), (d, i))
    out = []
    for d, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - k + 1):
            if first[b[i : i + k]] < (d, i):
                gone[i : i + k] = b"\1" * k
        spans = len(re.findall(b"\x01+", bytes(gone)))
        out.append((d, len(b), sum(gone), spans, sha(bytes(c for c, g in zip(b, gone) if not g))))
    return sorted(out)


def op3(docs, items, k=8):
    windows = defaultdict(set)
    for item, t in items:
        w = TERM.findall((t or "").translate(UPPER))
        if not w:
            continue
        for i in range(max(1, len(w) - k + 1)):
            windows[tuple(w[i : i + k])].add(item)
    sizes = sorted({len(x) for x in windows})
    out = []
    for d, t in docs:
        w = TERM.findall((t or "").translate(UPPER))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[x]
        ids = sorted(map(str, found))
        out.append((d, len(w), len(hit), len(ids), sha(",".join(ids)), len(ids) >= 2))
    return sorted(out)


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text):
    t = text or ""
    found = [(m.start(), 0, "email", m.end()) for m in EMAIL.finditer(t)]
    found += [(m.start(), 1, "ip", m.end()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            found.append((m.start(), 2, "card", m.end()))
    for m in PHONE.finditer(t):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((m.start(), 3, "phone", m.end()))
    return sorted(found)


def op5(docs):
    out = []
    for d, t in docs:
        s = base_spans(t)
        n = Counter(x[2] for x in s)
        out.append((d, n["email"], n["ip"], n["card"], n["phone"], sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in s))))
    return sorted(out)


def op8(docs):
    out = []
    for d, t in docs:
        w = words(t)
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        rep = set()
        for i in range(len(w) - 7):
            if seen[tuple(w[i : i + 8])] > 1:
                rep.update(range(i, i + 8))
        failed = len(w) < 20 or 100 * len(rep) > 30 * len(w)
        out.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(rep), failed))
    return sorted(out)


def op9(docs):
    return sorted((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in docs)


def shingles(text, k=5):
    w = words((text or "").translate(UPPER))
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def op10(docs):
    sets = [(d, shingles(t)) for d, t in docs]
    parent = {d: d for d, _ in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for x in s:
            index[x].append(i)
    for i, (d, s) in enumerate(sets):
        shared = Counter(j for x in s for j in index[x] if j < i)
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j][1]) - n):
                a, b = sorted((root(d), root(sets[j][0])))
                parent[b] = a
    return sorted((d, len(s), root(d)) for d, s in sets)


def feistel(number, n, seed):
    """The place of a row number: rounds that add a keyed hash of one half to the other, until inside the range."""
    prime = 2**31 - 1
    low = next(a for a in range(max(1, int((n - 1) ** 0.5)), n + 2) if -n % a <= 7)
    high = -(-n // low)

    def mixed(x, key):
        c = [(key * 48_271 + 1_013_904_223 * (i + 1)) % prime for i in range(3)]
        t = (x + c[0]) % prime
        t = t * (t % 1_000_003 + c[1]) % prime
        return (t * (c[2] | 1) + (t >> 15)) % prime

    while True:
        left, right = divmod(number, high)
        for r in range(6):
            key = seed * 6 + r + 1
            if r % 2:
                right = (right + mixed(left, key)) % high
            else:
                left = (left + mixed(right, key)) % low
        number = left * high + right
        if number < n:
            return number
