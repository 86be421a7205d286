"""JavaScript regular expressions for Java (Spark) and for Python."""

from __future__ import annotations

import functools
import re

from docframe.errors import DocframeError

# The white space of JavaScript's \\s, as the inside of a class.
SPACE = r"\t\n\x0b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def _translate(pattern: str, flags: str, end: str, code: str) -> str:
    """Rewrite what the dialects spell differently.

    ``end`` is the end-of-input anchor, ``code`` the format of a braced code point.
    """
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        two = pattern[i : i + 2]
        if c == "\\":
            brace = re.match(r"\\u\{([0-9A-Fa-f]+)\}", pattern[i:])
            if brace:
                out.append(code.format(int(brace[1], 16)))
                i += len(brace[0])
                continue
            if two == "\\s":
                out.append(SPACE if in_class else f"[{SPACE}]")
            elif two == "\\S" and not in_class:
                out.append(f"[^{SPACE}]")
            else:
                out.append("/" if two == "\\/" else two)
            i += 2
            continue
        if not in_class and (pattern.startswith("(?>", i) or (c == "+" and pattern[i - 1 : i] in ("*", "+", "?", "}") and i and pattern[i - 2 : i - 1] != "\\")):
            raise DocframeError(f"Invalid regular expression: /{pattern}/.")
        if in_class and two == "&&":
            out.append(r"&\&")
            i += 2
            continue
        if not in_class and pattern.startswith("[^]", i):
            out.append(r"[\s\S]")
            i += 3
            continue
        if not in_class and two == "[]":
            out.append("(?!)")
            i += 2
            continue
        if not in_class and pattern.startswith("(?<", i) and pattern[i + 3 : i + 4] not in ("=", "!") and end == r"\Z":
            out.append("(?P<")
            i += 3
            continue
        if c == "[" and in_class:
            out.append(r"\[")
        elif c == "$" and not in_class and "m" not in flags:
            out.append(end)
        else:
            in_class = (in_class or c == "[") and c != "]"
            out.append(c)
        i += 1
    return "".join(out)


def to_java(pattern: str, flags: str = "") -> str:
    """The pattern for Spark's ``rlike``."""
    inline = "".join({"i": "iu", "m": "m", "s": "s"}.get(f, "") for f in flags)
    return (f"(?{inline})" if inline else "") + _translate(pattern, flags, r"\z", r"\x{{{:x}}}")


@functools.lru_cache(maxsize=256)
def to_python(pattern: str, flags: str = "") -> re.Pattern:
    bits = sum({"i": re.I, "m": re.M, "s": re.S}.get(f, 0) for f in flags)
    return re.compile(_translate(pattern, flags, r"\Z", r"\U{:08x}"), bits)


def literal_prefix(pattern: str, flags: str = "") -> str:
    """What a matching string must begin with: the plain characters after ``^``."""
    if flags.replace("u", "") or "|" in pattern:
        return ""
    found = re.match(r"\^([A-Za-z0-9 _#:/-]+)", pattern)
    if not found:
        return ""
    text = found[1]
    return text[:-1] if pattern[len(found[0]) : len(found[0]) + 1] in ("*", "?", "{", "+") else text
