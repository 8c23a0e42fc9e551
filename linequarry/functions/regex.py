"""PCRE-style byte patterns as Java patterns over the byte view of a line (one character per byte)."""

from __future__ import annotations

from ..errors import QueryError
from .strategy import _class_end

BOUNDARY = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
NO_BOUNDARY = r"(?:(?<=[A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<![A-Za-z0-9_])(?![A-Za-z0-9_]))"
POSIX = {
    "alpha": r"\p{Alpha}", "digit": r"\p{Digit}", "alnum": r"\p{Alnum}", "upper": "A-Z", "lower": "a-z", "punct": r"\p{Punct}",
    "graph": r"\p{Graph}", "print": r"\p{Print}", "blank": r"\p{Blank}", "cntrl": r"\p{Cntrl}", "xdigit": r"\p{XDigit}", "space": r"\s", "word": r"\w",
}


class NeedsFallback(Exception):
    """Java has no such construct; the Python engine has."""


def byte_view(text: str) -> str:
    return text.encode().decode("latin-1")


def _class(body: str) -> str:
    """One bracket class: nested brackets and && lose the meaning that only Java gives them."""
    out, i = "[", 1
    if body[i : i + 1] == "^":
        out, i = "[^", 2
    if body[i : i + 1] == "]" and len(body) > i + 1:
        out, i = out + r"\]", i + 1
    end = len(body) - 1
    while i < end:
        if body[i] == "\\":
            n = body[i + 1 : i + 2]
            out += r"\x08" if n == "b" else body[i : i + 2]
            i += 2
        elif body.startswith("[:", i) and ":]" in body[i + 2 :]:
            stop = body.index(":]", i + 2)
            name = body[i + 2 : stop]
            no = name.startswith("^")
            known = POSIX.get(name.removeprefix("^"))
            if known is None:
                raise QueryError("bad_regex", f"unknown class [:{name}:]")
            out += f"[^{known}]" if no else known  # ranges, because Java folds no property
            i = stop + 2
        elif body[i] in "[&~":
            out += "\\" + body[i]
            i += 1
        else:
            out += body[i]
            i += 1
    return out + "]"


def to_java(pattern: str) -> str:
    """Raises NeedsFallback for recursion, \\K, conditionals and verbs."""
    p, out, i = byte_view(pattern), "(?d)", 0
    while i < len(p):
        c = p[i]
        if c == "\\":
            n = p[i + 1 : i + 2]
            if not n:
                raise QueryError("bad_regex", "the pattern ends in a backslash")
            if n == "K" or n == "g":
                raise NeedsFallback(pattern)
            out += BOUNDARY if n == "b" else NO_BOUNDARY if n == "B" else p[i : i + 2]
            i += 2
        elif c == "[":
            j = _class_end(p, i)
            if p[j - 1 : j] != "]" or j - i < 2:
                raise QueryError("bad_regex", "a class is not closed")
            out += _class(p[i:j])
            i = j
        elif p.startswith("(?P<", i):
            out += "(?<"
            i += 4
        elif p.startswith("(?P=", i):
            end = p.find(")", i)
            out += rf"\k<{p[i + 4 : end]}>"
            i = end + 1
        elif p.startswith(("(?P>", "(?R)", "(?&", "(?(", "(*"), i) or (p.startswith("(?", i) and p[i + 2 : i + 3].isdigit()):
            raise NeedsFallback(pattern)
        else:
            out += c
            i += 1
    return out
