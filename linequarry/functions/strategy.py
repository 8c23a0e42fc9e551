"""What a regular expression needs: tokens, classification, literal parts.

Escaped letters and digits are classes, anchors or control characters, so only
an escaped mark stands for itself.  ``tokens`` is the one place that knows the
syntax; the rest is written over its output.
"""

from __future__ import annotations

from dataclasses import dataclass

META = set(".^$*+?()[]{}|\\")
DECOMPOSED = "regex_decomposition_candidate_lines"


@dataclass(frozen=True)
class Token:
    kind: str  # char, any, class, escape, anchor, group, bar, meta (a mark where it has no meaning)
    text: str  # the character itself for char, else the source
    least: int = 1  # repetitions
    most: int | None = 1


def split_fold(pattern: str) -> tuple[bool, str]:
    """(whether it starts with an inline case flag, the rest)."""
    return (True, pattern[4:]) if pattern.startswith("(?i)") else (False, pattern)


def _class_end(p: str, i: int) -> int:
    j = i + 1
    if p[j : j + 1] == "^":
        j += 1
    if p[j : j + 1] == "]":
        j += 1
    while j < len(p) and p[j] != "]":
        if p[j] == "\\":
            j += 1
        elif p.startswith("[:", j) and ":]" in p[j + 2 :]:
            j = p.index(":]", j + 2) + 1
        j += 1
    return min(j + 1, len(p))


def _group_end(p: str, i: int) -> int:
    depth, j = 0, i
    while j < len(p):
        if p[j] == "\\":
            j += 1
        elif p[j] == "[":
            j = _class_end(p, j) - 1
        elif p[j] == "(":
            depth += 1
        elif p[j] == ")":
            depth -= 1
            if not depth:
                return j + 1
        j += 1
    return len(p)


def _repeat(p: str, i: int) -> tuple[int, int | None, int]:
    """(least, most, end) of the quantifier at i, if any; lazy and possessive marks belong to it."""
    least, most, j = 1, 1, i
    c = p[i : i + 1]
    if c == "?":
        least, most, j = 0, 1, i + 1
    elif c == "*":
        least, most, j = 0, None, i + 1
    elif c == "+":
        least, most, j = 1, None, i + 1
    elif c == "{":
        end = p.find("}", i)
        body = p[i + 1 : end] if end > 0 else ""
        a, comma, b = body.partition(",")
        if (a.isdigit() or (not a and comma and b.isdigit())) and (not b or b.isdigit()):
            least = int(a or 0)
            most = (int(b) if b else None) if comma else least
            j = end + 1
    if j > i and p[j : j + 1] in ("?", "+"):
        j += 1
    return least, most, j


def tokens(p: str) -> list[Token]:
    out, i = [], 0
    while i < len(p):
        c = p[i]
        if c == "\\":
            n = p[i + 1 : i + 2]
            if n == "x" and len(p) >= i + 4:
                kind, text, j = "escape", p[i : i + 4], i + 4
            elif n and n in "bBAzZG":
                kind, text, j = "anchor", p[i : i + 2], i + 2
            elif n and not n.isalnum():
                kind, text, j = "char", n, i + 2
            else:
                kind, text, j = "escape", p[i : i + 2], i + 2
        elif c == "[":
            j = _class_end(p, i)
            kind, text = "class", p[i:j]
        elif c == "(":
            j = _group_end(p, i)
            kind, text = "group", p[i:j]
        elif c == "|":
            kind, text, j = "bar", c, i + 1
        elif c in "^$":
            kind, text, j = "anchor", c, i + 1
        elif c == ".":
            kind, text, j = "any", c, i + 1
        else:
            kind, text, j = ("meta" if c in META else "char"), c, i + 1
        least, most, end = (1, 1, j) if kind == "bar" else _repeat(p, j)
        out.append(Token(kind, text, least, most))
        i = end
    return out


def plain_literal(p: str) -> str | None:
    """The text that p stands for if it is nothing but a literal."""
    got = tokens(p)
    if not got or any(t.kind != "char" or (t.least, t.most) != (1, 1) for t in got):
        return None
    return "".join(t.text for t in got)


def branches(p: str) -> list[str]:
    """Top-level alternatives."""
    out, start, i = [], 0, 0
    while i < len(p):
        if p[i] == "\\":
            i += 1
        elif p[i] == "[":
            i = _class_end(p, i) - 1
        elif p[i] == "(":
            i = _group_end(p, i) - 1
        elif p[i] == "|":
            out.append(p[start:i])
            start = i + 1
        i += 1
    return [*out, p[start:]]


def word_literal(p: str) -> str | None:
    """The literal between two word boundaries."""
    if len(p) > 4 and p.startswith(r"\b") and p.endswith(r"\b"):
        return plain_literal(p[2:-2])
    return None


def alternates(p: str) -> list[str] | None:
    got = [plain_literal(b) for b in branches(p)]
    return got if len(got) > 1 and None not in got else None


def is_decomposed(pattern: str) -> bool:
    body = split_fold(pattern)[1]
    return r"\w+\s+" in body and r"\s+\w+" in body


def classify(pattern: str) -> str:
    fold, body = split_fold(pattern)
    if word_literal(body) is not None:
        return "regex_ascii_casefold_word_boundary_literal" if fold else "regex_word_boundary_literal"
    if not fold and alternates(body):
        return "regex_literal_alternates"
    if plain_literal(body) is not None:
        return "regex_ascii_casefold_literal" if fold else "regex_plain_literal"
    got = tokens(body)
    if got and all(t.kind in ("char", "any", "class", "escape", "anchor") and t.least == t.most for t in got):
        return "regex_fixed_width_bytes"
    return DECOMPOSED if is_decomposed(body) else "regex_full"


def longest_fragment(pattern: str) -> str:
    """The longest text that every match must hold; empty with a case flag or top-level alternatives."""
    fold, body = split_fold(pattern)
    if fold or "(?" in body or len(branches(body)) > 1:
        return ""
    best, run = "", ""
    for t in tokens(body):
        if t.kind == "char" and t.least >= 1:
            run += t.text
            if len(run) > len(best):
                best = run
            if (t.least, t.most) != (1, 1):
                run = t.text if t.least == t.most == 1 else ""
        elif t.kind != "anchor":
            run = ""
    return best


def mandatory_prefix(pattern: str) -> str:
    """Literal text at the start of every match (after leading anchors)."""
    fold, body = split_fold(pattern)
    if fold or len(branches(body)) > 1:
        return ""
    out = ""
    for t in tokens(body):
        if t.kind == "anchor" and not out:
            continue
        if t.kind != "char" or (t.least, t.most) != (1, 1):
            break
        out += t.text
    return out
