"""Python regular expressions and replacement texts in Java's syntax.

Known difference that stays: Java's Unicode ``\\w`` also has combining marks.
"""

from __future__ import annotations

import re

#: Unicode classes, and "." that stops at a newline only.
FLAGS = "(?Ud)"


def pattern(p: str) -> str:
    """The Java pattern for a Python pattern for str."""
    out, i, in_class = [], 0, False
    while i < len(p):
        c = p[i]
        if c == "\\" and i + 1 < len(p):
            two = p[i : i + 2]
            out.append({"\\Z": "\\z"}.get(two, two) if not in_class else two)
            i += 2
            continue
        if in_class:
            if c == "]":
                in_class = False
                out.append(c)
            elif c in "[&":  # Java has nested classes and intersections
                out.append("\\" + c)
            else:
                out.append(c)
            i += 1
            continue
        if c == "[":
            in_class = True
            out.append(c)
            i += 1
            if p[i : i + 1] == "^":
                out.append("^")
                i += 1
            if p[i : i + 1] == "]":
                out.append("\\]")
                i += 1
            continue
        if p.startswith("(?P<", i):
            out.append("(?<")
            i += 4
            continue
        if p.startswith("(?P=", i):
            end = p.index(")", i)
            out.append(f"\\k<{p[i + 4 : end]}>")
            i = end + 1
            continue
        if c == "{" and re.match(r"\{,\d+\}", p[i:]):
            out.append("{0")
            i += 1
            continue
        out.append(c)
        i += 1
    return FLAGS + "".join(out)


def full(p: str) -> str:
    """Matches whole strings only; ``$`` would also match before a newline at the end."""
    return FLAGS + "^(?:" + pattern(p)[len(FLAGS) :] + ")\\z"


def replacement(r: str) -> str:
    """The Java replacement for a Python replacement."""
    out, i = [], 0
    while i < len(r):
        c = r[i]
        if c == "\\" and i + 1 < len(r):
            m = re.match(r"\\(?:(\d{1,2})|g<(\w+)>)", r[i:])
            if m:
                name = m.group(1) or m.group(2)
                out.append(f"${name}" if name.isdigit() else f"${{{name}}}")
                i += m.end()
                continue
            plain = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\\\"}.get(r[i + 1])
            if plain is None:
                raise ValueError(f"bad escape in replacement: {r[i : i + 2]!r}")
            out.append(plain)
            i += 2
            continue
        out.append("\\$" if c == "$" else c)
        i += 1
    return "".join(out)


def groups(p: str) -> int:
    return re.compile(p).groups
