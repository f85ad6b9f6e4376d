"""Path patterns as anchored regular expressions that run inside Spark's generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPECIAL = set("\\.+^$()|[]{}*?")


def quoted(c: str) -> str:
    return "\\" + c if c in SPECIAL else c


def to_regex(glob: str) -> str:
    """``*`` and ``?`` stay inside a path segment, ``**`` spans segments, ``{a,b}`` and ``[a-z]`` as usual; invalid patterns raise ValueError."""
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**", i) and glob[i - 1 : i] in ("", "/") and glob[i + 2 : i + 3] in ("", "/"):
            if i + 2 == len(glob):
                # A trailing /** also takes the folder itself.
                if out and out[-1] == "/":
                    out[-1] = "(?s:(?:/.*)?)"
                else:
                    out.append("(?s:.*)")
                i += 2
            else:
                out.append("(?:[^/]*/)*")
                i += 3
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            end = glob.find("]", i + 2)
            if end < 0:
                raise ValueError(f"unclosed class in glob {glob!r}")
            body = glob[i + 1 : end]
            if any(b > c for b, h, c in zip(body, body[1:], body[2:]) if h == "-"):
                raise ValueError(f"reversed range in glob {glob!r}")
            negated = body[0] in "!^"
            body = body[negated:].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&").replace("^", "\\^")
            out.append(f"[^/{body}]" if negated else f"[{body}]")
            i = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "\\":
            if i + 1 == len(glob):
                raise ValueError(f"trailing backslash in glob {glob!r}")
            i += 1
            out.append(quoted(glob[i]))
        else:
            out.append(quoted(c))
        i += 1
    if depth:
        raise ValueError(f"unclosed brace in glob {glob!r}")
    return "\\A" + "".join(out) + "\\z"


def matches_any(path: Column, globs: list[str] | tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (path.rlike(to_regex(g)) for g in globs), F.lit(False))


def split_glob(glob: str) -> tuple[str, str]:
    """``(prefix, kind)``: the whole segments that a pattern begins with and that hold no wildcard, and what has to be done with the rest: ``exact``
    (there is none), ``below`` (everything from there on) or ``regex``."""
    segments = glob.split("/")
    plain = 0
    while plain < len(segments) and not any(c in "*?[{\\" for c in segments[plain]):
        plain += 1
    prefix, rest = segments[:plain], segments[plain:]
    kind = "exact" if not rest else "below" if rest == ["**"] and all(prefix) else "regex"
    return "/".join(prefix), kind


def prefixes(path: Column) -> Column:
    """What :func:`split_glob` can give for a pattern that matches ``path``: nothing, and its first segments, one by one up to all."""
    parts = F.split(path, "/", -1)
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))
