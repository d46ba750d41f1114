"""Ignore patterns and path filters, compiled on the driver to regular expressions.

``*`` and ``?`` stay within a path component, ``**/`` spans folders, ``**`` spans
anything, and all else is literal (there are no character classes). A pattern
with a slash before its end is anchored at the root, others match at any depth; a
pattern that matches a folder matches all below it. A trailing slash means folders
only, so it matches no file by itself. Blank, comment and negated patterns are
left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

_META = set("\\.^$|()[]{}+*?")


def body_of(pattern: str) -> str:
    """The expression of one pattern without anchors."""
    out, rest = [], pattern
    while rest:
        for sign, expression in (("**/", "(?:.*/)?"), ("**", ".*"), ("*", "[^/]*"), ("?", "[^/]")):
            if rest.startswith(sign):
                out.append(expression)
                rest = rest[len(sign) :]
                break
        else:
            c, rest = rest[0], rest[1:]
            out.append("\\" + c if c in _META else c)
    return "".join(out)


def compiled(pattern: str) -> tuple[str, bool] | None:
    """(anchored expression, folders only), or None for a pattern that says nothing."""
    text = pattern.rstrip()
    if not text or text[0] in "#!":
        return None
    folders = text.endswith("/")
    text = text.rstrip("/") if folders else text
    if not text:
        return None
    rooted = "/" in text
    core = body_of(text.lstrip("/") if text.startswith("/") else text)
    return f"^{'' if rooted else '(?:.*/)?'}{core}(?:/.*)?$", folders


def file_expressions(patterns: Iterable[str] | None) -> list[str]:
    """The expressions that can match files."""
    return [e for e, folders in filter(None, map(compiled, patterns or ())) if not folders]


def any_match(path: Column, patterns: Iterable[str] | None) -> Column:
    """Whether any pattern matches a file's path; false for no usable pattern."""
    expressions = file_expressions(patterns)
    return path.rlike("|".join(f"(?:{e})" for e in expressions)) if expressions else F.lit(False)


def folder_matches(path: str, patterns: Iterable[str] | None) -> bool:
    """Whether a folder is ignored; for walking a tree on one machine."""
    return any(re.match(e, path if not folders else path) for e, folders in filter(None, map(compiled, patterns or ())))


def as_patterns(value: str | Iterable[str] | None) -> list[str] | None:
    """An argument of a search: comma-separated text or a list, blanks dropped."""
    if value is None:
        return None
    parts = value.split(",") if isinstance(value, str) else list(value)
    return [p.strip() for p in parts if p and p.strip()] or None


def literal_prefix(pattern: str) -> str:
    """What every path a rooted pattern matches begins with; lets a filter reach the scan."""
    text = pattern.strip()
    if "/" not in text.rstrip("/"):
        return ""
    head = re.split(r"[*?]", text.lstrip("/"), maxsplit=1)
    return head[0] if len(head) == 2 else ""


def path_filter(path: Column, include: str | Iterable[str] | None = None, exclude: str | Iterable[str] | None = None) -> Column:
    """Kept: matched by an include pattern, if there are any, and by no exclude pattern."""
    included, excluded = as_patterns(include), as_patterns(exclude)
    keep = F.lit(True)
    if included:
        keep = any_match(path, included)
        prefixes = {literal_prefix(p) for p in included}
        if len(prefixes) == 1 and (prefix := prefixes.pop()):
            keep = path.startswith(prefix) & keep
    return keep & ~any_match(path, excluded) if excluded else keep
