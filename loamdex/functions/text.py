"""Lines, tokens, names of paths: expressions that stay in the JVM."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_END = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"


def lines_of(text: Column) -> Column:
    """Lines as Python's ``splitlines`` gives them: no empty line after the last end."""
    parts = F.split(text, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


@cache
def fold_tables() -> tuple[str, str]:
    """Characters and what they fold to, by rule: lower case, and letters with a
    single mark lose it; marks U+0300 to U+0331 vanish (they have no counterpart)."""
    source, target = [], []
    for o in (*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x1F00)):
        c = chr(o)
        low = c.lower() if len(c.lower()) == 1 else c
        parts = unicodedata.normalize("NFD", low)
        base = parts[0] if len(parts) == 2 and unicodedata.category(parts[1]) == "Mn" and unicodedata.category(low).startswith("L") and len(unicodedata.normalize("NFD", parts[0])) == 1 else low
        base = {"ς": "σ", "ſ": "s"}.get(base, base)
        if base != c:
            source.append(c)
            target.append(base)
    source.append("µ")
    target.append("μ")
    return "".join(source) + "".join(map(chr, range(0x300, 0x332))), "".join(target)


def folded(text: Column) -> Column:
    source, target = fold_tables()
    return F.translate(F.lower(text), source, target)


def tokens(text: Column) -> Column:
    """Runs of letters, digits and private characters, folded; null has none."""
    return F.regexp_extract_all(folded(F.coalesce(text, F.lit(""))), F.lit("([\\p{L}\\p{N}\\p{Co}]+)"), F.lit(1))


def suffix(path: Column) -> Column:
    """The extension with its dot, in lower case; none for names that begin with their only dot."""
    return F.lower(F.regexp_extract(path, r"(?:^|/)[^/]*[^/.](?:\.*)(\.[^/.]+)$", 1))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(value: Column) -> Column:
    return F.translate(value, _UPPER, _LOWER)


def contains_like(value: Column, text: str) -> Column:
    """``LIKE '%text%'`` with ASCII case folded; ``%`` and ``_`` in the text are wild, a backslash is not."""
    return ascii_lower(value).like("%" + text.translate(str.maketrans(_UPPER, _LOWER)).replace("\\", "\\\\") + "%")


def stripped(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def url_uuid(text: Column) -> Column:
    """The version 5 UUID of a text in the URL namespace, as 32 hex digits."""
    h = F.substring(F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), F.encode(text, "UTF-8"))), 1, 32)
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("bigint").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(F.substring(h, 1, 12), F.lit("5"), F.substring(h, 14, 3), variant, F.substring(h, 18, 15))


def project_id(name: Column, path: Column) -> Column:
    """A folder's identity: its sanitised name and the start of its path's SHA-1."""
    clean = F.regexp_replace(name, r"[^\p{L}\p{N}_-]", "_")
    return F.concat(F.when(F.length(name) > 0, clean).otherwise(F.lit("root")), F.lit("_"), F.substring(F.sha1(path.cast("binary")), 1, 12))
