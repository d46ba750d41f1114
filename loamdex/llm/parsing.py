"""Source files whose text is invalid in their language.

Each current file is parsed against every supported grammar, and ``accepted`` has
the languages it parses in. It is invalid if its own is not among them. Of the others
that accept it, the one its tokens fit best says that its extension is wrong; if
there is none, the text is corrupt. A text without a token that tells a language
(comments and blanks, plain data) is never taken for that one.

Defined results: the current row of a path is the one with the greatest mtime;
paths without a row in the files table, and rows with other or null languages,
are not judged; a path without lines has the empty text, which is valid
except in JSON. Nesting has no limit but in Python, where what its own parser refuses as too
deep is invalid.
"""

from __future__ import annotations

import ast
import json
import re
import warnings
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamdex.llm.byfile import SourceFile, gathered, per_file

LANGUAGES = ("python", "java", "typescript", "javascript", "go", "rust", "c", "json")
#: Tokens that tell languages apart (words, and marks that one language writes).
MARKS = {
    "python": "def elif self import None True False lambda except raise pass with yield ):",
    "java": "public private protected static final class void extends implements throws package import new @Override",
    "typescript": "interface type export const readonly string number boolean any => import implements enum",
    "javascript": "function const let var => require module exports async export import undefined ===",
    "go": "func package := chan defer struct range nil import go interface",
    "rust": "fn let mut impl pub use match crate -> :: &str self",
    "c": "#include #define struct static void char int unsigned -> typedef sizeof",
    "json": '": {" "},',
}
_WORDS = re.compile(r"[#@&]?[A-Za-z_]\w*|:=|=>|->|::|===|\):|\":|\{\"|\"\}|\},")


def ranked(text: str, own: str) -> list[str]:
    """The other languages of which the text has any tokens, best fit first; ties by name."""
    seen = set(_WORDS.findall(text))
    fit = {}
    for lang, marks in MARKS.items():
        marks = marks.split()
        fit[lang] = sum(m in seen for m in marks) / len(marks)
    return sorted((x for x in LANGUAGES if x != own and fit[x] > 0), key=lambda x: (-fit[x], x))


def _no_constant(name: str):
    raise ValueError(name)


_JSON = re.compile(r'[ \t\n\r]*(?:([\[\]{},:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null))', re.A)


def _deep_json(text: str) -> bool:
    """Strict JSON of any depth, by a stack of open brackets and what may come next."""
    open_, want, at = [], "value", 0  # want: value, first (value or ]), key, name (key or }), colon, more (comma or closing)
    end = len(text.rstrip(" \t\n\r"))
    while at < end:
        m = _JSON.match(text, at, end)
        if not m:
            return False
        at, mark, string = m.end(), m[1], m[2]
        if want in ("value", "first"):
            if mark in ("[", "{"):
                open_.append(mark)
                want = "first" if mark == "[" else "name"
                continue
            if mark == "]" and want == "first":
                open_.pop()
            elif mark:
                return False
        elif want in ("key", "name"):
            if string:
                want = "colon"
                continue
            if mark != "}" or want == "key":
                return False
            open_.pop()
        elif want == "colon":
            if mark != ":":
                return False
            want = "value"
            continue
        elif not open_:
            return False
        elif mark == ",":
            want = "value" if open_[-1] == "[" else "key"
            continue
        elif mark == ("]" if open_[-1] == "[" else "}"):
            open_.pop()
        else:
            return False
        want = "more"
    return not open_ and want == "more"


def parses(text: str, lang: str) -> bool:
    if lang == "python":
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            try:
                compile(text.removeprefix("﻿"), "", "exec", ast.PyCF_ONLY_AST)
            except (SyntaxError, ValueError, RecursionError, MemoryError):
                return False
        return True
    if lang == "json":
        try:
            json.loads(text, parse_constant=_no_constant)
        except ValueError:
            return False
        except RecursionError:
            return _deep_json(text)
        return True
    from loamdex.llm.grammars import GRAMMARS

    return GRAMMARS[lang].parses(text)


_COMMENTS = re.compile(r"//[^\n]*|#[^\n]*|/\*[\s\S]*?\*/|\s+")


def grammars(text: str) -> list[str]:
    """All supported languages the text parses in."""
    return [lang for lang in LANGUAGES if parses(text, lang)]


def judge(text: str, lang: str, accepted: list[str] | None = None) -> tuple[bool, str | None, str | None]:
    """(invalid, cause, language it parses in), of what ``grammars`` says of the text."""
    if accepted is None:
        accepted = grammars(text)
    if lang in accepted:
        return False, None, None
    if accepted and _COMMENTS.sub("", text):
        for other in ranked(text, lang):
            if other in accepted:
                return True, "wrong extension", other
    return True, "corrupt", None


def _file(f: SourceFile) -> Iterable[tuple]:
    now = f.current
    if now is not None and now.lang in LANGUAGES:
        text = f.text
        accepted = grammars(text)
        yield (f.path, f.service, now.lang, *judge(text, now.lang, accepted), accepted)


SCHEMA = "path string, service_id string, lang string, invalid boolean, cause string, parses_as string, accepted array<string>"
_FIELDS = [("path", pa.string()), ("service_id", pa.string()), ("lang", pa.string()), ("invalid", pa.bool_()), ("cause", pa.string()), ("parses_as", pa.string()), ("accepted", pa.list_(pa.string()))]


def parsed(files: DataFrame, lines: DataFrame) -> DataFrame:
    """A row for each current file in a supported language."""
    return per_file(gathered(lines, files), _file, SCHEMA, _FIELDS)


def found(rows: DataFrame) -> DataFrame:
    return rows.where("invalid").select("path").distinct()


def rates(rows: DataFrame) -> DataFrame:
    """The rate of invalid files of each service and language, and of what causes."""
    bad = F.sum(F.col("invalid").cast("int"))
    return rows.groupBy("service_id", "lang").agg(
        F.count("*").alias("files"), bad.alias("invalid_files"), (bad / F.count("*")).alias("invalid_rate"),
        F.sum((F.col("cause") == "wrong extension").cast("int")).alias("wrong_extension"), F.sum((F.col("cause") == "corrupt").cast("int")).alias("corrupt"),
    )
