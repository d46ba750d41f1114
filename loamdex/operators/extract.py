"""Definitions of source texts: the rows of the symbol table.

Python is read with its own parser. For the other languages comments and strings
are blanked, definitions are found by one expression each, and a definition ends
with the bracket that closes its body. Texts that do not parse give what can be
found in them.
"""

from __future__ import annotations

import ast
import re
import warnings
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The label of each kind of definition.
KIND_LABEL = {
    "function_definition": "function",
    "function_declaration": "function",
    "function_item": "function",
    "method_declaration": "method",
    "method_definition": "method",
    "method": "method",
    "class_definition": "class",
    "class_declaration": "class",
    "class_specifier": "class",
    "struct_item": "struct",
    "struct_specifier": "struct",
    "struct_declaration": "struct",
    "interface_declaration": "interface",
    "trait_item": "trait",
    "enum_item": "enum",
    "enum_specifier": "enum",
    "enum_declaration": "enum",
    "type_alias_declaration": "type",
    "type_declaration": "type",
    "impl_item": "impl",
    "mod_item": "module",
    "module": "module",
    "object_declaration": "object",
    "record_declaration": "record",
    "constructor_declaration": "constructor",
    "annotation_type_declaration": "annotation",
}


class Definition(NamedTuple):
    name: str
    kind: str
    start_line: int
    end_line: int


def label(node_type: str) -> str:
    return KIND_LABEL.get(node_type, node_type)


_C_NOISE = re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.){1,8}'|`(?:[^`\\]|\\[\s\S])*`")
_HASH_NOISE = re.compile(r"#[^\n]*|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'")
_LUA_NOISE = re.compile(r"--\[\[[\s\S]*?\]\]|--[^\n]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'")


def blanked(text: str, noise: re.Pattern) -> str:
    """The text with comments and strings replaced by as many blanks; line ends stay."""
    return noise.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|async|override|virtual|partial|readonly|unsafe|extern|open|data|inner|inline|suspend|export|default|declare|native|synchronized|strictfp|new|const)\s+)*"
_WORDS_NOT_NAMES = frozenset("if for while switch catch return else do try new throw sizeof await yield typeof function match when synchronized using lock foreach in case".split())

#: For each language: (node type, expression with the name in a group).
_RULES: dict[str, list[tuple[str, re.Pattern]]] = {}


def _rules(language: str, *pairs: tuple[str, str]) -> None:
    _RULES[language] = [(kind, re.compile(expression, re.M)) for kind, expression in pairs]


_SCRIPT_RULES = (
    ("generator_function_declaration", r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*\s*(?P<n>[\w$]+)"),
    ("function_declaration", r"(?:^|[;}])[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+(?P<n>[\w$]+)"),
    ("class_declaration", rf"^[ \t]*{_MODS}class\s+(?P<n>[\w$]+)"),
)
_TYPE_RULES = (
    ("interface_declaration", r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:declare\s+)?interface\s+(?P<n>\w+)"),
    ("type_alias_declaration", r"^[ \t]*(?:export\s+)?(?:declare\s+)?type\s+(?P<n>\w+)\s*(?:<[^=\n]*>)?\s*="),
    ("enum_declaration", r"^[ \t]*(?:export\s+)?(?:declare\s+)?(?:const\s+)?enum\s+(?P<n>\w+)"),
)
_METHOD = ("method_definition", r"^[ \t]+(?:(?:public|private|protected|static|async|override|readonly|abstract|get|set)\s+)*\*?\s*(?P<n>[\w$#]+)\s*(?:<[^>\n]*>)?\([^;{}]*?\)\s*(?::[^;{}=]+)?\{")
_rules("javascript", *_SCRIPT_RULES, _METHOD)
_rules("typescript", *_SCRIPT_RULES[1:], *_TYPE_RULES, _METHOD)
_RULES["tsx"] = _RULES["typescript"]
_rules("rust", ("function_item", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:default\s+|const\s+|async\s+|unsafe\s+|extern\s+(?:\"[^\"]*\"\s+)?)*fn\s+(?P<n>\w+)"), ("struct_item", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?struct\s+(?P<n>\w+)"),
       ("enum_item", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?enum\s+(?P<n>\w+)"), ("trait_item", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(?P<n>\w+)"),
       ("impl_item", r"^[ \t]*(?:unsafe\s+)?impl\s*(?:<[^>{]*>)?\s*(?:!?[\w:]+(?:<[^{]*?>)?\s+for\s+)?&?(?P<n>\w+)"), ("mod_item", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?mod\s+(?P<n>\w+)"))
_rules("go", ("function_declaration", r"^func\s+(?P<n>\w+)"), ("method_declaration", r"^func\s*\([^)]*\)\s*(?P<n>\w+)"), ("type_declaration", r"^type\s+(?P<n>\w+)"))
#: Annotations on the line of a Java definition; those on lines above are found from there.
_JAVA_MODS = _MODS.replace("(?:(?:public", r"(?:@(?!interface\b)[\w.]+(?:\([^()\n]*\))?[ \t]+|(?:public", 1)[:-1] + "*+"
_JAVA_TYPE = r"(?!(?:return|new|throw|else|case|assert|yield|package|import)\b)(?:<[^>(){}]*>\s*)?[\w.]+(?:\s*<[^(){};=]*>)?(?:\s*\[\s*\])*"
_rules("java", ("class_declaration", rf"^[ \t]*{_JAVA_MODS}class\s+(?P<n>\w+)"), ("annotation_type_declaration", rf"^[ \t]*{_JAVA_MODS}@interface\s+(?P<n>\w+)"), ("interface_declaration", rf"^[ \t]*{_JAVA_MODS}(?<!@)interface\s+(?P<n>\w+)"),
       ("enum_declaration", rf"^[ \t]*{_JAVA_MODS}enum\s+(?P<n>\w+)"), ("record_declaration", rf"^[ \t]*{_JAVA_MODS}record\s+(?P<n>\w+)\s*(?:<[^>]*>)?\("), ("method_declaration", rf"^[ \t]*{_JAVA_MODS}{_JAVA_TYPE}\s+(?P<n>\w+)\s*\([^;{{}}=]*?\)\s*(?:throws\s+[\w.,\s]+)?[{{;]"),
       ("constructor_declaration", rf"^[ \t]*{_JAVA_MODS}(?P<n>[A-Z]\w*)\s*\([^;{{}}=]*?\)\s*(?:throws\s+[\w.,\s]+)?\{{"))
_rules("kotlin", ("function_declaration", rf"^[ \t]*{_MODS}(?:operator\s+|infix\s+|tailrec\s+)*fun\s+(?:<[^>]*>\s*)?(?:[\w.<>?]+\.)?(?P<n>\w+)\s*\("), ("class_declaration", rf"^[ \t]*{_MODS}(?:enum\s+|annotation\s+|value\s+)?(?:class|interface)\s+(?P<n>\w+)"), ("object_declaration", rf"^[ \t]*{_MODS}(?:companion\s+)?object\s+(?P<n>\w+)"))
_C_FUNCTION = r"^[ \t]*(?!return\b|else\b|typedef\b)(?:[A-Za-z_][\w:<>,~]*[\s*&]+)+(?:[\w:]+::)?(?P<n>~?[A-Za-z_]\w*)\s*\([^;{}=]*\)\s*(?:const\s*|noexcept\s*|override\s*)*\{"
_rules("c", ("function_definition", _C_FUNCTION), ("struct_specifier", r"\bstruct\s+(?P<n>\w+)\s*\{"), ("enum_specifier", r"\benum\s+(?P<n>\w+)\s*\{"))
_rules("cpp", ("function_definition", _C_FUNCTION), ("class_specifier", r"\bclass\s+(?P<n>\w+)[^;{()]*\{"), ("struct_specifier", r"\bstruct\s+(?P<n>\w+)[^;{()]*\{"), ("enum_specifier", r"\benum\s+(?:class\s+)?(?P<n>\w+)[^;{]*\{"))
_rules("c_sharp", ("method_declaration", rf"^[ \t]*{_MODS}{_JAVA_TYPE}\??\s+(?P<n>\w+)\s*(?:<[^>]*>)?\([^;{{}}]*?\)\s*(?:where[^{{]*)?(?:\{{|=>)"), ("class_declaration", rf"^[ \t]*{_MODS}class\s+(?P<n>\w+)"), ("interface_declaration", rf"^[ \t]*{_MODS}interface\s+(?P<n>\w+)"), ("struct_declaration", rf"^[ \t]*{_MODS}struct\s+(?P<n>\w+)"), ("enum_declaration", rf"^[ \t]*{_MODS}enum\s+(?P<n>\w+)"))
_rules("ruby", ("method", r"^[ \t]*def\s+(?:self\.)?(?P<n>[\w?!=]+)"), ("class", r"^[ \t]*class\s+(?P<n>[A-Z]\w*)"), ("module", r"^[ \t]*module\s+(?P<n>[A-Z]\w*)"))
_rules("php", ("function_definition", r"^function\s+&?(?P<n>\w+)"), ("class_declaration", rf"^[ \t]*{_MODS}class\s+(?P<n>\w+)"), ("method_declaration", r"^[ \t]+(?:(?:public|private|protected|static|final|abstract)\s+)*function\s+&?(?P<n>\w+)"), ("interface_declaration", r"^[ \t]*interface\s+(?P<n>\w+)"))
_rules("lua", ("function_declaration", r"^[ \t]*(?:local\s+)?function\s+(?P<n>[\w.:]+)"))
_KEYWORD_BLOCKS = {"ruby": (r"^\s*(?:def|class|module|if|unless|case|while|until|begin|for)\b|\bdo\b(?:\s*\|[^|]*\|)?\s*$", r"^\s*end\b"), "lua": (r"\b(?:function|then|do|repeat)\b", r"\b(?:end|until)\b")}


def _python(text: str) -> list[Definition]:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return _indented(text)
    out = []
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            kind = "class_definition" if isinstance(node, ast.ClassDef) else "function_definition"
            out.append(Definition(node.name, label(kind), node.lineno, node.end_lineno or node.lineno))
    return sorted(out, key=lambda d: (d.start_line, -d.end_line, d.name))


def _indented(text: str) -> list[Definition]:
    """What a Python text that does not parse still shows, by indentation."""
    lines, out = text.split("\n"), []
    for i, line in enumerate(lines):
        m = re.match(r"(\s*)(?:async\s+)?(def|class)\s+(\w+)", line)
        if m:
            end = i
            for j in range(i + 1, len(lines)):
                if lines[j].strip():
                    if len(lines[j]) - len(lines[j].lstrip()) <= len(m[1]):
                        break
                    end = j
            out.append(Definition(m[3], label("class_definition" if m[2] == "class" else "function_definition"), i + 1, end + 1))
    return out


def _annotated_from(lines: list[str], first: int) -> int:
    """The first line (1-based) of the annotations right above a definition."""
    while first > 1:
        k = first - 2
        depth = lines[k].count(")") - lines[k].count("(")
        while depth > 0 and k > 0 and first - k < 40:  # arguments over several lines
            k -= 1
            depth += lines[k].count(")") - lines[k].count("(")
        s = lines[k].strip()
        if not s.startswith("@") or s.startswith("@interface") or depth or lines[first - 2].rstrip().endswith((";", "{", "}")):
            return first
        first = k + 1
    return first


def extract(text: str, language: str | None) -> list[Definition]:
    """The definitions of a text in order of their start; none for languages without rules."""
    if not text or language is None:
        return []
    if language == "python":
        return _python(text)
    if language not in _RULES:
        return []
    noise = _HASH_NOISE if language == "ruby" else _LUA_NOISE if language == "lua" else _C_NOISE
    clean = blanked(text, noise)
    starts = [0] + [m.end() for m in re.finditer("\n", text)]
    closes = None if language in _KEYWORD_BLOCKS else _brackets(clean)
    lines = clean.split("\n")
    seen: dict[tuple[str, int], Definition] = {}
    for kind, rule in _RULES[language]:
        for m in rule.finditer(clean):
            name = m["n"]
            if name in _WORDS_NOT_NAMES:
                continue
            begin = m.start() + len(m[0]) - len(m[0].lstrip(" \t\n;}"))
            end = _keyword_end(clean, m.start(), language) if closes is None else _end(clean, m, closes)
            first, last = bisect_right(starts, begin), bisect_right(starts, end)
            if language == "java":
                first = _annotated_from(lines, first)
            seen.setdefault((name, first), Definition(name, label(kind), first, max(first, last)))
    return sorted(seen.values(), key=lambda d: (d.start_line, -d.end_line, d.name))


def _brackets(clean: str) -> dict[int, int]:
    out, stack = {}, []
    for m in re.finditer(r"[{}]", clean):
        if m[0] == "{":
            stack.append(m.start())
        elif stack:
            out[stack.pop()] = m.start()
    return out


def _end(clean: str, m: re.Match, closes: dict[int, int]) -> int:
    """Where a definition ends: its bracket's end, or the semicolon or line before one."""
    at = m.end() - 1 if clean[m.end() - 1] in "{;" else None
    if at is None:
        depth = 0
        for k in range(m.end(), len(clean)):
            c = clean[k]
            if c in "([":
                depth += 1
            elif c in ")]":
                depth -= 1
            elif depth <= 0 and (c in "{;" or (c == "\n" and k + 1 < len(clean) and not clean[k + 1].isspace() and clean[k + 1] not in "{.|&")):
                at = k
                break
        else:
            return len(clean) - 1
    return closes.get(at, len(clean) - 1) if clean[at] == "{" else at - (clean[at] == "\n")


def _keyword_end(clean: str, begin: int, language: str) -> int:
    opens, ends = (re.compile(x, re.M) for x in _KEYWORD_BLOCKS[language])
    depth, at = 0, begin
    for line in clean[begin:].split("\n"):
        depth += len(opens.findall(line)) - len(ends.findall(line))
        at += len(line) + 1
        if depth <= 0:
            return at - 2 if at - 2 >= begin else begin
    return len(clean) - 1


SCHEMA = "path string, name string, kind string, start_line int, end_line int"
_ARROW = pa.schema([("path", pa.string()), ("name", pa.string()), ("kind", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32())])


def symbols_of(files: DataFrame) -> DataFrame:
    """The symbol table of ``files`` (path, lang, text); runs where the rows are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, *d) for p, lang, text in zip(*(c.to_pylist() for c in batch.columns)) for d in extract(text or "", lang)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)

    return files.where(F.col("path").isNotNull()).select("path", "lang", "text").mapInArrow(run, SCHEMA)


def symbols_of_lines(lines: DataFrame, languages: DataFrame) -> DataFrame:
    """The symbol table of files given as ``lines`` (path, line, content) and ``languages`` (path, lang).

    One shuffle brings a file's lines together in order; equal rows count once, and
    files stream through one at a time.
    """
    rows = lines.select("path", F.col("line").cast("int").alias("line"), F.coalesce("content", F.lit("")).alias("content")).unionByName(languages.select("path", F.lit(None).cast("int").alias("line"), F.col("lang").alias("content")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, lang, held, last = None, None, [], None

        def flush() -> Iterator[pa.RecordBatch]:
            found = [(at, *d) for d in extract("\n".join(held), lang)] if lang else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), _ARROW)], schema=_ARROW)

        for batch in batches:
            for path, line, content in zip(*(c.to_pylist() for c in batch.columns)):
                if path != at:
                    yield from flush()
                    at, lang, held, last = path, None, [], None
                if line is None:
                    lang = content
                elif (line, content) != last:
                    held.append(content)
                    last = (line, content)
        yield from flush()

    return rows.where(F.col("path").isNotNull()).repartition("path").sortWithinPartitions("path", F.col("line").asc_nulls_first(), "content").mapInArrow(run, SCHEMA)
