"""Functions and methods paired with their documentation.

The candidates of a file are all its comments and, in Python, the strings that
bodies begin with. A definition is linked to its own string and to every comment
that ends within ``REACH`` lines above it, whatever stands between, so a comment may
have several definitions and a definition several comments. A link's weight comes
from the lines between, the kind of comment, the parameters its tags name and the
name it mentions. The links are solved as an assignment of greatest weight, each
comment to one definition at most and each definition to one comment, by the
Hungarian method on each component; a component of more than ``SMALL`` is first cut by
fixing links that outweigh the best others of both their ends together, which belong
to a solution. An assigned link is implausible if anything but Rust attributes stands between, if the
comment is of a kind that is no documentation in the language, or if it is a notice
about the file. Of the rest, pairs without a description of their own are dropped.

Defined results: equal rows of symbols count once; a definition in a file that
does not parse is paired like any other; a row whose line is outside of the text
or whose path has no lines has no pair; an end before the start counts as the
start; a null name matches nothing, so it needs a plausible comment.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamdex.llm.byfile import SourceFile, Symbol, gathered, per_file

KINDS = ("function", "method", "generator_function_declaration")
LEAST_WORDS = 4
#: Components with no more on either side are solved as they are.
SMALL = 4
#: Lines above a definition in which a comment is a candidate.
REACH = 6


class Comment(NamedTuple):
    """Lines are 0-based; ``style`` is docstring, hash, slashes, triple, block or doc."""

    first: int
    last: int
    style: str
    body: str


_STRING = re.compile(r"[rRuU]?(?:\"\"\"(?P<a>(?:[^\\]|\\[\s\S])*?)(?:\"\"\"|\Z)|'''(?P<b>(?:[^\\]|\\[\s\S])*?)(?:'''|\Z)|\"(?P<c>(?:[^\"\\\n]|\\[\s\S])*)\"|'(?P<d>(?:[^'\\\n]|\\[\s\S])*)')")
_HEAD = re.compile(r"\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|#[^\n]*|[()\[\]{}:]")
_SKIP = re.compile(r"(?:\s|#[^\n]*(?:\n|\Z)|\\\n)*")


def docstring(lines: list[str], symbol: Symbol) -> Comment | None:
    """The first statement of a Python body, if it is a string."""
    begin = symbol.start - 1
    text = "\n".join(lines[begin : max(symbol.end, symbol.start)])
    depth = 0
    for m in _HEAD.finditer(text):
        c = m[0]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == ":" and depth <= 0:
            at = _SKIP.match(text, m.end()).end()
            found = _STRING.match(text, at)
            if not found:
                return None
            first = begin + text.count("\n", 0, at)
            body = next((g for g in found.groups() if g is not None), "")
            return Comment(first, begin + text.count("\n", 0, found.end()), "docstring", body)
    return None


def comments_of(lines: list[str], python: bool) -> list[Comment]:
    """The comments that stand on lines of their own, in order: runs of line comments, and blocks from their opening to their end."""
    out, k, n = [], 0, len(lines)
    while k < n:
        s = lines[k].strip()
        if python:
            first = k
            while k < n and lines[k].lstrip().startswith("#"):
                k += 1
            if k > first:
                out.append(Comment(first, k - 1, "hash", "\n".join(x.strip().lstrip("#") for x in lines[first:k])))
            else:
                k += 1
        elif s.startswith("//"):
            triple, first = _triple(s), k
            while k < n and (t := lines[k].strip()).startswith("//") and _triple(t) == triple:
                k += 1
            out.append(Comment(first, k - 1, "triple" if triple else "slashes", "\n".join(x.strip().lstrip("/").removeprefix("!") for x in lines[first:k])))
        elif s.startswith("/*"):
            first, at = k, lines[k].find("/*") + 2
            while k < n and (end := lines[k].find("*/", at)) < 0:
                k, at = k + 1, 0
            if k == n:  # not closed: nothing below is looked at as a comment's text
                k = first + 1
                continue
            if lines[k][end + 2 :].strip():  # code behind it
                k += 1
                continue
            text = "\n".join([lines[first].lstrip(), *lines[first + 1 : k + 1]]).strip()
            doc = len(text) > 4 and text.startswith(("/**", "/*!")) and not text.startswith(("/***", "/**/"))
            inner = text[3 if doc else 2 : -2]
            out.append(Comment(first, k, "doc" if doc else "block", "\n".join(re.sub(r"^\s*\*+ ?", "", x) if i else x for i, x in enumerate(inner.split("\n")))))
            k += 1
        else:
            k += 1
    return out


def _triple(s: str) -> bool:
    return s.startswith("///") and not s.startswith("////")


def between(lines: list[str], last: int, at: int, attributes: bool) -> int:
    """How much stands between a comment that ends on line ``last`` and a definition on line ``at``: blank lines count once, others twice, attributes not at all."""
    k, much = at - 1, 0
    while k > last:
        s = lines[k].strip()
        if attributes and (first := k if s.startswith(("#[", "#![")) else _attribute_start(lines, k) if s.endswith("]") else None) is not None and first > last:
            k = first
        else:
            much += 2 if s else 1
        k -= 1
    return much


def _attributes_above(lines: list[str], at: int) -> int:
    """The first line of the attributes right above line ``at``; ``at`` if there are none."""
    while at:
        s = lines[at - 1].strip()
        first = at - 1 if s.startswith(("#[", "#![")) else _attribute_start(lines, at - 1) if s.endswith("]") else None
        if first is None:
            break
        at = first
    return at


def _attribute_start(lines: list[str], k: int) -> int | None:
    """The first line of an attribute over several lines that ends at ``k``."""
    for first in range(k, max(-1, k - 8), -1):
        s = lines[first].strip()
        if s.startswith(("#[", "#![")):
            return first
        if s.endswith((";", "}", "{")) or s.startswith("//"):
            return None
    return None


_SECTION = re.compile(r"^(?:args?|arguments?|params?|parameters?|returns?|return value|yields?|raises?|throws?|keyword arguments|attributes|receives|warns)\s*:?\s*$", re.I)
_SECTION_INLINE = re.compile(r"^(?:args?|arguments?|params?|parameters?|returns?|yields?|raises?|throws?)\s*:\s+\S", re.I)
_FIELD = re.compile(r"^(?::(?:param|parameter|arg|argument|key|keyword|type|returns?|rtype|raises?|raise|except|exception|var|ivar|cvar|yields?|meta)\b[^:]*:|@\w+)")
_MARKUP = re.compile(r"\{@inherit[dD]oc\}|</?\w+[^>]*>")


def description(body: str, style: str) -> str:
    """The text of a comment without tags and sections on parameters and results."""
    out: list[str] = []
    skip: int | None = None
    for raw in body.replace("\t", "    ").split("\n"):
        line = raw.strip()
        indent = len(raw) - len(raw.lstrip())
        if skip is not None:
            if not line or indent > skip:
                continue
            skip = None
        if style in ("doc", "triple", "block") and line.startswith("@"):
            break
        if style == "slashes" and re.match(r"(?:go:|nolint|\+build|lint:|export )", raw):
            continue
        if re.match(r"^#+\s*(?:arguments?|parameters?|returns?|errors?|panics?|safety|examples?)\s*$", line, re.I):
            skip = -1
            continue
        if skip is None and (_SECTION.match(line) or _FIELD.match(line) or _SECTION_INLINE.match(line)):
            skip = indent
            continue
        if re.fullmatch(r"[-=~*]{3,}", line):
            if out and _SECTION.match(out[-1]):
                out.pop()
                skip = -1
            continue
        out.append(line)
    text = " ".join(x for x in out if x)
    return re.sub(r"\{@\w+\s+([^}]*)\}", r"\1", _MARKUP.sub(" ", text)).strip()


_SPLIT = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_a-zA-Z]+")
_FILLERS = {"the", "a", "an", "this", "that", "it", "function", "method"}
_LATER = re.compile(
    r"^\W*(?:(?:todo|tbd|tbc|fixme|xxx|wip|tba)\b.*\b(?:doc\w*|describe|description|write|explain|comment|fill)\b.*|(?:todo|tbd|tbc|fixme|xxx|wip|tba)\W*"
    r"|(?:docs?|documentation|description|docstring|comment)\b.*\b(?:missing|pending|later|written|inherit\w*|follows?|todo|tbd|come|coming|needed|added|above|below|elsewhere)\b.*"
    r"|(?:to be|will be|needs to be|should be|not yet)\b.*\b(?:documented|written|described|done|filled|added)\b.*|(?:add|write|needs?|missing|insert|fill in|see)\b.*\b(?:docs?|documentation|description|docstring)\b.*"
    r"|inherit\w*\b.*|see (?:above|below|the (?:super|base|parent|interface|overrid\w+)\b.*|(?:super|base|parent|overrid\w+)\b.*)|(?:same|as) (?:as|in) (?:the )?(?:super|base|parent|interface|overridden)\b.*|overrid(?:es|den|e)\b.*)$",
    re.I | re.S,
)


def words_of(name: str) -> set[str]:
    return {w.lower() for w in _SPLIT.findall(name)}


def _stem(word: str) -> str:
    return word[:-1] if len(word) > 3 and word.endswith("s") and not word.endswith("ss") else word


def trivial(text: str, name: str) -> bool:
    """Whether a description says nothing that the name does not."""
    words = [w for w in text.split() if any(c.isalnum() for c in w)]
    if len(words) < LEAST_WORDS:
        return True
    own = {_stem(w) for w in words_of(name)}
    said = {_stem(x.lower()) for w in words for x in _SPLIT.findall(w)} - _FILLERS
    if said <= own:
        return True
    return len(words) < 14 and _LATER.match(text) is not None


_NOTICE = re.compile(r"(?i)\bSPDX-|\blicen[cs]ed?\b.*\b(?:MIT|Apache|BSD|GPL|MPL|ISC)\b|\b(?:MIT|Apache|BSD|GPL|MPL|ISC)\b.*\blicen[cs]e|@license|^\W*copyright\b|\(c\) (?:19|20)\d\d|sourceMappingURL")
_PARAMS = re.compile(r"(?:@param|:param|@arg)\s+(?:\{[^}]*\}\s*)?(?:[\w.]+\s+)?(\w+)")


def _names(body: str, name: str) -> bool:
    """Whether a comment speaks of a definition by its name."""
    return bool(name) and name in body and re.search(rf"(?<![\w$]){re.escape(name)}(?![\w$])", body) is not None


def weight(comment: Comment, much: int, usable: bool, symbol: Symbol, header: str) -> float:
    """How well a comment fits a definition; one right beside it outweighs what two others can reach."""
    tags = _PARAMS.findall(comment.body)
    fit = sum(bool(re.search(rf"\b{re.escape(t)}\b", header)) for t in tags) / len(tags) - 0.25 if tags else 0.0
    if _names(comment.body, symbol.name):
        fit += 0.5
    elif symbol.name and words_of(symbol.name) & words_of(comment.body):
        fit += 0.15
    return (4.0 if usable else 2.0) + 2 * fit if not much else max(0.05, 1.0 / much + 0.5 * fit - (0.0 if usable else 0.3))


def assign(links: dict[tuple[int, int], float], solved: list[int] | None = None) -> dict[int, int]:
    """Symbol to comment with the greatest total weight, each used once at most; ``solved`` gets the sizes of the components solved by the Hungarian method."""
    out: dict[int, int] = {}
    of_symbol: dict[int, dict[int, float]] = {}
    of_comment: dict[int, dict[int, float]] = {}
    for (s, c), w in links.items():
        of_symbol.setdefault(s, {})[c] = w
        of_comment.setdefault(c, {})[s] = w
    for rows, cols in list(_components(of_symbol, of_comment)):
        if len(rows) > SMALL or len(cols) > SMALL:
            _fix(rows, of_symbol, of_comment, out)
    for rows, cols in _components(of_symbol, of_comment):
        if len(rows) == 1:
            out[rows[0]] = max(cols, key=lambda c: (links[rows[0], c], -c))
        elif len(cols) == 1:
            out[max(rows, key=lambda s: (links[s, cols[0]], -s))] = cols[0]
        else:
            out |= _hungarian(rows, cols, links)
            if solved is not None:
                solved.append(max(len(rows), len(cols)))
    return out


def _components(of_symbol: dict[int, dict[int, float]], of_comment: dict[int, dict[int, float]]) -> Iterable[tuple[list[int], list[int]]]:
    """The symbols and comments that links connect."""
    done: set[int] = set()
    for s0, mine in of_symbol.items():
        if s0 in done or not mine:
            continue
        rows, cols, queue = [], {}, [s0]
        done.add(s0)
        while queue:
            s = queue.pop()
            rows.append(s)
            for c in of_symbol[s]:
                if c not in cols:
                    cols[c] = None
                    new = [t for t in of_comment[c] if t not in done]
                    done.update(new)
                    queue += new
        yield sorted(rows), sorted(cols)


def _fix(queue: list[int], of_symbol: dict[int, dict[int, float]], of_comment: dict[int, dict[int, float]], out: dict[int, int]) -> None:
    """Takes links out of a large component that outweigh the best others of both ends together: exchanging those for it loses nothing."""
    while queue:
        s = queue.pop()
        mine = of_symbol.get(s)
        if not mine:
            continue
        c = max(mine, key=lambda k: (mine[k], -k))
        theirs = of_comment[c]
        if mine[c] < max((w for k, w in mine.items() if k != c), default=0.0) + max((w for k, w in theirs.items() if k != s), default=0.0):
            continue
        out[s] = c
        touched = set()
        for k in of_symbol.pop(s):
            others = of_comment[k]
            del others[s]
            touched |= others.keys()
        for t in of_comment.pop(c):
            del of_symbol[t][c]
        queue += sorted(touched)


def _hungarian(rows: list[int], cols: list[int], links: dict[tuple[int, int], float]) -> dict[int, int]:
    n = max(len(rows), len(cols))
    cost = [[-links.get((rows[i], cols[j]), 0.0) if i < len(rows) and j < len(cols) else 0.0 for j in range(n)] for i in range(n)]
    u, v, match, way = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = [float("inf")] * (n + 1), [False] * (n + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = match[j0], float("inf"), 0
            for j in range(1, n + 1):
                if not used[j]:
                    cur = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if cur < least[j]:
                        least[j], way[j] = cur, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(n + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    return {rows[match[j] - 1]: cols[j - 1] for j in range(1, n + 1) if match[j] <= len(rows) and j <= len(cols) and (rows[match[j] - 1], cols[j - 1]) in links}


def _first_on_line(line: str, name: str) -> bool:
    """Whether the definition of ``name`` is the first thing on its line."""
    at = line.find(name) if name else 0
    return at >= 0 and not re.search(r"[;}]", line[:at])


def pairs(f: SourceFile) -> Iterable[tuple]:
    symbols = [s for s in f.symbols if s.kind in KINDS and 1 <= s.start]
    if not symbols or not f.lines:
        return
    if f.numbers[-1] == len(f.lines) and f.numbers[0] == 1:
        lines = f.lines
    else:  # lines are missing: keep the others at their numbers
        lines = [""] * f.numbers[-1]
        for n, text in zip(f.numbers, f.lines):
            if n >= 1:
                lines[n - 1] = text
    ending = f.path.rsplit(".", 1)[-1].lower()
    python, go, rust = ending in ("py", "pyi"), ending == "go", ending == "rs"
    usable = {"slashes", "triple", "block", "doc"} if go else {"docstring", "triple", "doc"}
    comments = comments_of(lines, python)
    ends = [c.last for c in comments]
    strings: dict[Comment, int] = {}
    links: dict[tuple[int, int], float] = {}
    beside: set[tuple[int, int]] = set()
    for k, s in enumerate(symbols):
        at = s.start - 1
        if at >= len(lines):
            continue
        header = "\n".join(lines[at : min(len(lines), at + 9)])
        near = [(i, between(lines, ends[i], at, rust)) for i in range(bisect_left(ends, at - REACH), bisect_left(ends, at))]
        if rust and near == [] and at and (first := _attributes_above(lines, at)) < at - REACH:
            near = [(i, 0) for i in range(bisect_left(ends, first - 1), bisect_left(ends, first))]
        if python and (own := docstring(lines, s)):
            i = strings.setdefault(own, len(ends) + len(strings))
            if i == len(comments):
                comments.append(own)
            near.append((i, 0))
        for i, much in near:
            c = comments[i]
            fits = c.style in usable and not (python and c.style == "hash")
            links[k, i] = weight(c, much, fits, s, header) + (0.25 if _first_on_line(lines[at], s.name) else 0.0)
            if not much and fits:
                beside.add((k, i))
    for k, i in sorted(assign(links).items()):
        s, c = symbols[k], comments[i]
        if (k, i) not in beside:
            continue
        about = description(c.body, c.style)
        if trivial(about, s.name) or (_NOTICE.search(c.body) and not _names(c.body, s.name)):
            continue
        if not python and ";" in lines[s.start - 1] and not _first_on_line(lines[s.start - 1], s.name):
            continue
        yield f.path, s.name, s.kind, s.start, s.end, about, c.body, "\n".join(lines[s.start - 1 : max(s.end, s.start)])


SCHEMA = "path string, name string, kind string, start_line int, end_line int, description string, comment string, code string"
_FIELDS = [("path", pa.string()), ("name", pa.string()), ("kind", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("description", pa.string()), ("comment", pa.string()), ("code", pa.string())]


def documented(symbols: DataFrame, lines: DataFrame) -> DataFrame:
    """Code and documentation of each documented function or method."""
    wanted = symbols.where(F.col("kind").isin(*KINDS))
    return per_file(gathered(lines, symbols=wanted), pairs, SCHEMA, _FIELDS)


def found(rows: DataFrame) -> DataFrame:
    return rows.select("path", "name", "start_line").distinct()
