"""Parsers for brace languages, by folding brackets from the inside.

A text is cut into tokens by one pattern and each token becomes one character of
a code string: a letter for identifiers, literals and operators of a kind, a
private character for each keyword. Then every bracket, innermost first, is
matched against what may stand in brackets of its shape (a block, a class body,
arguments, parameters ...) and replaced by a short word of fixed length that says
which of these it is. What may stand between brackets is a regular language once
the brackets in it are such words, so each is one compiled pattern; the
file is valid if the string that is left matches the pattern for files. Contents
are remembered, so that code of a known shape is never matched twice.

Code letters: i name, 0 number, s string, c character, t template, R regular
expression, l lifetime, d '.', p '+' '-', m '*', q '?', o '|', x '^', % '%' '/',
b comparison or logic, a compound assignment, u '++' '--', r '->', f '=>', n '::',
e '...', y '..', w ':=', h '<-', L end of line, E folded operand, G type arguments.
"""

from __future__ import annotations

import re
from itertools import islice

NAMES = r"[^\W\d][\w$]*|[$][\w$]*"
_OPERATORS = {
    ".": "d", "+": "p", "-": "p", "*": "m", "?": "q", "|": "o", "^": "x", "%": "%", "/": "%", "++": "u", "--": "u",
    "->": "r", "=>": "f", "::": "n", "...": "e", "..": "y", "..=": "y", ":=": "w", "<-": "h", "?.": "d",
    **dict.fromkeys(("==", "!=", "===", "!==", "<=", ">=", "&&", "||", "**", "??", "<<", "&^"), "b"),
    **dict.fromkeys(("+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", ">>>=", "**=", "&&=", "||=", "??=", "&^="), "a"),
}
_MARKERS = r"^(?:<{7}|={7}|>{7}|\|{7})(?=[ \t\r]|$)"
_JUNK = "\x00"
_KEYWORD_BASE = 0x80
_STARTS = {"(": "\x01", "[": "\x02", "{": "\x03"}
_SHAPES = {"(": 0, "[": 1, "{": 2}
_CLOSES = {")": "(", "]": "[", "}": "{"}
#: Tokens after which a file is asked, before the others are cut, whether it can begin so.
_FIRST = 24


class _Codes(dict):
    """Token to code character; unknown tokens are classified once."""

    def __init__(self, classify, known: dict[str, str]):
        super().__init__(known)
        self.classify, self.known = classify, known

    def __missing__(self, token: str) -> str:
        if len(self) > 200_000:
            self.clear()
            self.update(self.known)
        code = self.classify(token)
        if len(token) <= 64:  # long ones are comments and texts, seldom seen again
            self[token] = code
        return code


class Grammar:
    """A language: how to cut tokens, and what may stand in brackets and files."""

    def __init__(self, name: str, keywords: str, tokens: str, rules: dict[str, str], shapes: dict[str, list[str]], folds: dict[str, str], generics: str | None = None, lines=None, operators: str = "", literals=None):
        self.name = name
        self.lines, self.literals = lines, literals or {}
        words = keywords.split()
        self.keywords = {w: chr(_KEYWORD_BASE + k) for k, w in enumerate(words)}
        order = sorted((o for o in _OPERATORS if len(o) > 1 and o not in operators.split()), key=len, reverse=True)
        self.token = re.compile("|".join([_MARKERS, tokens, NAMES, r"\.?[0-9](?:[eEpP][+-]|\.(?!\.)|['\w])*", *map(re.escape, order), r"\n" if lines else r"(?!)", r"[^\s]"]), re.M)
        self.shapes = shapes
        self.classes: dict[str, str] = {}
        for shape, names in shapes.items():
            for k, n in enumerate(names):
                self.classes[n] = self.folded(shape, n)
        self.rules = rules
        self.texts: dict[str, str] = {}
        self.patterns: dict[str, re.Pattern] = {}
        self.folds = folds
        self.generic = None
        self._generics = generics
        self.known: dict[str, str] = {}
        self.held = 0
        self.aliens: re.Pattern | None = None
        self.codes = _Codes(self.classify, {**_OPERATORS, **{c: c for c in "&!~=:;,@#<>()[]{}\n"}, **self.keywords, "\n": "L"})

    def folded(self, shape: str, name: str | None = None, without: str | None = None) -> str:
        """The pattern of a folded bracket that may be a ``name``, and may not be a ``without``."""
        return "(?:" + _STARTS[shape] + "".join("1" if n == name else "_" if n == without else "." for n in self.shapes[shape]) + ")"

    def classify(self, token: str) -> str:
        if len(token) >= 7 and token[0] in "<=>|" and len(set(token)) == 1:
            return _JUNK
        if token.startswith(("//", "/*")) and len(token) > 1:
            return "" if token.startswith("//") or (len(token) > 3 and token.endswith("*/")) else _JUNK
        for start, code in self.literals.items():
            if token.startswith(start) and (len(token) > 1 or start == token):
                if code == "":
                    return ""
                if len(token) > len(start) or code == _JUNK:
                    return code
        c = token[0]
        if c == "'" and token[1:].isidentifier():
            return "l"
        if c == '"' or c == "'" or c == "`":
            return ("s" if c == '"' else "c" if c == "'" else "t") if len(token) > 1 and token[-1] == c else _JUNK
        if c.isdigit() or (c == "." and len(token) > 1 and token[1].isdigit()):
            return "0" if re.fullmatch(r"0[xX][\da-fA-F_']+\w*|0[bBoO][\d_']+\w*|(?:\d[\d_']*)?\.?\d*[\d_']*(?:[eEpP][+-]?[\d_]+)?[a-zA-Z]\w*|(?:\d[\d_']*)?\.?[\d_']*(?:[eEpP][+-]?[\d_]+)?", token) else _JUNK
        if c.isalpha() or c in "_$":
            return "i"
        return _JUNK

    def source(self, name: str) -> str:
        """A rule's pattern with names and keywords put in."""
        if name not in self.texts:
            if name in self.classes and name not in self.rules:
                self.texts[name] = self.classes[name]
            else:
                text = re.sub(r"\s+", "", self.rules[name])
                text = re.sub(r"'([^']+)'", lambda m: self.keywords[m[1]], text)
                self.texts[name] = "(?:" + re.sub(r"\{(\w+)\}", lambda m: self.classes[m[1]] if m[1] in self.classes else self.source(m[1]), text) + ")"
        return self.texts[name]

    def pattern(self, name: str) -> re.Pattern:
        if name not in self.patterns:
            self.patterns[name] = re.compile("(?:" + re.sub(r"\{(\w+)\}", lambda m: self.classes[m[1]] if m[1] in self.classes else self.source(m[1]), re.sub(r"'([^']+)'", lambda m: self.keywords[m[1]], re.sub(r"\s+", "", self.rules[name]))) + ")")
        return self.patterns[name]

    def atom(self, shape: str, content: str) -> str:
        key = shape + content
        got = self.known.get(key)
        if got is None:
            names = self.shapes[shape]
            plain = self.typed(content) if self._generics and "<" in content and ">" in content else content
            folded: dict[str, str] = {}
            mask = ["_"] * len(names)
            if _JUNK not in content:
                for k, n in enumerate(names):
                    how = self.folds.get(n, self.folds.get("", ""))
                    if how not in folded:
                        folded[how] = self.fold(how, plain)
                    if self.pattern(n + "_").fullmatch(folded[how]):
                        mask[k] = "1"
            self.held += len(content)
            if len(self.known) > 300_000 or self.held > 30_000_000:
                self.known.clear()
                self.held = 0
            got = self.known[key] = _STARTS[shape] + "".join(mask)
        return got

    def fold(self, how: str, content: str) -> str:
        """Applies the steps ``how`` names: operands and the like become one letter each."""
        for step in how.split():
            rule, letter = step.split(">")
            content = self.pattern(rule).sub(letter, content)
        return content

    def typed(self, content: str) -> str:
        """Type arguments and parameters, innermost first, as single letters."""
        if self.generic is None:
            self.generic = re.compile(re.sub(r"\{(\w+)\}", lambda m: self.classes[m[1]] if m[1] in self.classes else self.source(m[1]), re.sub(r"'([^']+)'", lambda m: self.keywords[m[1]], re.sub(r"\s+", "", self._generics))))
        n = 1
        while n:  # each round shortens the content
            content, n = self.generic.subn("G", content)
        return content

    def encode(self, tokens: list[str]) -> str:
        return "".join(map(self.codes.__getitem__, tokens))

    def alien(self) -> re.Pattern:
        """Tokens that stand in no rule, so in no file."""
        used = "".join([*map(self.source, self.rules), *self.keywords.values(), self._generics or "", "()[]{}<>L"])
        if "[^\x00]" in used:  # a macro is given any tokens
            return re.compile(_JUNK)
        return re.compile(f"[^{re.escape(''.join(sorted(set(used))))}]")

    def begins(self, code: str) -> bool:
        """False if no file has or begins with the tokens of ``code``."""
        if self.aliens is None:
            self.aliens = self.alien()
        if self.aliens.search(code):
            return False
        return self.pattern("begin").match(self.lines(self, code) if self.lines else code) is not None

    def parses(self, text: str) -> bool:
        first = list(islice(self.token.finditer(text), _FIRST))
        code = self.encode([m[0] for m in first])
        if not self.begins(code):
            return False
        if len(first) == _FIRST:
            code += self.encode(self.token.findall(text, first[-1].end()))
            if not self.begins(code):
                return False
        if self.lines:
            code = self.lines(self, code)
        parts: list[str] = []
        stack: list[tuple[str, list[str]]] = []
        for piece in re.split(r"([()\[\]{}])", code):
            if piece in _SHAPES:
                stack.append((piece, parts))
                parts = []
            elif piece in _CLOSES and piece:
                if not stack or stack[-1][0] != _CLOSES[piece]:
                    return False
                shape, outer = stack.pop()
                atom = self.atom(shape, "".join(parts))
                if "1" not in atom:
                    return False
                parts = outer
                parts.append(atom)
            elif piece:
                parts.append(piece)
        if stack:
            return False
        rest = "".join(parts)
        if self._generics and "<" in rest:
            rest = self.typed(rest)
        if "file" in self.folds:
            rest = self.fold(self.folds["file"], rest)
        return self.pattern("file_").fullmatch(rest) is not None


# ---------------------------------------------------------------- Java

_JAVA = Grammar(
    "java",
    "abstract assert boolean break byte case catch char class continue default do double else enum extends final finally float for if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null record permits yield sealed",
    r'"""[\s\S]*?"""|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)+\'|//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|\b(?:record(?=\s+[A-Z]\w*\s*[(<])|yield(?=\s+[\w"(])|sealed(?=\s+(?:class|interface|abstract|public))|permits(?=\s+\w+[\s,{]))\b|non-sealed|(?<![\w.$])(?:record|yield|sealed|permits)(?![\w$])',
    {
        "prim": "'boolean'|'byte'|'char'|'double'|'float'|'int'|'long'|'short'|'void'",
        "anno": "@i(?:di)*(?:{args})?",
        "mods": "(?:'public'|'private'|'protected'|'static'|'final'|'abstract'|'native'|'synchronized'|'transient'|'volatile'|'strictfp'|'default'|'sealed'|{anno})*",
        "name": "i(?:di)*",
        "type": "(?:{anno})*(?:{prim}|iG?(?:diG?)*){empty}*",
        "types": "{type}(?:,{type})*",
        "new": "'new'(?:{prim}|iG?(?:diG?)*)(?:{args}{cbody}?|(?:{expr}|{empty})+{init}?)",
        "post": "(?:d(?:G?i|'this'|'super'|'class'|{new})|{args}|{expr}|u|nG?(?:i|'new'))",
        "primary_": "(?:{new}|i(?:di)*(?:{args}|{expr}|nG?(?:i|'new'))|(?:{prim}|iG?(?:di)*){empty}*(?:d'class'|n(?:i|'new'))|iGn(?:i|'new')|(?<=[=(,:qrpm%&oxb<>a!'return''yield''throw'])'switch'{pexpr}{sw}|'this'|'super'|'null'|'true'|'false'|0|s|c|{pexpr}(?!r|[isc0]|'new'|'this'|'null'|{cast}|{pexpr}|!|~)){post}*",
        "lam": "(?:(?:i|{params})r)",
        "unary": "{lam}*(?:[p!~u]|{cast})*(?:i(?:di)*|E|{pexpr})u*|{lam}+{block}",
        "chain": "{unary}(?:(?:[pm%&oxb=a]|<|>{1,3})(?:{unary})|'instanceof'(?:'final')?{type}(?:i|{params})?)*",
        "ex": "(?:{chain}(?:q{chain}:{chain})*|'switch'E{sw})",
        "full": "(?:[p!~u]|{cast}|{lam})*(?:{block}|(?:{new}|i(?:di)*|0|s|c|'this'|'super'|'null'|'true'|'false'|{pexpr}|'switch'{pexpr}{sw}|{prim}{empty}*){post}*)(?:(?:[pm%&oxbq:=a]|<|>{1,3}|'instanceof')(?:[p!~u]|{cast}|{lam})*(?:{block}|(?:{new}|i(?:di)*G?|0|s|c|'this'|'null'|'true'|'false'|{pexpr}|{prim}{empty}*){post}*))*",
        "decl": "i{empty}*(?:=(?:{ex}|{init}))?",
        "head": "(?:'if'E|'while'E|'for'{forh}|i:|(?:(?<=;)|(?<={block}))'else')",
        "typedecl": "{mods}(?:'class'iG?(?:'extends'{type})?(?:'implements'{types})?(?:'permits'{types})?{cbody}|@?'interface'iG?(?:'extends'{types})?(?:'permits'{types})?{cbody}|'enum'i(?:'implements'{types})?{ebody}|'record'iG?{params}(?:'implements'{types})?{cbody})",
        "stmt": "(?:{head}*(?:;|{block}|(?:{anno}|'final')*{type}{decl}(?:,{decl})*;|{ex};|'return'(?:{ex})?;|'throw'{ex};|'yield'{ex};|'break'i?;|'continue'i?;|'do'(?:{block}|{ex};)'while'E;|'try'(?:{res}|E)?{block}(?:'catch'(?:{params}|E){block})*(?:'finally'{block})?|'switch'E{sw};?|'synchronized'E{block}|'assert'{ex}(?::{ex})?;|{typedecl}))",
        "block_": "(?>{stmt})*",
        "sw_": "(?:(?:'case'(?:{ex}(?:,{ex})*|{type}i)(?:i{pexpr})?|'default')(?::(?>{stmt})*|r(?:{block}|{ex};|'throw'{ex};)))*",
        "cbody_": "(?>;|'static'?{block}|{typedecl}|{mods}G?{type}i{params}{empty}*(?:'throws'{types})?(?:{block}|(?:'default'(?:{full}|{init}))?;)|{mods}G?i(?:{params})?(?:'throws'{types})?{block}|{mods}{type}i{empty}*(?:=(?:{full}|{init}))?(?:,i{empty}*(?:=(?:{full}|{init}))?)*;)*",
        "ebody_": "(?:{anno}*i{args}?{cbody}?(?:,{anno}*i{args}?{cbody}?)*,?)?(?:;(?>;|'static'?{block}|{typedecl}|{mods}G?{type}i{params}{empty}*(?:'throws'{types})?(?:{block}|;)|{mods}G?i{params}(?:'throws'{types})?{block}|{mods}{type}i{empty}*(?:=(?:{full}|{init}))?(?:,i{empty}*(?:=(?:{full}|{init}))?)*;)*)?",
        "init_": "(?:(?:{ex}|{init}|{anno})(?:,(?:{ex}|{init}|{anno}))*,?)?",
        "args_": "(?:(?:{ex}|{init}|{anno})(?:,(?:{ex}|{init}|{anno}))*)?|i=(?:{ex}|{init}|{anno})(?:,i=(?:{ex}|{init}|{anno}))*",
        "pexpr_": "{ex}",
        "params_": "(?:(?:'final'|{anno})*{type}(?:o{type})*e?(?:i|'this'){empty}*(?:,(?:'final'|{anno})*{type}e?i{empty}*)*|i(?:,i)*)?",
        "cast_": "{type}(?:&{type})*",
        "forh_": "(?:(?:'final'|{anno})*{type}{decl}(?:,{decl})*|{ex}(?:,{ex})*)?;(?:{ex})?;(?:{ex}(?:,{ex})*)?|(?:'final'|{anno})*{type}i:{ex}",
        "res_": "(?:(?:'final')?{type}i={ex}|{ex})(?:;(?:(?:'final')?{type}i={ex}|{ex}))*;?",
        "expr_": "{ex}",
        "empty_": "",
        "file_": "(?:(?:{anno})*'package'{name};)?(?:'import''static'?{name}(?:dm)?;|;)*(?:{typedecl};?)*",
        "begin": "(?:;|'package'{name};|'import''static'?{name}(?:dm)?;)*(?:$|[@'public''private''protected''static''final''abstract''native''synchronized''transient''volatile''strictfp''default''sealed''class''interface''enum''record']|(?:'package'|'import''static'?)(?:{name}(?:dm?)?)?$)",
    },
    {"(": ["args", "pexpr", "params", "cast", "forh", "res"], "[": ["expr", "empty"], "{": ["block", "cbody", "ebody", "init", "sw"]},
    {"block": "primary_>E", "sw": "primary_>E", "init": "primary_>E", "args": "primary_>E", "pexpr": "primary_>E", "forh": "primary_>E", "res": "primary_>E", "expr": "primary_>E"},
    generics="<(?:(?:{anno})*(?:(?:{prim}|iG?(?:diG?)*){empty}*|q)(?:(?:'extends'|'super')(?:{prim}|iG?(?:diG?)*){empty}*(?:&iG?(?:diG?)*)*)?(?:,(?:{anno})*(?:(?:{prim}|iG?(?:diG?)*){empty}*|q)(?:(?:'extends'|'super')(?:{prim}|iG?(?:diG?)*){empty}*(?:&iG?(?:diG?)*)*)?)*)?>",
)

# ---------------------------------------------------------------- JavaScript and TypeScript


def _script_lines(g: Grammar, code: str) -> str:
    """Keeps the ends of lines that end a statement."""
    if not hasattr(g, "_ends"):
        k = g.keywords
        opens = "".join(k[w] for w in "new typeof delete void const let var function class extends import export if else in of instanceof case async await throw from as static public private protected readonly abstract get set declare interface type enum namespace".split() if w in k and w not in ("get", "set", "type", "from", "as", "of", "async", "static", "declare", "namespace", "readonly", "abstract"))
        nexts = "".join(k[w] for w in ("instanceof", "in", "catch", "finally", "of") if w in k)
        g._ends = re.compile(rf"L+(?=[d,=ab?)\]}}:;q&oxm%<>fp(\[t{nexts}]|$)|(?<=[d,=ab(\[{{:;q&oxm%<fp!~{opens}])L+|^L+")
    return re.sub("L+", "L", g._ends.sub("", code))


_SCRIPT_WORDS = "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof let new return super switch this throw try typeof var void while with yield async await of static get set from as null true false undefined"
_TYPE_WORDS = " type interface enum implements abstract public private protected readonly declare namespace module keyof infer is asserts override unique satisfies"
_SCRIPT_TOKENS = (
    r'"(?:[^"\\\n]|\\[\s\S])*"|\'(?:[^\'\\\n]|\\[\s\S])*\'|`(?:[^`\\]|\\[\s\S])*`|//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|(?<![\w$)\]}])\#!\S[^\n]*'
    r"|(?:(?<=[=(,:\[!&|?{};+>\n])|(?<=[=(,:\[!&|?{};+>] )|(?<=return )|(?<=case ))/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[dgimsuvy]*"
    r"|#(?=[A-Za-z_$])[\w$]+"
)
_WORDY = "i|'async'|'of'|'get'|'set'|'from'|'as'|'static'|'undefined'|'let'|'await'|'yield'"
_SCRIPT = {
    "id": "[{idc}]",
    "any": "[i{allkw}]",
    "key": "(?:{any}|s|c|0|E|{arr})",
    "post": "(?:d(?:{any}|{args}|{expr})|{args}|{expr}|t|!(?![=b])|G(?={args}))",
    "func": "[UW]",
    "klass": "C",
    "func_": "'async'?'function'm?{id}G?{params}{ret}?L?{block}",
    "nameless_": "'async'?'function'm?G?{params}{ret}?L?{block}",
    "klass_": "'class'{id}?G?(?:'extends'(?:{id}|'null')(?:d{any})*{args}?G?)?{impl}?L?{cbody}",
    "lit0": "['this''super''null''true''false'0sctR]",
    "primary_": "(?>(?:(?<=[=,:?pm%&oxbqa<>!~fe{callkw}])(?:{func}|{klass})|'new'(?:{id}|'this'|{pexpr}|{func})(?:d{any})*G?{args}?|'new'd{any}|(?:'import'|'super'){args}|'import'd{any}|(?<!'function')(?<!'function'm){id}(?:d{any}|t|!(?=[d]))*G?(?:d?{args}|d?{expr})(?!{ret}?f)|(?:{lit0})(?={post})|(?<![{headkw}])(?<!'function'[{idc}])(?<!'function'm[{idc}])(?<!'function')(?<!'function'm)(?<!G){pexpr}(?={post})|{arr}(?!=)(?={post})){post}*+)",
    "lam": "F",
    "lam_": "'async'?G?(?:{id}|{params}{ret}?)f",
    "pre": "(?:[p!~uG]|'typeof'|'void'|'delete'|'await'|'yield'm?|{lam})",
    "opd": "(?:{id}(?:d{any}|!)*|E|{lit0}|{pexpr}|{arr}|{obj}|{func}|{klass})",
    "unary": "(?>{pre}*{lam}{block}|{pre}*{opd}(?:u|{post})*|'yield')",
    "chain": "(?:{unary})(?:(?:[pm%&oxb=a]|<|>{1,3}|'instanceof'|'in')(?:{unary}))*",
    "ex": "{chain}(?:q{chain}:{chain}(?:q{chain}:{chain})*)?",
    "exs": "{ex}(?:,{ex})*",
    "end": "(?:[;L]|$)",
    "bind": "(?:{id}|{arr}|{obj}|E)!?{ann}?",
    "vars": "(?:'const'|'let'|'var'){bind}(?:=(?:{ex}))?(?:,{bind}(?:=(?:{ex}))?)*",
    "head": "(?:'if'{pexpr}L?|'while'{pexpr}L?|'for''await'?{forh}L?|i:|(?:(?<=[;L])|(?<={block}))'else'L?|'with'{pexpr})",
    "named": "{names}|m(?:'as'{id})?",
    "mod": "'import'(?:{typew}?(?:{id}(?:,(?:{names}|m'as'{id}))?|{names}|m'as'{id})'from')?[scE](?:'with'{obj})?{end}|'export'(?:{typew}?(?:{names}|m(?:'as'{any})?)(?:'from'[scE])?{end}|'default'(?:{func}|'async'?'function'm?G?{params}{ret}?{block}|{abs}?{klass}|{ex}{end})|)",
    "abs": "",
    "stmt": "(?:{head}*(?:[;L]|{block}|{vars}{end}|U|{klass}|(?![W\x03]){exs}{end}|'return'(?:{exs})?{end}|'throw'{exs}{end}|'break'{id}?{end}|'continue'{id}?{end}|'debugger'{end}|'do'L?(?:{block}|{exs}[;L])L?'while'{pexpr}{end}?|'try'L?{block}L?(?:'catch'{params}?L?{block}L?)?(?:'finally'L?{block})?|'switch'{pexpr}L?{sw})|{more}|{mod})",
    "more": "(?!)",
    "block_": "(?>{stmt})*",
    "sw_": "L?(?:(?:'case'{exs}|'default'):(?>(?!'case'|'default'){stmt})*)*",
    "obj_": "(?:L?(?:e(?:{ex})|{key}:(?:{ex})|{id}(?:=(?:{ex}))?|(?:'async'?m?|'get'|'set')(?:{key}G?{params}{ret}?|E){block})(?:,L?(?:e(?:{ex})|{key}:(?:{ex})|{id}(?:=(?:{ex}))?|(?:'async'?m?|'get'|'set')(?:{key}G?{params}{ret}?|E){block}))*,?)?",
    "cbody_": "(?>[;L]|{deco}|'static'{block}|{cmods}(?:(?:'async'?m?|'get'|'set'){key}q?G?{params}{ret}?(?:L?{block}|{bodiless})|{key}[q!]?{ann}?(?:=(?:{full}))?{end}|{sig}))*",
    "deco": "@(?:i(?:di)*{args}?|E)",
    "cmods": "(?:'static'(?!=|{params}))?",
    "bodiless": "(?!)",
    "sig": "(?!)",
    "fopd": "(?:{func}|{klass}|'new'(?:{id}|'this')(?:d{any})*G?{args}?|{id}|'this'|'super'|'null'|'true'|'false'|0|s|c|t|R|{pexpr}|{arr}|{obj})(?:{post})*u?|{lam}{block}",
    "full": "{pre}*(?:{fopd})(?:(?:[pm%&oxbqa=:]|<|>{1,3}|'instanceof'|'in'){pre}*(?:{fopd}))*",
    "names_": "(?:L?{typew}?(?:{any}|s|c)(?:'as'(?:{any}|s|c))?(?:,L?{typew}?(?:{any}|s|c)(?:'as'(?:{any}|s|c))?)*,?)?",
    "arr_": ",*(?:(?:e?{ex})?(?:,+(?:e?{ex}))*),*",
    "expr_": "{exs}",
    "args_": "(?:e?{ex}(?:,e?{ex})*,?)?",
    "pexpr_": "{exs}",
    "params_": "(?:{par}(?:,{par})*,?)?",
    "par": "{pdeco}*{pmods}(?:e?(?:{id}|'this'|{arr}|{obj})q?{ann}?(?:=(?:{full}))?)",
    "pdeco": "{deco}",
    "pmods": "",
    "forh_": "(?:{vars}|{exs})?;(?:{exs})?;(?:{exs})?|(?:(?:'const'|'let'|'var'){bind}|{opd})(?:'of'|'in'){exs}",
    "file_": "(?>{stmt})*",
    "begin": "(?![^@]*?ii)",  # names stand side by side only after a decorator
}


def _script(name: str, types: bool) -> Grammar:
    rules = dict(_SCRIPT)
    rules["idw"] = _WORDY + ("|'type'|'declare'|'namespace'|'module'|'is'|'asserts'|'override'|'readonly'|'abstract'|'keyof'|'infer'|'unique'|'satisfies'|'public'|'private'|'protected'" if types else "")
    rules |= {"typew": "(?:'type'(?!'from'|,))" if types else "(?:(?!))", "ret": "(?::{tret})" if types else "(?:(?!))", "ann": "(?::{type})" if types else "(?:(?!))", "impl": "(?:'implements'{types})" if types else "(?:(?!))"}
    rules["cast_"] = "(?<!['import''export',m])(?:'as'|'satisfies')(?:'const'|{type})" if types else "(?!)"
    shapes = {"(": ["args", "pexpr", "params", "forh"], "[": ["arr", "expr"], "{": ["block", "obj", "cbody", "names", "sw"]}
    if types:
        rules |= {
            "lit": "[sct0'true''false''null''void''this']|p0",
            "tatom": "['keyof''readonly''unique''infer']*(?:'typeof'?{id}(?:d{any})*G?|'typeof'?'import'{args}(?:d{any})*G?|{lit}|{tparen}|{tbody}|{ttuple})(?:{ttuple})*",
            "tfun": "(?:'abstract'?'new'?(?:F|G?{params}f))",
            "type": "{tfun}*[o&]?{tatom}(?:[o&]{tfun}*{tatom})*(?:'extends'{tatom}(?:[o&]{tatom})*q{tfun}*{tatom}(?:[o&]{tatom})*:[o&]?{tfun}*{tatom}(?:[o&]{tatom})*)*",
            "tret": "(?:'asserts'?(?:{id}|'this')'is')?{type}|'asserts'(?:{id}|'this')",
            "types": "{type}(?:,{type})*",
            "tparen_": "{type}",
            "ttuple_": "(?:e?(?:{id}q?:)?{type}q?(?:,e?(?:{id}q?:)?{type}q?)*,?)?",
            "ixsig_": "{id}:{type}|{id}'in'{type}(?:'as'{type})?",
            "mem": "(?:(?:[p]?'readonly'(?!q?[:;,L]))?(?:{ixsig}(?:[p]?q)?{ann}?|(?:'get'|'set')?{key}q?(?:G?{params}{ret}?|{ann})?|'new'?G?{params}{ret}?))",
            "tbody_": "[L]?(?:{mem}(?:[;,L]+|$))*",
            "ebody_": "(?:L?(?:{any}|s|c)(?:={full})?(?:,L?(?:{any}|s|c)(?:={full})?)*,?)?L?",
            "typedecl": "{tmods}(?:'interface'{id}G?(?:'extends'{types})?L?{tbody}|'type'{id}G?={type}{end}|'const'?'enum'{id}L?{ebody}|(?:'namespace'|'module')(?:{id}(?:d{id})*|s|c)L?{block}|'abstract'{klass}|'function'm?{id}G?{params}{ret}?{end}|(?<='declare'){vars}{end}|(?<='declare'){klass}|{deco}L?)",
            "tmods": "(?:'declare')?",
            "more": "{typedecl}",
            "abs": "(?:'abstract')",
            "cmods": "(?:(?:'public'|'private'|'protected'|'static'|'readonly'|'abstract'|'override'|'declare')(?![q!]?[=:;,L]|{params}|$))*",
            "bodiless": "{end}",
            "sig": "{ixsig}{ann}?{end}",
            "pmods": "(?:(?:'public'|'private'|'protected'|'readonly'|'override')(?![q,:=]|$))*",
        }
        shapes["("].append("tparen")
        shapes["["] += ["ttuple", "ixsig"]
        shapes["{"] += ["tbody", "ebody"]
    generic = None
    if types:
        generic = r"<(?:'const')?{type}(?:'extends'{type})?(?:={type})?(?:,{type}(?:'extends'{type})?(?:={type})?)*,?>(?=[dt,;:L=&oq>f]|{args}|{params}|{ttuple}|{tbody}|{cbody}|{block}|'implements'|'extends'|$)|(?<=[=(,])<{type}>"
    early = "lam_>F func_>U nameless_>W klass_>C"
    folds = dict.fromkeys(("block", "sw", "obj", "arr", "expr", "args", "pexpr", "forh", "file"), (early + " cast_>" if types else early) + " primary_>E") | {"": early}
    g = Grammar(name, _SCRIPT_WORDS + (_TYPE_WORDS if types else ""), _SCRIPT_TOKENS, rules, shapes, folds, generics=generic, lines=_script_lines, literals={"/": "R", "#!": "", "#": "i"})
    g.classes["headkw"] = "".join(g.keywords[w] for w in "if while for switch with catch await".split())
    g.classes["idc"] = "i" + "".join(g.keywords[w] for w in re.findall(r"'(\w+)'", rules["idw"]) if w in g.keywords)
    g.classes["callkw"] = "".join(g.keywords[w] for w in "return new typeof void delete await yield in of instanceof throw case".split())
    del g.rules["idw"]
    g.classes["allkw"] = "".join(g.keywords.values())
    return g


_JS = _script("javascript", False)
_TS = _script("typescript", True)

# ---------------------------------------------------------------- Go


def _go_lines(g: Grammar, code: str) -> str:
    """A line that ends in an operand or a closing bracket ends in a semicolon."""
    k = g.keywords
    ends = "".join(k[w] for w in ("break", "continue", "fallthrough", "return"))
    return re.sub(rf"(?<=[i0sctu)\]}}{ends}])L", ";", code).replace("L", "")


_GO = Grammar(
    "go",
    "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    r'"(?:[^"\\\n]|\\.)*"|`[^`]*`|\'(?:[^\'\\\n]|\\[^\n])[^\'\n]*\'|//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|~',
    {
        "qual": "i(?:di)?(?:{targs}(?!{empty}))?",
        "pre": "(?:[m]|{empty}|{idx}|'chan'h?|h'chan'|'map'{idx}|{arre})",
        "type": "{pre}*(?:i(?:di)?{targs}?|'struct'{sbody}|'interface'{ibody}|'func'{params}(?:{res})?|{ptype})",
        "res": "{params}|{pre}*(?:i(?:di)?{targs}?|'interface'{ibody}|'struct'{sbody}|'func'{params})",
        "flit": "'func'{params}(?:{res})?{block}",
        "clit": "i(?:di)?{onlylit}|{pre}+i(?:di)?{lit}|{pre}*(?:i(?:di)?{targs}|'struct'{sbody}){lit}|(?:'map'{idx}|{empty}|{idx}|{arre}){pre}*(?:i(?:di)?{targs}?|'interface'{ibody}|'struct'{sbody}|'func'{params}){lit}",
        "post": "(?:d(?:i|{ptype})|{args}|{idx}|{slice})",
        "primary_": "(?:{flit}|{clit}|(?<!'func')(?<!'func'{params})(?<!'type')(?<!'var')(?<!'const')i(?:di)*(?:{args}|{idx}|{slice}|d{ptype}|{targs}{args})|(?:{empty}|{idx}|'map'{idx}){pre}*(?:i(?:di)?|'interface'{ibody}){args}|0|s|c|t|(?<!'func')(?<!'func'i)(?<!{params})(?<!{params}i){pexpr}){post}*",
        "unary": "[p!x&mh]*(?:i(?:di)?{lit}|i(?:di)*|E|{pexpr}){post}*|'chan'{type}|{type}",
        "ex": "(?>(?:{unary})(?:[pm%&oxb]|<|>{1,2}))*(?:{unary})",
        "exs": "(?>{ex},)*{ex}",
        "simple": "{exs}(?:(?:[=aw]){exs}|u|h{ex})?",
        "cond": "(?:(?:{simple})?;)?(?:{simple})?",
        "spec": "i(?:,i)*(?:{type})?(?:={exs})?",
        "tspec": "i{targs}?=?{type}",
        "stmt": "(?:(?:i:)?(?:{simple}|'var'(?:{spec}|{specs})|'const'(?:{spec}|{specs})|'type'(?:{tspec}|{tspecs})|'return'(?:{exs})?|'break'i?|'continue'i?|'goto'i|'fallthrough'|'go'{ex}|'defer'{ex}|{block}|'if'{cond}{block}(?:'else''if'{cond}{block})*(?:'else'{block})?|'for'(?:(?:{exs}[=w])?'range'{ex}|(?:{simple})?;(?:{ex})?;(?:{simple})?|{ex})?{block}|'switch'(?:(?:{simple};)?(?:{simple})?){sw}|'select'{sw}|i:))",
        "block_": ";*(?:(?>{stmt});+)*(?:{stmt})?;*",
        "sw_": "(?:(?:'case'(?:{simple}|{types})|'default'):;*(?:(?>{stmt});+)*(?:{stmt})?;*)*",
        "types": "{type}(?:,{type})*",
        "lit_": ";*(?:(?>(?:{ex}|{lit}|{block})(?=[:,]|$))(?::(?>(?:{ex}|{lit})(?=,|$)))?(?:,(?>(?:{ex}|{lit})(?=[:,]|$))(?::(?>(?:{ex}|{lit})(?=,|$)))?)*,?)?",
        "sbody_": ";*(?:(?:i(?:,i)*{type}|m?i(?:di)?{targs}?)[st]?(?:;+|$))*",
        "ibody_": ";*(?:(?:i{params}(?:{res})?|~?{type}(?:o~?{type})*)(?:;+|$))*",
        "args_": "(?>(?:{type}|e?{ex}e?)(?=,|$))(?:,(?>{ex}e?(?=,|$)))*,?|",
        "pexpr_": "{ex}",
        "ptype_": "{type}|'type'",
        "params_": "(?:(?:i(?:,i)*)?e?{type}(?:,(?:i(?:,i)*)?e?{type})*,?)?",
        "specs_": ";*(?:{spec}(?:;+|$))*",
        "tspecs_": ";*(?:{tspec}(?:;+|$))*",
        "imps_": ";*(?:[id]?[st](?:;+|$))*",
        "idx_": "{ex}|{type}",
        "targs_": "{type}(?:,{type})*,?|i(?:,i)*~?{type}(?:o~?{type})*(?:,i(?:,i)*~?{type}(?:o~?{type})*)*,?",
        "slice_": "(?:{ex})?:(?:{ex})?(?::{ex})?",
        "empty_": "",
        "arre_": "e",
        "top": "'func'(?:{params})?i{targs}?{params}(?:{res})?{block}?|'var'(?:{spec}|{specs})|'const'(?:{spec}|{specs})|'type'(?:{tspec}|{tspecs})",
        "file_": ";*'package'i;+(?:'import'(?:[id]?[st]|{imps});+)*(?:(?>{top})(?:;+|$))*",
        "begin": ";*(?:$|'package'(?:$|i(?:$|;)))",
    },
    {"(": ["args", "pexpr", "params", "ptype", "specs", "tspecs", "imps"], "[": ["idx", "targs", "slice", "empty", "arre"], "{": ["block", "lit", "sbody", "ibody", "sw"]},
    dict.fromkeys(("block", "sw", "lit", "args", "pexpr", "slice", "idx", "specs", "file"), "primary_>E"),
    lines=_go_lines,
)
_GO.classes["onlylit"] = _GO.folded("{", "lit", "block")

# ---------------------------------------------------------------- Rust

_RUST = Grammar(
    "rust",
    "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while union",
    r'//[^\n]*|/\*(?>(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?>[\s\S]*?\*/))*)\*/|b?r(\#*)"[\s\S]*?"(?:\#*)|[bc]?"(?:[^"\\]|\\[\s\S])*"|b?\'(?:[^\'\\\n]|\\(?:[^u\n]|u\{[^}\n]*\})[0-9a-fA-F]*)\'|\'[a-z_]\w*(?!\')|r\#[a-z]\w*|union(?=\s+[A-Z])'.replace("(\\#*)", "(?:\\#*)"),
    {
        "seg": "(?:i|'self'|'Self'|'super'|'crate')",
        "path": "(?:n)?{seg}(?:n?G|n{seg})*(?:{ptypes}(?:r{tsimple})?)?",
        "tsimple": "[&m]*(?:i|'Self'|'self')(?:n(?:i|G))*G?",
        "pathe": "n?{seg}(?:nG|n{seg})*|Gn{seg}(?:n{seg}|nG)*",
        "type": "(?:&l?'mut'?|m(?:'const'|'mut')|'dyn'|'impl'|'for'G)*(?:{path}|Gn{seg}(?:n{seg}|G)*|{ptypes}|{barr}|!|l|(?:'unsafe')?(?:'extern's?)?'fn'{ptypes}(?:r{tsimple})?|i!{tt})(?:p(?:q?{path}|l))*",
        "ret": "r{type}",
        "attr": "#!?{battr}",
        "vis": "(?:'pub'{pany}?)?",
        "where": "(?:'where'(?:{type}:(?:(?:q?{type}|l|G)(?:p(?:q?{type}|l))*)?,?|l:l,?)*)",
        "macro": "{pathe}!i?(?:{tt}|{tb}|{tk})",
        "closure": "(?:'move'|'async')*(?:o(?:(?:{pat})(?::{type})?(?:,(?:{pat})(?::{type})?)*,?)?o|b)(?:{ret}(?={block}))?",
        "ctl": "K",
        "ctl_": "(?<!f)(?:'unsafe'|'async''move'?|'loop'|l:)+{block}|(?:l:)?(?:'loop'{block}|'while'{cond}{block}|'for'{pat}'in'{cond}{block})|'if'{cond}{block}(?:'else''if'{cond}{block})*(?:'else'{block})?|'match'{cond}{mbody}",
        "cop": "(?>[p!m&]*(?:{pathe}|E|{targs}|{arr})(?:{post})*(?:'as'{type})*)",
        "cex": "y?{cop}(?:(?:[pm%xb=ay]|oo?|&&?|<<?|>{1,2}=?){cop})*y?",
        "cond": "(?:{cex}|'let'{pat}={cex}(?:&&(?:'let'{pat}=)?{cex})*)",
        "post": "(?:d(?:i(?:nG)?|0|'await')|{args}|{index}|q)",
        "primary_": "(?:{macro}|(?:{pathe})(?:{post}|{onlysinit})|0|s|c|'true'|'false'|(?<!'fn'){targs}|{arr})(?:{post})*+",
        "pre": "(?:[p!m]|&&?(?:'mut')?|{closure})",
        "opd": "(?:{pathe}{sinit}?|E|{ctl}|{block}|{targs}|{arr}|'return'|'break'l?|'continue'l?|y)(?:{post})*",
        "unary": "(?>{pre}*{opd}(?:'as'{type})*)",
        "ex": "(?:(?:'return'|'break'l?)(?=[^,;]))?(?:y)?(?:{unary})(?:(?:[pm%xb=ay]|oo?|&&?|<<?|>{1,2}=?)(?:{unary}))*y?",
        "pat": "o?{pat1}(?:o{pat1})*",
        "pat1": "(?:&+|'mut'|'ref')*(?:{pathe}(?:@{pat2})?(?:{targs}|{tpat}|{spat})?|{targs}|{tpat}|{arr}|{barr}|p?0|s|c|'true'|'false'|y|E)(?:y(?:p?0|c|{pathe}|E)?)?",
        "pat2": "(?:p?0(?:yp?0)?|c(?:yc)?|{pathe}|{targs}|{tpat}|E)",
        "item": "{attr}*{vis}(?:(?:'const'|'async'|'unsafe'|'extern's?)*'fn'iG?{params}(?:{ret})?(?:{where})?(?:{block}|;)|'struct'iG?(?:{where})?(?:{fields}|{pfields}(?:{where})?;|;)|'union'iG?{fields}|'enum'iG?(?:{where})?{ebody}|'unsafe'?'trait'iG?(?::{type}(?:p{type})*)?(?:{where})?{ibody}|'unsafe'?'impl'G?(?:!?{type}'for')?{type}(?:{where})?{ibody}|'mod'i(?:;|{mbodyitems})|'use'{useend};|'type'iG?(?::{type})?(?:{where})?(?:={type})?;|(?:'const'|'static''mut'?)(?:i)(?::{type})?(?:={exfull})?;|'extern''crate'i(?:'as'i)?;|'unsafe'?'extern's?{mbodyitems}|(?:{pathe})!i?(?:{tk}|(?:{tt}|{tb});)|i!{tk})",
        "useend": "n?(?:{seg}n)*(?:{seg}(?:'as'i)?|m|{uses})",
        "exfull": "(?:(?:{pre})*(?:{macro}|{pathe}|0|s|c|'true'|'false'|{targs}|{arr}|{ctl})(?:{post}|{sinit})*(?:'as'{type})*)(?:(?:[pm%xbay=]|oo?|&&?|<<?|>{1,2})(?:{pre})*(?:{macro}|{pathe}|0|s|c|'true'|'false'|{targs}|{arr})(?:{post}|{sinit})*(?:'as'{type})*)*",
        "stmt": "(?:;|{attr}*(?:'let'{pat}(?::{type})?(?:={ex}(?:'else'{block})?)?;|(?:{ctl}|{block})(?![dq]);?|{ex};|{macro};?)|{item})",
        "block_": "(?:{attr})*(?>{stmt})*(?:{attr}*{ex})?",
        "mbody_": "(?:{attr}*{pat}(?:'if'{ex})?f(?:(?:{ctl}|{block})(?![dq]),?|{ex}(?:,|$)))*",
        "fields_": "(?:{attr}*{vis}i:{type}(?:,{attr}*{vis}i:{type})*,?)?",
        "ebody_": "(?:{attr}*i(?:{fields}|{pfields})?(?:={exfull})?(?:,{attr}*i(?:{fields}|{pfields})?(?:={exfull})?)*,?)?",
        "ibody_": "(?:{attr})*(?>{item})*",
        "sinit_": "(?:{attr}*(?:(?:i|0)(?::(?:{ex}))?|y(?:{ex})?)(?:,{attr}*(?:(?:i|0)(?::(?:{ex}))?|y(?:{ex})?))*,?)?",
        "spat_": "(?:{attr}*(?:(?:i|0):{pat}|(?:'ref'|'mut')*i|y)(?:,(?:(?:i|0):{pat}|(?:'ref'|'mut')*i|y))*,?)?",
        "uses_": "(?:{useend}(?:,{useend})*,?)?",
        "any_": "[^\x00]*",
        "args_": "(?:{ex}(?:,{ex})*,?)?",
        "tpat_": "(?:(?>{pat}(?=,|$))(?:,(?>{pat}(?=,|$)))*,?)?",
        "params_": "(?:{attr}*(?:(?:&l?)?'mut'?'self'(?::{type})?|(?:{pat}:)?{type}|e)(?:,{attr}*(?:(?:{pat}:)?{type}|e))*,?)?",
        "ptypes_": "(?:(?:i:)?{type}(?:,(?:i:)?{type})*,?)?",
        "pfields_": "(?:{attr}*{vis}{type}(?:,{attr}*{vis}{type})*,?)?",
        "tt_": "[^\x00]*",
        "arr_": "(?:{ex}(?:,{ex})*,?|{ex};{ex})?",
        "index_": "{ex}",
        "barr_": "{type}(?:;{exfull})?|(?:(?>{pat}(?=,|$))(?:,(?>{pat}(?=,|$)))*,?)?",
        "battr_": "{path}(?:={exfull}|{tt}|{tb}|{tk})?|'unsafe'{tt}",
        "tb_": "[^\x00]*",
        "file_": "(?:{attr})*(?>{item})*",
        "begin": "$|['pub''const''async''unsafe''extern''fn''struct''union''enum''trait''impl''mod''use''type''static'<]|#!?(?:$|\\[)|n?(?:$|{seg}(?:n{seg})*(?:$|n$|n?<|!))",
    },
    {"(": ["args", "tpat", "params", "ptypes", "pfields", "tt"], "[": ["arr", "index", "barr", "battr", "tb"], "{": ["block", "mbody", "fields", "ebody", "ibody", "sinit", "spat", "uses", "any"]},
    dict.fromkeys(("block", "mbody", "args", "arr", "index", "sinit"), "primary_>E ctl_>K") | dict.fromkeys(("ebody", "ibody", "barr", "battr"), "ctl_>K"),
    generics="<(?:{type}'as'{type}|(?:'const'?(?:l|{type}|p?0|s|{block})(?::(?:(?:q?{type}|l)(?:p(?:q?{type}|l))*)?)?(?:=(?:{type}|0))?)(?:,(?:'const'?(?:l|{type}|p?0|s|{block})(?::(?:(?:q?{type}|l)(?:p(?:q?{type}|l))*)?)?(?:=(?:{type}|0))?))*,?)?>",
    operators="&& || ++ -- ** ?? << &^ <- ?. := === !== ***= >>= >>>= ** **= &&= ||= ??= &^=",
    literals={"b'": "c", "b\"": "s", "c\"": "s", "br\"": "s", "br#": "s", "r\"": "s", "r#\"": "s", "r##": "s"},
)
_RUST.classes["targs"] = _RUST.classes["args"]
_RUST.classes["pany"] = _RUST.folded("(")
_RUST.classes["tk"] = _RUST.folded("{")
_RUST.classes["mbodyitems"] = _RUST.classes["ibody"]
_RUST.classes["onlysinit"] = _RUST.folded("{", "sinit", "block")

# ---------------------------------------------------------------- C

_C = Grammar(
    "c",
    "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while _Bool _Static_assert",
    r'(?:^[ \t]*\#[ \t]*(?:include|define|undef|if|ifdef|ifndef|elif|else|endif|pragma|error|warning|line)\b(?:[^\n\\/]|\\(?:\r?\n|.)|/(?!\*)|/\*[\s\S]*?\*/)*)|[LuU8]{0,2}"(?:[^"\\\n]|\\[\s\S])*"|[LuU]?\'(?:[^\'\\\n]|\\[^\n])+\'|//(?:[^\n\\]|\\[\s\S])*|/\*[\s\S]*?(?:\*/|\Z)',
    {
        "prim": "'char'|'double'|'float'|'int'|'long'|'short'|'signed'|'unsigned'|'void'|'_Bool'",
        "qual": "'const'|'volatile'|'static'|'extern'|'inline'|'register'|'restrict'|'auto'|'typedef'",
        "su": "(?:'struct'|'union')(?:i{sbody}?|{sbody})|'enum'(?:i{ebody}?|{ebody})",
        "specs": "(?:(?:{qual})*(?:(?:{prim})(?:{prim}|{qual})*|(?:{su})(?:{qual})*|i(?:{qual})*))",
        "dtor": "(?:m|{qual})*(?:i|E|{pdtor})(?:{index}|{params})*",
        "init": "(?:={exinit})?(?::{ex})?",
        "exinit": "(?:{ex}|{linit})",
        "decls": "(?:{specs}{dtor}{init}(?:,{dtor}{init})*|(?:{qual})*(?:{su})(?:{qual})*)",
        "post": "(?:[dr]i|{args}|{index}|u)",
        "primary_": "(?:i(?:(?:[dr]i)*(?:{args}|{index}|u))|'sizeof'(?:{ptype}|{args})|{ptype}{linit}|0|s+|c|{pexpr}(?!i|[0sc]|!|~)){post}*",
        "pre": "(?:[p!~&mu]|{ptype}|'sizeof')",
        "unary": "{pre}*(?:i(?:[dr]i)*|E|0|c|s+|{pexpr}){post}*",
        "chain": "(?:{unary})(?:(?:[pm%&oxb=a]|<|>{1,2})(?:{unary}))*",
        "ex": "{chain}(?:q{chain}:{chain})*",
        "exs": "(?>{ex}(?=[,;]|$))(?:,(?>{ex}(?=[,;]|$)))*",
        "head": "(?:'if'E|'while'E|'for'{forh}|'switch'E|i:|'case'{ex}(?:e{ex})?:|'default':|(?:(?<=;)|(?<={block}))'else')",
        "stmt": "(?:{head}*(?:;|{block}|{decls};|{exs};|'return'(?:{exs})?;|'break';|'continue';|'goto'i;|'do'(?:{block}|{exs};)'while'E;))",
        "block_": "(?>{stmt})*(?:i:|'default':)?",
        "sbody_": "(?:{decls};|;)*",
        "ebody_": "(?:i(?:={ex})?(?:,i(?:={ex})?)*,?)?",
        "linit_": "(?:(?:(?:di|{index})+=)?(?>{exinit}(?=,|$))(?:,(?:(?:di|{index})+=)?(?>{exinit}(?=,|$)))*,?)?",
        "args_": "(?:(?>(?:{ex}|{specs}m*)(?=,|$))(?:,(?>(?:{ex}|{specs}m*)(?=,|$)))*)?",
        "pexpr_": "{exs}",
        "params_": "(?:{specs}(?:(?:m|{qual})*(?:i|{pdtor})?(?:{index}|{params})*)(?:,{specs}(?:(?:m|{qual})*(?:i|{pdtor})?(?:{index}|{params})*))*(?:,e)?|e)?",
        "pdtor_": "(?:m|{qual})+i?(?:{index}|{params})*",
        "ptype_": "{specs}(?:m|{qual})*(?:{index}|{pdtor}|{params})*",
        "forh_": "(?:{decls}|{exs})?;(?:{exs})?;(?:{exs})?",
        "index_": "(?:{exs})?|'static'?{ex}",
        "top": "{decls};|{specs}(?:m|{qual})*i{params}{block}|i{args};?|;|'extern's(?:{topblock}|(?={specs}))|'_Static_assert'{args};",
        "file_": "(?>{top})*",
        "begin": ";*(?:$|{prim}|{qual}|'struct'|'union'|'enum'|'_Static_assert'|i(?:$|{qual}|[(m0sc'sizeof']|i(?:$|[=:,;]|(?:[dr]i)*(?:$|[dr]$|[([u]))))",
    },
    {"(": ["args", "pexpr", "params", "pdtor", "ptype", "forh"], "[": ["index"], "{": ["block", "sbody", "ebody", "linit"]},
    dict.fromkeys(("block", "args", "pexpr", "linit", "index", "forh"), "primary_>E"),
    operators="** **= === !== >>>= ?? ??= &&= ||= ?. => <- := ..= .. &^ &^=",
    literals={'L"': "s", "L'": "c", 'u"': "s", 'U"': "s", 'u8"': "s", "#": ""},
)
_C.classes["topblock"] = _C.classes["block"]

GRAMMARS = {g.name: g for g in (_JAVA, _JS, _TS, _GO, _RUST, _C)}
