"""Credentials in source and configuration lines, found and masked.

Candidates are literal values: what names are set to, passwords and parameters
in URLs, arguments of headers, commands and SQL, tokens of known issuers and armoured
blocks (keys and certificates). A logistic regression scores each from how likely its
characters are under a Markov chain of the corpus, the words of the identifier
beside it, the folders of its path, and its form. It is trained on weak labels:
known patterns and strongly named random values against placeholders, references,
public blocks and plainly named values. What words of names and paths say is learnt
from the same labels. A fifth of the labels is held out; there the scores are
calibrated to the rate of credentials among labelled values (a slope and an offset),
and calibrated scores of at least ``THRESHOLD`` are masked.

The labelled sample is bounded: whole files by a hash of their path, about
``TRAIN_LINES`` lines of the table, and of their labelled values the ``TRAIN_ROWS`` of
least hash. The Markov chain counts the characters of all lines in a table of at most
97 x 97 entries.

Defined results: equal rows count once; null contents hold nothing; a value that
goes on for several lines is masked in each; the lines of a private key from its
opening to its closing marker all count, and an opening marker with nothing like
a key behind it does not. Of a key's lines every run of key characters is masked, in
opening and closing lines, too; markers, headers, quotes and comment marks stay. The weights start
from ``PRIOR`` with the force of a few labels, so without labels they stay there.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamdex.llm.byfile import SourceFile, gathered, per_file

THRESHOLD = 0.5
TRAIN_ROWS = 20_000
TRAIN_LINES = 400_000
MASK = "REDACTED"

_KNOWN_TEXT = (
    r"(?:A[SK]IA|AGPA|AROA)[0-9A-Z]{12,20}|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_\w{20,}|glpat-[\w-]{16,}|xox[abeprs]-[\w-]{10,}|[srp]k_(?:live|test)_\w{10,}"
    r"|AIza[\w-]{24,}|eyJ[\w-]{8,}\.[\w-]{8,}(?:\.[\w-]{8,})?|SG\.[\w-]{16,}\.[\w-]{16,}|npm_\w{30,}|pypi-\w{30,}|hf_\w{30,}|dop_v1_\w{40,}|sq0\w{3}-[\w-]{20,}|shpat_\w{30,}|ya29\.[\w-]{20,}"
)
KNOWN = re.compile(rf"(?<![\w-])(?:{_KNOWN_TEXT})")
_NAMES = r"pass|pwd|kennwort|contrase|senha|mot_?de_?passe|secret|token|key|auth|cred|bearer|signature|sig\b|jwt|cookie|license"
TRIGGER = re.compile(rf"(?i:{_NAMES})|://[^\s/\"']*@|{_KNOWN_TEXT}|IDENTIFIED|curl .*-u|(?:mysql|mariadb|mongo).*\s-p|value[\"']?\s*[:=]")

_SET = re.compile(r"(?P<key>[A-Za-z_$][\w.\-$]*)[\"']?\]?\s*(?::\s*&?'?[A-Za-z_][\w<>\[\]|&' ]*?(?==))?\s*(?:=>|:=|=|:|\+=)\s*(?:[A-Za-z_.]+\()?[bBrRuf@$]{0,2}(?P<q>\"|'|`)(?P<val>(?:[^\"'`\\\n]|\\.|(?!(?P=q))[\"'`])+)(?P=q)")
_DEFINE = re.compile(r"#define\s+(?P<key>\w+)\s+\(?\"(?P<val>[^\"\n]+)\"")
_BARE = re.compile(r"^\s*(?:[#;!]+|//+|--)?\s*(?:export\s+|set\s+|-\s+|ENV\s+|ARG\s+)?[\"']?(?P<key>[A-Za-z_][\w.\-]*)[\"']?\s*[=:]\s*(?P<val>[^\s\"'`{\[(][^\s\"'`,]*),?\s*(?:[#;].*)?$")
_EXPORT = re.compile(r"\s*(?:[$>#]\s+)?(?:export|set|ENV|ARG)\s")
_LOOSE = re.compile(rf"(?i)\b(?P<key>[\w.\-]*(?:{_NAMES})[\w.\-]*)\s*[=:]\s*(?P<val>[^\s\"'`,;(){{}}]{{6,}})")
_SAID = re.compile(rf"(?i)\b(?P<key>(?:[\w\-]+[ ])?(?:password|passwd|pwd|passphrase|kennwort|secret|api key|token|login))[\"']?\s+(?:is|was|=|:|->)?\s*[\"'`](?P<val>[^\s\"'`]{{6,}})[\"'`]")
_USER = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*://(?P<user>[^\s/:@\"'<>]*):(?P<val>[^\s/@\"'<>][^\s/@\"']*|<[^>]*>|\{\{[^}]*\}\}|\$\{[^}]*\})@")
_QUERY = re.compile(r"(?i)[?&;](?P<key>[\w\-]*(?:token|key|secret|sig|signature|password|passwd|pwd|auth|credential|code)[\w\-]*)=(?P<val>[^&\s\"'<>#`]+)")
_HEADER = re.compile(r"(?i)\b(?P<key>bearer|basic|token|apikey|digest)[ :]+(?P<val>[A-Za-z0-9._~+/\-]{8,}={0,2})")
_HEADER_NEAR = re.compile(r"(?i)authori[sz]ation|x-api-key|proxy-auth|header")
_SQL = re.compile(r"(?i)\b(?:PASSWORD|IDENTIFIED\s+BY(?:\s+PASSWORD)?|IDENTIFIED\s+WITH\s+\w+\s+BY)\s*(?:=\s*)?'(?P<val>[^'\n]+)'")
_CLI = re.compile(r"(?i)(?:\s-u\s+[\"']?[\w.\-@]+:(?P<a>[^\s\"']+)|\s--?(?:password|passwd|pass|token|secret|api-key|apikey|auth-token)[= ][\"']?(?P<b>[^\s\"'\-][^\s\"']+)|\bsshpass\s+-p\s*[\"']?(?P<c>[^\s\"']+)|\bPGPASSWORD=[\"']?(?P<d>[^\s\"']+)|\b(?:mysql|mariadb|mongo)\w*\s(?:[^|;]*\s)?-p[\"']?(?P<e>[^\s\"']{4,})|\b(?:login|machine)\s+\S+.*\s(?:password|passwd)\s+(?P<f>[^\s\"']{4,}))")
_PAIR_NAME = re.compile(r"(?i)[\"']?(?:name|key)[\"']?\s*[:=]\s*[\"']?(?P<key>[A-Za-z_][\w.\-]*)")
_PAIR_VALUE = re.compile(r"(?i)\bvalue[\"']?\s*[:=]\s*[\"']?(?P<val>[^\s\"',}]+)")
_OPEN = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*(?:PRIVATE KEY|PUBLIC KEY|CERTIFICATE|PARAMETERS)(?: BLOCK)?)-----")
_CLOSE = re.compile(r"-----END (?:[A-Z0-9]+ )*(?:PRIVATE KEY|PUBLIC KEY|CERTIFICATE|PARAMETERS)(?: BLOCK)?-----")
_BODY = re.compile(r"[A-Za-z0-9+/]{20,}={0,2}")
_CONFIG = {"env", "properties", "yaml", "yml", "toml", "ini", "cfg", "conf", "json", "tfvars", "xml", "sh", "bash", "sql", "plist"}
_BARE_IN = {"env", "properties", "yaml", "yml", "toml", "ini", "cfg", "conf", "tfvars", "sh", "bash"}


class Candidate(NamedTuple):
    start: int
    end: int
    value: str
    key: str
    form: str


_TRAIL = re.compile(r"[.,;:)\]}>]+$")


def candidates(line: str, ending: str, before: str = "") -> list[Candidate]:
    """The literal values of a line; overlapping ones by the more telling form."""
    out: list[Candidate] = []

    def put(m: re.Match, group: str, key: str, form: str) -> None:
        a, b = m.span(group)
        if b > a:
            out.append(Candidate(a, b, line[a:b], key, form))

    for m in _USER.finditer(line):
        put(m, "val", "url password", "userinfo")
    for m in _QUERY.finditer(line):
        if "://" in line[: m.start()] or line[: m.start()].rstrip().endswith(("/", '"')) or m["key"].lower() not in ("key", "code"):
            put(m, "val", m["key"], "query")
    for m in _SQL.finditer(line):
        put(m, "val", "password", "sql")
    for m in _CLI.finditer(line):
        put(m, m.lastgroup, "password", "cli")
    if _HEADER_NEAR.search(line) or "bearer" in line.lower():
        for m in _HEADER.finditer(line):
            if re.fullmatch(r"[a-z.]+|[A-Z][a-z.]+", m["val"]):
                continue  # a word of a sentence
            put(m, "val", "authorization " + m["key"], "header")
    for m in KNOWN.finditer(line):
        out.append(Candidate(*m.span(), m[0], "", "known"))
    pair = _PAIR_VALUE.search(line)
    if pair:
        name = _PAIR_NAME.search(line[: pair.start()]) or _PAIR_NAME.search(before)
        if name:
            put(pair, "val", name["key"], "set")
    for pattern in (_SET, _DEFINE):
        for m in pattern.finditer(line):
            put(m, "val", m["key"], "set")
    if (ending in _BARE_IN or _EXPORT.match(line)) and (m := _BARE.match(line)):
        put(m, "val", m["key"], "bare")
    if _COMMENT.match(line) or ending in _BARE_IN:
        for m in _LOOSE.finditer(line):
            put(m, "val", m["key"], "loose")
    for m in _SAID.finditer(line):
        put(m, "val", m["key"], "loose")
    kept: list[Candidate] = []
    for c in out:
        if all(c.end <= k.start or c.start >= k.end for k in kept):
            kept.append(c)
        elif c.form == "set":  # a whole literal around something found in it says nothing more
            continue
    return kept


_COMMENT = re.compile(r"^\s*(?:#|//|/?\*|--|;|<!--|\"\"\")")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
#: Words of names (fixed lists): what grants access, what makes a name speak of something else.
STRONG = frozenset("password passwd pwd pass passphrase passwort kennwort secret credential credentials apikey bearer jwt contrasena senha".split())
WEAKER = frozenset("token key auth authorization cookie signature sig login".split())
WITH_KEY = frozenset("api access private secret encryption signing master payment maps account deploy service storage s3 s session shared hmac webhook geo billing license client subscription app auth".split())
OTHER = frozenset("name kind type ref field policy header schema env path file url uri count length ttl expiry algorithm alg format prefix suffix label param column index mode scope public authorized fingerprint hint prompt regex pattern rule rules min max limit hash digest checksum id ids size store placeholder".split())
PLAIN = frozenset("commit revision etag digest checksum integrity hash sha md5 uuid request trace tenant build version".split())
PLACEHOLDER = re.compile(
    r"(?i)^(?:x{3,}|\*{3,}.*|\.{3,}|-+|_+|0+|1234\d*|none|null|nil|true|false|undefined|todo|tbd|fixme|n/?a|empty|unset|redacted|masked|hidden|omitted|placeholder|changeme.*|change[-_ ]?(?:me|this|it).*|replace[-_ ]?(?:me|this|with).*|insert.*here|put.*here"
    r"|(?:your|my|some|the|a|an)[-_ ].*|.*[-_ ]here|example.*|dummy.*|sample.*|fake.*|test[-_]?(?:only|value|secret|password|token|key)?|secret|password|passwd|token|string|value|foo|bar|baz|xxx.*)$"
    r"|\$\{|\$\(|\{\{|<%|%\(|^\$\w|^%\w+%$|^<.*>$|^\[.*\]$|^:\w+$|^@\w+@$|^#\{|\*{3,}|x{6,}|process\.env|os\.environ|getenv|System\.|secretsmanager|arn:aws:|^vault[:/]|^(?:ref|op|ssm|env|file|sm|keyring|gcp|aws|azure)[+]?:|credentials?$|^secret/|^/?(?:run|etc|var|opt|mnt)/|^kms:|^ENC\[|^!\w"
)
_UUID = re.compile(r"(?i)^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
_HEX = re.compile(r"(?i)^(?:sha\d+[:-])?[0-9a-f]{16,}$")
_PUBLIC = re.compile(r"^(?:ssh-(?:rsa|dss|ed25519)|ecdsa-|sk-ssh)|^sha(?:1|256|384|512)-|^AAAA[A-Z0-9]|BEGIN (?:PUBLIC|CERTIFICATE)|^-----")
_REFERENCE = re.compile(r"^[A-Za-z_$][\w$]*(?:(?:\.|::|->)[A-Za-z_$][\w$]*|\([^)]*\)|\[[^\]]*\])+$|^[A-Za-z]+\($")
_LOWER = re.compile(r"^[A-Z]?[a-z]+(?:[-_./ :][a-z]+)*$|^[A-Z]+(?:_[A-Z]+)+$|^[A-Z][a-z]+(?:-[A-Z][a-z]+)+$")
FEATURES = ("one", "strong", "weaker", "with_key", "other", "plain", "nameless", "known", "userinfo", "query", "header", "command", "placeholder", "public", "uuid", "hex", "reference", "lower", "spaces", "short", "length", "classes", "digits", "unlikely", "unlikely_named", "number", "config", "loose", "url", "dashed_number", "armour", "words", "place")
#: What the regression starts from, with the force of ``PRIOR_FORCE`` labels.
PRIOR = dict(one=-3.0, strong=3.5, weaker=2.0, with_key=1.0, other=-6.0, plain=-4.0, nameless=-1.0, known=7.0, userinfo=6.0, query=4.5, header=4.0, command=6.0, placeholder=-10.0, public=-9.0, uuid=0.5, hex=0.5, reference=-6.0, lower=-4.5, spaces=-4.0, short=-3.0, length=0.3, classes=0.6, digits=0.5, unlikely=0.4, unlikely_named=0.6, number=-6.0, config=0.2, loose=-0.3, url=-7.0, dashed_number=1.0, armour=0.5, words=0.0, place=0.0)


class Markov:
    """A chain over characters, folded to 97 codes, from counts of neighbours."""

    def __init__(self, counts: np.ndarray):
        rows = counts + 0.5
        self.surprise = -np.log(rows / rows.sum(axis=1, keepdims=True))

    def mean(self, value: str) -> float:
        c = fold(value.encode("utf-8"))
        return float(self.surprise[c[:-1], c[1:]].mean()) if len(c) > 1 else 3.0


def fold(data: bytes) -> np.ndarray:
    a = np.frombuffer(data, np.uint8).astype(np.int32) - 31
    return np.where((a < 1) | (a > 95), np.where(a > 95, 96, 0), a)


def _own_name(key: str) -> str:
    """The last two parts of a dotted name; those before say where a setting belongs."""
    return ".".join(key.split(".")[-2:])


def features(c: Candidate, ending: str, chain: Markov) -> list[float]:
    """What is known of a candidate but for ``words`` and ``place``, which a model adds."""
    v = c.value
    words = [w.lower() for w in _WORD.findall(_own_name(c.key))]
    have = set(words)
    joined = "".join(words)
    strong = bool(have & STRONG) or any(s in joined for s in ("password", "passwd", "apikey", "secretkey", "passphrase"))
    weaker = bool(have & WEAKER)
    with_key = bool("key" in have and have & WITH_KEY)
    tail = [w for w in words if not w.isdigit()][-3:]
    other = bool(set(tail) & OTHER) and c.form in ("set", "bare", "loose") or "public" in have or "authorized" in have
    if other and set(tail) & OTHER == {"id"} and "key" in have:
        other = False
    named = strong or weaker
    classes = sum(bool(re.search(p, v)) for p in (r"[a-z]", r"[A-Z]", r"\d", r"[^A-Za-z0-9]"))
    unlikely = min(4.0, max(0.0, chain.mean(v) - 3.0))
    digits = min(1.0, sum(ch.isdigit() for ch in v) / max(1, len(v)) * 3)
    known = bool(KNOWN.fullmatch(v))
    command = c.form in ("sql", "cli")
    return [
        1.0, strong, weaker and not strong, with_key, other, bool(have & PLAIN), not named and c.form in ("set", "bare", "loose"), known, c.form == "userinfo", c.form == "query", c.form == "header", command,
        bool(PLACEHOLDER.search(v)), bool(_PUBLIC.search(v)), bool(_UUID.match(v)), bool(_HEX.match(v)), bool(_REFERENCE.match(v)) and not known, bool(_LOWER.match(v)), bool(re.search(r"\s", v)), len(v) < 6,
        min(3.0, len(v) / 16), classes, digits, unlikely, unlikely * named, bool(re.fullmatch(r"[\d.,]+\w?", v)), ending in _CONFIG, c.form == "loose", bool(re.match(r"[a-z+]+://|\.{0,2}/[a-z0-9_./-]*$|[\w.-]+\.(?:pem|key|crt|json|ya?ml|txt|env|p12|jks)$", v)), bool(re.match(r"[a-z]+(?:-[a-z]+)+\d", v)), c.form == "armour", 0.0, 0.0,
    ]


def weak_label(c: Candidate, x: list[float]) -> int | None:
    """1, 0 or no opinion, from patterns alone."""
    f = dict(zip(FEATURES, x))
    if f["armour"]:
        return int("PRIVATE KEY" in c.key)
    if f["placeholder"] or f["public"] or f["reference"] or f["url"] or f["number"]:
        return 0
    if f["known"] or f["userinfo"] or f["command"] or (f["query"] and f["length"] > 0.9):
        return 1
    if f["other"] or f["plain"]:
        return 0
    if f["strong"] and f["classes"] >= 3 and not f["spaces"] and len(c.value) >= 8:
        return 1
    if f["weaker"] and not f["spaces"] and len(c.value) >= 12 and (f["uuid"] or f["hex"] or (f["classes"] >= 3 and f["digits"] and not f["lower"])):
        return 1
    if f["nameless"] and not f["known"]:
        return 0
    if f["lower"] and len(c.value) < 20:
        return 0
    return None


#: Labels that the starting weights count for, and that a word needs for half of its say.
PRIOR_FORCE = 0.5
_SMOOTH = 4.0


def key_words(c: Candidate) -> list[str]:
    return [w.lower() for w in _WORD.findall(_own_name(c.key)) if not w.isdigit()]


def place_words(path: str) -> list[str]:
    """The folders of a path below its service, and its ending."""
    return [*path.lower().split("/")[1:-1], "." + ending_of(path)]


class Example(NamedTuple):
    """A labelled candidate."""

    x: list[float]
    words: list[str]
    place: list[str]
    label: int
    held: bool


class Model(NamedTuple):
    weights: np.ndarray
    counts: np.ndarray
    words: dict[str, float] = {}
    places: dict[str, float] = {}
    slope: float = 1.0
    offset: float = 0.0

    def logit(self, x: list[float], words: list[str], place: list[str]) -> float:
        return float(np.dot(self.weights[:-2], x[:-2])) + float(self.weights[-2]) * _said(self.words, words) + float(self.weights[-1]) * _said(self.places, place)

    def scorer(self):
        chain = Markov(self.counts)
        places: dict[str, list[str]] = {}

        def score(c: Candidate, path: str) -> float:
            if path not in places:
                places.clear()
                places[path] = place_words(path)
            z = self.slope * self.logit(features(c, ending_of(path), chain), key_words(c), places[path]) + self.offset
            return 1.0 / (1.0 + float(np.exp(-min(30.0, max(-30.0, z)))))

        return score


def _said(odds: dict[str, float], words: list[str]) -> float:
    return min(3.0, max(-3.0, sum(odds.get(w, 0.0) for w in words)))


def _odds(rows: list[tuple[list[str], int]]) -> dict[str, float]:
    """How much more often than on the whole a word stands beside a credential, as a logarithm, drawn to nought for seldom words."""
    yes, no = Counter(), Counter()
    for words, label in rows:
        (yes if label else no).update(set(words))
    base = (sum(y for _, y in rows) + 1) / (len(rows) + 2)
    out = {}
    for w in yes | no:
        rate = (yes[w] + _SMOOTH * base) / (yes[w] + no[w] + _SMOOTH)
        out[w] = float(np.log(rate / (1 - rate)) - np.log(base / (1 - base)))
    return out


def _newton(x: np.ndarray, y: np.ndarray, start: np.ndarray, force: float, steps: int = 40) -> np.ndarray:
    """Weights of greatest likelihood under a Gaussian prior around ``start``."""
    w = start.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + force * np.eye(len(w)), x.T @ (p - y) + force * (w - start))
        w = w - step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(examples: list[Example], counts: np.ndarray) -> Model:
    """Weights from the examples that are not held out, calibrated on those that are."""
    prior = np.array([PRIOR[k] for k in FEATURES])
    training = [e for e in examples if not e.held]
    model = Model(prior, counts, _odds([(e.words, e.label) for e in training]), _odds([(e.place, e.label) for e in training]))
    if not training:
        return model
    table = lambda some: np.array([[*e.x[:-2], _said(model.words, e.words), _said(model.places, e.place)] for e in some], float)
    model = model._replace(weights=_newton(table(training), np.array([e.label for e in training], float), prior, PRIOR_FORCE))
    held = [e for e in examples if e.held]
    if held:
        z = np.clip(table(held) @ model.weights, -30, 30)
        slope, offset = _newton(np.column_stack([z, np.ones(len(z))]), np.array([e.label for e in held], float), np.array([1.0, 0.0]), 1.0)
        model = model._replace(slope=float(max(0.05, slope)), offset=float(offset))
    return model


def examples_of(f: SourceFile, chain: Markov) -> Iterator[tuple[int, Example]]:
    """(hash, example) of each candidate of a file that patterns alone can label."""
    ending, place = ending_of(f.path), place_words(f.path)
    text = "\n".join(f.lines)

    def put(line: int, c: Candidate) -> Iterator[tuple[int, Example]]:
        x = features(c, ending, chain)
        label = weak_label(c, x)
        if label is not None:
            h = xxhash.xxh3_64_intdigest(f"{f.path}\n{f.numbers[line]}\n{c.start}") >> 1
            yield h, Example(x, key_words(c), place, label, h % 5 == 0)

    inside: set[int] = set()
    for block in armoured(f.lines) if "-----BEGIN" in text else ():
        inside.update(range(block.first, block.last + 1))
        yield from put(block.first, block.candidate(f.lines))
    for i in triggered(f.lines, text):
        if i not in inside:
            for c in candidates(f.lines[i], ending, f.lines[i - 1] if i else ""):
                yield from put(i, c)


def ending_of(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower()


class Block(NamedTuple):
    """An armoured block: 0-based lines of its opening and end, and whether its closing marker was found."""

    label: str
    first: int
    last: int
    ended: bool

    def candidate(self, lines: list[str]) -> Candidate:
        """What a model scores: the characters of the body, named by the marker."""
        opening = _OPEN.search(lines[self.first])
        body = "".join(_RUN.findall("\n".join([lines[self.first][opening.end() :], *lines[self.first + 1 : self.last + 1]]).split("-----END")[0].replace("\\n", "\n")))
        return Candidate(*opening.span(), body, self.label, "armour")


_RUN = re.compile(r"[A-Za-z0-9+/]{4,}={0,2}")


def armoured(lines: list[str]) -> Iterator[Block]:
    """The blocks that have something like a body behind their opening marker."""
    i = 0
    while i < len(lines):
        m = _OPEN.search(lines[i])
        if not m:
            i += 1
            continue
        rest = lines[i][m.end() :]
        close = _CLOSE.search(rest)
        if close:
            if _BODY.search(rest[: close.start()].replace("\\n", " ")):
                yield Block(m[1], i, i, True)
            i += 1
            continue
        last, body = i, bool(_BODY.search(rest))
        ended = False
        for j in range(i + 1, len(lines)):
            if _CLOSE.search(lines[j]):
                last, ended = j, True
                body = body or bool(_BODY.search(lines[j][: _CLOSE.search(lines[j]).start()]))
                break
            if _OPEN.search(lines[j]):
                break
            bare = re.sub(r"\\n|[\s\"'+,;|>#*/\\()]", "", lines[j])
            if bare and not re.fullmatch(r"[A-Za-z0-9=.:\-]*", bare):
                break
            body = body or bool(_BODY.search(lines[j]))
            last = j
        if body:
            if not ended:
                while last > i and not _BODY.search(lines[last]):
                    last -= 1
            yield Block(m[1], i, last, ended)
        i = max(last, i) + 1


_KEY_PARTS = re.compile(r"(\\[nrt])|((?<![A-Za-z0-9+/])[bBrRuUfF]{1,2}(?=[\"'`]))|[A-Za-z0-9+/]*[A-Za-z0-9][A-Za-z0-9+/]*={0,2}")
_LITERAL = re.compile(r"\"[^\"]*(?:\"|$)|'[^']*(?:'|$)|`[^`]*(?:`|$)")
_COMMENTED = re.compile(r"\s*(?:(?://+|#+|\*+|--|;+)\s*)?")
_PEM_HEADER = re.compile(r"[\s\"'#*/]*(?:Proc-Type|DEK-Info|Comment|Version|Subject|X-[\w-]+): ")


def _masked_runs(s: str) -> str:
    return _KEY_PARTS.sub(lambda m: m[1] or m[2] or MASK, s)


def masked_key(line: str, opens: bool, closes: bool) -> str:
    """A line of a private key without key characters: behind the opening marker, before the closing one, between quotes where there are any."""
    head = tail = ""
    middle = line
    if opens and (m := _OPEN.search(middle)):
        head, middle = middle[: m.end()], middle[m.end() :]
    if closes and (c := _CLOSE.search(middle)):
        middle, tail = middle[: c.start()], middle[c.start() :]
    if _PEM_HEADER.match(middle):
        return line
    if head:
        quote = next((q for q in reversed(head) if q in "\"'`"), None)
        at = middle.find(quote) if quote and not tail else -1
        if at >= 0:  # the literal ends on this line: code follows, perhaps with more literals
            return head + _masked_runs(middle[:at]) + quote + _LITERAL.sub(lambda m: _masked_runs(m[0]), middle[at + 1 :])
        return head + _masked_runs(middle) + tail
    if not tail and _LITERAL.search(middle):
        return _LITERAL.sub(lambda m: _masked_runs(m[0]), middle)
    start = _COMMENTED.match(middle).end()
    lead = middle[:start]
    if tail and (q := max(middle.rfind(x) for x in "\"'`")) >= start:
        lead, start = middle[: q + 1], q + 1
    return lead + _masked_runs(middle[start:]) + tail


_STARTED = re.compile(r"(?P<key>[A-Za-z_][\w.\-]*)[\"']?\s*(?::\s*[\w&'\[\]<> ]+?)?\s*(?:=|:=|:)\s*\(?\s*$")
_GOES_ON = re.compile(r"^\s*(?:[+.]\s*)?[bBrRuf]?(?P<q>[\"'`])(?P<val>[^\"'`\n]+)(?P=q)\s*(?P<tail>[+.\\]?)")


#: Literals of which a line with a candidate has at least one, in lower case.
_LITERALS = "pass pwd kennwort contrase senha motdepasse mot_de_passe secret token key auth cred bearer signature sig jwt cookie license :// akia asia agpa aroa ghp_ gho_ ghu_ ghs_ ghr_ github_pat_ glpat- xoxa xoxb xoxe xoxp xoxr xoxs sk_live_ sk_test_ rk_live_ rk_test_ pk_live_ pk_test_ aiza eyj sg. npm_ pypi- hf_ dop_v1_ sq0 shpat_ ya29. identified curl mysql mariadb mongo value".split()
_FINDER: list = []


def triggered(lines: list[str], text: str) -> list[int]:
    """Indexes of the lines that may hold a candidate, by one pass of an automaton over the text."""
    if not _FINDER:
        import ahocorasick

        finder = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for w in _LITERALS:
            finder.add_word(w, 1)
        finder.make_automaton()
        _FINDER.append(finder)
    low = text.lower()
    if len(low) != len(text):  # characters whose lower case is longer
        return [i for i, line in enumerate(lines) if TRIGGER.search(line)]
    out, at, end = [], -1, -1
    starts = None
    for pos, _ in _FINDER[0].iter(low):
        if pos < end:
            continue
        if starts is None:
            starts = [0]
            for line in lines:
                starts.append(starts[-1] + len(line) + 1)
        at = bisect_right(starts, pos) - 1
        end = starts[at + 1] - 1
        if not out or out[-1] != at:
            out.append(at)
    return [i for i in out if TRIGGER.search(lines[i])]


def hits(f: SourceFile, score) -> Iterable[tuple]:
    text = "\n".join(f.lines)
    lines = f.lines
    where = triggered(lines, text)
    if not where:
        return
    ending = ending_of(f.path)
    done: set[int] = set()
    for block in armoured(lines) if "-----BEGIN" in text else ():
        if (s := score(block.candidate(lines), f.path)) >= THRESHOLD:
            for i in range(block.first, block.last + 1):
                done.add(i)
                yield f.path, f.numbers[i], "private key", s, masked_key(lines[i], i == block.first, block.ended and i == block.last)

    def masked(i: int, found: list[tuple[Candidate, float]]) -> tuple:
        out, at, line = [], 0, lines[i]
        for c, _ in sorted(found):
            out += [line[at : c.start], MASK]
            at = c.end
        return f.path, f.numbers[i], "+".join(sorted({c.form for c, _ in found})), max(s for _, s in found), "".join(out) + line[at:]

    for i in where:
        if i in done:
            continue
        line = lines[i]
        found = [(c, s) for c in candidates(line, ending, lines[i - 1] if i else "") if (s := score(c, f.path)) >= THRESHOLD]
        if found:
            done.add(i)
            yield masked(i, found)
        # A literal that begins on the next line, or goes on there.
        end = line.rstrip()
        key = None
        if end.endswith(("=", "(", ":")) and (started := _STARTED.search(end)):
            key = started["key"]
        elif found and found[-1][0].form == "set" and found[-1][0].end >= len(end) - 4 and end.endswith(("+", ".", "\\", '"', "'", "`")):
            key = found[-1][0].key
        j = i + 1
        while key and j < len(lines) and j not in done and (m := _GOES_ON.match(lines[j])):
            c = Candidate(*m.span("val"), m["val"], key, "set")
            s = score(c, f.path)
            if s < THRESHOLD:
                break
            done.add(j)
            yield masked(j, [(c, s)])
            if m["tail"] not in ("+", ".", "\\"):
                break
            j += 1


def character_counts(lines: DataFrame) -> tuple[np.ndarray, int]:
    """Neighbours of characters over all lines, a table of at most 97 x 97 rows, and the number of lines, by one scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(97 * 97 + 1, np.int64)
        for batch in batches:
            total[-1] += batch.num_rows
            column = batch.column(0).drop_null()
            data = np.frombuffer(column.buffers()[2], np.uint8)[np.frombuffer(column.buffers()[1], np.int32)[column.offset] : np.frombuffer(column.buffers()[1], np.int32)[column.offset + len(column)]] if len(column) else np.zeros(0, np.uint8)
            if len(data) > 1:
                a = data.astype(np.int32) - 31
                a = np.where((a < 1) | (a > 95), np.where(a > 95, 96, 0), a)
                total[:-1] += np.bincount(a[:-1] * 97 + a[1:], minlength=97 * 97)
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(total[k])], names=["k", "n"])

    out = np.zeros(97 * 97 + 1)
    for k, n in lines.select(F.col("content").cast("string")).mapInArrow(run, "k int, n bigint").groupBy("k").agg(F.sum("n").alias("n")).collect():
        out[k] = n
    return out[:-1].reshape(97, 97), int(out[-1])


_EXAMPLES = "h bigint, x array<double>, words array<string>, place array<string>, label int, held boolean"
_EXAMPLES_ARROW = [("h", pa.int64()), ("x", pa.list_(pa.float64())), ("words", pa.list_(pa.string())), ("place", pa.list_(pa.string())), ("label", pa.int32()), ("held", pa.bool_())]


def train(lines: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fits the model on at most ``rows`` labelled values of sampled files.

    The share of files that is looked at follows from the table's size, so neither
    the sample's shuffle nor what the driver gets grows with the table.
    """
    counts, n = character_counts(lines)
    share = min(1.0, TRAIN_LINES / max(1, n))
    some = lines.where(F.pmod(F.xxhash64("path"), F.lit(1_000_000_000)) < int(share * 1_000_000_000))
    state: dict = {}

    def setup() -> None:
        state["chain"] = Markov(counts)

    labelled = per_file(gathered(some), lambda f: ((h, *e) for h, e in examples_of(f, state["chain"])), _EXAMPLES, _EXAMPLES_ARROW, setup)
    return fit([Example(r["x"], r["words"], r["place"], r["label"], r["held"]) for r in labelled.orderBy("h").limit(rows).collect()], counts)


SCHEMA = "path string, line int, form string, score double, masked string"
_FIELDS = [("path", pa.string()), ("line", pa.int32()), ("form", pa.string()), ("score", pa.float64()), ("masked", pa.string())]


def redacted(lines: DataFrame, model: Model | None = None) -> DataFrame:
    """The lines that hold credentials, with the values masked."""
    model = model or train(lines)
    state: dict = {}

    def setup() -> None:
        state["score"] = model.scorer()

    return per_file(gathered(lines), lambda f: hits(f, state["score"]), SCHEMA, _FIELDS, setup)


def found(rows: DataFrame) -> DataFrame:
    return rows.select("path", "line").distinct()
