"""Text decoded with the wrong character encoding, found and restored.

Multibyte damage (UTF-8 read as a legacy code page, once or several times):
characters are mapped back to the bytes of the code page, an automaton over the
byte structure (as a compiled pattern over the characters that stand for lead
and continuation bytes) finds maximal well-formed spans, and only those spans
are decoded. A span counts if its characters become ones that texts use; the
code page of a text is the one that explains most.

Single-byte damage (one legacy code page read as another) has no byte structure.
It shows in neighbours: how many intact texts have a character beside its left and
right neighbour is counted over the corpus, each different text once (copies only
help another reading to its ``LEAST`` documents), and a text is damaged where another reading of its rare characters makes them at least
``GAIN`` times as usual. What is damaged alike in many texts must not count as
usual: the counts are first taken from texts whose letters fit an alphabet
(``orderly``), then from all texts that those counts do not show to be damaged.
Two characters must become better, or one (marks that join words aside) whose other
reading ``STRONG`` different texts have, ``ALONE`` times as many as other intact texts have it
beside its neighbours. What the other readings of three characters say is worked out once a worker.
The counts are keyed by two characters of legacy code pages, so the table has at
most 2 x 700 x 700 rows at any size of the corpus.

Lost characters (U+FFFD inside a word, or several together) are found, too, but
cannot be restored.

Defined results: null and empty texts are no cases; a span that stands alone
between quotation marks or backticks is quoted as an example and left alone, and
so is a single U+FFFD between spaces; restored texts keep everything outside the
decoded spans.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code pages that UTF-8 is taken for.
PAGES = ("cp1252", "cp1250", "cp1251", "cp1254", "cp437", "cp850", "mac_roman", "cp866", "koi8_r", "iso8859_2", "iso8859_15", "cp852", "cp1253")
#: Code pages taken for one another.
SINGLE = ("cp1252", "cp1250", "iso8859_2", "cp1251", "koi8_r", "cp866", "cp437", "cp850", "cp852", "mac_roman")
_CYRILLIC = ("cp1251", "cp866", "koi8_r")
GAIN = 8
LEAST = 3
STRONG = 10
ALONE = 50
#: Share of the intact texts above which a pair of neighbours is usual.
WEAK = 0.002
_KEPT = 1_000_000


def _page(name: str) -> dict[int, str]:
    """What each high byte becomes; undefined ones stay control characters, as most decoders leave them."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[b] = bytes([b]).decode(name)
        except UnicodeDecodeError:
            out[b] = chr(b)
    return out


def _usual(c: str) -> bool:
    """Whether intact texts use the character: letters of living scripts, punctuation, symbols, emoji."""
    o = ord(c)
    if o < 0x80:
        return c.isprintable() or c in "\n\r\t"
    if o < 0x180:
        return o >= 0xA0 and o not in (0xAD, 0x138, 0x149, 0x178, 0x17F)
    return (
        0x218 <= o <= 0x21B or 0x300 <= o <= 0x30F or 0x386 <= o <= 0x3CE or 0x401 <= o <= 0x45F or o in (0x490, 0x491)
        or 0x5D0 <= o <= 0x5EA or 0x621 <= o <= 0x64A or 0x900 <= o <= 0x97F or 0xE01 <= o <= 0xE5B or 0x1E00 <= o <= 0x1EFF
        or 0x2002 <= o <= 0x203A or o in (0x2044, 0x20AC, 0x2116, 0x2122, 0x2126) or 0x2190 <= o <= 0x22FF or 0x2500 <= o <= 0x27BF
        or 0x2B05 <= o <= 0x2B55 or 0x3000 <= o <= 0x30FF or 0x4E00 <= o <= 0x9FFF or 0xAC00 <= o <= 0xD7A3
        or 0xFF01 <= o <= 0xFF9F or o in (0xFE0F, 0xFEFF, 0xFB01, 0xFB02) or 0x1F000 <= o <= 0x1FAFF or 0xE0020 <= o <= 0xE007F
    )


class _Reader:
    """The automaton of one code page."""

    def __init__(self, name: str):
        self.name = name
        page = _page(name)
        self.bytes_of = {c: b for b, c in page.items()}
        if name == "cp1252":  # where it leaves bytes undefined, and where ISO 8859-1 was meant
            self.bytes_of |= {chr(b): b for b in range(0x80, 0xA0)}
        other: dict[int, list[str]] = {}
        for c, b in self.bytes_of.items():
            other.setdefault(b, []).append(c)

        def of(a: int, b: int) -> str:
            return "[" + "".join(re.escape(c) for x in range(a, b + 1) for c in other[x]) + "]"

        self.leads = frozenset(c for x in range(0xC2, 0xF5) for c in other[x])
        self.tails = frozenset(c for x in range(0x80, 0xC0) for c in other[x])
        tail = of(0x80, 0xBF)
        form = f"{of(0xC2, 0xDF)}{tail}|{of(0xE0, 0xEF)}{tail}{{2}}|{of(0xF0, 0xF4)}{tail}{{3}}"
        self.span = re.compile(f"(?:{form})+")
        self.one = re.compile(form)

    def decoded(self, span: str) -> str | None:
        try:
            return bytes(self.bytes_of[c] for c in span).decode("utf-8")
        except UnicodeDecodeError:
            return None


_READERS: list[_Reader] = []
_NONASCII = re.compile(r"[^\x00-\x7f]")
_TOGETHER = re.compile(r"[^\x00-\x7f]{2,}")
_QUOTES = {"“": "”", "„": "“", "«": "»", "‘": "’", '"': '"', "'": "'", "`": "`", "‹": "›", "「": "」"}
_LOST = re.compile(r"\w�|�\w|��")


def _readers() -> list[_Reader]:
    if not _READERS:
        _READERS.extend(_Reader(n) for n in PAGES)
    return _READERS


def _quoted(text: str, a: int, b: int) -> bool:
    return 0 < a and b < len(text) and _QUOTES.get(text[a - 1]) == text[b]


def _layer(text: str, reader: _Reader) -> list[tuple[int, int, str]]:
    """The spans of ``text`` that the code page explains, with what they become."""
    out = []
    for m in reader.span.finditer(text):
        a, b = m.span()
        if _quoted(text, a, b):
            continue
        if reader.name in _CYRILLIC:
            # Intact Cyrillic has short well-formed spans by chance; damage covers whole runs.
            if (a and ord(text[a - 1]) >= 0x400 and ord(text[a - 1]) < 0x500) or (b < len(text) and 0x400 <= ord(text[b]) < 0x500):
                continue
        whole = reader.decoded(m[0])
        if whole is not None and _fine(whole):
            out.append((a, b, whole))
            continue
        for one in reader.one.finditer(text, a, b):
            got = reader.decoded(one[0])
            if got is not None and _fine(got):
                out.append((*one.span(), got))
    return out


_SPARSE = re.compile(r"[\u0590-\u0e7f]")


def _fine(got: str) -> bool:
    """Usual characters, or more layers of damage, by whatever code pages, that end in usual characters.

    A single letter of a script whose words are written in nothing else is chance.
    """
    if all(map(_usual, got)):
        return len(got) >= 3 or not _SPARSE.search(got)
    for reader in _readers():
        if got[0] in reader.leads and reader.span.fullmatch(got):
            inner = reader.decoded(got)
            if inner and (all(map(_usual, inner)) or (len(inner) > 1 and _fine(inner))):
                return True
    return False


def restore_multibyte(text: str) -> tuple[str, list[str], int]:
    """(text, code page of each layer, characters decoded); every layer shortens the text, so they end."""
    pages, changed = [], 0
    while True:
        together = " ".join(_TOGETHER.findall(text))  # well-formed spans have two characters beyond ASCII at least
        if not together:
            break
        best: tuple[int, int, _Reader, list] | None = None
        have = set(together)
        for reader in _readers():
            if have.isdisjoint(reader.leads) or have.isdisjoint(reader.tails) or not reader.one.search(together):
                continue
            spans = _layer(text, reader)
            gain = sum(b - a for a, b, _ in spans)
            # Of code pages that explain as much, the one that puts fewest capitals behind small letters.
            capitals = sum(a > 0 and got[0].isupper() and text[a - 1].islower() for a, _, got in spans)
            if gain and (best is None or (gain, -capitals) > best[:2]):
                best = (gain, -capitals, reader, spans)
        if best is None:
            break
        gain, _, reader, spans = best
        parts, at = [], 0
        for a, b, got in spans:
            parts += [text[at:a], got]
            at = b
        text = "".join(parts) + text[at:]
        pages.append(reader.name)
        changed += gain
    return text, pages, changed


#: Double-byte encodings that were read as a Western code page.
DOUBLE = ("gb2312", "euc_jp", "cp932", "euc_kr", "big5")
_WEST = _page("cp1252")
_WEST_BYTES = {c: b for b, c in _WEST.items()} | {chr(b): b for b in range(0x80, 0x100) if chr(b) not in _WEST.values()}
_WEST_RUN = re.compile("(?:[" + "".join(map(re.escape, _WEST_BYTES)) + "][@-~]?){5,}")
_EAST = re.compile(r"[\u3000-\u30ff\u4e00-\u9fff\uac00-\ud7a3\uff01-\uff9f0-9A-Za-z]+")


def restore_double(text: str) -> tuple[str, str, int] | None:
    """Runs of Western characters that are East Asian text in a double-byte encoding."""
    best: tuple[int, str, str] | None = None
    for name in DOUBLE if _WEST_RUN.search(text) else ():
        gain = 0

        def put(m: re.Match, name: str = name) -> str:
            nonlocal gain
            data = bytes(_WEST_BYTES.get(c) or ord(c) for c in m[0])
            try:
                got = data.decode(name)
            except UnicodeDecodeError:
                return m[0]
            if sum(ord(c) > 0x2FFF for c in got) < 3 or not _EAST.fullmatch(got):
                return m[0]
            # Both national sets have kana at one place, but only Japanese texts use them.
            gain += len(m[0]) + (name == "euc_jp" and any("぀" <= c <= "ヿ" for c in got))
            return got

        out = _WEST_RUN.sub(put, text)
        if gain and (best is None or gain > best[0]):
            best = (gain, f"cp1252>{name}", out)
    return best and (best[2], best[1], best[0])


_LEGACY = {c for n in {*PAGES, *SINGLE} for c in _page(n).values()}


def _side(c: str) -> str:
    """A neighbour, folded: letters in lower case, other ASCII by class, letters of other scripts as one."""
    if c < "\x80":
        return c.lower() if c.isalpha() else "0" if c.isdigit() else " "
    return c if c in _LEGACY else "@"


_LEGACY_MARK = re.compile("[" + "".join(re.escape(c) for c in sorted(_LEGACY) if c == "\xa0" or not c.isspace()) + "]")


def _positions(text: str) -> list[int]:
    return [m.start() for m in _LEGACY_MARK.finditer(text)]


class _Remembered(dict):
    """What a function says of three characters, worked out once (tables of bounded size)."""

    def __init__(self, work: Callable[[str], object]):
        super().__init__()
        self.work = work

    def __missing__(self, near: str):
        if len(self) >= _KEPT:
            self.clear()
        got = self[near] = self.work(near)
        return got


def nears(text: str) -> set[str]:
    """Each character that legacy code pages have, between its neighbours."""
    padded = f" {text} "
    return {padded[i : i + 3] for i in _positions(text)}


#: The keys of a character between its neighbours: '<' with the left one, '>' with the right one.
_KEYS = _Remembered(lambda near: ("<" + _side(near[0]) + near[1], ">" + near[1] + _side(near[2])))


def neighbours(text: str) -> set[str]:
    """The keys of all characters of ``text`` that legacy code pages have."""
    return {k for near in nears(text) for k in _KEYS[near]}


#: Letters beyond ASCII of the languages of each script.
_ALPHABETS = {
    "latin": [frozenset(x) for x in (
        "äöüßé", "àâæçéèêëîïôœùûüÿ", "áéíïñóúü", "àáâãçéêíóôõúü", "àèéìíîòóùú", "áéèëïíóöüê", "åäöéü", "æøåéóôèê", "áðéíóúýþæö", "ąćęłńóśźżé", "áäčďéěíĺľňóôŕřšťúůýž", "áéíóöőúüű", "ăâîșțşţ",
        "çğıöşüiâîû\u0307", "čćđšž", "āčēģīķļņōŗšūž", "ąčęėįšųūž", "äöõüšž", "àçéèíïóòúü", "çëé", "àáâãèéêìíòóôõùúýăđĩũơư",
    )],
    "cyrillic": [frozenset("абвгдежзийклмнопрстуфхцчшщъыьэюяё"), frozenset("абвгґдеєжзиіїйклмнопрстуфхцчшщьюя"), frozenset("абвгдеёжзійклмнопрстуўфхцчшыьэюя"), frozenset("абвгдђежзијклљмнњопрстћуфхцчџшѓѕќ")],
    "greek": [frozenset("αβγδεζηθικλμνξοπρστυφχψωςάέήίόύώϊϋΐΰ")],
}
#: Marks that stand between letters in intact texts.
_JOINING = set("’‘'·–—…\u00ad\u200d\u200c\u2011\u00a0/→")


def _script(c: str) -> str:
    o = ord(c)
    return "greek" if 0x370 <= o < 0x400 else "cyrillic" if 0x400 <= o < 0x530 else "latin" if o < 0x250 or 0x1E00 <= o < 0x1F00 else ""


def _order(near: str) -> tuple[str, str] | None:
    """(script, small letter) of a middle letter, two empty strings for a sign; None if it stands in disorder."""
    left, c, right = near
    if c in "ªº" or not c.isalpha():
        return None if (c not in _JOINING and left.isalpha() and right.isalpha()) or "\x80" <= c < "\xa0" else ("", "")
    script = _script(c)
    if left.isalpha() and (_script(left) != script or (c.isupper() and left.islower())):
        return None
    if right.isalpha() and _script(right) != script:
        return None
    return script, c.lower()


_ORDER = _Remembered(_order)


def orderly(text: str) -> bool:
    """Whether letters fit an alphabet of their script, no word mixes scripts or has capitals after small letters, and no sign parts a word."""
    letters: dict[str, set[str]] = {}
    for near in nears(text):
        got = _ORDER[near]
        if got is None:
            return False
        if got[0] or got[1]:
            letters.setdefault(got[0], set()).update(got[1])
    return all(any(have <= x for x in _ALPHABETS.get(script, ())) for script, have in letters.items())


class SingleByte:
    """Finds the other reading of a text, given in how many intact texts, and documents with copies, each pair of neighbours stands."""

    def __init__(self, counts: dict[str, tuple[int, int]], texts: int):
        self.counts = counts
        self.weak = max(2.0, WEAK * texts)
        self.effects = _Remembered(self._effect)
        self.intact: set[str] = set()
        self.becomes: dict[str, dict[str, list[int]]] = {}
        self.readings: list[tuple[str, str, dict[int, str]]] = []
        pages = {n: _page(n) for n in SINGLE}
        for wrong in SINGLE:
            for right in SINGLE:
                if wrong != right:
                    table = {ord(pages[wrong][b]): pages[right][b] for b in range(0x80, 0x100) if pages[wrong][b] != pages[right][b]}
                    if wrong == "cp1252":
                        table |= {b: pages[right][b] for b in range(0x80, 0xA0)}
                    self.readings.append((wrong, right, table))

    def usual(self, near: str) -> tuple[int, int]:
        """(texts, documents) that have the middle character beside its neighbours."""
        left, right = _KEYS[near]
        left, right = self.counts.get(left, (0, 0)), self.counts.get(right, (0, 0))
        return min(left[0], right[0]), min(left[1], right[1])

    def _effect(self, near: str) -> tuple[int, list[tuple[int, int, bool, int]]] | None:
        """What other readings make of the middle character: how usual it is, then (reading, better, sure, worse) of each; None if it is usual."""
        u = self.usual(near)[0]
        if near[1] == "�" or u > self.weak:
            return None
        said = []
        for other, readings in self._others(near):
            v, documents = self.usual(other) if other[1] > "\x7f" else (0, 0)
            if documents >= LEAST and v >= GAIN * u:
                sure = v >= max(STRONG, ALONE * (u - 1)) and near[1] not in _JOINING and other[1].isalpha() and not (other[1].islower() and other[2].isupper())
                said += [(k, 1, sure, 0) for k in readings]
            elif v < u:
                said += [(k, 0, False, 1) for k in readings]
        return u, said

    def _others(self, near: str) -> list[tuple[str, list[int]]]:
        """What the three characters become, and by which readings, where the middle one changes."""
        c = near[1]
        if c not in self.becomes:
            groups: dict[str, list[int]] = {}
            for k, (_, _, table) in enumerate(self.readings):
                if ord(c) in table:
                    groups.setdefault(table[ord(c)], []).append(k)
            self.becomes[c] = groups
        if near[0] < "\x80" and near[2] < "\x80":
            return [(near[0] + other + near[2], readings) for other, readings in self.becomes[c].items()]
        whole: dict[str, list[int]] = {}
        for readings in self.becomes[c].values():
            for k in readings:
                whole.setdefault(near.translate(self.readings[k][2]), []).append(k)
        return list(whole.items())

    def restore(self, text: str, alone: bool = True) -> tuple[str, str, int] | None:
        """(text, 'wrong>right', characters changed), if another reading is far more usual; ``alone``: of one character, too."""
        left = nears(text) - self.intact
        for near in [x for x in left if self.effects[x] is None]:
            left.remove(near)
            if len(self.intact) >= _KEPT:
                self.intact.clear()
            self.intact.add(near)
        if not left:
            return None
        padded = f" {text} "
        rare: dict[int, int] = {}
        sums: dict[int, list[int]] = {}
        for i in _positions(text):
            near = padded[i : i + 3]
            if near not in left or _quoted(text, i, i + 1):
                continue
            rare[i], said = self.effects[near]
            for k, better, sure, worse in said:
                s = sums.get(k)
                if s is None:
                    s = sums[k] = [0, 0, 0]
                s[0] += better
                s[1] += sure
                s[2] += worse
        best: tuple[int, int] | None = None
        for k in sorted(sums):
            better, sure, worse = sums[k]
            if (better >= 2 or (alone and sure)) and better > worse and (best is None or better - worse > best[0]):
                best = (better - worse, k)
        if best is None:
            return None
        wrong, right, table = self.readings[best[1]]
        out = list(text)
        changed = 0
        for i, u in rare.items():
            near = padded[i : i + 3].translate(table)
            if near[1] != text[i] and self.usual(near)[0] >= u:
                out[i] = near[1]
                changed += 1
        return "".join(out), f"{wrong}>{right}", changed


STATES = ("restored", "partly", "lost")
SCHEMA = "doc_id bigint, state string, reading string, changed int, text string"
_ARROW = [("doc_id", pa.int64()), ("state", pa.string()), ("reading", pa.string()), ("changed", pa.int32()), ("text", pa.string())]


def examine(text: str | None, single: SingleByte | None) -> tuple[str, str, int, str] | None:
    """(state, reading, characters changed, restored text) of a damaged text; None for an intact one."""
    if not text or text.isascii():
        return None
    lost = bool(_LOST.search(text))
    out, pages, changed = restore_multibyte(text)
    reading = "+".join(f"{p}>utf_8" for p in pages)
    double = restore_double(text)
    first = single.restore(text) if single else None
    if double and double[2] > max(changed, first[2] if first else 0):
        out, reading, changed = double
    else:
        double = None
        if first and first[2] > changed:
            out, reading, changed = text, "", 0
    other = None if not single or double else first if out is text or out == text else single.restore(out)
    if other:
        out, name, n = other
        reading, changed = "+".join(filter(None, (reading, name))), changed + n
    if not changed and not lost:
        return None
    return ("lost" if lost and not changed else "partly" if lost or _LOST.search(out) else "restored"), reading, changed, out


def neighbour_counts(texts: DataFrame, counted: Callable[[], Callable[[str], bool]]) -> DataFrame:
    """(pair, texts, documents): in how many of the ``counted`` texts, and of their documents, each pair of neighbours stands.

    Texts are counted before any repair; pre-aggregated in each task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each: Counter = Counter()
        copies: Counter = Counter()
        test = counted()
        for batch in batches:
            for text, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if test(text):
                    keys = [*neighbours(text), "#"]
                    each.update(keys)
                    if n > 1:
                        copies.update(dict.fromkeys(keys, n - 1))
        if each:
            yield pa.RecordBatch.from_arrays([pa.array(list(each)), pa.array(list(each.values()), pa.int64()), pa.array([n + copies[k] for k, n in each.items()], pa.int64())], names=["pair", "texts", "documents"])

    return texts.mapInArrow(run, "pair string, texts bigint, documents bigint").groupBy("pair").agg(F.sum("texts").alias("texts"), F.sum("documents").alias("documents"))


def intact_counts(documents: DataFrame) -> Broadcast:
    """The counts of neighbours in texts without single-byte damage, and the number of those texts."""
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as many as asked for: judging takes more than reading
    texts = documents.select(F.col("text").cast("string").alias("text")).where(F.col("text").rlike(r"[^\x00-\x7f]")).repartition(parts, "text").groupBy("text").agg(F.count("*").alias("n"))

    def send(counts: DataFrame) -> Broadcast:
        got = {r[0]: (r[1], r[2]) for r in counts.where((F.col("documents") > 1) | (F.col("pair") == "#")).collect()}
        return documents.sparkSession.sparkContext.broadcast((got, got.get("#", (0, 0))[0]))

    first = send(neighbour_counts(texts, lambda: orderly))

    def undamaged() -> Callable[[str], bool]:
        single = SingleByte(*first.value)
        return lambda text: orderly(text) or single.restore(text, alone=False) is None

    return send(neighbour_counts(texts, undamaged))


def damaged(documents: DataFrame) -> DataFrame:
    """The damaged rows of ``documents`` with what could be restored."""
    known = intact_counts(documents)
    schema = pa.schema(_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from loamdex.llm.byfile import packed

        single = SingleByte(*known.value)

        def rows():
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    got = examine(text, single)
                    if got:
                        yield (doc, *got)

        yield from packed(rows(), schema)

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").rlike(r"[^\x00-\x7f]")).mapInArrow(run, SCHEMA)


def found(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id").distinct()
