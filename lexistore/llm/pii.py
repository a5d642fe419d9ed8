"""Personal data, found in the text as it stands and behind common disguises.

The base scan applies one pattern a kind to the text.  The second scan reads the text
through transducers that keep, for every character they put out, the source span it came
from: look-alike letters and digits become ASCII, spelled digits become digits, and
"(at)", "[dot]", " at ", " dot " and the like become "@" and ".".  Identifiers found in that
reading go back to source code points; those that touch no base span are added.

Word-shaped disguises occur in ordinary prose, so they count only with strong evidence: an
address spelled with a bare "at" needs a spelled or bracketed dot as well and, like one
with a bare "dot", a known ending, and numbers are
added only if at least one character was in fact disguised and the kind's own test holds;
IP addresses and phone numbers are also read with the dots that stand for "[dot]", " dot " and the like.

Defined cases: a null text counts as empty and has no spans; rows are independent, so
repeated rows get equal results; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

KINDS = ("email", "ip", "card", "phone")

# Every pattern is linear: a run that fails is not tried again from its middle.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[int, int, int]  # start, kind's place in KINDS, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of each address: domains forwards, then the local part backwards, so the work is linear."""
    done = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            done = m.end()


def base_spans(text: str) -> list[Span]:
    """All base spans by start, then kind.  A long domain part can't overlap the next local part."""
    out: list[Span] = []
    if "@" in text:
        out += [(a, 0, b) for a, b in addresses(text)]
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


# Characters drawn like an ASCII one (Cyrillic, Greek, then punctuation).
LOOKALIKES = {
    "а": "a", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "о": "o", "р": "p", "ѕ": "s", "х": "x", "у": "y", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v",
    "\u2024": ".", "\u3002": ".", "\u00b7": ".", "\u2010": "-", "\u2011": "-", "\u2013": "-", "\u2212": "-", "\u00a0": " ", "\u2007": " ", "\u202f": " ",
}
LOOKALIKES |= {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}  # fullwidth forms
LOOKALIKES |= {chr(first + d): str(d) for first in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for d in range(10)}
_DRAWN = str.maketrans(LOOKALIKES)
_ANY_DRAWN = re.compile("[" + "".join(map(re.escape, LOOKALIKES)) + "]")

# Digits spelled out in the languages of the corpus.
SPELLED = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "oh": 0,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "null": 0, "eins": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}
_NUMERAL = "(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + ")"
# two or more numerals in a row, or a numeral beside digits: a lone "one" is just a word
_SPELLED_RUN = re.compile(rf"(?i)(?<![^\W_])(?:{_NUMERAL}|[0-9]+)(?:[\x20\-.,]{{1,2}}(?:{_NUMERAL}|[0-9]+|dot|point)(?![^\W_]))+(?![^\W_])")
_WORD_IN_RUN = re.compile(rf"(?i)(?<![^\W_])(?:{_NUMERAL}|dot|point)(?![^\W_])|(?<=[^\W_])[\x20,](?:\x20)?(?=[^\W_])")
_PLUS = re.compile(r"(?i)(?<![^\W_])plus\x20(?=[0-9])")
_AT = re.compile(r"(?i)\x20?(?:\(\x20?at\x20?\)|\[\x20?at\x20?\]|\{\x20?at\x20?\}|<\x20?at\x20?>|\(@\)|\[@\])\x20?|\x20at\x20|\x20@\x20")
_DOT = re.compile(r"(?i)\x20?(?:\(\x20?dot\x20?\)|\[\x20?dot\x20?\]|\{\x20?dot\x20?\}|<\x20?dot\x20?>|\(\.\)|\[\.\])\x20?|\x20dot\x20")
# what every pattern above needs to change a text; "at" counts only beside a dot that is here
_HINT = re.compile(
    r"(?i)[\[({<]\x20?(?:at|dot|@|\.)\x20?[\])}>]|\x20dot\x20|\x20@\x20|(?<![^\W_])plus\x20[0-9]"
    rf"|(?<![^\W_]){_NUMERAL}[\x20\-.,]{{1,2}}(?:{_NUMERAL}|[0-9]|dot|point)|(?:[0-9]|dot|point)[\x20\-.,]{{1,2}}{_NUMERAL}(?![^\W_])"
)


# Endings that make a worded address ("at", "dot") more than prose.
ENDINGS = frozenset("com org net edu gov int info biz io co me tv us uk ie au ca in eu de at ch fr be es mx ar it nl pt br pl se no dk fi cz jp cn ru".split())


class Mapped:
    """A reading of a text that knows the source span behind each of its characters.

    Every rewriting is a layer of edits: parallel lists of places in the text before and
    after it.  A place is followed back layer by layer, by bisection, so memory grows with
    the edits and not with the text.
    """

    def __init__(self, text: str):
        self.text = text
        self.layers: list[tuple[list[int], list[int], list[int], list[int]]] = []

    def replace(self, pattern: re.Pattern, put) -> None:
        """Puts ``put(match)`` for every match; its characters all come from the whole match."""
        pieces, at, place = [], 0, 0
        starts, ends, before, after = [], [], [], []  # new start and end, old start and end
        for m in pattern.finditer(self.text):
            a, b, new = m.start(), m.end(), put(m)
            if new is None:
                continue
            pieces += [self.text[at:a], new]
            place += a - at
            starts.append(place)
            place += len(new)
            ends.append(place)
            before.append(a)
            after.append(b)
            at = b
        if starts:
            self.text = "".join(pieces) + self.text[at:]
            self.layers.append((starts, ends, before, after))

    def _back(self, layer: tuple[list[int], ...], start: int, end: int) -> tuple[int, int, bool]:
        """The span before a layer, and whether an edit of the layer is in it."""
        starts, ends, before, after = layer
        i = bisect_right(starts, start) - 1  # the last edit that starts at or before the span
        j = bisect_right(starts, end - 1) - 1  # the same for its last character
        inside_i, inside_j = i >= 0 and start < ends[i], j >= 0 and end - 1 < ends[j]
        a = before[i] if inside_i else start + (after[i] - ends[i] if i >= 0 else 0)
        b = after[j] if inside_j else end + (after[j] - ends[j] if j >= 0 else 0)
        return a, b, inside_i or j > i

    def source(self, start: int, end: int) -> tuple[int, int]:
        for layer in reversed(self.layers):
            start, end, _ = self._back(layer, start, end)
        return start, end

    def changed(self, start: int, end: int) -> bool:
        """Whether any character of the span was put by an edit."""
        for layer in reversed(self.layers):
            start, end, hit = self._back(layer, start, end)
            if hit:
                return True
        return False


class Taken:
    """Stretches of a text that spans cover: apart from each other, in order, found by bisection."""

    def __init__(self, base: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, _, b in base:  # by start; kinds may overlap each other
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def take(self, a: int, b: int) -> bool:
        """Covers a..b if nothing there is covered yet."""
        at = bisect_right(self.starts, a)
        if (at and self.ends[at - 1] > a) or (at < len(self.starts) and self.starts[at] < b):
            return False
        self.starts.insert(at, a)
        self.ends.insert(at, b)
        return True


def _digits_of(m: re.Match) -> str | None:
    run = m[0]
    if not re.search(rf"(?i){_NUMERAL}", run):
        return None

    def one(w: re.Match) -> str:
        word = w[0].lower()
        return "." if word in ("dot", "point") else str(SPELLED[word]) if word in SPELLED else ""

    return re.sub(r"\.[\x20]|[\x20]\.", ".", _WORD_IN_RUN.sub(one, run))


def hidden_spans(text: str, base: list[Span]) -> list[Span]:
    """Spans that only the deobfuscated reading shows, in source code points."""
    drawn = not text.isascii() and _ANY_DRAWN.search(text) is not None
    plain = text.translate(_DRAWN) if drawn else text  # one character for one: offsets stay
    if not drawn and not _HINT.search(plain):
        return []
    taken = Taken(base)
    out: list[Span] = []

    def add(kind: int, a: int, b: int) -> None:
        if taken.take(a, b):
            out.append((a, kind, b))

    if drawn:
        for a, kind, b in base_spans(plain):
            if text[a:b] != plain[a:b]:
                add(kind, a, b)
    if _HINT.search(plain):
        disguised = Mapped(plain)
        disguised.replace(_DOT, lambda m: ".")
        disguised.replace(_AT, lambda m: "@")
        for first, end in addresses(disguised.text):
            read = disguised.text[first:end]
            a, b = disguised.source(first, end)
            raw = plain[a:b]
            bare = re.search(r"(?i)\x20at\x20", raw) is not None
            last = read.rpartition(".")[2].lower()
            worded = bare or re.search(r"(?i)\x20dot\x20", raw) is not None
            if raw != read and (not bare or _DOT.search(raw)) and (last in ENDINGS if worded else len(last) >= 2 and last.isalpha()):
                add(0, a, b)
        for start, kind, end in base_spans(disguised.text):
            if kind in (1, 3) and disguised.changed(start, end):  # the kinds that are written with dots
                add(kind, *disguised.source(start, end))
        numbers = Mapped(plain)
        numbers.replace(_SPELLED_RUN, _digits_of)
        numbers.replace(_PLUS, lambda m: "+")
        for start, kind, end in base_spans(numbers.text):
            if kind and numbers.changed(start, end):
                add(kind, *numbers.source(start, end))
        both = Mapped(plain)  # spelled numerals between disguised dots
        both.replace(_DOT, lambda m: ".")
        both.replace(_SPELLED_RUN, _digits_of)
        for start, kind, end in base_spans(both.text):
            if kind == 1 and both.changed(start, end):
                add(kind, *both.source(start, end))
    return sorted(out)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_text(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans, added spans."""
    base = base_spans(text or "")
    return base, hidden_spans(text or "", base)


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base (spans as text), spans (base and added)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, bases, alls = [], [], []
            for text in batch.column("text").to_pylist():
                base, more = scan_text(text)
                counts.append([sum(k == kind for _, k, _ in base) for kind in range(4)])
                bases.append(joined(base))
                alls.append(joined(sorted(base + more)))
            by_kind = [pa.array([c[k] for c in counts], pa.int64()) for k in range(4)]
            columns = [batch.column("doc_id"), *by_kind, pa.array(bases, pa.string()), pa.array(alls, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "spans"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return rows.mapInArrow(scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")
