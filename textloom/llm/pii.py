"""Personal data in texts, also where it is disguised, with offsets into the source text.

Plain detectors find emails, IPv4 addresses, payment cards and phone numbers. A chain of three small transducers
then rewrites a copy of the text: look-alike letters and digits to ASCII (zero-width characters vanish), at/dot
disguises to ``@`` and ``.``, runs of spelled digits to digits. Each step carries, for every character that it
writes, the source span it stands for. The same detectors read the copy, and what they find is mapped back to
source characters. Spans of the plain pass always stay; a disguised find is added unless one of its kind holds it
whole, so the two may overlap where the plain pass saw a part of an address. Every pattern runs in time linear in the text.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import per_text, ship

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    end, at = 0, text.find("@")
    while at >= 0:
        if at >= end and (m := _DOMAIN.match(text, at + 1)):
            start = at
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                end = m.end()
                yield "email", start, end
        at = text.find("@", at + 1)


def plain_spans(text: str) -> list[Span]:
    """Spans by kind and start; leftmost matches of a kind don't overlap, and one that fails its test is dropped."""
    out = list(_emails(text)) if "@" in text else []
    if _DIGIT.search(text) is None:
        return out
    if text.count(".") >= 3:
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


# --- fixed values: look-alikes of ASCII letters, in the order of the letters beside them
_CYRILLIC = dict(zip("авеіјкмнорѕстухАВЕІЈКМНОРЅСТУХԁԛԝһ", "abeijkmhopsctyxABEIJKMHOPSCTYXdqwh", strict=True))
_GREEK = dict(zip("αικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aiknoptuxABEZHIKMNOPTYX", strict=True))
_SIGNS = {"。": ".", "．": ".", "․": ".", "‧": ".", "＠": "@", "﹫": "@", "＋": "+", "﹢": "+", "－": "-", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ", " ": " ", " ": " "}
_ZERO_WIDTH = frozenset("­​‌‍⁠﻿")
_DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
# ---

_ALIKE = _CYRILLIC | _GREEK | _SIGNS
_SPOKEN_WORDS = frozenset(_DIGIT_WORDS) | frozenset("0123456789") | {"dot", "point", "punkt", "punto"}
_WORD = "|".join(sorted(_DIGIT_WORDS, key=len, reverse=True))
_SPOKEN = re.compile(rf"(?i)(?<!\w)(?:{_WORD}|[0-9]++)(?:[\x20,-]{{1,2}}(?:{_WORD}|[0-9]++|dot|point|punkt|punto)(?!\w)){{3,}}")
_SPOKEN_ITEM = re.compile(rf"(?i){_WORD}|[0-9]++|dot|point|punkt|punto")
_PLUS = re.compile(r"(?i)(?<!\w)plus[\x20]{1,2}(?=[0-9])")
# --- fixed values: at and dot as English, German, Spanish and French say them
_AT, _DOT = r"(?:at|ät|arroba|arobase)", r"(?:dot|punkt|punto|point)"
# ---
_BRACKET_AT = re.compile(rf"(?i)[\x20]?[\[({{<][\x20]?(?:{_AT}|@)[\x20]?[\])}}>][\x20]?")
_BRACKET_DOT = re.compile(rf"(?i)[\x20]?[\[({{<][\x20]?(?:{_DOT}|\.)[\x20]?[\])}}>][\x20]?")
# bare, at and dot must be of one language, as "at that point in" is none. A host may stand before any last label, but
# for a determiner ("look at the dot on it") only before a label that ends addresses
_LABEL = r"[a-z0-9-]{1,63}"
_ENDS = r"(?:com|org|net|edu|gov|info|io|co|uk|de|fr|es|eu|us|example)(?!\w)"
_DETERMINER = r"(?:an?|the|this|that|these|those|each|every|any|some|no|one|my|your|his|her|its|our|their)\x20dot\x20"


def _bare_at(at: str, dot: str) -> str:
    host = rf"{_LABEL}(?:\.{_LABEL}){{0,4}}\x20{dot}\x20(?:{_LABEL}\x20{dot}\x20){{0,3}}"
    return rf"\x20{at}\x20(?={host}{_ENDS}|(?!{_DETERMINER}){host}[a-z]{{2,63}}(?!\w))"


_BARE_AT = re.compile(rf"(?i)(?<=[a-z0-9])(?:{_bare_at('at', 'dot')}|{_bare_at('(?:ät|at)', 'punkt')}|{_bare_at('arroba', 'punto')}|{_bare_at('arobase', 'point')})")
_BRACKETS = re.compile(rf"[\[({{<]\x20?(?:{_AT}|{_DOT}|@|\.)\x20?[\])}}>]")
_DOTS = ("dot", "punkt", "punto", "point")
_BARE_DOT = re.compile(rf"(?i)(?<=[a-z0-9])\x20{_DOT}\x20(?=[a-z0-9])")
_DOT_BEFORE = re.compile(rf"(?i)(?<=[A-Za-z0-9._%+-])\x20{_DOT}\x20\Z")


class Copy:
    """A rewritten text that knows its source. Each step keeps its edits alone: their places in its result and in what it was given."""

    def __init__(self, text: str):
        self.text, self.steps = text, []

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Put in place of each text[a:b], in order, a string; its characters all stand for the whole of a:b."""
        if not edits:
            return
        text, at, moved, places = [], 0, 0, []
        for a, b, new in edits:
            text += (self.text[at:a], new)
            places.append((a + moved, a + moved + len(new), a, b))
            moved += len(new) - (b - a)
            at = b
        text.append(self.text[at:])
        self.text = "".join(text)
        self.steps.append(list(zip(*places, strict=True)))

    def source(self, a: int, b: int) -> tuple[int, int]:
        """The span of the source that text[a:b] stands for; b > a."""
        for begins, ends, sources, stops in reversed(self.steps):
            i, j = bisect_right(begins, a) - 1, bisect_right(begins, b - 1) - 1
            a = sources[i] if i >= 0 and a < ends[i] else a + (stops[i] - ends[i] if i >= 0 else 0)
            b = stops[j] if j >= 0 and b <= ends[j] else b + (stops[j] - ends[j] if j >= 0 else 0)
        return a, b


def _fold(c: str) -> str | None:
    """What a non-ASCII character is rewritten to; None leaves it."""
    if c in _ALIKE:
        return _ALIKE[c]
    if c in _ZERO_WIDTH:
        return ""
    if c.isdecimal():
        return str(unicodedata.decimal(c))
    wide = unicodedata.normalize("NFKC", c)
    return wide if len(wide) == 1 and wide.isascii() and wide != c else None


def _foldable(text: str) -> bool:
    if text.isascii():
        return False
    try:
        return b"\xad" in (raw := text.encode("latin-1")) or b"\xa0" in raw
    except UnicodeEncodeError:
        return True


def _dots_before(text: str) -> list[tuple[int, int, str]]:
    """Edits of the spelled dots in the local parts of addresses."""
    edits, at = [], text.find("@")
    while at >= 0:
        start, own = at, []
        while start > 0:
            end = start
            while start > 0 and text[start - 1] in _LOCAL:
                start -= 1
            m = _DOT_BEFORE.search(text, max(0, start - 8), start) if start < end else None
            if m is None:
                break
            own.append((m.start(), start, "."))
            start = m.start()
        edits += reversed(own)
        at = text.find("@", at + 1)
    return edits


def normalised(text: str) -> Copy | None:
    """The text without its disguises, or None where it has none."""
    fold, low = _foldable(text), text.lower()
    bracket = _BRACKETS.search(low) is not None
    dot = any(f" {w} " in low for w in _DOTS)
    if not (fold or bracket or dot or b"\1\1\1\1" in bytes(map(_SPOKEN_WORDS.__contains__, low.replace("-", " ").replace(",", " ").split()))):
        return None
    copy = Copy(text)
    if fold:
        found = {c: new for c in set(text) if not c.isascii() and (new := _fold(c)) is not None}
        if found:
            hit = re.compile("[" + "".join(map(re.escape, found)) + "]")
            copy.rewrite([(m.start(), m.end(), found[m[0]]) for m in hit.finditer(text)])
    copy.rewrite([(*m.span(), "@") for m in _BRACKET_AT.finditer(copy.text)])
    copy.rewrite([(*m.span(), ".") for m in _BRACKET_DOT.finditer(copy.text)])
    copy.rewrite([(*m.span(), "@") for m in _BARE_AT.finditer(copy.text)])
    if "@" in copy.text:
        copy.rewrite(_dots_before(copy.text))
        copy.rewrite([(*m.span(), ".") for m in _BARE_DOT.finditer(copy.text) if copy.text.rfind("@", max(0, m.start() - 128), m.start()) >= 0])
    spoken = []
    for m in _SPOKEN.finditer(copy.text):
        if not any(c.isalpha() for c in m[0]):
            continue
        last = m.start()
        for w in _SPOKEN_ITEM.finditer(copy.text, m.start(), m.end()):
            word = w[0].lower()
            spoken.append((last if w.start() > last else w.start(), w.end(), word if word.isdigit() else _DIGIT_WORDS.get(word, ".")))
            last = w.end()
    copy.rewrite(spoken)
    copy.rewrite([(*m.span(), "+") for m in _PLUS.finditer(copy.text)])
    return None if copy.text == text else copy


def all_spans(text: str | None) -> tuple[list[Span], list[Span]]:
    """Spans of the plain pass, and those that only the rewritten copy shows."""
    text = text or ""
    base = plain_spans(text)
    copy = normalised(text)
    if copy is None:
        return base, []
    added: list[Span] = []
    taken = {k: sorted((a, b) for kind, a, b in base if kind == k) for k in KINDS}
    for kind, a, b in plain_spans(copy.text):
        start, end = copy.source(a, b)
        # plain finds of a kind are apart and in order: only the last that begins by start can hold it
        at = bisect_right(taken[kind], (start, len(text) + 1)) - 1
        if at < 0 or end > taken[kind][at][1]:
            added.append((kind, start, end))
    return base, added


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span, or union of spans that overlap, replaced by its first kind in angle brackets."""
    out, at, reach = [], 0, -1
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= max(at, reach):
            out += (text[at:a], f"<{kind.upper()}>")
        at = reach = max(at, b)
    return "".join(out) + text[at:]


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_email, n_ip, n_card, n_phone (plain finds), base_sha256, spans
    (all finds), base_spans, n_added. Spans are kind:start:end in code points, end exclusive, by kind and start.

    A null text is empty: no spans, the digest of the empty string. Very long texts are read whole. Repeated rows each
    give their row; ids may be null; an empty table gives an empty result; other columns are ignored. Nothing is
    shuffled.
    """

    def make():
        def found(texts: list[str]) -> list:
            rows = []
            for text in texts:
                base, added = all_spans(text)
                plain = written(base)
                rows.append((*(sum(s[0] == k for s in base) for k in KINDS), hashlib.sha256(plain.encode()).hexdigest(), written(base + added), plain, len(added)))
            return list(zip(*rows, strict=True))

        return found

    return per_text(docs, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, base_spans string, n_added long", make, id_col, text_col)


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs with every find masked in the text; the length column, where there is one, follows.

    Null texts stay null, empty ones empty; rows that repeat, null ids and all other columns stay as they are. Very long
    texts are read whole. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    at_text = docs.columns.index(text_col)

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        base, added = all_spans(text)
        return masked(text, base + added) if base or added else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                column = part.column(at_text)
                yield part.set_column(at_text, part.schema.field(at_text), pa.array(map(one, column.to_pylist()), column.type))

    out = docs.mapInArrow(run, docs.schema)
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return out
