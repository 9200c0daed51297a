"""Personal data in reports, also where it is disguised.

Plain identifiers are found in the text as it stands. Then transducers rewrite the text and remember where each character came from: look-alike, full-width and
invisible characters become plain ones, ``[at]``, ``(dot)`` and spelled forms become ``@`` and ``.``, and runs of spelled digits become digits. The
same patterns run over the rewritten text, and what they find is mapped back to the characters of the source. Added spans never replace plain ones.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Kinds in their order, and the patterns of the identifiers.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Spelled digits of four languages, words for signs, look-alikes of Latin letters.
_DIGIT_WORDS = {
    word: str(digit)
    for words in (
        "zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve")
    for digit, word in enumerate(words.split())
}
_AT_WORDS = ("at", "arobase", "arroba", "klammeraffe")
_DOT_WORDS = ("dot", "punkt", "point", "punto")
_PLUS_WORDS = ("plus", "más")
_LOOKALIKES = dict(zip("асеорхуіјѕԁԛԝАВСЕНІЈКМОРЅТХУοανικρτυχΑΒΕΗΙΚΜΝΟΡΤΥΧΖ", "aceopxyijsdqwABCEHIJKMOPSTXYoavikptuxABEHIKMNOPTYXZ"))
_INVISIBLE = "­​‌‍‎‏⁠﻿"


def _folds() -> dict[str, str]:
    fold = dict(_LOOKALIKES)
    fold |= {chr(0xFF01 + k): chr(0x21 + k) for k in range(94)}
    for zero in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6):
        fold |= {chr(zero + k): str(k) for k in range(10)}
    fold |= dict.fromkeys("             　", " ")
    fold |= dict.fromkeys("‐‑‒–—−﹣", "-")
    fold |= {"﹫": "@", "․": ".", "。": ".", "｡": "."}
    return fold | dict.fromkeys(_INVISIBLE, "")


_FOLD = _folds()
_ODD = re.compile("[" + "".join(map(re.escape, _FOLD)) + "]")
_OPEN, _SHUT = r"[\[({<]", r"[\])}>]"
_NAME = r"[A-Za-z0-9]"
_AT, _DOT = "|".join(_AT_WORDS), "|".join(_DOT_WORDS)
_SIGNS = re.compile(
    rf"(?P<at>(?<={_NAME})\s{{0,4}}{_OPEN}\s{{0,4}}(?:{_AT}|@)\s{{0,4}}{_SHUT}\s{{0,4}}(?={_NAME})"
    rf"|(?<={_NAME})\s{{1,4}}@\s{{0,4}}(?={_NAME})|(?<={_NAME})@\s{{1,4}}(?={_NAME})"
    rf"|(?<={_NAME})\s{{1,4}}(?:{_AT})\s{{1,4}}(?=[A-Za-z0-9-]{{1,63}}(?:\s{{0,4}}{_OPEN}\s{{0,4}}(?:{_DOT}|\.)\s{{0,4}}{_SHUT}\s{{0,4}}|\s{{1,4}}(?:{_DOT})\s{{1,4}}|\.)[A-Za-z]))"
    rf"|(?P<dot>(?<={_NAME})\s{{0,4}}{_OPEN}\s{{0,4}}(?:{_DOT}|\.)\s{{0,4}}{_SHUT}\s{{0,4}}(?={_NAME})|(?<={_NAME})\s{{1,4}}(?:{_DOT})\s{{1,4}}(?={_NAME}))",
    re.IGNORECASE)
#: Where nothing of this stands, ``_SIGNS`` finds nothing: what each of its branches needs, without the surroundings.
_SIGN_HINT = re.compile(rf"@|{_OPEN}\s{{0,4}}(?:{_AT}|\.)|\s(?:{_AT})\s|{_DOT}", re.IGNORECASE)
_DIGIT = "|".join(sorted(_DIGIT_WORDS, key=len, reverse=True))
_TOKEN = rf"(?:{_DIGIT}|{'|'.join(_PLUS_WORDS)}|{_DOT}|\+?[0-9]+)"
_SPELLED = re.compile(rf"(?<!\w)(?:{_TOKEN})(?:[\s.,-]{{1,3}}(?:{_TOKEN})){{3,}}(?!\w)", re.IGNORECASE)
_PART = re.compile(rf"(?P<word>[^\W\d_]+)|(?P<digits>\+?[0-9]+)|(?P<gap>[\s.,-]+)")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def identifiers(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the plain identifiers: leftmost, not overlapping within a kind; failing matches are dropped."""
    out = []
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            free = found.end()
            out.append((start, 0, free))
        at = text.find("@", max(at + 1, free))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _digits(m.group())
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


class _Tape:
    """A rewritten text whose pieces know the source range that they stand for."""

    def __init__(self, text: str):
        self.text, self.starts, self.sources = text, [0], [(0, len(text), True)]

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The source range of ``text[start:end]``."""
        a, b = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        first, last = self.sources[a], self.sources[b]
        return (first[0] + start - self.starts[a] if first[2] else first[0]), (last[0] + end - self.starts[b] if last[2] else last[1])

    def rewrite(self, edits: list[tuple[int, int, str]]) -> _Tape:
        """With ``text[a:b]`` replaced, for the ordered edits ``(a, b, new)``."""
        out, parts, size, done = _Tape(""), [], 0, 0
        out.starts, out.sources = [], []

        def copy(a: int, b: int) -> None:
            nonlocal size
            k = bisect_right(self.starts, a) - 1
            while a < b:
                stop = min(b, self.starts[k + 1] if k + 1 < len(self.starts) else len(self.text))
                s, e, plain = self.sources[k]
                out.starts.append(size)
                out.sources.append((s + a - self.starts[k], s + stop - self.starts[k], True) if plain else (s, e, False))
                parts.append(self.text[a:stop])
                size += stop - a
                a, k = stop, k + 1

        for a, b, new in edits:
            copy(done, a)
            if new:
                out.starts.append(size)
                out.sources.append((*self.source(a, b), False))
                parts.append(new)
                size += len(new)
            done = b
        copy(done, len(self.text))
        out.text = "".join(parts)
        if not out.starts:
            out.starts, out.sources = [0], [(0, 0, True)]
        return out


def _spelled(text: str) -> list[tuple[int, int, str]]:
    """Edits that turn runs of spelled digits into digits: words into their digits, gaps between them into nothing."""
    edits = []
    for run in _SPELLED.finditer(text):
        if sum(w.lower() in _DIGIT_WORDS for w in re.findall(r"[^\W\d_]+", run.group())) < 3:
            continue
        for m in _PART.finditer(text, run.start(), run.end()):
            word = m.group().lower()
            if m.lastgroup == "gap":
                new = "." if "." in word and not re.search(r"[\s,-]", word) else ""
            elif m.lastgroup == "digits":
                continue
            else:
                new = _DIGIT_WORDS.get(word) or ("+" if word in _PLUS_WORDS else ".")
            edits.append((m.start(), m.end(), new))
    return edits


def disguised(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of identifiers of the rewritten text, in characters of the source; empty where nothing is rewritten."""
    tape, changed = _Tape(text), False
    if not text.isascii():
        edits = [(m.start(), m.end(), _FOLD[m.group()]) for m in _ODD.finditer(text)]
        if edits:
            tape, changed = tape.rewrite(edits), True
    edits = _spelled(tape.text)
    if edits:
        tape, changed = tape.rewrite(edits), True
    if _SIGN_HINT.search(tape.text):
        edits = [(m.start(), m.end(), "@" if m.lastgroup == "at" else ".") for m in _SIGNS.finditer(tape.text)]
        if edits:
            tape, changed = tape.rewrite(edits), True
    if not changed:
        return []
    return [(a, kind, b) for start, kind, end in identifiers(tape.text) for a, b in [tape.source(start, end)]]


def all_spans(text: str) -> list[tuple[int, int, int, bool]]:
    """Plain spans and the disguised ones that no plain span of their kind touches: ``(start, kind, end, added)`` in order."""
    plain = identifiers(text)
    by: dict[int, list[tuple[int, int]]] = {}
    for start, kind, end in plain:
        by.setdefault(kind, []).append((start, end))
    out = [(*s, False) for s in plain]
    for start, kind, end in disguised(text):
        held = by.get(kind, [])
        k = bisect_right(held, (end, -1))  # plain spans of a kind don't overlap: the last that starts before the end decides
        if not (k and held[k - 1][1] > start):
            out.append((start, kind, end, True))
    return sorted(out)


_SPAN = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()),
    T.StructField("added", T.BooleanType())]))


@F.arrow_udf(_SPAN)
def _find(column: pa.Array) -> pa.Array:
    return pa.array(
        [[{"kind": KINDS[k], "start": a, "stop": b, "added": added} for a, k, b, added in all_spans(text or "")] for text in column.to_pylist()],
        pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("added", pa.bool_())])))


@F.arrow_udf(T.StringType())
def _redact(column: pa.Array) -> pa.Array:
    def clean(text):
        if text is None:
            return None
        parts, done = [], 0
        for start, kind, end, _ in all_spans(text):
            if start >= done:
                parts += [text[done:start], f"<{KINDS[kind].upper()}>"]
            done = max(done, end)
        return "".join([*parts, text[done:]])

    return pa.array([clean(t) for t in column.to_pylist()], pa.string())


def personal_data(loops: DataFrame, id_column: str = "file_id", text_column: str = "report") -> DataFrame:
    """``(id, spans)``, one row per row of ``loops``: spans by start, then kind (``KINDS``), in characters, end exclusive.

    ``added`` marks those that only the rewritten text shows. A null or empty text has none. Rows that repeat are answered each for itself; further
    columns are not looked at.
    """
    return loops.select(id_column, _find(F.col(text_column).cast("string")).alias("spans"))


def span_text(spans: Column) -> Column:
    """``kind:start:stop`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(report: Column) -> Column:
    """The text with a tag in angle brackets in place of each span; of overlapping spans the first names the tag. Null stays null."""
    return _redact(report.cast("string"))
