"""Personal data in texts, plain and disguised, as spans of the source's code points.

Plain identifiers are found in the text as it is: email addresses, IPv4 addresses, card numbers
that pass the Luhn check, and international phone numbers. Disguised ones are found after two
transducers have normalised the text: the first writes look-alike characters as the ASCII ones they
imitate and drops invisible ones; the second writes spelled digits as digits, and ``[at]``, ``(dot)``,
"at ... dot ..." and their like as signs. Each output character keeps the source interval it was made
of, so a span found in the normalised text maps back to the source. A span of the normalised text is
reported if some character of it was changed and no plain span of its kind contains it; a plain span
is always reported. Texts in which no rule can fire are not normalised.

Bare words are signs only in a whole disguise: "at" before a word with a "dot" behind it, "dot"
between the labels of such an address or between numbers, "plus" before a digit. So ordinary prose is
left alone.

All searches take time in proportion to the text, also for texts of one endless word or number.

Defined cases: a null text is the empty text and holds nothing; rows are independent, so repeated rows
give equal rows; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from operator import and_

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from .common import batches

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_NUMBER = re.compile(r"[0-9]+(?:[ -][0-9]+)*")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+")

#: Characters that look like an ASCII one, beside those that compatibility decomposition resolves.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "І": "I", "Ј": "J", "Ѕ": "S",
    "а": "a", "е": "e", "к": "k", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ո": "n", "ԛ": "q", "ԝ": "w",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "υ": "u", "ı": "i", "ɑ": "a", "ɡ": "g",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "。": ".", "·": ".", "•": ".", "∙": ".", "⋅": ".",
}
#: Characters that are not seen.
INVISIBLE = "­᠎​‌‍‎‏⁠⁡⁢⁣⁤﻿"
#: Digits as words (English, Spanish, French, German).
DIGITS = [("zero", "cero", "zéro", "null"), ("one", "uno", "un", "eins"), ("two", "dos", "deux", "zwei"), ("three", "tres", "trois", "drei"),
          ("four", "cuatro", "quatre", "vier"), ("five", "cinco", "cinq", "fünf"), ("six", "seis", "sechs"), ("seven", "siete", "sept", "sieben"),
          ("eight", "ocho", "huit", "acht"), ("nine", "nueve", "neuf", "neun")]
#: Words for the signs of an address that belong together, and for plus.
SIGNS, PLUS = [("at", "dot"), ("arroba", "punto"), ("arobase", "point"), ("klammeraffe", "punkt")], ("plus", "más")

_DIGIT = {w: str(d) for d, words in enumerate(DIGITS) for w in words}
_any = lambda words: "(?:" + "|".join(sorted(words, key=len, reverse=True)) + ")"
_DIGIT_WORD, _AT, _DOT_WORD, _PLUS = _any(_DIGIT), _any([a for a, _ in SIGNS]), _any([d for _, d in SIGNS]), _any(PLUS)
_LABEL, _WORD_START, _WORD_END = r"[A-Za-z0-9-]+", r"(?<![^\W_])", r"(?![^\W_])"
_GAP, _SPACE = r"[ \t]{0,8}", r"[ \t]{1,8}"  # longer gaps are no part of a disguise, so white space is read once
_boxed = lambda sign: rf"(?:(?<![ \t]){_GAP}[\[({{<]{_GAP}{sign}{_GAP}[\])}}>]{_GAP})"
_bare = lambda word: rf"(?:(?<![ \t]){_SPACE}{word}{_SPACE})"
_BOXED_AT, _BOXED_DOT = _boxed(f"(?:@|{_AT})"), _boxed(rf"(?:\.|{_DOT_WORD})")
_ANY_DOT = f"(?:{_BOXED_DOT}|{_bare(_DOT_WORD)})"


def _address(at: str, dot: str) -> str:
    """A bare sign with a domain behind it of which a dot is written out."""
    rest = rf"(?:(?:{dot}|\.){_LABEL})*"
    return rf"{at}(?={_LABEL}{rest}{dot}{_LABEL})"


_ADDRESS = re.compile("|".join(
    [rf"{_BOXED_AT}(?={_LABEL}(?:{_ANY_DOT}|\.){_LABEL})", _address(rf"(?:(?<![ \t]){_GAP}@{_GAP})", _ANY_DOT)]
    + [_address(_bare(a), f"(?:{_BOXED_DOT}|{_bare(d)})") for a, d in SIGNS]), re.I)
_TAIL = re.compile(rf"{_LABEL}(?:(?:{_ANY_DOT}|\.){_LABEL})*", re.I)
_DOT = re.compile(_ANY_DOT, re.I)
_NAME_BEFORE = re.compile(rf"(?:[A-Za-z0-9_%+-]+{_ANY_DOT})+[A-Za-z0-9._%+-]*$", re.I)
_SPELLED = re.compile(rf"{_WORD_START}(?:(?P<plus>{_PLUS}){_GAP}(?=[0-9(]|{_DIGIT_WORD}{_WORD_END})|(?P<digit>{_DIGIT_WORD}){_WORD_END})", re.I)
_NUMBER_DOT = re.compile(rf"(?<=[0-9]){_ANY_DOT}(?=[0-9])", re.I)
_BOX = re.compile(rf"[\[({{<]{_GAP}(?:@|\.|{_AT}|{_DOT_WORD}){_GAP}[\])}}>]")
_SPACED_DOT = re.compile(rf"[ \t]{_DOT_WORD}[ \t]")
_RUN = re.compile(rf"(?:{_DIGIT_WORD}[ \t.-]{{0,8}}){{4}}")
_PLUS_NUMBER = re.compile(rf"{_PLUS}{_GAP}(?:[0-9(]|{_DIGIT_WORD})")


def hinted(text: str) -> bool:
    """Whether a text holds what the second transducer needs to matter; cheap tests come first."""
    low = text.lower()
    return (any(dot in low for _, dot in SIGNS) and bool(_SPACED_DOT.search(low)) or any(p in low for p in PLUS) and bool(_PLUS_NUMBER.search(low)) or bool(_BOX.search(low))
            or _digit_words(low) and bool(_RUN.search(low)))


def _digit_words(low: str) -> bool:
    """Whether two digit words follow each other, as the inner ones of four do."""
    known = list(map(_DIGIT.__contains__, low.replace("-", " ").replace(".", " ").split()))
    return any(map(and_, known, known[1:]))


def emails(text: str) -> list[Span]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
            last = domain.end()
        else:
            last = at + 1  # what stands before this sign can't belong to a later address
        at = text.find("@", at + 1)
    return out


def ips(text: str) -> list[Span]:
    out = []
    for chain in _DOTTED.finditer(text):
        parts, at = chain.group().split("."), chain.start()  # the first four numbers of a chain match, then the next four
        for k in range(0, len(parts) - 3, 4):
            size = sum(map(len, parts[k:k + 4])) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts[k:k + 4]):
                out.append((at, at + size))
            at += size + 1
    return out


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(int(d) * 2 - 9 * (d > "4") for d in digits[-2::-2])
    return total % 10 == 0


def cards(text: str) -> list[Span]:
    out = []
    for m in _NUMBER.finditer(text):
        if 16 <= m.end() - m.start() <= 37:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[Span]:
    out = []
    for m in _PHONE.finditer(text):
        own = m.group().rstrip(" ().-")
        if len(own) >= 4 and 8 <= sum(c.isdigit() for c in own) <= 15:
            out.append((m.start(), m.start() + len(own)))
    return out


FIND = {"email": emails, "ip": ips, "card": cards, "phone": phones}


class Characters(dict):
    """First transducer, as a table for ``str.translate``: code point to ASCII, to nothing, or to itself."""

    def __missing__(self, code: int):
        c = chr(code)
        to = "" if c in INVISIBLE else LOOKALIKES.get(c)
        if to is None and code >= 128:
            plain = unicodedata.normalize("NFKC", c)
            to = plain if len(plain) == 1 and plain.isascii() and plain.isprintable() else c
        self[code] = c if to is None else to
        return self[code]


CHARACTERS = Characters()


class Rewritten:
    """A text with the source interval [start, end) of each of its characters and whether it was changed."""

    def __init__(self, text: str):
        self.text = text.translate(CHARACTERS)
        if len(self.text) == len(text):
            self.start = list(range(len(text)))
        else:
            self.start = [i for i, c in enumerate(text) if CHARACTERS[ord(c)]]
        self.end = [i + 1 for i in self.start]
        self.changed = [a != text[i] for a, i in zip(self.text, self.start)]
        for k in range(1, len(self.start)):  # an invisible character hidden between two others
            self.changed[k] |= self.start[k] != self.end[k - 1]

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces disjoint intervals, in order, by texts of at most one character."""
        text, start, end, changed, last = [], [], [], [], 0
        for a, b, to in edits:
            text.append(self.text[last:a])
            start += self.start[last:a]
            end += self.end[last:a]
            changed += self.changed[last:a]
            if to:
                text.append(to)
                start.append(self.start[a])
                end.append(self.end[b - 1])
                changed.append(True)
            last = b
        self.text = "".join(text) + self.text[last:]
        self.start, self.end, self.changed = start + self.start[last:], end + self.end[last:], changed + self.changed[last:]


def spelled_digits(text: str) -> list[tuple[int, int, str]]:
    """Digit words as digits; white space between two of them goes."""
    edits: list[tuple[int, int, str]] = []
    for m in _SPELLED.finditer(text):
        if m["plus"]:
            edits.append((m.start(), m.end(), "+"))
            continue
        if edits and edits[-1][2] != "+" and 0 < m.start() - edits[-1][1] <= 8 and not text[edits[-1][1]:m.start()].strip(" \t"):
            edits.append((edits[-1][1], m.start(), ""))
        edits.append((m.start(), m.end(), _DIGIT[m["digit"].lower()]))
    return edits


def address_signs(text: str) -> list[tuple[int, int, str]]:
    """The signs of disguised addresses: at, the dots behind it, and those of the name before it."""
    edits, last = [], 0
    for m in _ADDRESS.finditer(text):
        if m.start() < max(last, 1) or text[m.start() - 1] not in _LOCAL:
            continue
        left = max(last, m.start() - 100)
        name = _NAME_BEFORE.search(text, left, m.start())
        if name and (name.start() == left or text[name.start() - 1].isspace() or name.start() == 0):
            edits += [(d.start(), d.end(), ".") for d in _DOT.finditer(text, name.start(), m.start())]
        edits.append((m.start(), m.end(), "@"))
        tail = _TAIL.match(text, m.end())
        edits += [(d.start(), d.end(), ".") for d in _DOT.finditer(text, m.end(), tail.end())]
        last = tail.end()
    return edits


def number_dots(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), ".") for m in _NUMBER_DOT.finditer(text)]


def disguised(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in the source of identifiers that only the normalised text shows."""
    plain = text if text.isascii() else text.translate(CHARACTERS)
    if plain == text and not hinted(text):
        return []
    out = Rewritten(text)
    if hinted(out.text):
        for edits in (spelled_digits, number_dots, address_signs):
            out.rewrite(edits(out.text))
    return [(kind, out.start[a], out.end[b - 1]) for kind in KINDS for a, b in FIND[kind](out.text) if any(out.changed[a:b])]


def spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(plain spans, all spans) by kind, then start."""
    base = [(kind, a, b) for kind in KINDS for a, b in FIND[kind](text)]
    more = [(kind, a, b) for kind, a, b in disguised(text) if not any(k == kind and x <= a and b <= y for k, x, y in base)]
    return base, sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1:])) if more else base


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans); the four counts are of the plain spans."""
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS),
              T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_spans", T.LongType())]

    def run(rows):
        for batch, texts in batches(rows, text_col):
            found = [spans(t) for t in texts]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
            sha = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), *counts, pa.array(sha, pa.string()), pa.array([joined(every) for _, every in found], pa.string()),
                 pa.array([len(every) for _, every in found], pa.int64())], names=[f.name for f in fields])

    return docs.select(id_col, text_col).mapInArrow(run, T.StructType(fields))


def redact(docs: DataFrame, mask: str = "<{}>", text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``text_col``, plain or disguised, replaced by its kind; overlapping spans
    become one that is named after the first."""
    def run(rows):
        for batch, texts in batches(rows, text_col):
            at = batch.schema.get_field_index(text_col)
            null = batch.column(at).is_null().to_pylist()
            clean = [None if none else _masked(t, mask) for none, t in zip(null, texts)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(clean, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def _masked(text: str, mask: str) -> str:
    out, last = [], 0
    for kind, a, b in sorted(spans(text)[1], key=lambda s: s[1:]):
        if a >= last:
            out += [text[last:a], mask.format(kind)]
        last = max(last, b)
    return "".join(out) + text[last:]
