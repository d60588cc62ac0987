"""Personal data in texts, also where it is disguised, with spans in the text as it was given.

The base kinds are found in the text itself. Then transducers, one after the other, write a normalised text
(look-alike and compatibility letters, digits of all scripts, characters that do not show, `(at)` and `dot`,
spelled digits, in any case), in which every character knows the span it came from; what the same detectors
find there and the base did not, or only in part, is mapped back. How many digits are a number they decide.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pennyworks.llm.common import slices, small_batches

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, str]

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A digit before the start would have been part of the same match, so asking for none loses nothing.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_DOTTED = re.compile(r"[0-9]\.[0-9]")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Each @ with its longest local part; linear however long a run of letters is."""
    done, at = 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at) if at > done and text[at - 1] in _LOCAL else None
        if m:
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            yield start, m.end(), "email"
            done = m.end()
        at = text.find("@", max(at + 1, done))


def detect(text: str) -> list[Span]:
    """Base spans of a text by start, then kind; code points, end exclusive."""
    found: list[Span] = list(_emails(text))
    for m in _IP.finditer(text) if _DOTTED.search(text) else ():
        if all(len(part) < 4 and int(part or 0) <= 255 for part in (p.lstrip("0") for p in m[0].split("."))):
            found.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGITS.findall(m[0])) <= 15:
                found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


#: Stands for a dot that was disguised until it is known which hosts have one.
_DOT = "\ue000"

# Look-alikes of Latin letters in Cyrillic and Greek, and of the signs in addresses.
_LOOKALIKES = dict(zip("аеорсухіјѕһкмнтвԁԛԝАВЕКМНОРСТХІЈЅΑΒΕΖΗΙΚΜΝΟΡΤΥΧαοινρ", "aeopcyxijshkmhtbdqwABEKMHOPCTXIJSABEZHIKMNOPTYXaoivp", strict=True))
_LOOKALIKES |= {"․": ".", "。": ".", "‐": "-", "‑": "-", "–": "-", "−": "-", "﹫": "@", "﹒": ".", "﹢": "+"}
_NUMBERS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}


def _glyphs() -> dict[str, str]:
    """What each character that stands for others is read as; those that do not show as nothing."""
    found = {}
    for k in (*range(0x80, 0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x20000), *range(0xE0000, 0xE01F0)):
        c = chr(k)
        plain, digit = unicodedata.normalize("NFKC", c), unicodedata.decimal(c, None)
        if digit is not None:
            found[c] = str(digit)
        elif unicodedata.category(c) == "Cf" or k == 0x34F or 0xFE00 <= k <= 0xFE0F or 0xE0100 <= k:
            found[c] = ""
        elif plain != c and plain.isascii():
            found[c] = plain
    return found | _LOOKALIKES | {_DOT: "\ue001"}  # a text's own mark is not taken for ours


_GLYPHS = _glyphs()

_NUMBER = "(?ai:zero|oh|one|two|three|four|five|six|seven|eight|nine)"
_NUMBER_HINT = re.compile(r"(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)(?![^\W\d_])")
_WORDS_OF_DIGITS = rf"(?<![^\W\d_]){_NUMBER}+(?![^\W\d_])"
_GAP = r"[ \t,-]+"
_SIGN_HINT = re.compile(r"[ \t]dot[ \t]|[(\[{<][ \t]*(?:at|dot|@|\.)[ \t]*[)\]}>]", re.I)
_SIGN = re.compile(
    r"(?:(?<![ \t])[ \t]+)?[(\[{<][ \t]*(?P<sign>at|dot|@|\.)[ \t]*[)\]}>][ \t]*"
    r"|(?<=[A-Za-z0-9])[ \t]+(?P<dot>dot)[ \t]+(?=[A-Za-z0-9])",
    re.I,
)
_LABELS = rf"[A-Za-z0-9-]{{1,63}}(?:[.{_DOT}][A-Za-z0-9-]{{1,63}})+"
# The host has a disguised dot and ends in a name, and is not itself the local part of what follows.
_AT = re.compile(
    rf"(?<=[A-Za-z0-9._%+-])[ \t]+at[ \t]+(?=(?P<host>{_LABELS})(?P<next>[._%+]*@|[ \t]+at[ \t]+{_LABELS})?)",
    re.I,
)
_NO_NAME = re.compile(rf"[.{_DOT}](?:[0-9-]+|{_NUMBER})$", re.I)
_SPELLED = re.compile(
    rf"(?P<plus>(?<![^\W\d_])plus{_GAP}(?=[0-9]|{_WORDS_OF_DIGITS})|\+{_GAP}(?={_WORDS_OF_DIGITS}))"
    rf"|(?P<run>{_WORDS_OF_DIGITS}(?:{_GAP}{_WORDS_OF_DIGITS})*)(?P<tail>{_GAP}(?=[0-9]))?"
    rf"|(?P<gap>(?<=[0-9]){_GAP}(?={_WORDS_OF_DIGITS}))",
    re.I,
)
_NUMBER_WORD = re.compile(_NUMBER, re.I)
#: No more than one spelled digit, which next to a whole number is an ordinary word.
_LITTLE = re.compile(rf"[\W_]*{_NUMBER}?[\W_]*", re.I)
Edit = tuple[int, int, str]


def _plain_glyphs(text: str) -> Iterator[Edit]:
    held = () if text.isascii() else _GLYPHS.keys() & set(text)
    for m in re.finditer(f"[{re.escape(''.join(held))}]", text) if held else ():
        yield m.start(), m.end(), _GLYPHS[m[0]]


def _plain_signs(text: str) -> Iterator[Edit]:
    for m in _SIGN.finditer(text) if _SIGN_HINT.search(text) else ():
        yield m.start(), m.end(), "@" if m["sign"] and m["sign"].lower() in ("at", "@") else _DOT


def _plain_at(text: str) -> Iterator[Edit]:
    for m in _AT.finditer(text) if _DOT in text else ():
        if _DOT in m["host"] and not m["next"] and not _NO_NAME.search(m["host"]):
            yield m.start(), m.end(), "@"


def _plain_numbers(text: str) -> Iterator[Edit]:
    for m in _SPELLED.finditer(text) if _NUMBER_HINT.search(text.lower()) else ():
        if m["plus"]:
            yield m.start(), m.end(), "+"
        elif m["gap"]:
            yield m.start(), m.end(), " "
        else:
            words = [(w.start(), _NUMBERS[w[0].lower()]) for w in _NUMBER_WORD.finditer(text, m.start(), m.end("run"))]
            for (at, digit), end in zip(words, [*(x for x, _ in words[1:]), m.end("run")], strict=True):
                yield at, end, digit
            if m["tail"]:
                yield m.start("tail"), m.end("tail"), " "


class Normalised:
    """A text after some edits, and the way back to the source."""

    def __init__(self, text: str, edits: Callable[[str], Iterator[Edit]], before: Normalised | None = None):
        self.before = before
        self.segments: list[tuple[int, int, int, int]] = []  # start and end in the text, start and end in the source
        parts, at, length = [], 0, 0
        for start, end, s in edits(text):
            parts += [text[at:start], s]
            length += start - at
            self.segments.append((length, length + len(s), start, end))
            length, at = length + len(s), end
        self.text = "".join([*parts, text[at:]]) if self.segments else text
        self.starts, self.ends = [x[0] for x in self.segments], [x[1] for x in self.segments]

    def then(self, edits: Callable[[str], Iterator[Edit]]) -> Normalised:
        return Normalised(self.text, edits, self)

    def source(self, start: int, end: int) -> tuple[int, int, bool]:
        """Source span of [start, end), and whether a disguise lies in it."""
        first, last, touched = start, end, False
        for s, e, source_s, source_e in self._near(start, end):
            if e <= start:
                first = source_e + start - e
            elif s <= start:
                first = source_s
            if e <= end:
                last = source_e + end - e if e < end else source_e
                last = last if s < end else last
            elif s < end:
                last = source_e
            touched |= s < end and e > start or s == e and start < s < end
        if not self.before:
            return first, last, touched
        first, last, earlier = self.before.source(first, last)
        return first, last, touched or earlier

    def _near(self, start: int, end: int) -> list[tuple[int, int, int, int]]:
        low, high = bisect.bisect_right(self.ends, start), bisect.bisect_left(self.starts, end)
        return self.segments[max(0, low - 1) : high]


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), both by start, then kind."""
    text = text or ""
    base = detect(text)
    plain = Normalised(text, _plain_glyphs).then(_plain_signs).then(_plain_at)
    plain.text = plain.text.replace(_DOT, ".") if plain.before.segments else plain.text
    numbers = plain.then(_plain_numbers)
    again = [(plain, x) for x in detect(plain.text)] if plain.text != text else []
    again += [(numbers, x) for x in detect(numbers.text) if x[2] != "email"] if numbers.segments else []
    starts, ends = [x for x, _, _ in base], list(itertools.accumulate((y for _, y, _ in base), max))
    added = set()
    for form, (start, end, kind) in again:
        s, e, touched = form.source(start, end)
        if touched and _is_more(text, s, e, [(x, y) for x, y, _ in base[bisect.bisect_right(ends, s) : bisect.bisect_left(starts, e)] if s < y]):
            added.add((s, e, kind))
    widest, reach = [], dict.fromkeys(KINDS, -1)
    for x in sorted(added, key=lambda x: (x[0], -x[1])):
        if x[1] > reach[x[2]]:
            widest.append(x)
            reach[x[2]] = x[1]
    return base, sorted([*base, *widest], key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def _is_more(text: str, start: int, end: int, base: list[tuple[int, int]]) -> bool:
    """Whether [start, end) tells more than the base spans that it meets."""
    if not base:
        return True
    return not all(_LITTLE.fullmatch(x) for x in (text[start : min(x for x, _ in base)], text[max(y for _, y in base) : end]))


def spans(documents: DataFrame) -> DataFrame:
    """doc_id, base and all: arrays of (start, end, kind) for every row of documents.

    A null text counts as empty and has no spans. Nulls in doc_id pass through, repeated rows come back as
    often as they came, an empty table gives an empty result, other columns are not looked at.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [find(t.as_py()) for t in batch.column(1)]
            columns = [pa.array([[dict(zip(("start", "end", "kind"), s, strict=True)) for s in f[k]] for f in found], kind) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "base", "all"])

    span = "array<struct<start: long, end: long, kind: string>>"
    return small_batches(documents).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, base {span}, all {span}")


def _mask(text: str | None) -> str | None:
    if not text:
        return text
    parts, at = [], 0
    for start, end, kind in find(text)[1]:
        if end <= at:
            continue
        parts += [text[at : max(at, start)], f"<{kind.upper()}>" if start >= at else ""]
        at = end
    return "".join([*parts, text[at:]])


def redact(documents: DataFrame) -> DataFrame:
    """documents with each span replaced by its kind, as in `<EMAIL>`; rows, order and other columns stay.

    Where spans overlap, the first one's kind stands for all that they cover; of equal starts the kind that KINDS lists first. Texts are read whole, however long;
    null and empty ones stay, repeated rows are treated alike, and an empty table gives an empty one.
    """
    names, at = documents.columns, documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            text = pa.array([_mask(t.as_py()) for t in batch.column(at)], batch.column(at).type)
            yield pa.RecordBatch.from_arrays([text if k == at else c for k, c in enumerate(batch.columns)], names=names)

    return small_batches(documents).mapInArrow(run, documents.schema)


def digest(spans_column: str):
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans_column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
