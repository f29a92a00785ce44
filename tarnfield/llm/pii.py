"""Personal data: fixed patterns plus offset-preserving deobfuscation.

Base spans come from four patterns on the source text.  The method then runs
the text through small transducers that normalise homoglyphs, spelled digits
and at/dot disguises.  Each transducer yields pieces of output, every output
character keeping the source range it came from; the same patterns run on the
normalised text, and what they find is mapped back to source offsets.  Base
spans stay as they are; spans that one of the same kind covers are left out, and
those that reach beyond a base span stand beside it.

Two forms are left alone, since plain sentences have them too: a bare "at" before
a written host (joe at host.org), and a written sign before a host whose dot
stands between blanks (joe@host . org).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfield.llm.common import read

KINDS = ("email", "ip", "card", "phone")

#: Fixed patterns of the base spans.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a match can only start where its digits do, so long runs are read once
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Fixed values, from the public list of confusable characters: by ASCII character, those of other scripts that look
#: like it, beside what compatibility normalisation folds.
LOOKALIKES = {
    "A": "АΑᎪ", "B": "ВΒᏴ", "C": "СϹᏟ", "D": "Ꭰ", "E": "ЕΕᎬ", "F": "Ϝ", "G": "ԌᏀ", "H": "НΗᎻ", "I": "ІΙӀ", "J": "ЈᎫ", "K": "КΚᏦ", "L": "Ꮮ", "M": "МΜϺᎷ",
    "N": "Ν", "O": "ОΟՕ", "P": "РΡᏢ", "Q": "Ԛ", "R": "ᎡᏒ", "S": "ЅՏᏚ", "T": "ТΤᎢ", "U": "Ս", "V": "ѴᏙ", "W": "ԜᎳ", "X": "ХΧ", "Y": "УΥҮ", "Z": "ΖᏃ",
    "a": "аαɑ", "b": "Ьƅ", "c": "сϲᴄ", "d": "ԁ", "e": "еҽ", "f": "ք", "g": "ɡցᶃ", "h": "һհ", "i": "іιıɩɪ", "j": "јϳ", "k": "кκĸ", "l": "ӏǀ", "n": "ոռη", "o": "оοօσᴏ",
    "p": "рρϱ", "q": "ԛգ", "r": "гᴦ", "s": "ѕꜱƽ", "t": "τ", "u": "υսʋᴜ", "v": "νѵᴠ", "w": "ԝѡωɯᴡ", "x": "хχ", "y": "уүγʏ", "z": "ᴢ",
    ".": "\u2024\u2219", "-": "\u2010\u2011\u2012\u2013\u2212\u2043", " ": "\u00a0\u2007\u2009\u202f",
}
HOMOGLYPHS = {c: plain for plain, others in LOOKALIKES.items() for c in others}
#: Invisible characters that split identifiers.
INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
#: Names of digits.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4",
    "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
}

_WORD_OF_DIGIT = "|".join(DIGIT_WORDS)
_CASELESS = re.IGNORECASE | re.ASCII
#: A run of spelled digits, perhaps mixed with written ones; a single word is no number.
_SPELLED = re.compile(rf"(?<![A-Za-z0-9])(?:plus[\x20-])?(?:(?:{_WORD_OF_DIGIT}|[0-9]|dot|point)[\x20-]?){{3,}}(?![A-Za-z])", _CASELESS)
_SPELLED_PART = re.compile(rf"(plus|{_WORD_OF_DIGIT}|dot|point)[\x20-]?|([0-9])[\x20-](?={_WORD_OF_DIGIT}|dot|point)", _CASELESS)
_A_WORD = re.compile(_WORD_OF_DIGIT, _CASELESS)
#: A dot in words between written digits.
_WRITTEN = re.compile(r"(?<=[0-9])[\x20-](?:dot|point)[\x20-](?=[0-9])", _CASELESS)
#: name (at) host (dot) org: bracketed signs, or bare words where another sign is disguised too, in any mix.
_BRACKETED = re.compile(r"\x20?[\[({<]\x20?(at|dot)\x20?[\])}>]\x20?", _CASELESS)
_AT = re.compile(r"\x20?[\[({<]\x20?at\x20?[\])}>]\x20?|\x20(at|@)\x20|@", _CASELESS)
_DOT_WORD = r"\x20?[\[({<]\x20?dot\x20?[\])}>]\x20?|\x20dot\x20"
_DOTS = {False: re.compile(rf"({_DOT_WORD}|\x20\.\x20)|\.", _CASELESS), True: re.compile(rf"({_DOT_WORD})|\x20?\.\x20?", _CASELESS)}
_HOSTS = {k: re.compile(rf"[A-Za-z0-9-]+(?:(?:{x.pattern})[A-Za-z0-9-]+)+", _CASELESS) for k, x in _DOTS.items()}
_NAME_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile("[0-9]")
#: What every run of spelled digits holds: the name of a digit beside another part.
_TWO_SPELLED = re.compile(rf"(?:{_WORD_OF_DIGIT})[\x20-]?(?:{_WORD_OF_DIGIT}|[0-9]|dot|point)|(?:[0-9]|dot|point)[\x20-]?(?:{_WORD_OF_DIGIT})")
_SIGNS = re.compile(r"[\[({<]\x20?(?:at|dot)")


@cache
def _folded() -> dict[str, str]:
    """What a character is read as: look-alikes, and what compatibility normalisation makes printable ASCII."""
    flat = ((c, unicodedata.normalize("NFKC", c)) for c in map(chr, range(0x80, 0x20000)) if not 0xD800 <= ord(c) < 0xE000)
    ascii_ones = {c: x for c, x in flat if x.isascii() and x.isprintable() and x}
    return ascii_ones | HOMOGLYPHS | dict.fromkeys(INVISIBLE, "")


@cache
def _foldable() -> re.Pattern[str]:
    return re.compile("[" + "".join(map(re.escape, sorted(_folded()))) + "]")


def _disguised(text: str) -> bool:
    """Whether any transducer could change the text; texts for which this is false pass through unchanged."""
    if not text.isascii() and not _folded().keys().isdisjoint(set(text)):
        return True
    low = text.lower()
    if " dot " in low or " @ " in low or any(c in low for c in "[({<") and _SIGNS.search(low):
        return True
    return _TWO_SPELLED.search(low) is not None or ("dot" in low or "point" in low) and _WRITTEN.search(low) is not None



def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def find(text: str) -> list[tuple[int, int, int]]:
    """(rank of kind, start, end) by kind and start: leftmost non-overlapping matches of each kind, failing ones dropped."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        # the leftmost match around this sign starts where the run of name characters before it does
        left = at
        while left > end and (text[left - 1].isascii() and (text[left - 1].isalnum() or text[left - 1] in "._%+-")):
            left -= 1
        domain = _DOMAIN.match(text, at + 1) if left < at else None
        if domain:
            end = domain.end()
            found.append((0, left, end))
        at = text.find("@", max(at + 1, end))
    first = _DIGIT.search(text)
    if not first:
        return found
    for m in _IP.finditer(text, first.start()):
        if all(int(p) <= 255 if len(p) < 9 else not p.strip("0") or int(p.lstrip("0")[:9]) <= 255 and len(p.lstrip("0")) <= 3 for p in m.group().split(".")):
            found.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text, first.start()):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            found.append((3, m.start(), m.end()))
    return found


class Mapped:
    """Text under transduction: out[i] came from source[start[i]:end[i]]."""

    def __init__(self, text: str):
        self.text = text
        self.start = list(range(len(text)))
        self.end = list(range(1, len(text) + 1))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace text[a:b] by new for each (a, b, new), in order and apart; every new character covers the whole of a..b."""
        if not edits:
            return
        text, start, end, at = [], [], [], 0
        for a, b, new in edits:
            text += (self.text[at:a], new)
            start += self.start[at:a] + [self.start[a]] * len(new)
            end += self.end[at:a] + [self.end[b - 1]] * len(new)
            at = b
        self.text = "".join(text) + self.text[at:]
        self.start, self.end = start + self.start[at:], end + self.end[at:]


def _fold_characters(m: Mapped) -> None:
    table = _folded()
    m.rewrite([(x.start(), x.end(), table[x[0]]) for x in _foldable().finditer(m.text)])


def _fold_signs(m: Mapped) -> None:
    text, edits, done = m.text, [], 0
    for x in _AT.finditer(text):
        bare, left = x[1] is not None, x.start()
        host = _HOSTS[bare].match(text, x.end()) if x.start() >= done else None
        if not host:
            continue
        dots = list(_DOTS[bare].finditer(text, host.start(), host.end()))
        in_words = any(y[1] and y[1] != " . " for y in dots)
        # a bare sign between words is one where the rest is disguised too; "at" and "@" as such are common
        if not (in_words or x[1] == "@" or not bare and x[0] != "@"):
            continue
        before = []
        while True:
            word = left
            while word > done and text[word - 1] in _NAME_CHARACTERS:
                word -= 1
            if word == left or word - 5 <= done or text[word - 5 : word].lower() != " dot " or text[word - 6] not in _NAME_CHARACTERS:
                break
            before.append((word - 5, word, "."))
            left = word - 5
        if word == x.start():
            continue
        edits += before[::-1]
        if bare:
            edits.append((x.start(), x.end(), "@"))
        edits += [(y.start(), y.end(), ".") for y in dots if y[0] != "." and not set(y[0]) & set("[({<")]
        done = host.end()
    m.rewrite(edits)
    m.rewrite([(x.start(), x.end(), "@" if x[1].lower() == "at" else ".") for x in _BRACKETED.finditer(m.text)])


def _fold_digits(m: Mapped) -> None:
    edits = []
    for x in _SPELLED.finditer(m.text):
        if not _A_WORD.search(x[0]):
            continue
        for y in _SPELLED_PART.finditer(x[0]):
            word = (y[1] or y[2]).lower()
            gap = len(y[0]) - len(word)
            new = "+" if word == "plus" else "." if word in ("dot", "point") else DIGIT_WORDS.get(word, word)
            last = x.start() + y.end() == x.end()
            edits.append((x.start() + y.start(), x.start() + y.end() - (gap if last else 0), new))
    m.rewrite(edits)
    m.rewrite([(x.start(), x.end(), ".") for x in _WRITTEN.finditer(m.text)])


def detect(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, added spans) of one text, both (rank, start, end) in code points of the source."""
    text = text or ""
    base = find(text)
    if not _disguised(text):
        return base, []
    m = Mapped(text)
    _fold_characters(m)
    _fold_signs(m)
    _fold_digits(m)
    if m.text == text:
        return base, []
    added = []
    for rank, a, b in find(m.text):
        x, y = m.start[a], m.end[b - 1]
        if m.text[a:b] != text[x:y] and not any(k == rank and s <= x and y <= e for k, s, e in base):
            added.append((rank, x, y))
    return base, added


_SPANS = "array<struct<kind: string, start: int, end: int, added: boolean>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (kind, start, end, added) of every row, by kind and start.

    Null and empty texts have no span; repeated rows are scanned each; ids may be
    null and of any type; texts are read whole, however long, in time that grows with their
    length; other columns of docs are not looked at; an empty table stays empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("added", pa.bool_())]))
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                base, added = detect(text)
                tagged = sorted([(*s, False) for s in base] + [(*s, True) for s in added])
                rows.append([{"kind": KINDS[k], "start": x, "end": y, "added": new} for k, x, y, new in tagged])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, spans {_SPANS}")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: ~x["added"])
    number = lambda kind: F.size(F.filter("spans", lambda x: ~x["added"] & (x["kind"] == kind))).cast("long")
    listed = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select(
        "doc_id",
        *[number(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )
