"""Problem 3: text that looks the same but differs in its characters.

A whole Arrow batch becomes one array of code points. Full-width forms, spaces, zero-width characters and ligatures go
through lookup tables (a gather, with offsets where one character becomes none or several); accents are composed by a
sorted table of (letter, mark) pairs; look-alike letters are decided word by word from counts of scripts. Every step is an
array operation over the batch, none a string call per row.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .letters import CYRILLIC_LOOKS, LATIN_LOOKS

# Characters without width, and spaces that don't break.
ZERO_WIDTH = "\u00ad\u180e\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\u2064\ufeff" + "\U000e0001" + "".join(map(chr, range(0xE0020, 0xE0080)))
NO_BREAK = "\u00a0\u2007\u202f"
WIDTH, ACCENT, ZERO, SPACE, LETTER = 1, 2, 4, 8, 16
#: All code points; beyond the second plane there are ideographs, selectors and tags only.
TOP, SECOND = 0x110000, 0x20000
_LATIN, _CYRILLIC, _GREEK, _ARMENIAN, _OTHER = 1, 2, 3, 4, 5


class Tables:
    """The lookup tables, made by rule from the Unicode database."""

    def __init__(self) -> None:
        self.flag = np.zeros(TOP, np.uint8)
        self.count = np.ones(TOP, np.uint8)
        self.first = np.arange(TOP, dtype=np.uint32)
        self.at = np.zeros(TOP, np.uint32)
        more: list[int] = []
        self.mark = np.zeros(TOP, bool)
        self.mark[0xE0100:0xE01F0] = True
        self.styled = np.zeros(TOP, bool)
        self.script = np.zeros(TOP, np.uint8)
        self.script[SECOND:0xE0000] = _OTHER
        pairs: dict[int, int] = {}
        for cp in range(SECOND):
            c = chr(cp)
            cat = unicodedata.category(c)
            if cat == "Cn":
                continue
            if cat[0] == "L" and c not in "ªº":
                name = unicodedata.name(c, "").split(" ")[0]
                self.script[cp] = {"LATIN": _LATIN, "CYRILLIC": _CYRILLIC, "GREEK": _GREEK, "ARMENIAN": _ARMENIAN}.get(name, _OTHER)
            self.mark[cp] = cat == "Mn"
            d = unicodedata.decomposition(c)
            if not d:
                continue
            if d.startswith(("<wide>", "<narrow>")) or cp == 0x3000 or 0xFB00 <= cp <= 0xFB06:
                to = unicodedata.normalize("NFKC", c)
                self.flag[cp] = WIDTH
                self.count[cp], self.at[cp], self.first[cp] = len(to), len(more), ord(to[0])
                more += map(ord, to)
            elif d.startswith("<font>"):  # letters and digits in the styles of mathematics
                to = unicodedata.normalize("NFKC", c)
                self.styled[cp], self.first[cp] = len(to) == 1, ord(to[0])
            elif d[0] != "<" and " " in d and unicodedata.normalize("NFC", c) == c:
                a, b = (int(x, 16) for x in d.split())
                pairs[a << 32 | b] = cp
        for c in ZERO_WIDTH:
            self.flag[ord(c)], self.count[ord(c)] = ZERO, 0
        for c in NO_BREAK:
            self.flag[ord(c)], self.first[ord(c)] = SPACE, 0x20
        self.more = np.array(more, np.uint32)
        self.keys = np.array(sorted(pairs), np.uint64)
        self.composed = np.array([pairs[k] for k in sorted(pairs)], np.uint32)
        self.to_latin = np.zeros(TOP, np.uint32)
        for c, to in LATIN_LOOKS.items():
            self.to_latin[ord(c)] = ord(to)
        self.to_cyrillic = np.zeros(TOP, np.uint32)
        for c, to in CYRILLIC_LOOKS.items():
            self.to_cyrillic[ord(c)] = ord(to)


@lru_cache(1)
def tables() -> Tables:
    return Tables()


def _sums(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sums of ``x`` between consecutive offsets (n + 1 of them), empty ones 0."""
    total = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
    return total[start[1:]] - total[start[:-1]]


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of a string array in a row, and the n + 1 offsets of its texts (nulls are empty)."""
    texts = texts.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(off) else np.empty(0, np.uint8)
    begins = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), begins[off - off[0]]


def to_strings(points: np.ndarray, start: np.ndarray, valid: np.ndarray) -> pa.Array:
    """The reverse: a string array from code points and offsets."""
    data = points.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    off = np.concatenate([[0], np.cumsum(width)])[start]
    bits = pa.array(valid).buffers()[1] if not valid.all() else None
    return pa.Array.from_buffers(pa.large_string(), len(start) - 1, [bits, pa.py_buffer(off.astype(np.int64).tobytes()), pa.py_buffer(data)]).cast(pa.string())


def normalized(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The texts in one form, and per text the kinds of what was changed (bits)."""
    t = tables()
    valid = np.asarray(texts.is_valid())
    points, start = code_points(texts)
    n = len(texts)
    found = np.zeros(n, np.uint8)
    if not len(points):
        return to_strings(points, start, valid), found
    row = np.repeat(np.arange(n), np.diff(start))
    flag = t.flag[points]
    np.bitwise_or.at(found, row[flag > 0], flag[flag > 0])
    styled = t.styled[points]
    if styled.any():  # a word in a style looks like another one; a single letter or a digit is a sign of mathematics, brought to the same form all the same
        lettered = t.script[points] > 0
        near = np.zeros(len(points), bool)
        near[1:] = lettered[:-1] & (row[1:] == row[:-1])
        near[:-1] |= lettered[1:] & (row[1:] == row[:-1])
        found[row[styled & lettered & near]] |= LETTER

    # widths, spaces, zero-width characters, ligatures: gather, with offsets for what grows or goes
    count = t.count[points].astype(np.int64)
    new = t.first[points]
    if (count != 1).any():
        place = np.cumsum(count) - count
        out = np.repeat(new, count)
        many = np.flatnonzero(count > 1)
        for k in range(1, int(count.max()) if len(many) else 0):
            grown = many[count[many] > k]
            out[place[grown] + k] = t.more[t.at[points[grown]] + k]
        row = np.repeat(row, count)
        new = out
    # letters before marks, so that a mark is composed with the letter its word needs
    points, changed = _letters(new.astype(np.uint32), row, n, t)
    np.bitwise_or.at(found, row[changed], np.uint8(LETTER))

    # marks: each pass joins the first mark after a letter to it, until no pair has a composed letter
    while len(points) > 1:
        mark = t.mark[points]
        at = np.flatnonzero(mark[1:] & ~mark[:-1] & (row[1:] == row[:-1])) + 1
        if not len(at):
            break
        key = points[at - 1].astype(np.uint64) << np.uint64(32) | points[at].astype(np.uint64)
        where = np.minimum(np.searchsorted(t.keys, key), len(t.keys) - 1)
        hit = t.keys[where] == key
        at, where = at[hit], where[hit]
        if not len(at):
            break
        points[at - 1] = t.composed[where]
        found[row[at]] |= ACCENT
        stay = np.ones(len(points), bool)
        stay[at] = False
        points, row = points[stay], row[stay]

    start = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])
    return to_strings(points, start, valid), found


def _letters(points: np.ndarray, row: np.ndarray, n: int, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Look-alike letters brought to the script of their word; and which code points changed."""
    low = points
    script = t.script[low]
    letter = (script > 0) | t.mark[low]
    look = (t.to_latin[low] > 0) & letter
    changed = np.zeros(len(points), bool)
    if not look.any() or not len(points):
        return points, changed
    first = letter & np.concatenate([[True], ~letter[:-1] | (row[1:] != row[:-1])])
    begin = np.flatnonzero(first)
    word = np.cumsum(first) - 1  # of a letter: its word
    words = len(begin)
    of = lambda x: np.bincount(word[x & letter], minlength=words)
    latin_all = (script == _LATIN) & ~look
    as_cyrillic = t.to_cyrillic[low] > 0
    latin = of(latin_all)
    foreign = of(look)
    foreign_cyrillic = of(look & (script == _CYRILLIC))
    plain = of((script > _LATIN) & ~look)
    plain_cyrillic = of((script == _CYRILLIC) & ~look)
    odd_latin = of(latin_all & ~as_cyrillic)
    length = of(letter)
    greek = of(script == _GREEK)
    row_of_word = row[begin]
    in_row = lambda x: np.bincount(row[x], minlength=n)[row_of_word]
    row_plain = in_row((script > _LATIN) & (script < _OTHER) & ~look)
    row_latin = in_row(latin_all & ~as_cyrillic)
    row_cyrillic = in_row((script == _CYRILLIC) & ~look)
    mixed = (latin > 0) & (foreign > 0) & (plain == 0)
    # a word of letters that either script has: the script of more of its letters, in a line that has that script
    to_cyr_mixed = mixed & (odd_latin == 0) & (row_cyrillic > 0) & (foreign_cyrillic >= latin) & (foreign == foreign_cyrillic)
    whole = (latin == 0) & (plain == 0) & (foreign > 0) & (row_plain == 0) & (row_latin > 0) & ~((length == 1) & (greek == 1))
    to_latin = (mixed & ~to_cyr_mixed) | whole
    to_cyr = to_cyr_mixed | ((plain_cyrillic > 0) & (plain == plain_cyrillic) & (latin > 0) & (odd_latin == 0) & (foreign == foreign_cyrillic))
    safe = np.minimum(np.maximum(word, 0), words - 1)
    a = look & letter & to_latin[safe]
    b = latin_all & as_cyrillic & to_cyr[safe]
    points = np.where(a, t.to_latin[low], np.where(b, t.to_cyrillic[low], points)).astype(np.uint32)
    return points, a | b


def one_form(df: DataFrame, record_id: str, text: str) -> DataFrame:
    """``(rec_id, text, kinds)``: every row's text in one form; ``kinds`` has a bit for each sort of change (1 full width,
    2 combining accent, 4 zero width, 8 non-breaking space, 16 look-alike letter; none for single signs of mathematics).

    No shuffle. A null text stays null with kinds 0, an empty one empty; null ids and repeated rows are kept as they are;
    texts of any length are whole in their batch; extra columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, kinds = normalized(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), text, pa.array(kinds.astype(np.int32))], names=["rec_id", "text", "kinds"])

    return df.select(F.col(f"`{record_id}`").cast("long").alias("rec_id"), F.col(f"`{text}`").alias("_t")).mapInArrow(run, "rec_id long, text string, kinds int")


def look_alike(df: DataFrame, record_id: str, text: str) -> DataFrame:
    """``(rec_id, kinds, text)`` of the rows that hold such characters, with the text as it stands.

    Rows of plain ASCII are dropped by the JVM; the rest goes through the arrays of ``normalized``, nothing else.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, kinds = normalized(b.column(1))
            at = np.flatnonzero(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(kinds[at].astype(np.int32)), b.column(1).take(pa.array(at))], names=["rec_id", "kinds", "text"])

    rows = df.where(F.col(f"`{text}`").rlike(r"[^\x00-\x7f]"))
    return rows.select(F.col(f"`{record_id}`").cast("long").alias("rec_id"), F.col(f"`{text}`").alias("_t")).mapInArrow(run, "rec_id long, kinds int, text string")
