"""Problem 1: text decoded with the wrong character encoding.

Every word with a character outside ASCII (or an escape) is the start of a best-first search. A state is a text, an
operation encodes it in one character set and decodes the bytes in another, or resolves escapes; a visited set holds the
states' hashes, and a cost for implausible characters orders the queue. The cheapest text reached is the repair. Words
repeat a lot, so each task keeps what it found. The chains of operations that the words of a line propose are then judged
over the whole line, by how frequent its pairs of letters are in the corpus: a line was garbled in one way.
"""

from __future__ import annotations

import heapq
import html
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .letters import cyrillic_skeleton, skeleton

# Character sets whose bytes may have been shown for those of another.
SHOWN_AS = ("latin-1", "cp1252", "cp437", "cp850", "mac_roman", "cp1250", "cp1251", "cp866", "koi8-r", "cp1253", "cp1254", "cp1255", "iso8859-2", "iso8859-15")
MEANT = ("cp1252", "cp1251", "cp1255", "koi8-r", "cp866", "mac_roman", "cp437", "cp850", "cp1250", "iso8859-5")
# Letters that Western European text uses, lower case; pairs of accented letters that are usual; letters
# of other European alphabets.
USUAL = frozenset("àáâãäåæçèéêëìíîïñòóôõöøùúûüßœÿ")
USUAL_PAIRS = frozenset(("çã", "çõ", "çá", "çó", "éâ", "éé", "éê", "éè", "éï", "ïé", "èé", "áé", "íá", "íó", "íé", "áí", "óá", "úí", "öß", "üß", "äß", "éà"))
RUSSIAN = frozenset(map(chr, range(0x430, 0x450))) | {"ё"}
CENTRAL = frozenset("ąćęłńśźżčďěňřšťůžőűășşțţğıđāēīūģķļņėįųœħġċ")
QUOTES = frozenset("“”‘’«»„‚‹›–—…•")
SIGNS = frozenset("§°№€£¥©®™×÷−±¿¡′″†‡¶·")
SPACING = frozenset("¤¦¨¬¯´¸¢£¥¶±ˆ˜ˇ˘˙˛˝‰†‡‚„‹›√∫∂∑∏≤≥≠∞◊≈∩≡⌠⌡⌐¡¿®©§÷×·°")

ESCAPED = re.compile(r"&(?:#\d{2,6}|#x[0-9a-fA-F]{2,5}|[A-Za-z]{2,8}\d{0,2});|\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}|(?:%[89A-Fa-f][0-9A-Fa-f]){2,}|(?:=[89A-F][0-9A-F]){2,}")
#: What a row must hold to be looked at (Java syntax): anything beyond ASCII, or an escape.
LOOKED_AT = r"[^\x00-\x7f]|[\x01-\x08\x0e-\x1f\x7f]|&#?\w{2,8};|\\[ux][0-9a-fA-F]{2}|(%[89A-Fa-f][0-9A-Fa-f]){2}|(=[89A-F][0-9A-F]){2}"
MARGIN, STEP = 0.9, 0.5
#: Cost from which a word is garbled though nothing repairs it.
LOST = 6
#: What is left of a letter spelled in UTF-8 whose last byte was dropped.
CUT = re.compile("[a-zß-ÿ][ÂÃÐÑ][a-zß-ÿ]")
WORD = re.compile(r"[^ \t\r\n]+")
WIDE = re.compile("[\uff00-\uffef\u3000\xa0\u2007\u202f]")
INVISIBLE = re.compile("[\u200b-\u200d\u2060\ufeff]")
TWO_SCRIPTS = re.compile("[A-Za-zÀ-ɏ][\u0370-\u058f]|[\u0370-\u058f][A-Za-zÀ-ɏ]|[ı\u0250-\u02af]")
ANY_LETTER = re.compile(r"[^\W\d_ªº]")
CYRILLIC_WORD = re.compile("[\u0400-\u04ff]+")
RUSSIAN_WORD = re.compile("(?<![\u0400-\u04ff])[а-яё]{3,}(?![\u0400-\u04ff])")
PURE_CYRILLIC = re.compile(r"[\u0400-\u04ff\W\d_]+")
HEBREW_WORD = re.compile("[א-ת]{2,}")
# How many of a thousand letters of Russian text each letter is.
LETTER_SHARE = dict(zip("оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё", (110, 85, 80, 74, 67, 63, 55, 47, 45, 44, 35, 32, 30, 28, 26, 20, 19, 17, 17, 16, 16, 14, 12, 10, 9, 7, 6, 5, 4, 3, 3, 0.4, 0.4), strict=True))
LETTER_LOG = {c: math.log(n / 1000) for c, n in LETTER_SHARE.items()}
RUSSIAN_VOWELS = frozenset("аеёиоуыэюяіїє")
ODD_CASE = re.compile(r"[a-zа-яё][A-ZА-ЯЁ]")
ANY_WORD = re.compile(r"[^\W\d_]{2,}")
HARD = re.compile("[�\x01-\x08\x0e-\x1b\x7f-\x84\x86-\x9f]")


@lru_cache(4096)
def _kind(c: str) -> tuple[str, str]:
    """General category and script of a character."""
    cat = unicodedata.category(c)
    script = unicodedata.name(c, "NONE").split()[0] if cat[0] == "L" else ""
    return cat, script if script in ("LATIN", "CYRILLIC", "GREEK", "HEBREW") else ("LATIN" if cat[0] == "L" and c in "ªº" else script and "OTHER")


def cost(t: str, mixed: bool = False, line: str = "") -> float:
    """How implausible the characters of a word are: 0 for ordinary words of any language.

    ``mixed``: the word stands in a line of arbitrary upper and lower case, so case tells nothing. ``line``: ``ru`` or ``he``
    for a word in a line with words in small Russian or in Hebrew letters.
    """
    if t.isascii() and not HARD.search(t):
        return 0.0
    total, n = 0.0, len(t)
    for i, c in enumerate(t):
        if c < "\x80":
            if c < " " or c == "\x7f":
                total += 3
            continue
        cat, script = _kind(c)
        before, after = t[i - 1] if i else " ", t[i + 1] if i + 1 < n else " "
        lettered = before.isalpha() + after.isalpha()
        strange_after = after >= "\x80" and _kind(after)[0][0] not in "LMZC" and after not in "”’»…"
        if c == "�":
            total += 6
        elif cat in ("Cc", "Co", "Cn", "Cs"):
            total += 5
        elif "─" <= c <= "▟":
            total += 4
        elif c in "ªº":
            total += 0 if before in "nN." or before.isdigit() or before == "°" else 2
        elif c == "µ":
            total += 2 if before.isalpha() or after.isalpha() and after not in "msgAVWFl" else 0
        elif cat[0] == "L":
            low = c.lower()
            if script == "LATIN":
                total += 0 if low in USUAL else 0.4 if c in CENTRAL else 1.5
                if c != low and not mixed and before.isalpha() and before == before.lower() != before.upper():
                    total += 2.5
                elif c != low and not mixed and before.isalpha() and after.islower():
                    total += 1
                if low in "ãâ" and after in "œÿƒžšŸŽŠŒ":
                    total += 1.5
                if low in "ùûò" and not before.isalnum() and not after.isalnum():
                    total += 2.2
                if c == "ß" and before.lower() in "bcdfghjklmnpqrstvwxz":
                    total += 2.2
                if before >= "\x80" and before.isalpha() and _kind(before)[1] == "LATIN" and before not in "ªº" and (before + c).lower() not in USUAL_PAIRS:
                    total += 0.4 if c in CENTRAL or before in CENTRAL else 1.2
                if c == low and not mixed and "A" <= before <= "Z" and "A" <= after <= "Z":
                    total += 2.5
                if strange_after:
                    total += 2 if c != low or low in "ãâåîïðøñ" else 0.5
                elif c != low and after == "\xa0":
                    total += 2
            elif script == "CYRILLIC":
                total += 0 if low in RUSSIAN else 2
                total += 1.5 if strange_after and after not in "“„–—" else 0
            elif script == "OTHER" or script not in ("GREEK", "HEBREW"):
                total += 3
            if before.isalpha() and before not in "ªº" and ("LATIN" if before < "\x80" else _kind(before)[1]) != script:
                total += 2.5
            if after < "\x80" and after.isalpha() and script != "LATIN" and not (script == "GREEK" and i == 0 and n == 2):
                total += 2.5
        elif cat[0] == "M":
            total += 1
        elif cat == "No":
            total += 2 if after.isalpha() or before.isalpha() and before not in "mskc" else 0.2
        elif cat == "Zs":
            total += 0.2
        elif cat == "Cf":
            total += 0.2
        elif c == "·" and lettered == 2 and before not in "lL":
            total += 2.2
        elif c in "’·-‑":
            total += 0 if lettered == 2 else 0.2
        elif c in QUOTES:
            total += 2.5 if lettered == 2 and c not in "–—…" else 0.3 if lettered == 2 else 0
        elif c in SIGNS or c in SPACING:
            odd = c in SPACING and not (c in "¿¡" and not before.isalpha()) and not (c in "°©®™§×÷·¢£¥" and lettered < 2)
            total += 2.5 if lettered == 2 or odd and lettered else 0.5 if odd else 0
        else:
            total += 2 if lettered == 2 else 1 if lettered else 0.5
        if cat[0] in "SPN" and before >= "\x80" and _kind(before)[0][0] in "SPN" and not (c in QUOTES and before in QUOTES):
            total += 1.5
    for m in CYRILLIC_WORD.finditer(t):
        w = m[0]
        if not any(v in RUSSIAN_VOWELS for v in w.lower()) and len(w) > 3:
            total += 1 + 0.5 * len(w)
        if w[0] in "ъыьЪЫЬ":
            total += 1.5
        if len(w) > 2 and not mixed and w[0].islower() and w[1:].isupper():
            total += 2.2
        elif line == "ru" and not mixed and w.isupper() and (gain := likely(_recoded(w, "cp1251", "koi8-r")) - likely(w)) > 0.8:
            total += 1.5 + gain
    if t[0] == "ô" and re.fullmatch("ô[A-Za-z]+ö[.,;:!?]*", t):
        total += 2.2  # quotes in another set
    if line and all("à" <= c <= "ÿ" for c in t if c.isalpha()) and sum(c.isalpha() for c in t) > 1:
        total += 1.5
    return total


def likely(w: str) -> float:
    """Logarithm of a Russian word's likelihood by the frequency of its letters."""
    return sum(LETTER_LOG.get(c, -7.0) for c in w.lower())


def script_of_line(t: str) -> str:
    """``ru`` if the line has words in small Russian letters, ``he`` if it has Hebrew ones."""
    return "ru" if RUSSIAN_WORD.search(t) else "he" if HEBREW_WORD.search(t) else ""


def _byte_of(name: str) -> dict[str, int]:
    """Character to byte in a character set; bytes it leaves out stand for the control characters of their number."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(name)] = b
        except UnicodeDecodeError:
            out.setdefault(chr(b), b)
    return out


BYTES = {name: _byte_of(name) for name in SHOWN_AS}
CHARS = {name: {b: c for c, b in _byte_of(name).items()} for name in MEANT}


def _utf8_runs(t: str, to_byte: dict[str, int], any_case: bool) -> str:
    """The text with every run that spells a multi-byte UTF-8 sequence in the character set replaced by its character."""
    out, i, n, changed = [], 0, len(t), False

    def options(c: str) -> tuple[int, ...]:
        own = (to_byte[c],) if c in to_byte else ()
        if any_case and c >= "\x80" and (s := c.swapcase()) != c and s in to_byte:
            own += (to_byte[s],)
        return own

    while i < n:
        c = t[i]
        if c >= "\x80":
            done = False
            for lead in options(c):
                k = 1 if 0xC2 <= lead < 0xE0 else 2 if 0xE0 <= lead < 0xF0 else 3 if 0xF0 <= lead < 0xF5 else 0
                if not k or i + k >= n:
                    continue
                rest = [next((b for b in options(x) if 0x80 <= b < 0xC0), -1) for x in t[i + 1 : i + 1 + k]]
                if -1 in rest:
                    continue
                try:
                    out.append(bytes([lead, *rest]).decode("utf-8"))
                except UnicodeDecodeError:
                    continue
                i, done, changed = i + k + 1, True, True
                break
            if done:
                continue
        out.append(c)
        i += 1
    return "".join(out) if changed else t


def _recoded(t: str, shown: str, meant: str) -> str:
    """Bytes of one character set read in another, for the whole word; the text itself if a character has no byte."""
    to_byte, to_char, out = BYTES[shown], CHARS[meant], []
    for c in t:
        if c < "\x80":
            out.append(c)
        elif (b := to_byte.get(c)) is not None:
            out.append(to_char[b])
        else:
            return t
    return "".join(out)


def _unescaped(t: str) -> str:
    def one(m: re.Match[str]) -> str:
        s = m[0]
        if s[0] == "&":
            return html.unescape(s)
        if s[0] == "\\":
            return chr(int(s[2:], 16))
        try:
            return bytes.fromhex(s.replace("%", "").replace("=", "")).decode("utf-8")
        except UnicodeDecodeError:
            return s

    return ESCAPED.sub(one, t)


def apply(op: tuple[str, ...], t: str) -> str:
    """One operation on a text."""
    if op[0] == "utf8":
        return _utf8_runs(t, BYTES[op[1]], op[2] == "any")
    return _recoded(t, op[1], op[2]) if op[0] == "recode" else _unescaped(t)


UTF8_OPS = [("utf8", name, case) for case in ("same", "any") for name in SHOWN_AS]
ALL_OPS = [*UTF8_OPS, *(("recode", a, b) for a in SHOWN_AS if a not in ("cp1253", "cp1254", "iso8859-15") for b in MEANT if a != b)]


def search(word: str, mixed: bool = False, line: str = "") -> tuple[str, float, tuple[tuple[str, ...], ...]]:
    """The cheapest text reachable from a word, the cost it saves, and the operations that lead there.

    Best first: the queue is ordered by the text's cost plus what its operations cost. A state is visited once. A
    successor is kept if it is cheaper than its parent - one that spells UTF-8 also if it is dearer by up to ten, as it may have to pass
    through control characters; it is shorter than its parent. So the search ends by itself, with no limit on its depth. A word that becomes plausible
    by exchanging letters for those they look like is no case of a wrong encoding and is left alone.
    """
    start = cost(word, mixed, line)
    if (plain := _unescaped(word)) != word and not plain.isascii():
        new, saved, ops = search(plain, mixed, line)
        return new, max(saved, MARGIN), (("unescape",), *ops)
    bare = unicodedata.normalize("NFC", WIDE.sub(lambda m: unicodedata.normalize("NFKC", m[0]), INVISIBLE.sub("", word)))
    for plain in (bare, skeleton(bare), cyrillic_skeleton(bare)):
        healed = [h for n in ("latin-1", "cp1252", "cp1251") if (h := _utf8_runs(word, BYTES[n], False)) != word]
        spelled = any(cost(h, mixed, line) == 0 for h in healed)
        if plain != word and cost(plain, mixed, line) <= 0.6 and not spelled and not HARD.search(word):
            return word, 0.0, ()
    for ops in (UTF8_OPS, ALL_OPS):  # what spells UTF-8 is no chance; other sets are only tried where that explains nothing
        best, rank, used = _cheapest(word, start, ops, mixed, line)
        if start - rank >= MARGIN and cost(best, mixed, line) <= 0.6:
            break
    if any(o[0] == "recode" for o in used) and cost(best, mixed, line) > 0.6:
        return word, 0.0, ()  # bytes of one set can be read in any other: only a wholly plausible result counts
    return best, start - rank, used


def _cheapest(word: str, start: float, tried: list, mixed: bool, line: str) -> tuple[str, float, tuple[tuple[str, ...], ...]]:
    """The best-first search itself: the cheapest text, its cost with that of its operations, and these."""
    best, best_cost, best_ops = word, start, ()
    seen = {hash(word)}
    queue: list[tuple[float, int, str, float, tuple]] = [(start, 0, word, start, ())]
    count = 0
    while queue:
        rank, _, text, own, ops = heapq.heappop(queue)
        if rank < best_cost:
            best, best_cost, best_ops = text, rank, ops
        if own == 0 and ops:
            break
        if own == 0:
            continue
        paid = rank - own
        for op in tried:
            new = apply(op, text)
            if new == text or hash(new) in seen:
                continue
            seen.add(hash(new))
            price = STEP + (0.6 if op[0] == "recode" else 0.2 if op[-1] == "any" else 0)
            c = cost(new, mixed, line)
            # a text that spells UTF-8 may have to pass through control characters on its way
            if c + price < own + (10 if op[0] == "utf8" and op[2] == "same" else 0):
                count += 1
                heapq.heappush(queue, (c + paid + price, count, new, c, (*ops, op)))
    return best, best_cost, best_ops


def of_mixed_case(t: str) -> bool:
    """Whether a line is written in arbitrary case: two words or more change from lower to upper case inside."""
    return sum(1 for m in ANY_WORD.finditer(t) if ODD_CASE.search(m[0])) >= 2 and sum(1 for m in ANY_WORD.finditer(t) if m[0].isascii() and ODD_CASE.search(m[0])) >= 1


def lost(word: str, mixed: bool = False, line: str = "") -> bool:
    """Whether a word that nothing repairs shows wrong characters all the same: bytes dropped on the way, or a set not known
    here. It must be implausible in each form of what it may look like, have signs or capitals among its letters, and hold
    Latin and Cyrillic letters only: words of other scripts can't be judged."""
    if not mixed and CUT.search(word):
        return True
    bare = unicodedata.normalize("NFC", WIDE.sub(lambda m: unicodedata.normalize("NFKC", m[0]), INVISIBLE.sub("", word)))
    letters = [c for c in bare if c >= "\x80" and c.isalpha() and c not in "ªºµ"]
    if len(letters) < 2 or any(_kind(c)[1] not in ("LATIN", "CYRILLIC") for c in letters):
        return False
    inner = list(zip(bare, bare[1:], bare[2:], strict=False))
    odd = sum(c >= "\x80" and _kind(c)[0] in ("No", "Sm", "Sc", "Sk", "So", "Po") and c not in QUOTES and (a.isalpha() or b.isalpha()) for a, c, b in inner)
    odd += 0 if mixed else sum(a.islower() and c.isupper() for a, c, _ in inner)
    return odd >= 2 and min(cost(x, mixed, line) for x in (bare, skeleton(bare), cyrillic_skeleton(bare))) >= LOST


# How much rarer than usual a pair must be before a line's sets are doubted, and by how much a reading in another
# set must be more frequent, for each pair that it changes and for the line (logarithms).
RARE, BETTER, BETTER_SIGN, BETTER_LINE, FLOOR = 2.0, 2.0, 4.0, 7.0, 0.1
_SPACED = {c: " " for c in range(0x80) if not chr(c).isalpha()}
#: The characters whose pairs are counted: all that the character sets know, and ASCII letters.
ALPHABET = sorted({c for table in (*BYTES.values(), *({c: 0 for c in t.values()} for t in CHARS.values())) for c in table} | {c for name in SHOWN_AS for c in BYTES[name]})
RECODES = [op for op in ALL_OPS if op[0] == "recode"]
TABLES = {op: {ord(c): CHARS[op[2]][b] for c, b in BYTES[op[1]].items()} for op in RECODES}


class Pairs:
    """How frequent pairs of characters are in a corpus, of which at least one is beyond ASCII."""

    def __init__(self, counts: dict[str, int]) -> None:
        total = sum(counts.values()) + 1
        self.log = {p: math.log((n + FLOOR) / total) for p, n in counts.items()}
        self.floor = math.log(FLOOR / total)
        self.usual = sum(n * self.log[p] for p, n in counts.items()) / total

    def score(self, t: str) -> tuple[float, int]:
        """The sum of logarithms over the text's pairs, and their number."""
        get, floor, s, n = self.log.get, self.floor, 0.0, 0
        t = f" {t} ".translate(_SPACED)
        for a, b in zip(t, t[1:], strict=False):
            if a > "\x7f" or b > "\x7f":
                s += get(a + b, floor)
                n += 1
        return s, n

    def rarest(self, t: str) -> float:
        """The logarithm of the text's rarest pair."""
        t = f" {t} ".translate(_SPACED)
        return min((self.log.get(a + b, self.floor) for a, b in zip(t, t[1:], strict=False) if a > "\x7f" or b > "\x7f"), default=0.0)


def count_pairs(texts: list[str]) -> dict[str, int]:
    """The pairs of the alphabet in texts, counted in one array."""
    points = np.frombuffer(("\n" + "\n".join(texts) + "\n").translate(_SPACED).encode("utf-32-le", "surrogatepass"), "<u4")
    known = np.isin(points, np.array([0x20, *map(ord, ALPHABET), *range(0x41, 0x5B), *range(0x61, 0x7B)], np.uint32))
    beyond = points > 0x7F
    ok = known[:-1] & known[1:] & (beyond[:-1] | beyond[1:])
    pairs, n = np.unique(points[:-1][ok].astype(np.uint64) << np.uint64(32) | points[1:][ok], return_counts=True)
    return {chr(int(p) >> 32) + chr(int(p) & 0xFFFFFFFF): int(k) for p, k in zip(pairs, n, strict=True)}


class Repairer:
    """Repairs texts word by word, then by the line, and remembers the words it has seen. ``pairs``: how frequent pairs of
    letters are; without them only the words decide."""

    def __init__(self, pairs: Pairs | None = None, most_words: int = 200_000) -> None:
        self.pairs = pairs
        self.words: dict[tuple[str, bool, str], tuple[str, bool, tuple]] = {}
        self.most = most_words

    def word(self, w: str, mixed: bool = False, line: str = "") -> tuple[str, bool, tuple]:
        got = self.words.get((w, mixed, line))
        if got is None:
            if len(self.words) >= self.most:  # only frees memory: a word that comes again is searched again
                self.words.clear()
            hard = bool(HARD.search(w))
            suspicious = hard or cost(w, mixed, line) >= MARGIN or bool(ESCAPED.search(w))
            new, saved, ops = search(w, mixed, line) if suspicious else (w, 0.0, ())
            wrong = hard or saved >= MARGIN
            if suspicious and not wrong and lost(w, mixed, line):
                wrong, new, ops = True, w, ()
            got = self.words[w, mixed, line] = (new if wrong else w, wrong, ops if wrong else ())
        return got

    def _hebrew(self, w: str, result: tuple, parts: list, line: str) -> tuple:
        """Words shown in Western letters may be Russian or Hebrew: what the rest of the line is, else - Hebrew has no
        capitals, and its letters end earlier - what their letters allow."""
        ops = result[2]
        if len(ops) == 1 and ops[0][0] == "recode" and ops[0][1] in ("latin-1", "cp1252") and ops[0][2] in ("cp1251", "cp1255"):
            shown = [c for m in parts for c in m[0] if "À" <= c <= "ÿ"]
            hebrew = line == "he" or not line and all("à" <= c <= "ú" for c in shown)
            op = ("recode", ops[0][1], "cp1255" if hebrew else "cp1251")
            return apply(op, w), True, (op,)
        return result

    def reading(self, words: list[str], chains: list[tuple]) -> tuple[float, float, tuple, list[str]]:
        """The most frequent reading of a line's words: its score, that of the words as they stand, the chain of operations that
        leads to it, and the words. Chains come from the words' searches; every exchange of one set for another is tried, too."""
        asked = " ".join(words)
        own, n = self.pairs.score(asked)
        signs = not any(map(ANY_LETTER.search, words))  # then what is meant are signs as well
        best, chain, text, seen = own, (), asked, {asked}
        for ops in [*chains, *((op,) for op in RECODES)]:
            if len(ops) == 1 and ops[0] in TABLES:
                new = asked.translate(TABLES[ops[0]])
            else:
                new = " ".join(_chained(ops, w) for w in words)
            if new in seen:
                continue
            seen.add(new)
            s, k = self.pairs.score(new)
            # fewer pairs beyond ASCII are not better by their number: those that went count as usual ones
            s += self.pairs.usual * max(0, n - k) - STEP * len(ops)
            if s > best and new.count(" ") == asked.count(" ") and not (signs and ANY_LETTER.search(new)) and not TWO_SCRIPTS.search(new):
                best, chain, text = s, ops, new
        return best, own, chain, text.split(" ")

    def text(self, t: str) -> tuple[bool, str, bool]:
        """Whether the text is garbled, the text as it was (as far as it can be had), and whether that is whole."""
        parts = [m for m in WORD.finditer(t) if not m[0].isascii() or ESCAPED.search(m[0]) or HARD.search(m[0])]
        if not parts:
            return False, t, True
        mixed, line = of_mixed_case(t), script_of_line(t)
        results = [self.word(m[0], mixed, line) for m in parts]
        flagged = any(r[1] for r in results)
        if not flagged and (mixed or not self.pairs or not self.doubted([m[0] for m in parts])):
            return False, t, True
        results = [self._hebrew(m[0], r, parts, line) for m, r in zip(parts, results, strict=True)]
        usual = Counter(r[2] for r in results if r[1] and r[2]).most_common(1)
        words, whole = [], True
        for m, (new, wrong, ops) in zip(parts, results, strict=True):
            # words of one line were garbled alike: what most of them underwent is tried for those that are plausible by
            # chance, and for those that could be read in other ways as well
            if usual and ops != usual[0][0] and not (PURE_CYRILLIC.fullmatch(m[0]) and not m[0].isupper()):
                other = _chained(usual[0][0], m[0])
                if cost(other, mixed, line) <= cost(new, mixed, line):
                    new = other
            whole = whole and not (wrong and new == m[0])
            words.append(new)
        if self.pairs:
            # what no word gave away may spell UTF-8 in a way that looks plausible
            chains = [r[2] for r in results if r[2]] if flagged else [(op,) for op in UTF8_OPS if op[2] == "same"]
            words, whole = self._line([m[0] for m in parts], words, chains, whole)
            if not flagged and words == [m[0] for m in parts]:
                return False, t, True
        out, at = [], 0
        for m, new in zip(parts, words, strict=True):
            out += [t[at : m.start()], new]
            at = m.end()
        fixed = "".join([*out, t[at:]])
        return True, fixed, whole and not HARD.search(fixed)

    def doubted(self, words: list[str]) -> bool:
        """Whether a line that no word of gives away has rare pairs, and only letters that its sets may have changed."""
        return self.pairs.rarest(" ".join(words)) < self.pairs.usual - RARE and not any(WIDE.search(w) or INVISIBLE.search(w) or TWO_SCRIPTS.search(w) or unicodedata.normalize("NFC", w) != w for w in words)

    def _line(self, words: list[str], fixed: list[str], chains: list[tuple], whole: bool) -> tuple[list[str], bool]:
        """The words' own repairs, or the reading of the whole line where that is clearly more frequent."""
        best, own, chain, read = self.reading(words, list(dict.fromkeys(chains)))
        if not chain or len(read) != len(words):
            return fixed, whole
        now, n = self.pairs.score(" ".join(fixed))
        if fixed != words:
            now += self.pairs.usual * max(0, self.pairs.score(" ".join(words))[1] - n)
            # a word of a mixed line that was sound stays as it is
            return (read, True) if best > now and not any(map(HARD.search, read)) else (fixed, whole)
        n = sum(_changed(a, b) for a, b in zip(words, read, strict=True))
        # where only signs change, as a dash does, the one read must be far more frequent than the one shown
        lettered = any(a != b and ANY_LETTER.search(a) for a, b in zip(words, read, strict=True))
        if best - own >= max(BETTER_LINE, (BETTER if lettered else BETTER_SIGN) * n):
            return read, True
        return fixed, whole


def _changed(a: str, b: str) -> int:
    """How many pairs of characters of a word another reading of it changes."""
    if len(a) != len(b):
        return len(a) + 1
    differ = [False, *(x != y for x, y in zip(a, b, strict=True)), False]
    return sum(x or y for x, y in zip(differ, differ[1:], strict=False))


def _chained(ops: tuple, w: str) -> str:
    for op in ops:
        w = apply(op, w)
    return w


def letter_pairs(df: DataFrame, text: str) -> Pairs:
    """The pairs of letters of all texts of a table. Counted in each task; the alphabet has some 600 characters, so there are at
    most as many pairs as its square, and some thousand in practice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for b in batches:
            counts.update(count_pairs(b.column(0).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["pair", "n"])

    rows = df.where(F.col(f"`{text}`").rlike(r"[^\x00-\x7f]")).select(F.col(f"`{text}`").alias("_t"))
    return Pairs({r[0]: r[1] for r in rows.mapInArrow(run, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()})


def garbled(df: DataFrame, record_id: str, text: str) -> DataFrame:
    """``(rec_id, repaired, whole)`` for every record whose text shows wrongly decoded characters.

    ``whole`` is false where something stays lost (replacement or control characters, words nothing repairs). A first pass counts
    the pairs of letters of all texts, a second one repairs. No text is moved: rows of plain ASCII are
    dropped by the JVM, the others are searched where they are read. Null or empty texts are never garbled, null ids stay
    null, repeated rows are reported each; an empty table gives an empty result. Only the two named columns are read.
    """
    pairs = df.sparkSession.sparkContext.broadcast(letter_pairs(df, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Repairer(pairs.value)
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            rows = [(i, *x[1:]) for i, t in enumerate(texts) if (x := r.text(t))[0]]
            take = pa.array([i for i, *_ in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(take), pa.array([x[1] for x in rows], pa.string()), pa.array([x[2] for x in rows], pa.bool_())], names=["rec_id", "repaired", "whole"])

    rows = df.where(F.col(f"`{text}`").rlike(LOOKED_AT)).select(F.col(f"`{record_id}`").cast("long").alias("rec_id"), F.col(f"`{text}`").alias("_t"))
    return rows.mapInArrow(run, "rec_id long, repaired string, whole boolean")


def garbled_rows(df: DataFrame, text: str, wanted: bool = True) -> DataFrame:
    """The rows of a table whose text is garbled, or (``wanted`` false) those whose text isn't; all columns as they are."""
    at, schema = df.columns.index(text), df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Repairer()
        for b in batches:
            yield b.filter(pa.array([t is not None and r.text(t)[0] is wanted or t is None and not wanted for t in b.column(at).to_pylist()], pa.bool_()))

    return df.mapInArrow(run, schema)
