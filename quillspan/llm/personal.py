"""Problem 10: personal data in free text.

Broad patterns give candidate spans: every pair of capitalised words, every run of digits, every number beside a capitalised
word, every @. Labelers - shapes, gazetteers, words before and after, what the same word does elsewhere in the corpus - vote
for or against each candidate or abstain, and often disagree. Expectation-maximisation over the counts of all vote patterns
estimates how reliable each labeler is (no labelled data); its posteriors train a logistic classifier over votes and shapes,
which decides. Both models see counts of patterns only, of which there are few, whatever the number of documents.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined, spread, stored

KINDS = ("email", "id_number", "phone", "address", "name")
PLACEHOLDER = {"email": "[EMAIL]", "id_number": "[ID_NUMBER]", "phone": "[PHONE]", "address": "[ADDRESS]", "name": "[NAME]"}
#: A space that may be a line break of a hard wrap (with the marks of a quotation).
S = r"(?:[ \t ]+|[ \t]*\r?\n[ \t>|]*)"
CAP = r"[A-ZÀ-ÖØ-ÞŠŽ][\w'’]+(?:-[A-ZÀ-ÖØ-ÞŠŽ][\w'’]+)?"

# First names (the gazetteer).
FIRST_NAMES = frozenset(
    "Adam Ahmed Aisha Akira Alan Alba Alberto Alejandro Alex Alexander Alexei Ali Alice Alicia Amara Amelia Amir Ana Andrea Andrei Andrew Angela"
    " Anita Anna Anne Antoine Antonio Arthur Beatriz Benjamin Bernard Boris Brian Bruno Camille Carlos Carmen Caroline Catherine Charles Charlotte"
    " Chen Chiara Chloé Christian Claire Clara Daniel Daniela David Diego Dieter Dmitri Edward Elena Elias Elizabeth Emily Emma Eric Esther Eva"
    " Fatima Felix Fernando Francesco Frank Gabriel George Giulia Grace Hannah Hans Hassan Heinrich Helen Helena Henry Hiroshi Hugo Ibrahim Ines"
    " Ingrid Irene Isabel Ivan Jack Jacob James Jan Jane Javier Jean Jennifer João Johannes John Jonas Jorge José Julia Julian Jürgen Karin Karl"
    " Katharina Kenji Kevin Kofi Lars Laura Leila Lena Leo Li Linda Lisa Louis Luca Lucas Lucía Luis Lukas Mandla Manuel Marco Margaret Maria Marie"
    " Mario Mark Marta Martin Mary Mateo Matthew Max Mei Michael Miguel Mohammed Natalia Nadia Ngozi Nicolas Nina Noah Noam Oliver Olga Omar Oscar"
    " Paul Pedro Peter Philippe Pierre Priya Rachel Rafael Richard Robert Rosa Ruth Samir Samuel Sara Sarah Sergei Simon Sofia Sophie Søren Stefan"
    " Susan Tariq Thomas Tomás Valentina Victor Wei William Yael Yuki Yusuf Zoë".split()
)
FIRST_UPPER = frozenset(n.upper() for n in FIRST_NAMES)
# Words that follow a capitalised word which then is no surname.
THINGS = frozenset("street road lane avenue terrace gardens blvd boulevard drive square court close place row way crescent".split())
# Particles of surnames.
PARTICLE = rf"(?:{S}(?:von der|van der|van den|von|van|de la|de|da|di|del|der|dos|du|le|la|bin|al))?"
LAST = rf"{S}({CAP})"
AFTER_FIRST = re.compile(rf"(?:{S}[A-ZÀ-Þ]\.)?{PARTICLE}{LAST}")
CAPITAL = re.compile(r"(?<![\w@.+'’-])[A-ZÀ-ÖØ-ÞŠŽ][\w'’]*")
INITIAL = re.compile(rf"(?<![\w.@+-])[A-ZÀ-Þ]\.{PARTICLE}{LAST}(?![\w@])")
UPPER_LAST = re.compile(rf"(?<![\w@.+-])([A-ZÀ-Þ][A-ZÀ-Þ'’]+(?:-[A-ZÀ-Þ'’]+)?),{S}$")
# Words before and after a person's name.
BEFORE_NAME = re.compile(
    r"(?:\b(?:Dear|Hello|Hi|Hey|Ask|Signed:?|Herrn?|Frau|Mme|Mlle|Monsieur|Madame|Mr\.?|Mrs\.?|Ms\.?|Miss|Dr\.?|Prof\.?|Sr\.?|Sra\.?|Señora?|Bonjour|Cher|Chère|Hallo|Lieber?|Hola|Estimad[oa]|Caro|Cara|Olá|Уважаемый|Уважаемая|"
    r"(?:go|goes|went|write|talk|speak|report|reports|addressed|sent|send) to|signed by|(?:was|were|is|been) \w+ by|contact|attn:?|c/o|from|To:|From:|Cc:|author:?|owner:?)|\b(?:name|nom|nombre|nome|contact|user|customer|kunde)\s?[=:]|"
    r"\b(?:Regards|Best|Thanks|Thank you|Cheers|Sincerely|Yours(?: \w+)?|Cordialement|Bien à vous|Grüßen|Grüße|Gruß|Saludos|Atentamente|Atenciosamente|Abraços|С уважением|בברכה),?)\s*[>|*•\-]?\s*$",
    re.I,
)
AFTER_NAME = re.compile(rf"^(?:{S}?(?:wrote|writes|reports?|reported|says)\s?:|{S}said{S}that|{S}asked{S}(?:why|whether|if|how)|{S}hat{S}angerufen|{S}a{S}demandé|{S}last{S}week|,{S}?(?:tel|phone|\+|\(?\d)|{S}?\(?[\w.+-]+\s?(?:@|\(at\)|\[at\]|AT\s)|{S}?\|{S}?[\w.+-]+|{S}?<|,\s*$)", re.I)
TITLE_VERB = re.compile(r"\b(?:Dr|Mr|Mrs|Ms|Prof|Herr|Frau|Mme)\.?\s$")

# What stands for @ (lower case); the word "at" between spaces does too.
AT_SIGNS = ("@", "(at)", "[at]", "&#64;")
AT_WORD = re.compile(r"at(?=\s)")
LOCAL = re.compile(r"[\w.%+-]*\w$")
DOT = rf"(?:\.|{S}?\[dot\]{S}?|{S}?\(dot\){S}?|{S}DOT{S})"
DOMAIN = re.compile(rf"(?:[A-Za-z0-9-]+{DOT})+[A-Za-z0-9]+", re.I)
# Endings of host names.
ENDINGS = frozenset("com org net edu gov int info biz io co de fr es pt ru il uk us eu ch at nl be it se no dk pl example invalid test localhost".split())
MAIL_WORDS = re.compile(r"(?:mail|e-mail|contact|copies|send|sent|to|from|bounced|écrivez|à|schreiben|an|and|y|escriba|mailto|write|reply|\||\(|<|[:=])\W*$", re.I)

PHONES = [
    re.compile(p)
    for p in (
        r"\+1[ \-.]?\(?\d{3}\)?[ \-.]?\d{3}[ \-.]?\d{4}",
        rf"\(\d{{3}}\){S}?\d{{3}}[-. ]\d{{4}}",
        r"\d{3}([-.])\d{3}\1\d{4}",
        rf"\+44{S}?(?:\(0\){S}?)?\d{{2,5}}{S}\d{{3,6}}(?:{S}\d{{3,4}})?",
        rf"0\d{{2}}{S}\d{{4}}{S}\d{{4}}",
        rf"0\d{{4}}{S}\d{{6}}",
        rf"00\d{{2}}{S}\d{{1,4}}(?:{S}\d{{2,4}}){{1,4}}",
        rf"0\d(?:[. ]\d{{2}}){{4}}",
        rf"\+33{S}?(?:\(0\))?\d(?:[. ]\d{{2}}){{4}}",
        rf"\+49{S}?(?:\(0\))?\d{{2,5}}{S}\d{{3,9}}(?:-\d{{1,5}})?",
        r"0\d{2,4}/\d{5,9}(?:-\d{1,5})?",
        rf"\+46-\d{{1,3}}-?\d{{2,3}}(?:{S}\d{{2,3}}){{1,3}}",
        rf"\+\d{{1,3}}(?:[ \-.]\(?\d{{1,5}}\)?){{2,6}}",
        r"\+[1-9]\d{7,14}",
    )
]
#: Any number that can be the start of a run of digits, and such a run; dates, versions, addresses of hosts, decimals.
NUMBER_START = re.compile(r"(?<![\w.,+(\-/])(?:[+(]|\d)|(?<=[|>*,;=(])\(?[+\d]")
DIGITS = re.compile(rf"\+?\(?\d{{1,5}}\)?(?:(?:{S}|[-./])?\(?\d{{1,9}}\)?){{1,6}}(?![\w])")
OTHER_NUMBER = re.compile(r"\d{4}-\d\d-\d\d|\d\d?[./]\d\d?[./]\d{4}|\d{1,3}(?:\.\d{1,3}){3}|\d{1,3}\.\d{1,3}(?:\.\d{1,3})?|\d+")
CODE = re.compile(r"(?<![\w.,+(\-/#@])[A-Z]{0,3}-?\d[\dA-Z]{5,}(?:-[\dA-Z]+)*(?![\w])")
PHONE_START = re.compile(r"(?<![\w.,+(\-/])(?:\+\d|\(\d{3}\)|\d{3}[-.]\d{3}[-.]|0\d)|(?<=[|>*,;=(])\(?(?:\+\d|\d{3}[-.]\d{3}[-.]|0\d)")
PHONE_WORDS = re.compile(r"(?:\btel(?:efon|ephone|éfono|efone)?\b\.?|\bphone\b|\bfax\b|\bcall\b|\btext me at|\brufen sie|\bmobile?\b|\bm:|\bt:?|\banswers on|\bring\b|\bhandy\b|\bor\b|appelez|llame a|ligue|тел\.?|טלפון)\s*[:=]?\s*$", re.I)
NO_PHONE = re.compile(r"(?:\broute|\bbuild|\bhost|\bpages?|\bshelf|\bversion|\bchecksum|\bhash|\bjob|\bref\.?|\bnº|\bnr\.?|\bno\.|\bnumber|\bid|\bssn|\bcard|\bpassport)\W*$", re.I)

# Names of identity numbers.
ID_LABEL = re.compile(
    r"\b(?:SSN|social security(?: number| no\.?| #)?|soc\. ?sec\.(?: no\.?| number)?|NI (?:number|no\.?)|NINO|(?:national )?insurance (?:number|no\.?)|ID card(?: no\.?| number)?|ID (?:no\.?|number|#)|national (?:id|identity)(?: card| number| no\.?)?|"
    r"tax (?:id|number|no\.?)|TIN|NIF|NIE|DNI|CPF|CURP|citizen (?:number|id|no\.?)|person(?:al)? (?:number|id|no\.?)|personnummer|passport(?: no\.?| number| #)?|travel document(?: no\.?| number)?|identity (?:card|document|number|no\.?)(?: no\.?| number)?|"
    rf"driver'?s? licen[cs]e(?: no\.?| number)?|Steuer-?ID|Personalausweis|Reisepass|Ausweis(?:nummer|-Nr\.)?|passeport|numéro de sécurité sociale|pasaporte|passaporte|паспорт|ИНН|СНИЛС|ת\.?ז\.?){S}?[:=#]?{S}?$",
    re.I,
)
ID_SHAPES = [
    re.compile(p)
    for p in (
        r"\d{3}-\d{2}-\d{4}",
        rf"[A-Z]{{2}}(?:{S}?\d{{2}}){{3}}{S}?[A-D]",
        rf"\d{{3}}{S}\d{{3}}{S}\d{{3}}",
        r"[A-Z]{1,2}\d{6,8}",
        r"\d{8}-?[A-Z]",
        r"[XYZ]-?\d{7}-?[A-Z]",
        r"\d{6}[-+]\d{4}",
        r"\d{3}\.\d{3}\.\d{3}-\d{2}",
    )
]
ID_ANY = re.compile(r"[A-Z0-9]*\d[A-Z0-9]*(?:[ \-./][A-Z0-9]*\d[A-Z0-9]*)*(?:[ \-]?[A-Z])?")
ID_START = re.compile(rf"(?<![\w.,+(\-/#@])(?:\d{{3}}-\d{{2}}-\d|[A-Z]{{2}}{S}?\d{{2}}|\d{{3}}{S}\d{{3}}{S}\d{{3}}|[A-Z]{{1,2}}\d{{6}}|[XYZ]?-?\d{{7,8}}-?[A-Z]|\d{{6}}[-+]\d{{4}}|\d{{3}}\.\d{{3}}\.\d{{3}}-)")
# Parts of those names, by which they are looked for.
LABEL_WORDS = ("ssn", "ecurity", "soc.", "nino", "ni n", "nsurance", "id ", "tax", "tin", "nif", "nie", "dni", "cpf", "curp", "citizen", "person", "assport", "travel doc", "dentity", "icense", "icence", "ausweis", "passeport", "asaporte", "steuer", "паспорт", "инн", "снилс", "ת.ז")

# Kinds of streets and boxes.
STREETS = r"(?:Street|Road|Lane|Avenue|Terrace|Gardens|Blvd\.?|Boulevard|Drive|Square|Court|Close|Place|Row|Way|Crescent|Hill|Park|Mews|Grove|St\.|Rd\.|Ave\.?|STREET|ROAD|LANE|AVENUE|TERRACE|GARDENS|BLVD\.?|BOULEVARD|DRIVE|SQUARE|COURT|CLOSE|PLACE|ROW|WAY|CRESCENT)"
# Words by which the other forms of addresses are looked for.
STREET_ENDS = ("straße", "strasse", "str.", "gasse", "weg", "platz", "allee", "ring", "damm", "ufer")
STREET_STARTS = ("rua", "avenida", "av.", "travessa", "praça", "calle", "plaza", "paseo", "camino")
BOXES = ("box", "postfach", "apartado", "postale", "locked bag")
NUMBERED = re.compile(r"\d{1,5}[A-Z]?(?:/\d+)?(?: ?(?:bis|ter))?,?\s[\s>|]*(?:[A-ZÀ-Þ]|(?:rue|avenue|boulevard|place|allée|chemin|quai|impasse|cours)\s)")
FLAT = re.compile(rf"(?i:Flat|Apt\.?|Apartment|Unit|Suite|Room){S}\d+[A-Z]?,{S}$")
ADDRESSES = [
    re.compile(p)
    for p in (
        rf"\d{{1,5}}[A-Z]?(?:/\d+)?{S}(?!(?:The|THE)\b)(?:(?i:North|South|East|West|Old|New|Upper|Lower|Great|Little){S})?{CAP}(?:{S}{CAP})?{S}{STREETS}(?!\w)",
        rf"\d{{1,4}}(?: ?(?:bis|ter))?,?{S}(?i:rue|avenue|boulevard|place|allée|chemin|quai|impasse|cours){S}(?:(?i:de la|de l['’]|des|du|de|d['’]){S}?)?{CAP}",
        rf"(?:{CAP}[ -])?[A-ZÀ-Þ][\w'’-]*(?i:straße|strasse|str\.|gasse|weg|platz|allee|ring|damm|ufer){S}\d{{1,4}}[a-z]?(?!\w)",
        rf"(?i:Rua|Avenida|Av\.|Travessa|Praça|Calle|Plaza|Paseo|Camino){S}(?:(?i:de las?|de los|de|da|do|dos|das|del|la){S})*{CAP},?{S}(?:(?i:nº|n\.º|no\.){S}?)?\d{{1,5}}[A-Z]?(?!\w)",
        rf"(?i:P\.? ?O\.?{S}Box|Postfach|Apartado(?: de correos)?|Boîte postale|Locked Bag){S}\d{{1,6}}(?!\w)",
    )
]
BESIDE = re.compile(rf"(?<![\w.#/+(-])\d{{1,4}}[A-Z]?,? {CAP}(?: {CAP})?(?!\w)|(?<![\w@.'’-])[A-ZÀ-Þ][\w'’-]{{2,}},? \d{{1,4}}[a-z]?(?![\w.:/-])")
PLACE_AFTER = re.compile(rf"^(?:,{S}(?:(?i:Apt\.?|Flat|Unit|\d+º){S}?\w*,{S})?(?:\d{{4,5}}{S})?(?:\dº{S}\w,{S})?{CAP}|{S}(?:[A-Z]\w+{S})?\d{{5}}|,?{S}{CAP}{S}\d{{4,5}}|{S}{CAP}\b)")
PLACE_WORDS = re.compile(r"(?:\baddress\b:?|moved to|\bto|\bat|lives? (?:in|at)|stands at|based at|adresse:?|dirección:?|endereço:?|wohnt in|visit|from|near)\s*[:=|]?\s*$", re.I)

#: Labelers per kind, in the order of their votes.
LABELERS = {
    "email": ("plain or disguised form", "host ending", "word before", "version or handle"),
    "phone": ("form", "word before", "leading sign", "number of digits", "label of another number"),
    "id_number": ("form", "label before", "phone nearby", "other number"),
    "address": ("street or box", "place after", "word before", "field of its own", "small words"),
    "name": ("gazetteer of first names", "words before", "words after", "parts of a name", "contact data beside", "line of its own", "small words and things", "line in capitals", "first word elsewhere"),
}
#: The labeler that looks a name's first word up in the whole corpus: votes from so many uses on, for or against, by the share
#: of uses where a person is named.
ELSEWHERE, LEAST_USES, NAMED_SHARE, OTHER_SHARE = 8, 3, 0.9, 0.1

#: Labelers whose abstention tells nothing.
SILENT = {"name": (0, ELSEWHERE)}

#: kind, start, end, votes, shape (categories that only the classifier sees), first word of a name
Span = tuple[str, int, int, tuple[int, ...], tuple[int, ...], str]
DIGIT, DIGIT_RUN = re.compile(r"\d"), re.compile(r"\d+")


def _finds(text: str, words: tuple[str, ...]) -> Iterator[int]:
    """Where any of the words begins, word by word."""
    for w in words:
        k = text.find(w)
        while k >= 0:
            yield k
            k = text.find(w, k + len(w))


def _lower(t: str) -> str:
    """Lower case of the same length."""
    low = t.lower()
    return low if len(low) == len(t) else "".join(x if len(x := c.lower()) == 1 else c for c in t)


def _ats(t: str, low: str) -> Iterator[tuple[int, int]]:
    """Spans of @ and of what may stand for it, with the spaces beside."""
    for w in AT_SIGNS:
        for k in _finds(low, (w,)):
            z = k + len(w)
            if w == "@":
                yield k, z
            elif w != "&#64;":
                yield k - (k > 0 and t[k - 1].isspace()), z + t[z : z + 1].isspace()
            elif k and t[k - 1].isspace() and t[z : z + 1].isspace():
                yield k - 1, z + 1
    for m in AT_WORD.finditer(low):
        if m.start() and t[m.start() - 1].isspace():
            yield m.start() - 1, m.end() + 1


def _emails(t: str, low: str) -> Iterator[Span]:
    for a, z in _ats(t, low):
        local = LOCAL.search(t, max(0, a - 64), a)
        domain = DOMAIN.match(t, z)
        if not local or not domain:
            continue
        host = re.split(DOT, domain[0], flags=re.I)
        if any(not p for p in host):
            continue
        end = domain.end()
        plain = t[a:z] == "@" and "[" not in domain[0]
        digits = host[-1].isdigit() or host[0].isdigit()
        ending = host[-1].lower() in ENDINGS
        left = t[max(0, local.start() - 24) : local.start()]
        form = -1 if digits else 1
        yield "email", local.start(), end, (form, 1 if ending else -1, 1 if MAIL_WORDS.search(left) else 0, -1 if digits or re.search(r"(?i)install\s$", left) else 0), (int(plain), min(3, len(host))), ""


def _phones(t: str, runs: list[int]) -> Iterator[Span]:
    at = 0
    for a in runs:
        while a and t[a - 1] in "+(":
            a -= 1
        if a < at or not NUMBER_START.match(t, a):
            continue
        best = 0
        if PHONE_START.match(t, a):
            best = max((x.end() for p in PHONES if (x := p.match(t, a))), default=0)
            if best < len(t) and best and (t[best].isalnum() or t[best] in "-/" and t[best + 1 : best + 2].isalnum()):
                best = 0
        form = 1 if best else 0
        if not best:  # a run of digits of no known form
            x = DIGITS.match(t, a)
            best = x.end() if x else 0
        value = t[a:best]
        n = sum(map(str.isdigit, value))
        if not 7 <= n <= 15:
            continue
        if form:
            at = best
        left = t[max(0, a - 48) : a]
        if ID_LABEL.search(left):
            continue  # a candidate of that kind
        if OTHER_NUMBER.fullmatch(value):
            form = -1
        sign = value[0] in "+(" or value[0] == "0"
        yield "phone", a, best, (form, 1 if PHONE_WORDS.search(left) else 0, 1 if sign else 0, 1 if 9 <= n <= 14 else -1, -1 if NO_PHONE.search(left) else 0), (min(n, 14), "+(0".find(value[0]) + 1), ""


def _ids(t: str, low: str, runs: list[int]) -> Iterator[Span]:
    seen = set()
    starts = []
    for p in runs:  # with the letters before the digits
        a = p - 1 if p and t[p - 1] in "- \n\r\t" else p
        k = a
        while k and a - k < 3 and "A" <= t[k - 1] <= "Z":
            k -= 1
        starts.append(k if k < a else p)

    def votes(a: int, z: int, form: int, label: bool) -> tuple:
        left = t[max(0, a - 24) : a]
        letters = sum(map(str.isalpha, t[a:z]))
        return (form, 1 if label else -1, -1 if PHONE_WORDS.search(left) else 0, -1 if not label and NO_PHONE.search(left) else 0), (min(letters, 3), min(z - a, 16)), ""

    for a in starts:
        if not ID_START.match(t, a):
            continue
        end = max((x.end() for p in ID_SHAPES if (x := p.match(t, a)) and not t[x.end() : x.end() + 1].isalnum()), default=0)
        if end:
            seen.add(a)
            yield "id_number", a, end, *votes(a, end, 1, bool(ID_LABEL.search(t, max(0, a - 48), a)))
    for k in _finds(low, LABEL_WORDS):  # a label with a value of another form
        if not DIGIT.search(t, k, k + 48):
            continue
        for x in ID_ANY.finditer(t, k, min(len(t), k + 48)):
            a = x.start()
            if a in seen or t[a - 1].isalnum() or t[x.end() : x.end() + 1].isalnum() or not ID_LABEL.search(t[max(0, a - 48) : a]):
                break
            if sum(c.isdigit() for c in x[0]) >= 5:
                seen.add(a)
                yield "id_number", a, x.end(), *votes(a, x.end(), 0, True)
            break
    for a in starts:  # codes of any other form
        if a not in seen and (m := CODE.match(t, a)):
            yield "id_number", m.start(), m.end(), *votes(m.start(), m.end(), 0, bool(ID_LABEL.search(t[max(0, m.start() - 48) : m.start()])))


def _address_spans(t: str, low: str, runs: list[int]) -> Iterator[tuple[int, int]]:
    number, rue, german, first, box = ADDRESSES
    for a in runs:
        if not NUMBERED.match(t, a) or a and (t[a - 1].isalnum() or t[a - 1] in "-.#/"):
            continue
        x = number.match(t, a) or rue.match(t, a)
        if x:
            flat = FLAT.search(t, max(0, a - 28), a)
            yield flat.start() if flat else a, x.end()
    for k in _finds(low, STREET_ENDS):
        if DIGIT.search(t, k, k + 16):
            x = next((x for x in german.finditer(t, max(0, k - 48), min(len(t), k + 40)) if x.start() <= k < x.end()), None)
            if x and (not x.start() or not t[x.start() - 1].isalnum()):
                yield x.span()
    for k in _finds(low, STREET_STARTS):
        if (not k or not t[k - 1].isalnum()) and DIGIT.search(t, k, k + 72) and (x := first.match(t, k)):
            yield x.span()
    for k in _finds(low, BOXES):
        if DIGIT.search(t, k, k + 20):
            x = next((x for x in box.finditer(t, max(0, k - 16), min(len(t), k + 40)) if x.start() <= k < x.end()), None)
            if x and (not x.start() or not t[x.start() - 1].isalnum()):
                yield x.span()


def _addresses(t: str, low: str, runs: list[int]) -> Iterator[Span]:
    spans = {x: 1 for x in _address_spans(t, low, runs)}
    starts = {a for a, _ in spans}
    for p in runs:  # numbers beside capitalised words, of whatever sort
        m = BESIDE.match(t, p)
        if not m and p > 3 and t[p - 1] == " ":
            a = 1 + max(t.rfind(" ", 0, p - 1), t.rfind("\n", 0, p - 1))
            m = BESIDE.match(t, a) if t[a].isupper() else None
        if m and m.start() not in starts:
            spans.setdefault(m.span(), -1)
    done = -1
    for (a, z), street in sorted(spans.items(), key=lambda x: (x[0][0], -x[1], x[0][1])):
        if a < done and street > 0 or street < 0 and any(p < z and a < q for (p, q), s in spans.items() if s > 0):
            continue
        done = z if street > 0 else done
        left, right = t[max(0, a - 24) : a], t[z : z + 48]
        own = (not left.strip(" \t>|*-•") or left.rstrip(" \t>")[-1:] in "\n|,=:") and right.lstrip(" \t")[:1] in ("", "\n", "\r", ",", "|", ".", ")")
        small = street < 0 and any(w.lower() in NO_NAMES for w in re.findall(r"[^\W\d]+", t[a:z]))
        yield "address", a, z, (street, 1 if PLACE_AFTER.match(right) else 0, 1 if PLACE_WORDS.search(left) else 0, 1 if own else 0, -int(small)), (int(t[a].isdigit()), min(3, t.count(" ", a, z))), ""


def _names(t: str, beside: list[tuple[int, int]], first_names: frozenset[str] = FIRST_NAMES) -> Iterator[Span]:
    begins = np.array(sorted(a for a, _ in beside), np.int64)

    def span(a: int, z: int, first: str, last: str, parts: int, form: int) -> Span:
        left, right = t[max(0, a - 40) : a], t[z : z + 40]
        before, after = bool(BEFORE_NAME.search(left) or TITLE_VERB.search(left) or CLOSING.search(left)), bool(AFTER_NAME.match(right))
        k = int(np.searchsorted(begins, z))
        near = k < len(begins) and begins[k] - z <= 40 and t.count("\n", z, int(begins[k])) <= 1 and not SENTENCE_END.search(t, z, int(begins[k]))
        alone = not left.split("\n")[-1].strip(" \t>|*-•") and (not right.split("\n")[0].strip(" \t|") or right[:1] in ",|")
        running = not before and not near and bool(RUNNING.search(left))
        follow = NEXT_WORD.match(right)
        small = form != 2 and first.lower() in NO_NAMES or last.lower() in NO_NAMES or last.lower() in THINGS or bool(follow and follow[1].lower() in THINGS)
        capitals = first.isupper() and len(first) > 2 and last.isupper() and (CAPITALS.search(left) or CAPITALS_AFTER.match(right))
        known = first.capitalize() in first_names if first.isupper() and len(first) > 2 else first in first_names
        return "name", a, z, (0 if form == 2 else 1 if known else -1, 1 if before else -1 if running else 0, int(after), parts, int(near), int(alone), -int(small), -int(bool(capitals)), 0), (form, min(2, z - a >> 4)), "" if form == 2 else first.lower()

    for m in CAPITAL.finditer(t):
        w, a, z = m[0], m.start(), m.end()
        if len(w) == 1:
            x = INITIAL.match(t, a)
            if x:
                yield span(a, x.end(), w, x[1], 1, 2)
            continue
        if t[z : z + 1] not in (" ", "\n", "\r", "-"):
            if len(w) > 2 and w.isupper() and (x := TURNED.match(t, z)):
                yield span(a, x.end(), x[1], w, 1, 3)
            continue
        x = AFTER_FIRST.match(t, z)
        if x:
            parts = 1 if "." in x[0] or PARTICLES_IN.search(x[0]) or "-" in x[1] else 0
            yield span(a, x.end(), w, x[1], parts, 1 if w.isupper() else 0)


SENTENCE_END, RUNNING, NEXT_WORD = re.compile(r"[.!?]\s"), re.compile(r"[a-zß-ÿ,][ ]$"), re.compile(rf"{S}(\w+)")
CAPITALS, CAPITALS_AFTER = re.compile(r"[A-ZÀ-Þ]{2,}[.,]? $"), re.compile(r"[.,]? [A-ZÀ-Þ]{2,}\b")
TURNED, PARTICLES_IN = re.compile(rf",{S}([A-ZÀ-ÖØ-ÞŠŽ][a-zß-ÿ'’]+)(?!\w)"), re.compile(r"\s[a-z]")
# Words that are no part of a name - articles, pronouns, prepositions, salutations, farewells, titles, labels.
NO_NAMES = frozenset(
    "a an and as at because before but by for from if in into its near of on or our so that the their these this those to under unless until when where while with your his her my all some most no not after although although both every keep"
    " das der die dem den des ein eine einen im in am zum zur und oder mit von sie wir ich ihr rufen bitte mein unser kein jeder"
    " le la les un une des du de et à au aux ce cette sa son ses el los las una y o os as um uma do da dos das"
    " dear hello hi hey regards best thanks thank cheers sincerely yours signed herr herrn frau mme mlle monsieur madame mr mrs ms miss dr prof bonjour cher chère hallo liebe lieber hola estimado estimada caro cara olá grüßen grüße gruß saludos cordialement"
    " tel phone fax call passport id ssn no route build version page box flat apt suite room ask contact name from cc attn"
    " rua avenida travessa praça calle plaza paseo camino straße gasse platz allee street road lane avenue terrace gardens square court".split()
)
CLOSING = re.compile(r"\b(?:Regards|regards|Best|Thanks|Thank you|Cheers|Sincerely|Yours(?: \w+)?|Cordialement|Bien à vous|Grüßen|Grüße|Gruß|Saludos|Atentamente|Atenciosamente|Abraços|С уважением),?[ \t]*\r?\n[>|*•\- \t]*$")


def candidates(t: str, first_names: frozenset[str] = FIRST_NAMES) -> list[Span]:
    """All candidate spans of a text with the votes of their kind's labelers."""
    low = _lower(t)
    runs = [m.start() for m in DIGIT_RUN.finditer(t)]
    out = [*_emails(t, low), *_phones(t, runs), *_ids(t, low, runs), *_addresses(t, low, runs)]
    return out + list(_names(t, [(a, z) for k, a, z, v, *_ in out if k != "id_number" and v[0] > 0], first_names))


class Model:
    """Reliabilities by expectation-maximisation, and the classifier trained on what it believes.

    ``counts`` maps (kind, votes, shape) to how many candidates have them.
    """

    def __init__(self, counts: Counter[tuple[str, tuple[int, ...], tuple[int, ...]]], rounds: int = 200) -> None:
        self.weights: dict[str, np.ndarray] = {}
        self.shapes: dict[str, list[list[int]]] = {}
        self.reliability: dict[str, np.ndarray] = {}
        for kind in KINDS:
            own = sorted((v, s, n) for (k, v, s), n in counts.items() if k == kind)
            if own:
                votes, shape, n = np.array([v for v, _, _ in own]), np.array([s for _, s, _ in own]), np.array([c for *_, c in own], float)
                self.shapes[kind] = [sorted(set(c.tolist())) for c in shape.T]
                p, self.reliability[kind] = self.believe(votes, n, rounds, SILENT.get(kind, ()))
                self.weights[kind] = self.train(self.features(kind, votes, shape), n, p)
        self.known: dict[tuple, float] = {}

    @staticmethod
    def believe(votes: np.ndarray, n: np.ndarray, rounds: int, silent: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
        """Posterior of a true span per vote pattern (labelers independent given the truth), and the rates of votes against,
        abstentions and votes for of every labeler on true and on false spans.

        It begins with the majority of votes; rates are smoothed by one candidate, nothing else is assumed.
        """
        p = 1 / (1 + np.exp(-1.5 * votes.sum(axis=1) + 0.5))
        rates = np.zeros((votes.shape[1], 3, 2))
        for _ in range(rounds):
            true, false = p * n, (1 - p) * n
            prior = (true.sum() + 1) / (n.sum() + 2)
            log = np.full(len(p), np.log(prior) - np.log(1 - prior))
            for j in range(votes.shape[1]):
                told = (votes[:, j] != 0) | (j not in silent)
                for v in (-1, 0, 1):
                    at = votes[:, j] == v
                    if not told[at].all():
                        continue
                    rates[j, v + 1] = (true[at].sum() + 1 / 3) / (true[told].sum() + 1), (false[at].sum() + 1 / 3) / (false[told].sum() + 1)
                    log[at] += np.log(rates[j, v + 1, 0]) - np.log(rates[j, v + 1, 1])
            new = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
            if np.abs(new - p).max() < 1e-6:
                break
            p = new
        return p, rates

    def features(self, kind: str, votes: np.ndarray, shape: np.ndarray) -> np.ndarray:
        hot = [shape[:, [j]] == np.array(values)[None, :] for j, values in enumerate(self.shapes[kind])]
        return np.concatenate([np.ones((len(votes), 1)), votes == 1, votes == -1, *hot], axis=1).astype(float)

    @staticmethod
    def train(x: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Weighted logistic regression by Newton steps, with a small ridge."""
        w = np.zeros(x.shape[1])
        for _ in range(50):
            q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ (n * (q - p)) + 0.5 * w
            hess = (x * (n * np.maximum(q * (1 - q), 1e-6))[:, None]).T @ x + 0.5 * np.eye(len(w))
            step = np.linalg.solve(hess, grad)
            w = w - step
            if np.abs(step).max() < 1e-8:
                break
        return w

    def probability(self, kind: str, votes: tuple[int, ...], shape: tuple[int, ...]) -> float:
        if kind not in self.weights:
            return 0.0
        p = self.known.get((kind, votes, shape))
        if p is None:
            z = float((self.features(kind, np.array([votes]), np.array([shape])) @ self.weights[kind])[0])
            p = self.known[kind, votes, shape] = float(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        return p

    def decide(self, spans: list[Span]) -> list[tuple[str, int, int]]:
        """The spans believed, without overlaps."""
        return chosen([(k, a, z, p) for k, a, z, v, s, _ in spans if (p := self.probability(k, v, s)) >= 0.5])


def chosen(spans: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int]]:
    """Spans without overlaps: of two that overlap the more certain one, then the longer one."""
    out: list[tuple[str, int, int]] = []
    for _, k, _, a, z in sorted((-round(p, 6), KINDS.index(k), a - z, a, z) for k, a, z, p in spans):
        if all(z <= b or a >= e for _, b, e in out):
            out.append((KINDS[k], a, z))
    return sorted(out, key=lambda s: s[1])


def person_like(votes: tuple[int, ...]) -> bool:
    """Whether a candidate stands where a person is named, whatever its words are."""
    return votes[6] == votes[7] == 0 and votes[1] + votes[2] + votes[4] + votes[5] > 0


def _texts(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Documents with ``c``, a number of id and text together."""
    t, i = F.col(f"`{text}`"), F.col(f"`{doc_id}`")
    return df.where(i.isNotNull() & t.isNotNull()).select(i.cast("long").alias("doc_id"), t.alias("_t"), F.xxhash64(i, t).alias("c"))


CANDIDATES = pa.schema([("c", pa.int64()), ("doc_id", pa.int64()), ("kind", pa.int8()), ("a", pa.int32()), ("z", pa.int32()), ("votes", pa.string()), ("shape", pa.string()), ("first", pa.string()), ("named", pa.bool_())])


def candidate_table(df: DataFrame, doc_id: str, text: str, first_names: frozenset[str] = FIRST_NAMES) -> DataFrame:
    """A row per candidate: where it is, its votes and shape as text, a name's first word, and whether it stands where a
    person is named. One pass over the texts, which are not moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for c, i, t in zip(b.column(2).to_pylist(), b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for k, a, z, v, s, f in candidates(t, first_names):
                    rows.append((c, i, KINDS.index(k), a, z, _text_of(v), _text_of(s), f or None, k == "name" and person_like(v)))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * len(CANDIDATES), CANDIDATES, strict=True)], schema=CANDIDATES)

    return _texts(df, doc_id, text).mapInArrow(run, "c long, doc_id long, kind byte, a int, z int, votes string, shape string, first string, named boolean")


def _text_of(values: tuple[int, ...]) -> str:
    return ",".join(map(str, values))


@lru_cache(1 << 14)
def _votes_of(votes: str, company: int) -> tuple[int, ...]:
    v = tuple(map(int, votes.split(",")))
    return (*v[:ELSEWHERE], company) if len(v) > ELSEWHERE else v


@lru_cache(1 << 14)
def _shape_of(shape: str) -> tuple[int, ...]:
    return tuple(map(int, shape.split(",")))


def judged(table: DataFrame) -> tuple[DataFrame, Model]:
    """Stored candidates with ``company``, the vote of what a name's first word does elsewhere, and the model fitted on all.

    Words are counted in each task first; a word that very many candidates begin with ("the") is broadcast to them. Counts of
    vote patterns (at most some thousand) come to the driver.
    """
    uses = stored(table.where(F.col("first").isNotNull()).groupBy("first").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("named").cast("long")).alias("m")))
    share = F.col("m") / F.col("n")
    told = uses.where(F.col("n") >= LEAST_USES).select("first", F.when(share >= NAMED_SHARE, 1).when(share < OTHER_SHARE, -1).alias("company")).where(F.col("company").isNotNull())
    limit = max(10_000, table.count() // (4 * spread(table.sparkSession)))
    rows = joined(table, told, "first", uses.where(F.col("n") > limit).select("first")).withColumn("company", F.coalesce("company", F.lit(0)))
    counts = rows.groupBy("kind", "votes", "shape", "company").agg(F.count(F.lit(1)).alias("n")).collect()
    return rows, Model(Counter({(KINDS[r[0]], _votes_of(r[1], r[3]), _shape_of(r[2])): r[4] for r in counts}))


def _places(df: DataFrame, doc_id: str, text: str, first_names: frozenset[str] = FIRST_NAMES) -> DataFrame:
    """``(c, doc_id, places)`` of the documents that have any: kinds and spans in order, without overlaps."""
    rows, fitted = judged(stored(candidate_table(df, doc_id, text, first_names)))
    model = df.sparkSession.sparkContext.broadcast(fitted)

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = [model.value.probability(KINDS[k], _votes_of(v, c), _shape_of(s)) for k, v, s, c in zip(*(b.column(n).to_pylist() for n in ("kind", "votes", "shape", "company")), strict=True)]
            out = pa.RecordBatch.from_arrays([*(b.column(n) for n in ("c", "doc_id", "kind", "a", "z")), pa.array(p, pa.float64())], names=["c", "doc_id", "kind", "a", "z", "p"])
            yield out.filter(pa.array([x >= 0.5 for x in p], pa.bool_()))

    def resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places = [chosen([(KINDS[x["kind"]], x["a"], x["z"], x["p"]) for x in spans]) for spans in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([[{"kind": k, "a": a, "z": z} for k, a, z in x] for x in places], PLACES)], names=["c", "doc_id", "places"])

    kept = rows.mapInArrow(likely, "c long, doc_id long, kind byte, a int, z int, p double").distinct()
    grouped = kept.groupBy("c", "doc_id").agg(F.collect_list(F.struct("kind", "a", "z", "p")).alias("_s"))  # one document's
    return grouped.mapInArrow(resolved, "c long, doc_id long, places array<struct<kind:string,a:long,z:long>>")


PLACES = pa.list_(pa.struct([("kind", pa.string()), ("a", pa.int64()), ("z", pa.int64())]))


def personal_data(df: DataFrame, doc_id: str, text: str, first_names: frozenset[str] = FIRST_NAMES) -> DataFrame:
    """``(doc_id, kind, start_pos, end_pos)`` of every place, in code points.

    The documents are read once; their candidates are stored, the models are fitted on the counts of vote patterns of all
    of them, and the stored candidates are classified. Null texts and ids are left out, empty texts have no places, a row
    repeated with its text is reported once, an empty table gives an empty result; extra columns are not read.
    """
    return _places(df, doc_id, text, first_names).select("doc_id", F.explode("places").alias("_p")).select("doc_id", F.col("_p.kind").alias("kind"), F.col("_p.a").alias("start_pos"), F.col("_p.z").alias("end_pos"))


def redacted(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``(doc_id, text, places)``: every text with typed placeholders for its personal data, the rest as it was.

    The places of ``personal_data`` are joined to the texts (broadcast, where Spark measures them to be few). Rows with a null
    text or id are left out, repeated ones are kept.
    """
    found = _places(df, doc_id, text).select("c", F.col("doc_id").alias("_d"), "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, places = [], []
            for t, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                out, at = [], 0
                for x in spans or []:
                    out += [t[at : x["a"]], PLACEHOLDER[x["kind"]]]
                    at = x["z"]
                texts.append("".join([*out, t[at:]]))
                places.append(len(spans or []))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(places, pa.int32())], names=["doc_id", "text", "places"])

    own = _texts(df, doc_id, text)
    both = own.join(found, (own["c"] == found["c"]) & (F.col("doc_id") == F.col("_d")), "left").select("doc_id", "_t", "places")
    return both.mapInArrow(run, "doc_id long, text string, places int")
