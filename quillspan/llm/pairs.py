"""Problem 7: prompt and answer pairs with a defect.

Rules in order: nothing there, only the prompt's words, a phrase that declines, another script or language, an end that
breaks off. An empty pair has no other defect, nor has a copied one (it continues nothing, and its words end where the
prompt's do); a refusal has no other language (it continues nothing either). Otherwise every rule that fires gives a row.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, joined, spread, stored

# First-person phrases that decline to write, per language (matched in lower case).
REFUSALS = re.compile(
    "|".join(
        (
            # English
            r"\bi(?:'m| am) (?:sorry|afraid|unable|not able|not allowed|not comfortable|not permitted)\b.{0,40}\b(?:can't|cannot|can not|unable|not able|isn't possible|won't|must refuse|decline|rather not|not allowed)\b",
            r"\bi (?:can't|cannot|can not|could not|won't|will not|must not|am not able to|am unable to|am not allowed to|am not permitted to|do not feel able to) (?:help|assist|answer|continue|complete|write|produce|provide|comply|fulfil|fulfill|do|create|generate|respond|support|discuss|share)\b",
            r"\b(?:isn't|is not|it's not) possible for me to\b",
            r"\bi (?:must|have to|need to|will have to) (?:refuse|decline)\b",
            r"\bsomething i (?:have to|must|need to) (?:decline|refuse)\b",
            r"\bi(?:'d| would) rather not\b",
            r"\bi (?:decline|refuse) to\b",
            # French
            r"\bje (?:dois|suis obligée?) (?:de )?(?:refuser|décliner)\b",
            r"\bje (?:ne peux|ne puis|ne suis) pas (?:vous |t'|l'|en |autorisée? |capable |en mesure |y )?(?:aider|répondre|continuer|écrire|produire|traiter|compléter|de|à|faire|mesure)\b",
            r"\bil (?:m'est|ne m'est pas) (?:impossible|possible) de\b",
            r"\bje refuse de\b",
            # German
            r"\b(?:kann|darf|werde|möchte) ich (?:dabei|damit|dazu|diesen?|dieses|diese|dir|ihnen|das|hier|leider)\b.{0,40}\b(?:nicht|nichts|keine)\b",
            r"\bich (?:kann|darf|werde|möchte) (?:dabei|damit|dazu|diesen?|dieses|diese|dir|ihnen|das|hier|leider)\b.{0,40}\b(?:nicht|nichts|keine)\b",
            r"\b(?:muss ich|ich muss)\b.{0,40}\bablehnen\b",
            r"\bich lehne\b.{0,40}\bab\b",
            # Spanish
            r"\bno me es posible (?:continuar|ayudar|responder|escribir|completar|atender|seguir)\b",
            r"\b(?:debo|tengo que) (?:rechazar|negarme|declinar)\b",
            r"\bno (?:puedo|podré|debo) (?:ayudar|ayudarte|ayudarle|continuar|responder|escribir|completar|atender|seguir)\b",
            # Portuguese
            r"\bnão (?:posso|consigo|devo|poderei) (?:ajudar|continuar|responder|escrever|completar|atender|seguir)\b",
            r"\b(?:tenho de|tenho que|devo|preciso) (?:recusar|declinar)\b",
            r"\bnão me é possível\b",
            # Russian
            r"\bя не (?:могу|смогу|буду|в состоянии) ",
            r"(?<!\w)не могу (?:помочь|продолжить|ответить|написать|выполнить)\b",
            r"\b(?:вынужден|вынуждена|должен|должна|приходится) (?:отказать|отказаться|отклонить)",
            # Hebrew
            r"(?:אני|איני|אינני) (?:לא )?(?:יכול|יכולה|מסרב|מסרבת|נאלץ|נאלצת)",
            r"(?:עלי|עליי) לסרב|לא אוכל (?:לעזור|להמשיך|לענות)",
        )
    )
)
DECLINED = re.compile(r"declin|refus|can't assist|cannot assist|can't help|cannot help|turned down|withheld|would not answer|won't answer|blocked|safety|not allowed|policy", re.I)

# Frequent small words of each language.
SMALL_WORDS = {
    "en": "the a an and of in to with that this was were is are had have has so because before after while until unless although both every for from its their our his her it at as or when where which not but could would by on behind beside those these this most some two our my your no from",
    "fr": "le la les un une des du de et est a à avec sans pour dans sur qui que ne pas plus très dès après avant pendant depuis malgré chez sa son ses cette cet ce au aux été en notre côté tôt",
    "de": "der die das und den dem des ein eine einen einer ist wird wurde mit von zu über für nach vor während trotz ohne gemäß im am aus auf alle jede jeden keine nicht mehr ältere später laut siehe in zur zum",
    "es": "el la los las un una y de del en con sin por para no su sus más todavía durante después según ningún sólo al junto a través desde otra otro que se dos",
    "pt": "o a os as um uma e de do da dos das em com sem por para não seu sua mais até depois além às ao à no na nos nas que se foi três junto perto",
}
_OWN: dict[str, dict[str, float]] = {}
for _lang, _words in SMALL_WORDS.items():
    for _w in _words.split():
        _OWN.setdefault(_w, {})[_lang] = 1.0
# Letters that tell languages apart.
LETTER_HINTS = {"ß": "de", "ä": "de", "ö": "de", "ü": "de", "ñ": "es", "¿": "es", "¡": "es", "ã": "pt", "õ": "pt", "è": "fr", "ê": "fr pt", "î": "fr", "û": "fr", "œ": "fr", "ë": "fr", "ç": "fr pt", "é": "fr es pt", "à": "fr pt", "í": "es pt", "ó": "es pt", "ú": "es pt", "á": "es pt", "ô": "fr pt", "â": "fr pt"}
# Words after which a clause cannot end.
UNFINISHED = frozenset(
    "the a an and or but of to with as so that because while until unless although before if when where which who whose for from by at into onto than its their our my your his her this these those every both most some no not had has have is are was were be been very"
    " le la les un une des du de et ou à au aux en avec sans pour dans sur qui que dont malgré pendant chez sa son ses cette cet ce leur leurs très ne par plus"
    " der die das den dem des ein eine einen einem einer und oder mit von zu zur zum über für nach vor während trotz ohne gemäß im am aus auf in an dass weil wenn keine kein jede jeden jeder alle sehr"
    " el los las una y o del con sin por para que su sus según durante ningún otra otro más sólo al"
    " os um uma e do da dos das em com sem não seu sua até à às no na nos nas ao aos mais outra outro"
    " и в на по до из без под над от к с у о об для при за через не или что как его их".split()
)
TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
# A word stands at proper ends as good as never below the share SELDOM; a share is judged as if WEIGHT more uses
# with the USUAL share of ends (5-10 % of the words in each language) had been seen, so that a few uses decide nothing.
SELDOM, USUAL, WEIGHT = 0.02, 0.06, 6
OPENERS = {"(": ")", "[": "]", "{": "}", "“": "”", "«": "»", "„": "“"}


CYRILLIC, HEBREW = re.compile("[Ѐ-ӿ]"), re.compile("[א-ת]")
PLAIN = re.compile(r"\b[^\W\d_A-ZÀ-Þ][^\W\d_]*")
OF_OTHERS = re.compile(r"[\u0400-\u05ff]")
APOSTROPHE = re.compile("['’]")
ELIDED, ELIDED_SHORT = re.compile(r"[dlnscjmtq]u?['’]"), re.compile(r"(?:[dlnscjmt]|qu)['’]")


def words_of(t: str) -> list[str]:
    if t.isascii():
        return TOKEN.findall(t.lower())
    return [w.replace("’", "'") for w in TOKEN.findall(unicodedata.normalize("NFC", t).casefold())]


def script_of(t: str) -> str:
    """The script of a text's words that aren't names in Latin letters: ``ru``, ``he`` or ``latin`` ('' without words)."""
    if t.isascii() or not OF_OTHERS.search(t):
        return "latin" if PLAIN.search(t) else ""
    cyrillic, hebrew = len(CYRILLIC.findall(t)), len(HEBREW.findall(t))
    plain = OF_OTHERS.sub("", "".join(PLAIN.findall(t)))
    top = max((cyrillic, "ru"), (hebrew, "he"), (sum(map(str.isalpha, plain)), "latin"))
    return top[1] if top[0] else ""


@lru_cache(1 << 16)
def _hints(w: str) -> tuple[tuple[tuple[str, float], ...], tuple[frozenset[str], ...]]:
    """What one word says: weights of languages, and the sets of languages it narrows a text down to, in order."""
    score: list[tuple[str, float]] = []
    sets: list[frozenset[str]] = []
    low = w.lower()
    if ELIDED_SHORT.match(low):
        sets.append(frozenset(("fr",)))
    named = w[0].isupper() and len(w) > 3 and low not in _OWN
    for part in APOSTROPHE.split(low):
        own = _OWN.get(part)
        if own:
            score += [(lang, 1 / len(own)) for lang in own]
            sets.append(frozenset(own))
    if ELIDED.match(low):
        score.append(("fr", 1.0))
    if not low.isascii():
        for c in {c for c in low if c in LETTER_HINTS}:
            own = LETTER_HINTS[c].split()
            score += [(lang, 0.6 / len(own)) for lang in own]
        sets += [frozenset(LETTER_HINTS[c].split()) for c in low if c in LETTER_HINTS]
    return () if named else tuple(score), tuple(sets)


def language_scores(t: str) -> dict[str, float]:
    """Evidence per Latin-script language: small words it has (shared ones count less), and letters that hint at it."""
    score = dict.fromkeys(SMALL_WORDS, 0.0)
    for w in TOKEN.findall(t):
        for lang, weight in _hints(w)[0]:
            score[lang] += weight
    return score


def possible_languages(t: str) -> set[str]:
    """The languages that have all of a short text's small words and accented letters; empty where nothing tells."""
    s = script_of(t)
    if s in ("ru", "he"):
        return {s}
    left, told = frozenset(SMALL_WORDS), False
    for w in TOKEN.findall(t):
        for own in _hints(w)[1]:
            if left & own:
                left, told = left & own, True
    return set(left) if told else set()


def language_of(t: str) -> str:
    """``ru``, ``he``, one of the Latin-script languages, or '' where nothing tells."""
    s = script_of(t)
    if s != "latin":
        return s
    ranked = sorted(((v, k) for k, v in language_scores(t).items()), reverse=True)
    return ranked[0][1] if ranked[0][0] >= 0.9 and ranked[0][0] >= ranked[1][0] + 0.5 else ""


def told_language(t: str) -> str:
    """``language_of``, or the one language that a text with little evidence can be in."""
    found = language_of(t)
    if not found and len(may := possible_languages(t)) == 1:
        found = next(iter(may))
    return found


def continuation(query: str, text: str) -> str:
    """The text without the query in front of it (compared by words)."""
    q, at, k = words_of(query), 0, 0
    for m in TOKEN.finditer(text):
        if k >= len(q) or m[0].casefold().replace("’", "'") != q[k]:
            break
        k, at = k + 1, m.end()
    return text[at:] if k == len(q) and q else text


def open_ended(t: str) -> bool:
    """Whether a quote or bracket stays open."""
    for a, b in OPENERS.items():
        if a == "„":
            continue
        if t.count(a) > t.count(b) and not (a == "“" and "„" in t):
            return True
    return t.count('"') % 2 == 1


def ending(t: str) -> tuple[str, str]:
    """The last word (lower case) and what follows it."""
    z = len(t)
    while z and not t[z - 1].isalnum():
        z -= 1
    if not z:
        return "", t.strip()
    # a word has no white space: it stands behind the last one
    a = z
    while a and not t[a - 1].isspace():
        a -= 1
    last = None
    for last in TOKEN.finditer(t, a, z):
        pass
    return last[0].lower(), t[last.end() :].strip()


def broken(known: int, final: int, longer: int) -> bool:
    """Whether a last word is a piece of a word, or one that needs a next one.

    A piece is hardly seen beside the ``longer`` words it begins, and not at ends; shares only, so the size of the table
    doesn't matter.
    """
    n = known + final
    return n < SELDOM * longer and final <= SELDOM * n or final + WEIGHT * USUAL < SELDOM * (n + WEIGHT)


#: Without one of these parts (lower case) no phrase above can stand in a text.
DECLINING = re.compile("sorry|afraid|n't|not|unable|possib|refus|declin|rather|décl|impossib|pas |nicht|keine|ablehn|lehne|posib|rechaz|negar|puedo|podré|debo|não|recus| не |могу|отказ|откло|ני |לסרב|לא ")


def judged(query: str | None, text: str | None) -> tuple[list[str], str | None]:
    """The defects of one pair that it shows by itself; and its last word, if how that is used elsewhere has to tell whether it
    breaks off."""
    if text is None or not any(map(str.isalnum, text)):
        return ["empty"], None
    q = words_of(query or "")
    if q and set(words_of(text)) <= set(q):
        return ["copy"], None
    out = []
    low = text.lower().replace("’", "'")
    if DECLINING.search(low) and REFUSALS.search(low):
        out.append("refusal")
    elif q:
        rest = continuation(query or "", text)
        asked, given = script_of(query or ""), script_of(rest)
        if asked and given and asked != given:
            out.append("other_language")
        elif (b := language_of(rest)) and (may := possible_languages(query or "")) and b not in may:
            found = language_scores(rest)
            if b not in found or found[b] >= max((found[x] for x in may if x in found), default=0) + 1:
                out.append("other_language")
    word, tail = ending(text)
    closing = tail.strip("\"'”’»)]} ")
    if open_ended(text):
        out.append("truncated")
    elif closing in ("", "-", "–", "—", "…", "...", "..", ",", ";", ":", "/", "&", "+", "=") or closing.endswith(("...", "…", "-", ",", ":", ";")):
        if closing or word in UNFINISHED:
            out.append("truncated")
        elif not word.isdigit():
            return out, word
    return out, None


def defects(query: str | None, text: str | None, known: int | None, final: int | None, longer: int | None) -> list[str]:
    """The defects of one pair. ``known``/``final``: how often the text's last word stands inside or at a proper end of
    other texts in its language; ``longer``: how often words stand there that it begins."""
    out, word = judged(query, text)
    return [*out, "truncated"] if word is not None and broken(known or 0, final or 0, longer or 0) else out


COUNTS = ("known", "final", "longer")


def broken_column() -> Column:
    """``broken`` over the columns of counts, nulls as 0."""
    known, final, longer = (F.coalesce(F.col(c), F.lit(0)) for c in COUNTS)
    n = known + final
    return (n < SELDOM * longer) & (final <= SELDOM * n) | (final + WEIGHT * USUAL < SELDOM * (n + WEIGHT))


def _languages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their language."""
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([told_language(t) for t in b.column(0).to_pylist()], pa.string())], names=["_t", "_lang"])


PAIR = "response_id long, rank_no int, defects array<string>, _lang string, word string"


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with the defects they show; where a last word is in doubt, the word and the language in which the answer ends: that
    of what follows the query, else of the whole text."""
    for b in batches:
        found, lang, words = [], [], []
        for q, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            own, word = judged(q, t)
            found.append(own)
            words.append(word)
            lang.append((told_language(continuation(q or "", t)) or told_language(t)) if word is not None else None)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.string())), pa.array(lang, pa.string()), pa.array(words, pa.string())], names=["response_id", "rank_no", "defects", "_lang", "word"])


def word_statistics(texts: DataFrame, text: str, asked: DataFrame) -> DataFrame:
    """``(_lang, word, known, final, longer)`` of the words ``asked`` (a column ``word``): per language, and under '' over all
    texts, how often a word stands before another one, how often a text ends with it and a full stop, and how often longer
    words stand there that it begins.

    Words are counted in each task before they are moved. Of a longer word only those beginnings are looked at that are as
    long as some word that is asked for, so a very long one costs no more than there are such lengths.
    """
    t = texts.where(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{text}`").alias("_t")).mapInArrow(_languages, "_t string, _lang string")
    parts = t.select("_lang", F.regexp_extract_all(F.lower("_t"), F.lit(r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*"), F.lit(0)).alias("_w"), F.col("_t").rlike(r"[^.…][.!?][\"'”’»)\]]*\s*$").alias("_e"))
    flat = parts.select("_lang", F.size("_w").alias("_n"), "_e", F.posexplode("_w").alias("_p", "word"))
    inside = F.col("_p") < F.col("_n") - 1
    uses = stored(flat.groupBy("_lang", "word").agg(F.sum(F.when(inside, 1).otherwise(0)).alias("known"), F.sum(F.when(~inside & F.col("_e"), 1).otherwise(0)).alias("final")))
    lengths = sorted(r[0] for r in asked.select(F.length("word")).distinct().collect() if r[0])  # a handful of numbers
    if not lengths:
        return uses.select("*", F.lit(0).cast("long").alias("longer")).limit(0)
    none = F.lit(0).cast("long")
    begins = F.explode(F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n < F.length("word")), lambda n: F.substring("word", F.lit(1), n)))
    begun = uses.select("_lang", begins.alias("word"), none.alias("known"), none.alias("final"), (F.col("known") + F.col("final")).alias("longer"))
    both = uses.where(F.length("word").isin(lengths)).select("*", none.alias("longer")).unionByName(begun)
    own = both.groupBy("_lang", "word").agg(*(F.sum(c).alias(c) for c in COUNTS)).join(asked.select("word").distinct(), "word", "left_semi")
    own = stored(own)
    every = own.groupBy("word").agg(*(F.sum(c).alias(c) for c in COUNTS)).select(F.lit("").alias("_lang"), "word", *COUNTS)
    return own.where(F.col("_lang") != "").unionByName(every.select(*own.columns))


def defective(requests: DataFrame, responses: DataFrame, suggestions: DataFrame, most_results: int = 5) -> DataFrame:
    """``(response_id, rank_no, defect)`` for the answers to requests of mode ``AI``.

    A request that was sent again counts once, with its latest attempt. Responses without suggestions get rank 0 if the
    request is valid: ``refusal`` if the error says the text was declined, else ``empty``; ``max_results`` null counts as
    the default. Nulls: a null text is empty; with a null or blank query only rules about the text itself apply; responses
    to unknown requests, null response ids and null ranks of real suggestions are left out or kept as they stand (rank
    null). Repeated suggestion rows are reported each. Empty tables give an empty result. Only named columns are read.
    """
    req = requests.groupBy("request_id").agg(F.max_by(F.struct("query", "mode", "max_results"), F.col("attempt")).alias("_r"))
    req = req.select("request_id", F.col("_r.query").alias("query"), F.col("_r.mode").alias("mode"), F.col("_r.max_results").alias("most")).where(F.col("mode") == "AI")
    answered = responses.select("response_id", "request_id", "error").where(F.col("response_id").isNotNull()).join(req, "request_id")
    given = suggestions.select(F.col("response_id").alias("_s"), "rank_no", F.col("text").alias("_text"))
    both = answered.join(given, F.col("response_id") == F.col("_s"), "left")

    none = both.where(F.col("_s").isNull() & F.col("query").rlike(r"[^\s ​]") & (F.coalesce("most", F.lit(0)) <= most_results))
    silent = none.select("response_id", F.lit(0).alias("rank_no"), F.when(F.col("error").rlike("(?i)" + DECLINED.pattern), "refusal").otherwise("empty").alias("defect"))

    pairs = stored(both.where(F.col("_s").isNotNull()).select("response_id", "rank_no", "query", "_text").mapInArrow(_pairs, PAIR))
    shown = pairs.select("response_id", "rank_no", F.explode("defects").alias("defect"))
    # only a last word without a full stop has to be looked up; most pairs have none and are not moved
    doubted = pairs.where(F.col("word").isNotNull())
    some = doubted.select("_lang", "word").distinct()
    stats = stored(word_statistics(suggestions, "text", some))
    own, every = stats.where((F.col("_lang") != "") & (F.col("known") + F.col("final") + F.col("longer") > 0)), stats.where(F.col("_lang") == "")
    every = every.select("word", *(F.col(c).alias(f"_{c}") for c in COUNTS))
    # a word that its language doesn't have at all is looked up in all texts
    found = [F.when(F.col("known").isNotNull(), F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in COUNTS]
    known = some.join(own, ["_lang", "word"], "left").join(every, "word", "left").select("_lang", "word", *found)
    pieces = stored(known.where(broken_column()).select(F.to_json(F.struct("_lang", "word")).alias("_key")))
    asked = doubted.select("response_id", "rank_no", F.to_json(F.struct("_lang", "word")).alias("_key"))
    hot = hot_keys(asked, "_key", max(10_000, pairs.count() // (4 * spread(pairs.sparkSession))))
    cut = joined(asked, pieces, "_key", stored(hot), "inner").select("response_id", "rank_no", F.lit("truncated").alias("defect"))
    return shown.unionByName(cut).unionByName(silent.select("response_id", F.col("rank_no").cast("int"), "defect"))
