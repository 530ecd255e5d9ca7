"""Operators over single texts: encodings, look-alikes, pairs, leaks, personal data."""

import random
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspan.llm import encoding, leaks, lookalikes, pairs, personal

PROPER = [
    "Le théâtre de Mérignac préfère une réponse brève, dès le début (nº 12).", "Größere Tabellen für Gäste überträgt die Straße nicht.", "O cão não começou às três; informações à noite.",
    "¿Cuándo llegó el niño? «Mañana», dijo él.", "Большая таблица ждёт новой проверки.", "הספר הישן שומר את התשובות", "at −4 °C for €15 (3×4) — “the” baker’s…", "Δt = 0.2 s with λ = 0.3", "NÃO É RARO: AÇÃO", "naïve café Zoë",
    "plain ascii & more = fine 50%", "", "№ 5 § 2", "Příliš žluťoučký kůň", "Zażółć gęślą jaźń", "ağaç çiçek ışık", "日本語のテキスト", "한국어 문장",
]


@pytest.mark.parametrize("text", PROPER)
def test_proper_text_is_left_alone(text):
    assert encoding.Repairer().text(text) == (False, text, True)


@pytest.mark.parametrize("text", PROPER[:6])
@pytest.mark.parametrize("shown", ["latin-1", "cp1252", "mac_roman", "cp437", "cp1250"])
def test_round_trip(text, shown):
    wrong = "".join(c if c < "\x80" else "".join(encoding.CHARS.get(shown, {}).get(b) or bytes([b]).decode(shown, "replace") for b in c.encode()) for c in text)
    if "�" in wrong:
        pytest.skip("not every byte has a character")
    found, fixed, whole = encoding.Repairer().text(wrong)
    assert found and whole and fixed == text


@pytest.mark.parametrize(
    ("wrong", "right"),
    [("Ã©cole", "école"), ("ÃƒÂ©lan", "élan"), ("rΘsumΘ", "résumé"), ("ni±os", "niños"), ("Êàæäàÿ ñòðîêà", "Каждая строка"), ("РџСЂРѕРІРµСЂРєР°", "Проверка"), ("äñôø äéùï", "הספר הישן"), ("â€œthe bakerâ€\x9d", "“the baker”"), ("caf&eacute; &amp; bar", "café & bar"), ("mã©moire", "mémoire"), ("Каждая Ð½Ð¾Ð²Ð°Ñ строка", None), ("a�b", None)],
)
def test_repairs(wrong, right):
    found, fixed, whole = encoding.Repairer().text(wrong)
    assert found and (right is None or fixed == right and whole)


@pytest.mark.parametrize("wrong", ["数据库测试文件".encode("gbk").decode("latin-1"), "資料庫測試".encode("big5").decode("latin-1"), "日本語のテキスト".encode("shift_jis").decode("mac_roman"), "die neue StraÃe"])
def test_what_nothing_repairs_is_reported(wrong):
    assert encoding.Repairer().text(wrong) == (True, wrong, False)


@pytest.mark.parametrize("text", ["x²+y²≤r² für ΔE≈½mv²", "NGUYỄN ĐẶNG Thị Hằng", "ZAŻÓŁĆ GĘŚLĄ", "әңгімелеу қазақша", "İstanbul'da ŞİŞLİ", "Python入門と日本語", "ёлка/ёж·№5"])
def test_unusual_text_is_not_lost(text):
    assert not any(encoding.lost(w) for w in text.split())


def test_look_alikes_are_no_wrong_encoding():
    for t in ("thе quiеt hаrbor", "Νο frοzen rivеr", "нoвoй пpoвepки", "ａｍｂｅｒ café", "café", "Por\xa0três pontes", "sl​ow"):
        assert not encoding.Repairer().text(t)[0], t


# Sentences of which lines are made.
CLEAN = [
    "La montaña pequeña llegó sin explicación después del café.", "El niño durmió mucho más allí, ¿verdad?", "Á última hora, la canción sonó así en el jardín.", "À côté du marché, le théâtre était fermé à sept heures.",
    "Où est la forêt près de la rivière où naît le fleuve ?", "Dès l'été, les élèves préfèrent être à la plage.", "Größere Gäste hören die schöne Übung für später.", "Die Straße führt über müde Füße zum Mädchen.",
    "O cão não começou às três; informações à mão.", "A região terá eleições já em março, não é?", "Большая таблица ждёт новой проверки до вечера.", "Тихий сад хранит старые ответы в каждой строке.", "Новый путь ведёт через лес к реке и обратно.", "Кто читает эти письма, тот знает ответ на вопрос.",
]


@pytest.mark.parametrize(
    ("meant", "shown"),
    [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp437"), ("utf-8", "cp1251"), ("utf-8", "mac_roman"), ("cp1251", "koi8-r"), ("koi8-r", "cp1252"), ("koi8-r", "cp1251"), ("cp1251", "cp1252"), ("cp1252", "mac_roman"), ("cp1252", "cp1250"), ("mac_roman", "cp1252"), ("cp866", "cp1251"), ("cp1252", "cp1251"), ("cp850", "cp1252")],
)
def test_restored_lines(meant, shown):
    """Nine lines of ten come back as they were, whatever set they were shown in; clean ones are left alone."""
    rng = random.Random(meant + shown)
    latin, russian = CLEAN[:10], CLEAN[10:]
    clean = [" ".join(rng.sample(part, 2)) for part in (latin, russian) for _ in range(150)]
    pairs = encoding.Pairs(encoding.count_pairs(clean * 5))
    repair = encoding.Repairer(pairs)
    garbled = []
    for t in dict.fromkeys(clean):
        try:
            g = t.encode(meant).decode(shown)
        except UnicodeError:
            continue
        if g != t:
            garbled.append((g, t))
    right = sum(repair.text(g)[1] == t for g, t in garbled)
    assert len(garbled) >= 12 and right >= 0.9 * len(garbled), (len(garbled), right)
    assert not any(repair.text(t)[0] for t in clean)


def test_pairs_are_counted_as_they_are_looked_up():
    counts = encoding.count_pairs(["né, 5 été!", "a日é", "é"])
    assert counts == {"né": 1, "é ": 4, " é": 2, "ét": 1, "té": 1}


def test_garbled_table(spark):
    rows = [(1, "Ã©cole", "x"), (2, "école", "x"), (3, None, "x"), (4, "", "x"), (None, "Ã©t", "x"), (1, "Ã©cole", "x"), (5, "a" * 50_000 + "Ã©", "x")]
    df = spark.createDataFrame(rows, "id long, t string, rec_id string")
    got = encoding.garbled(df, "id", "t").collect()
    assert sorted((r["rec_id"] or 0, r["repaired"][:5]) for r in got) == [(0, "ét"), (1, "école"), (1, "école"), (5, "aaaaa")] and all(r["whole"] for r in got)
    assert encoding.garbled(df.limit(0), "id", "t").count() == 0


# one form


def by_row(text):
    """The same form by plain Python calls, without look-alike letters."""
    out = []
    for c in text:
        if c in lookalikes.ZERO_WIDTH:
            continue
        d = unicodedata.decomposition(c)
        out.append(" " if c in lookalikes.NO_BREAK else unicodedata.normalize("NFKC", c) if d.startswith(("<wide>", "<narrow>")) or c == "　" or "ﬀ" <= c <= "ﬆ" else c)
    return "".join(out)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.one_of(st.characters(min_codepoint=32, max_codepoint=0x24F), st.sampled_from("ａＺ３！　​﻿\xa0  ﬁﬃ̧́̈日😀é")), max_size=12)), max_size=6))
def test_form_equals_row_by_row(texts):
    # ASCII letters are taken out, so that no word decides about look-alikes
    texts = [None if t is None else "".join(c for c in t if not c.isascii() or not c.isalpha()) for t in texts]
    got, kinds = lookalikes.normalized(pa.array(texts, pa.string()))
    for t, g, k in zip(texts, got.to_pylist(), kinds, strict=True):
        if t is None:
            assert g is None and k == 0
            continue
        plain = by_row(t)
        assert unicodedata.normalize("NFC", g) == unicodedata.normalize("NFC", plain) or any(c in "ıɑɡ" or "ƀ" <= c for c in t)
        assert bool(k) or g == t


@pytest.mark.parametrize(
    ("text", "form", "kinds"),
    [
        ("ａｍｂｅｒ　ｔｅｓｔ", "amber test", 1), ("café ȩ́", "café ȩ́", 2), ("sl​ow﻿", "slow", 4), ("Por\xa0três", "Por três", 8), ("thе quiеt", "the quiet", 16), ("Νο frοzen", "No frozen", 16), ("ѕо аѕ the", "so as the", 16),
        ("нoвoй пpoвepки", "новой проверки", 16), ("Kınobrind ɑnd", "Kinobrind and", 16), ("WORKSНOР", "WORKSHOP", 16), ("Δt = 1, λ and π", "Δt = 1, λ and π", 0), ("Сам он", "Сам он", 0), ("nº 5 ½", "nº 5 ½", 0), ("𝐇𝐞𝐥𝐥𝐨 𝒲𝑜𝓇𝓁𝒹", "Hello World", 16), ("𝟏𝟐 𝕏 = 𝑥", "12 X = x", 0), ("a\U000e0041b", "ab", 4), ("𐐀𐐨 𠀋 😀", "𐐀𐐨 𠀋 😀", 0), ("הספר Tirutox", "הספר Tirutox", 0), ("", "", 0),
    ],
)
def test_forms(text, form, kinds):
    got, k = lookalikes.normalized(pa.array([text, None, text]))
    assert got.to_pylist() == [form, None, form] and k.tolist() == [kinds, 0, kinds]


def test_form_tables(spark):
    df = spark.createDataFrame([(1, "thе", 0), (2, None, 0), (3, "", 0), (1, "thе", 0), (4, "Ã\xa0 la", 0), (5, "x" * 40_000 + "е", 0)], "id long, t string, kinds int")
    found = lookalikes.look_alike(df, "id", "t")
    assert sorted((r["rec_id"], r["kinds"]) for r in found.collect()) == [(1, 16), (1, 16), (4, 8), (5, 16)]
    assert sorted(r["rec_id"] for r in encoding.garbled_rows(found, "text", False).collect()) == [1, 1, 5]
    assert sorted(r["rec_id"] for r in encoding.garbled_rows(found, "text").collect()) == [4]
    assert [r["text"] for r in lookalikes.one_form(df, "id", "t").where("rec_id = 2").collect()] == [None]
    assert lookalikes.one_form(df.limit(0), "id", "t").count() == 0 and lookalikes.look_alike(df.limit(0), "id", "t").count() == 0
    sliced = pa.array(["zz", "ａb", None, "ｃ"]).slice(1)
    assert lookalikes.normalized(sliced)[0].to_pylist() == ["ab", None, "c"]


# pairs


@pytest.mark.parametrize(
    ("query", "text", "want"),
    [
        ("The old pump", None, ["empty"]), ("The old pump", " … ", ["empty"]), ("The old pump", "​", ["empty"]), ("The old pump", '"The OLD pump!"', ["copy"]), ("The old pump", "the old pump The old pump", ["copy"]),
        ("The old pump", "I'm sorry, but I can't help with that.", ["refusal"]), ("El niño", "El niño: Por desgracia, no me es posible continuar el texto.", ["refusal"]), ("Der Weg", "Leider darf ich diesen Text nicht fortsetzen.", ["refusal"]),
        ("The old pump", "The old pump moved on and said sorry.", []), ("The old pump", "The old pump moved but cannot help the driver.", []), ("The old pump", "The old pump préfère une réponse brève malgré la chaleur.", ["other_language"]),
        ("Тихий сад", "Тихий сад хранит ответы.", []), ("Тихий сад", "The garden keeps the answers of its owner.", ["other_language"]), ("La página número dos de X", "La página número dos de X cerró después del café.", []),
        ("The old pump", "The old pump moved the", ["truncated"]), ("The old pump", "The old pump moved,", ["truncated"]), ("The old pump", "The old pump moved on (see the notes", ["truncated"]), ("The old pump", 'The old pump said "no', ["truncated"]),
        ("The old pump", "The old pump moved slowly (see the notes).", []), ("The old pump", "The old pump moved slowly", []), ("", "Some text.", []), (None, "Some text.", []),
    ],
)
def test_defects(query, text, want):
    assert pairs.defects(query, text, 50, 40, None) == want


def test_broken_words():
    assert pairs.defects("The pump", "The pump moved slo", 0, 0, True) == ["truncated"]
    assert pairs.defects("The pump", "The pump moved the bright", 900, 1, None) == ["truncated"]
    assert pairs.defects("The pump", "The pump met Zorblax", 0, 0, None) == []


@pytest.mark.parametrize(
    ("query", "text", "want"),
    [
        ("Kloteli harbor", "Каждая строка ждёт новой проверки.", ["other_language"]), ("Kloteli harbor", "Kloteli harbor הספר הישן שומר את התשובות.", ["other_language"]), ("Каждая строка", "pumps moved quickly.", ["other_language"]),
        ("Kloteli harbor", "Kloteli harbor pumps moved quickly.", []), ("Kloteli", "Kloteli ждёт новой проверки.", []), ("Каждая строка", "Каждая строка Gudeplur.", []),
    ],
)
def test_scripts_tell_without_small_words(query, text, want):
    assert pairs.defects(query, text, 50, 40, None) == want


@pytest.mark.parametrize("scale", [1, 10, 100])
def test_broken_words_at_any_size(scale):
    """A piece with stray uses is a piece, a word with ends is sound, however large the table."""
    assert pairs.defects("The pump", "The pump moved in the mir", scale, 0, 300 * scale) == ["truncated"]
    assert pairs.defects("The pump", "The pump moved the key", 80 * scale, 9 * scale, 300 * scale) == []
    assert pairs.defects("The pump", "The pump moved the quest", 3 * scale, 2 * scale, 300 * scale) == []


@pytest.mark.parametrize("copies", [1, 8, 40])
def test_words_of_other_languages_do_not_count(spark, copies):
    """'mir' is a German word, and a piece of 'mirror' in English."""
    known = ["The pump is behind the mirror.", "The mirror was in the old house.", "Der alte Tisch ist von mir und der Frau.", "Das war nicht von mir."]
    rows = [(9, 1, "The old pump was seen in the mir"), (9, 2, "Der neue Stuhl ist nicht von mir"), *((8, k, t) for k, t in enumerate(known * copies))]
    req = spark.createDataFrame([(1, 0, "The old pump", "AI", 3)], "request_id long, attempt int, query string, mode string, max_results long")
    resp = spark.createDataFrame([(9, 1, None)], "response_id long, request_id long, error string")
    sug = spark.createDataFrame(rows, "response_id long, rank_no int, text string")
    got = {tuple(r) for r in pairs.defective(req, resp, sug).collect()}
    assert got == {(9, 1, "truncated"), (9, 2, "other_language")}


def test_defective_table(spark):
    req = spark.createDataFrame([(1, 1, "old", "CORPUS", 5), (1, 2, "The pump", "AI", 0), (2, 1, "The pump", "AI", 6), (3, 1, None, "AI", 1), (4, 1, "The pump", "AI", None), (5, 1, "The pump", "CORPUS", 1), (6, 1, "The pump", "AI", 5)], "request_id long, attempt int, query string, mode string, max_results long")
    res = spark.createDataFrame([(10, 1, None), (20, 2, "too many"), (30, 3, "blank"), (40, 4, "request was turned down"), (50, 5, None), (60, 6, "timed out"), (None, 1, None)], "response_id long, request_id long, error string")
    sug = spark.createDataFrame([(10, 1, "The pump."), (10, 2, None), (10, 3, "The pump moved."), (50, 1, None), (99, 1, None)], "response_id long, rank_no int, text string")
    got = sorted(tuple(r) for r in pairs.defective(req, res, sug).collect())
    assert got == [(10, 1, "copy"), (10, 2, "empty"), (40, 0, "refusal"), (60, 0, "empty")]
    assert pairs.defective(req.limit(0), res.limit(0), sug.limit(0)).count() == 0


# leaks


def test_alignment_against_definition():
    rng = random.Random(3)

    def score(a, b):
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        r = np.zeros_like(h)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                s = leaks.MATCH if a[i - 1] == b[j - 1] else leaks.MISMATCH
                h[i, j] = max(0, h[i - 1, j - 1] + s, h[i - 1, j] + leaks.GAP, h[i, j - 1] + leaks.GAP)
                r[i, j] = r[i - 1, j - 1] + 1 if s > 0 else 0
        return h.max(), r.max()

    some = [([rng.randrange(4) for _ in range(rng.randint(1, 12))], [rng.randrange(4) for _ in range(rng.randint(1, 20))]) for _ in range(80)]
    scores, runs = leaks.align([np.array(a) for a, _ in some], [np.array(b) for _, b in some])
    assert list(zip(scores, runs, strict=True)) == [score(a, b) for a, b in some]


def test_leaks(spark):
    rng = random.Random(9)
    items = [" ".join(f"t{rng.randrange(300)}" for _ in range(30)) for _ in range(8)]
    docs, want = [], set()
    for d in range(60):
        w = [f"t{rng.randrange(300)}" for _ in range(80)]
        if d % 3 == 0:
            i, n = rng.randrange(8), rng.choice([12, 13, 20])
            s = rng.randrange(30 - n + 1)
            w[20 : 20 + n] = items[i].split()[s : s + n]
            if n >= 13:
                want.add((d, i))
        docs.append((d, "\r\n> ".join(", ".join(w[k : k + 7]).upper() for k in range(0, 80, 7)), 1))
    docs += [(100, None, 1), (101, "", 1), (None, docs[0][1], 1)]
    df = spark.createDataFrame(docs, "id long, t string, item_id int")
    it = spark.createDataFrame([*enumerate(items), (50, None), (51, ""), (52, "too short")], "iid long, it string")
    got = {tuple(r) for r in leaks.leaked_passages(df, "id", "t", it, "iid", "it").collect()}
    brute = set()
    for d, t, _ in docs[:60]:
        words = " ".join(leaks.words_of(t))
        for i, x in enumerate(items):
            k = x.split()
            if any(f" {' '.join(k[s : s + 13])} " in f" {words} " for s in range(18)):
                brute.add((d, i))
    assert got == brute and want <= got
    assert leaks.leaks(df.limit(0), "id", "t", it, "iid", "it").count() == 0 and leaks.leaks(df, "id", "t", it.limit(0), "iid", "it").count() == 0


def test_full_bitmap_loses_nothing(spark, monkeypatch):
    """With far too few bits everything passes, and the result is the same."""
    rng = random.Random(5)
    items = [(i, " ".join(f"t{rng.randrange(90)}" for _ in range(20))) for i in range(30)]
    docs = [(d, " ".join(f"t{rng.randrange(90)}" for _ in range(15)) + " " + items[d % 30][1]) for d in range(40)]
    tables = spark.createDataFrame(docs, "d long, t string"), "d", "t", spark.createDataFrame(items, "i long, t string"), "i", "t"
    want = sorted(tuple(r) for r in leaks.leaks(*tables).collect())
    monkeypatch.setattr(leaks, "LEAST_BITS", 64)
    monkeypatch.setattr(leaks, "MOST_BITS", 64)
    assert sorted(tuple(r) for r in leaks.leaks(*tables).collect()) == want and len(want) >= 40


def test_passage_with_any_four_words_left_whole(spark):
    words = [f"w{i}" for i in range(48)]
    docs = [(k, " ".join(w if k <= i < k + 4 or i % 3 else f"x{i}" for i, w in enumerate(words))) for k in range(45)]
    got = leaks.leaks(spark.createDataFrame(docs, "d long, t string"), "d", "t", spark.createDataFrame([(7, " ".join(words))], "i long, t string"), "i", "t").collect()
    assert sorted(r["doc_id"] for r in got) == list(range(45)) and all(r["item_id"] == 7 and r["score"] >= 45 for r in got)


def edited(rng, words, every, kind):
    """One word in so many changed, left out or doubled by another one."""
    out = []
    for i, w in enumerate(words):
        other = f"z{rng.randrange(9999)}"
        out += [w] if i % every else {"changed": [other], "left out": [], "put in": [other, w]}[kind]
    return out


@pytest.mark.parametrize("every", [8, 6, 5])
def test_recall_by_rate_of_edits(spark, every):
    rng = random.Random(every)
    items = [[f"v{rng.randrange(400)}" for _ in range(rng.randint(26, 60))] for _ in range(60)]
    docs = [(n, " ".join(["start", *edited(rng, w, every, kind), "end"])) for n, (w, kind) in enumerate((w, k) for w in items for k in ("changed", "left out", "put in"))]
    got = leaks.leaks(spark.createDataFrame(docs, "d long, t string"), "d", "t", spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "i long, t string"), "i", "t").collect()
    assert {(n, n // 3) for n in range(180)} <= {(r["doc_id"], r["item_id"]) for r in got}


def test_edited_passage(spark):
    item = "the narrow readers of the old diagram approved that urban engineer separately after the late owner claimed every orchard"
    edited = item.replace("urban", "rural").replace("late ", "")
    df = spark.createDataFrame([(1, f"before it {edited} and after"), (2, "nothing of it here")], "id long, t string")
    rows = leaks.leaks(df, "id", "t", spark.createDataFrame([(7, item)], "i long, x string"), "i", "x").collect()
    assert [(r["doc_id"], r["item_id"]) for r in rows] == [(1, 7)] and rows[0]["longest_run"] < 13 and rows[0]["score"] >= 2 * 17 - 2


# personal data

NOTE = """Hello João M. Tavares,

Call +44 20 7946 0593 or (202) 555-0157, not 192.0.2.29. Install pump@7.3.8 and call @reader_valve.
Passport No.: XQ2954725 and SSN 934-84-5277; Route 35-1800-58B, build 4.30.532 of 2034-10-24.
We moved to Flat 24, 174 Vukosond Gardens, Sobrizur. The Ropite Street receipt is old.
| Anna de Vries | anna.vries+x [at] mail [dot] vries [dot] example | 01632 960402 |
Regards,
TAVARES, Ruth
Zebefaxgasse 53, 21218 Memopil
"""


FIRST = ["Adam", "Alice", "Anna", "Boris", "Clara", "Daniel", "Elena", "Emma", "Felix", "Grace", "Helen", "Hugo", "Ines", "Ivan", "Jane", "Karin", "Laura", "Lukas", "Maria", "Nadia", "Omar", "Paul", "Rosa", "Sofia"]


def corpus(rng, documents=400):
    """Texts with people, contact data, and many capitalised words and numbers that are none; and the places of the people."""
    out, people = [], []
    last = lambda: "".join(rng.choice(("ko", "ri", "ta", "lu", "ves", "mir", "don")) for _ in range(3)).title()
    for _ in range(documents):
        parts = []
        for _ in range(rng.randint(2, 6)):
            who, place, k = f"{rng.choice(FIRST)} {last()}", last(), rng.randrange(11)
            n = rng.randint(100, 999)
            named = k < 6
            parts.append([
                f"Dear {who},\nthe valve is old.", f"Please ask {who} whether it is so.", f"{who} wrote: the lamp was new.", f"Thanks,\n{who}\n", f"{who}\nT +44 20 7946 0{n}\n", f"Mail {who}, {place.lower()}@mail.example, soon.",
                f"The {place} line has Route {n} in it.", f"Das Haus ist in {place} Harbor, build {n}.30.532 of 2034-10-24.", f"Near the {place} Gardens Street they met.", f"Passport No.: XQ2954{n} and host 192.0.2.{n % 200}.", f"We moved to {n} {place} Street, {last()}. Call (202) 555-0{n}."][k])
            if named:
                people.append((len(out), sum(len(p) + 1 for p in parts[:-1]) + parts[-1].index(who)))
        out.append(" ".join(parts))
    return out, set(people)


def model_of(texts, first_names=personal.FIRST_NAMES):
    return personal.Model(Counter((k, v, s) for t in texts for k, _, _, v, s, _ in personal.candidates(t, first_names)))


def test_personal_spans():
    model = model_of(corpus(random.Random(2))[0] + [NOTE] * 20)
    got = [(k, NOTE[a:z]) for k, a, z in model.decide(personal.candidates(NOTE))]
    assert got == [
        ("name", "João M. Tavares"), ("phone", "+44 20 7946 0593"), ("phone", "(202) 555-0157"), ("id_number", "XQ2954725"), ("id_number", "934-84-5277"), ("address", "Flat 24, 174 Vukosond Gardens"),
        ("name", "Anna de Vries"), ("email", "anna.vries+x [at] mail [dot] vries [dot] example"), ("phone", "01632 960402"), ("name", "TAVARES, Ruth"), ("address", "Zebefaxgasse 53"),
    ]


@pytest.mark.parametrize(("text", "value"), [("call +442071234567 today", "+442071234567"), ("tel +4915112345678.", "+4915112345678"), ("Thanks,\nZorbina Kletterman\n", "Zorbina Kletterman"), ("a letter from Zorbina Kletterman", "Zorbina Kletterman"), ("Route 35 to 98 Kloteli", "98 Kloteli"), ("offset 12-345-678", "12-345-678")])
def test_candidates_are_broad(text, value):
    assert value in [text[c[1] : c[2]] for c in personal.candidates(text)]


@pytest.mark.parametrize("share", [0.0, 0.5])
def test_names_without_the_gazetteer(spark, share):
    """First names taken out of the list are found by what stands around them, and by where else they stand."""
    texts, people = corpus(random.Random(7))
    kept = frozenset(n for n in personal.FIRST_NAMES if n not in FIRST or random.Random(n).random() < share)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {(r["doc_id"], r["start_pos"]) for r in personal.personal_data(df, "id", "t", kept).where("kind = 'name'").collect()}
    assert len(got & people) >= 0.9 * len(people) and len(got & people) >= 0.95 * len(got)


def test_model_decides_otherwise_than_the_sum_of_votes():
    texts, _ = corpus(random.Random(4), 800)
    model, other = model_of(texts), 0
    for t in texts:
        other += sum((sum(v) > 0) != (model.probability(k, v, s) >= 0.5) for k, _, _, v, s, _ in personal.candidates(t))
    assert other > 50


def test_model_tells_votes_apart():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.4
    good = [np.where(rng.random(4000) < 0.9, np.where(truth, 1, -1), np.where(truth, -1, 1)) for _ in range(3)]
    noise = [rng.integers(-1, 2, 4000), np.zeros(4000, int)]
    counts = {}
    for v in zip(*good, *noise, strict=True):
        k = ("email", tuple(int(x) for x in v), (1, 2))
        counts[k] = counts.get(k, 0) + 1
    model = personal.Model(counts)
    guess = np.array([model.probability("email", tuple(int(x) for x in v), (1, 2)) > 0.5 for v in zip(*good, *noise, strict=True)])
    assert (guess == truth).mean() > 0.95
    assert model.probability("phone", (1, 1, 1, 1, 0), (0, 0)) == 0.0
    right = model.reliability["email"]
    assert all(0.85 < right[j, 2, 0] < 0.95 and 0.05 < right[j, 2, 1] < 0.15 for j in range(3)) and abs(right[3, 2, 0] - right[3, 2, 1]) < 0.1


def test_personal_tables(spark):
    texts, _ = corpus(random.Random(3), 150)
    rows = [(i, NOTE, "x") for i in range(6)] + [(7, None, "x"), (8, "", "x"), (None, NOTE, "x"), (9, "a " * 20_000 + "mail to x.y@mail.example today", "x"), (0, NOTE, "x")] + [(100 + i, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    got = personal.personal_data(df, "doc_id", "text").collect()
    assert {(r["kind"], r["start_pos"]) for r in got if r["doc_id"] == 0} >= {("email", NOTE.index("anna.vries")), ("phone", NOTE.index("+44"))}
    assert len([r for r in got if r["doc_id"] == 0]) == len([r for r in got if r["doc_id"] == 1])
    assert [(r["kind"], r["start_pos"]) for r in got if r["doc_id"] == 9] == [("email", 40_008)]
    red = {r["doc_id"]: r for r in personal.redacted(df, "doc_id", "text").collect()}
    assert red[9]["text"].endswith("mail to [EMAIL] today") and "[PHONE] or [PHONE], not 192.0.2.29" in red[0]["text"] and red[8]["text"] == "" and 7 not in red
    assert personal.personal_data(df.limit(0), "doc_id", "text").count() == 0 and personal.redacted(df.limit(0), "doc_id", "text").count() == 0
