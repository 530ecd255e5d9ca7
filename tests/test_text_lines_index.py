import random
import re
import sys

import pytest
from pyspark.sql import functions as F

from quillspan.functions import text as t
from quillspan.operators import index as ix
from quillspan.operators import legacy, lines
from quillspan.sources.archive import ZipTextSource, from_documents, read_folder, read_zip


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("raw", "expected"),
    [("don't", "dont"), ("state-of-the-art", "stateoftheart"), ("hello,world", "helloworld"), ("be, that", "be that"), ("e.g.", "eg"), ("a\tb", "ab"), ("  A   b ", "a b"), ("...", ""), ("", ""), ("Ünï 1", "n 1")],
)
def test_normalize(spark, raw, expected):
    assert one(spark, t.normalize, raw) == expected == t.normalize_text(raw)


def test_normalize_every_character(spark):
    chars = [chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    got = spark.createDataFrame([(c,) for c in chars], "c string").select("c", t.normalize(F.concat(F.lit("x"), F.col("c"), F.lit("y"))).alias("n")).collect()
    assert all(r["n"] == t.normalize_text(f"x{r['c']}y") for r in got)


def test_trigrams(spark):
    assert one(spark, t.trigrams, "to be") == ["to ", "o b", " be"] == t.trigrams_of("to be")
    assert one(spark, t.trigrams, "to") == []


def test_blank_and_separators(spark):
    spaces = [chr(c) for c in range(sys.maxunicode) if not 0xD800 <= c < 0xE000 and chr(c).isspace()]
    assert all(re.fullmatch(t.BLANK.replace("^", "").replace("$", "").replace(r"\u", "\\u"), c) for c in spaces)
    text = "a\r\nb\nc\rd\x0be\x0cf\x1cg\x1dh\x1ei\x85j k l\n\n 　\nm"
    df = spark.createDataFrame([(text, "x.txt", 0)], "text string, source_path string, file_ord long")
    got = {r["offset"]: r["original_text"] for r in lines.raw_lines(df).collect()}
    assert got == {i: v for i, v in enumerate(text.splitlines()) if v.strip()}


def test_display(spark):
    assert one(spark, t.displayed, "　 \tx ") == "x "
    assert one(spark, t.displayed_clean, "﻿ ​x") == "x"
    assert t.logged("a\nb\r" + "x" * 300) == "a\\nb\\r" + "x" * 196


def test_legacy_clean(spark):
    assert one(spark, t.legacy_clean, "  Hi,\t(you)  Über-x! ") == "hi you überx"


def test_zip(spark, archive):
    path = archive({"top.txt": "line one\n\n   \nline two\n", "sub/nested.TXT": "x", "sub/deeper/n2.txt": b"caf\xe9 line\n", "image.png": b"\x00", "d.txt.bak": "no"})
    rows = lines.sentences(read_zip(spark, path)).orderBy("file_ord", "offset").collect()
    assert [(r["original_text"], r["source_path"], r["offset"]) for r in rows] == [("line one", "top.txt", 0), ("line two", "top.txt", 3), ("x", "sub/nested.TXT", 0), ("café line", "sub/deeper/n2.txt", 0)]
    assert ZipTextSource.name() == "zip_text" and read_zip(spark, path).rdd.getNumPartitions() == 1
    archive({"z.txt": "last"}, "more.zip")
    several = read_zip(spark, path.replace("corpus.zip", "*.zip"), 10)
    assert several.rdd.getNumPartitions() == 4 and [r["source_path"] for r in several.orderBy("file_ord").collect()] == ["top.txt", "sub/nested.TXT", "sub/deeper/n2.txt", "z.txt"]


def test_empty_zip(spark, archive):
    assert read_zip(spark, archive({"a.png": b"x"})).count() == 0


def test_folder(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_bytes(b"\xef\xbb\xbfbom\n")
    (tmp_path / "in" / "deep" / "b.TXT").write_bytes(b"caf\xe9")
    (tmp_path / "in" / "c.md").write_text("no")
    got = {r["source_path"]: r["text"] for r in read_folder(spark, str(tmp_path / "in")).collect()}
    assert got == {"a.txt": "﻿bom\n", "deep/b.TXT": "café"}
    for n in range(40):
        (tmp_path / "in" / f"n{n}.txt").write_text("x")
    rows = read_folder(spark, str(tmp_path / "in")).select("source_path", "file_ord").orderBy("file_ord").collect()
    assert [r["file_ord"] for r in rows] == list(range(42)) and [r["source_path"] for r in rows] == sorted(r["source_path"] for r in rows)


def test_numbers_are_dense_and_ordered(spark):
    docs = spark.createDataFrame([(i, f"l{i}\n\nm{i}\n", "s") for i in range(50)], "doc_id long, text string, source string")
    rows = lines.numbered(from_documents(docs)).orderBy("sentence_id").collect()
    assert [r["sentence_id"] for r in rows] == list(range(100))
    assert [(r["file_ord"], r["offset"]) for r in rows] == sorted((r["file_ord"], r["offset"]) for r in rows)
    assert lines.numbered(from_documents(docs.limit(0))).count() == 0


def test_index(spark, sentences):
    rows = sentences(["asymmetric warfare requires careful planning.", "hello world", "unrelated line", "hello there world", "...", "hello"])
    words, grams = ix.word_pairs(rows), ix.trigram_pairs(rows)
    lists = {r["word"]: r["ids"] for r in ix.postings(words, "word").collect()}
    assert lists["hello"] == [1, 3, 5] and "" not in lists
    assert {r["trigram"]: r["lines"] for r in ix.posting_sizes(grams, "trigram").collect()}["hel"] == 3
    assert sorted(r[0] for r in ix.word_candidates(words, "hello").collect()) == [1, 3, 5] and ix.word_candidates(words, "hell").isEmpty()
    assert {r[0] for r in ix.trigram_candidates(grams, "metric").collect()} == {0} and ix.trigram_candidates(grams, "he").isEmpty()
    vocab = ix.vocabulary(rows)
    assert ix.contains_word(vocab, "there") and not ix.contains_word(vocab, "ther")
    assert {r[0] for r in ix.words_containing(vocab, "ell").collect()} == {"hello"} and ix.words_containing(vocab, "").count() == vocab.count()
    assert tuple(ix.index_counts(rows).first())[:2] == (6, 10)
    assert {r[0] for r in ix.candidates(rows, "ell").collect()} == {1, 3, 5}
    assert {r[0] for r in ix.candidates(rows, "helo xorld").collect()} >= {1, 3, 5} and ix.candidates(rows, "").isEmpty()
    assert ix.lookup(rows, ix.word_candidates(words, "hello")).count() == 3
    with pytest.raises(ValueError):
        ix.short_query_candidates(grams, words, "sixsix")


@pytest.mark.parametrize(("word", "hit"), [("pythxn", True), ("pythonn", True), ("pyton", True), ("python", True), ("pyxyn", False)])
def test_fuzzy(spark, word, hit):
    vocab = spark.createDataFrame([("python",), ("java",), ("rust",)], "word string")
    assert [r[0] for r in ix.fuzzy_lookup(vocab, word).collect()] == (["python"] if hit else [])


def test_save_load_cache(spark, archive, tmp_path, capsys):
    path, cache = archive({"a.txt": "hello world\nfoo"}), str(tmp_path / "cache")
    a = ix.CorpusIndex.load_or_build(spark, path, cache)
    assert a.sentences.count() == 2 and a.words.count() == 3 and a.vocabulary.count() == 3
    b = ix.CorpusIndex.load_or_build(spark, "/does/not/exist.zip", cache)
    assert sorted(b.sentences.collect()) == sorted(a.sentences.collect())
    assert [r["original_text"] for r in b.sentence(1).collect()] == ["foo"]
    assert {r[0] for r in b.candidates("hello").collect()} == {0}
    assert tuple(b.counts().first()) == tuple(ix.index_counts(b.sentences).first()) == (2, 3, 10)
    assert ix.build_and_report(spark, path)["sentences"] == 2
    capsys.readouterr()
    assert ix.main([path], spark) == 0 and "2 sentences, 3 words, 10 trigrams" in capsys.readouterr().out and ix.main([]) == 2


def test_stored_index_equals_lines(spark, archive, tmp_path):
    rng = random.Random(5)
    words = ["harbor", "quiet", "lantern", "of", "the", "a", "bridge", "moved", "hqrbor"]
    path = archive({f"{n}.txt": "\n".join(" ".join(rng.choice(words) for _ in range(5)) for _ in range(30)) for n in range(4)})
    stored = ix.CorpusIndex.load_or_build(spark, path, str(tmp_path / "i"))
    for q in ("harbor of", "harxor of", "ridg", "the quet", "zz", "of", "lanternn brid", "a b", "xqz wvk", ""):
        want = sorted(r[0] for r in ix.candidates(stored.sentences, q).collect())
        assert sorted(r[0] for r in stored.candidates(q).collect()) == want, q
    both = ix.intersected(ix.word_candidates(stored.words, "harbor"), ix.word_candidates(stored.words, "the"))
    assert sorted(r[0] for r in both.collect()) == sorted(r["sentence_id"] for r in stored.sentences.collect() if {"harbor", "the"} <= set(r["normalized_text"].split()))


def test_legacy_index(spark):
    df = spark.createDataFrame([("The cat sat\n\nthe dog!\n", "d/a.txt", 0), ("the cat sat", "b.txt", 1), ("x", "c.TXT", 2)], "text string, source_path string, file_ord long")
    rows = lines.legacy_lines(df)
    assert sorted((r["file"], r["offset"], r["sentence"]) for r in rows.collect()) == [("a.txt", 0, "the cat sat"), ("a.txt", 12, ""), ("a.txt", 13, "the dog"), ("b.txt", 0, "the cat sat")]
    assert {r["sentence"]: r["offsets"] for r in legacy.file_offsets(rows).collect()}["the cat sat"] == {"a.txt": [0], "b.txt": [0]}
    assert {r["sentence"]: r["score"] for r in legacy.prefix_matches(rows, "the cet").collect()} == {"the cat sat": 14 - 4}
    assert {r["sentence"]: r["score"] for r in legacy.prefix_matches(rows, "thee do").collect()} == {"the dog": 14}
    assert legacy.prefix_matches(rows, "").count() == 4
