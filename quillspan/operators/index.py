"""Index tables - words, trigrams, vocabulary - and the ways to look candidates up in them."""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.matching import SHORT_QUERY
from ..functions.text import normalize_text, trigrams, trigrams_of, words
from ..sources.archive import read_zip
from ..storage import exists
from . import lines as _lines

#: Words that a short query may stand in for them to be looked up by name; beyond that the table is searched.
MOST_WORDS = 1000
TABLES = ("sentences", "word_postings", "trigram_postings", "vocabulary")


def word_pairs(sentences: DataFrame) -> DataFrame:
    """``(word, sentence_id)``, once per line."""
    return sentences.select(F.explode(F.array_distinct(words(F.col("normalized_text")))).alias("word"), "sentence_id")


def trigram_pairs(sentences: DataFrame) -> DataFrame:
    """``(trigram, sentence_id)``, once per line."""
    return sentences.select(F.explode(F.array_distinct(trigrams(F.col("normalized_text")))).alias("trigram"), "sentence_id")


def postings(pairs: DataFrame, key: str, span: int = 1 << 20) -> DataFrame:
    """``(key, part, ids)`` with sorted distinct ids. A part covers ``span`` ids, so no list holds more than that, and a key
    that most lines have is spread over as many rows as it needs."""
    part = F.floor(F.col("sentence_id") / span).cast("long").alias("part")
    return pairs.groupBy(key, part).agg(F.sort_array(F.collect_set("sentence_id")).alias("ids"))


def posting_sizes(pairs: DataFrame, key: str) -> DataFrame:
    """``(key, lines, first_id)``: in how many lines a key occurs, and the first of them; combined before the shuffle."""
    return pairs.groupBy(key).agg(F.count(F.lit(1)).alias("lines"), F.min("sentence_id").alias("first_id"))


def vocabulary(sentences: DataFrame) -> DataFrame:
    return sentences.select(F.explode(words(F.col("normalized_text"))).alias("word")).distinct()


def index_counts(sentences: DataFrame) -> DataFrame:
    """One row: ``sentences``, ``words``, ``trigrams``. One pass over the lines: words and trigrams leave them together, each
    with a mark, and are made distinct in the tasks before the shuffle."""
    line = F.col("normalized_text")
    own, lines = F.array(F.lit("")), F.lit("l")
    parts = F.array(F.struct(lines.alias("of"), own.alias("values")), F.struct(F.lit("w").alias("of"), F.array_distinct(words(line)).alias("values")), F.struct(F.lit("t").alias("of"), F.array_distinct(trigrams(line)).alias("values")))
    flat = sentences.select(F.explode(parts).alias("_p")).select("_p.of", F.explode("_p.values").alias("value"))
    per = flat.groupBy("of", "value").agg(F.count(F.lit(1)).alias("n"))
    count = lambda kind: F.sum(F.when(F.col("of") == kind, F.col("n") if kind == "l" else 1).otherwise(0)).cast("long")
    return per.agg(*(F.coalesce(count(k), F.lit(0)).alias(name) for k, name in (("l", "sentences"), ("w", "words"), ("t", "trigrams"))))


def word_candidates(pairs: DataFrame, word: str) -> DataFrame:
    """Ids of the lines that hold a word. Over a stored table only the word's own rows are read."""
    return pairs.where(F.col("word") == word).select("sentence_id")


def trigram_candidates(pairs: DataFrame, text: str) -> DataFrame:
    """Ids of the lines that hold any trigram of a text."""
    return pairs.where(F.col("trigram").isin(trigrams_of(text))).select("sentence_id").distinct()


def intersected(first: DataFrame, *more: DataFrame) -> DataFrame:
    """Ids that are in all of several lookups, once each."""
    return reduce(lambda a, b: a.join(b, "sentence_id", "left_semi"), more, first.distinct())


def contains_word(vocab: DataFrame, word: str) -> bool:
    return not vocab.where(F.col("word") == word).limit(1).isEmpty()


def words_containing(vocab: DataFrame, part: str) -> DataFrame:
    """Words with a part anywhere; '' gives all."""
    return vocab.where(F.col("word").contains(part))


def fuzzy_lookup(vocab: DataFrame, word: str, max_edits: int = 1) -> DataFrame:
    """Words within so many edits, the word itself included, sorted."""
    return vocab.where(F.levenshtein("word", F.lit(word), max_edits) >= 0).orderBy("word")


def short_query_candidates(pairs: DataFrame, vocab_pairs: DataFrame, query: str) -> DataFrame:
    """Lines with a trigram of a query of at most five characters, or with a word that holds it."""
    if len(query) > SHORT_QUERY:
        raise ValueError(f"only for queries of at most {SHORT_QUERY} characters")
    return trigram_candidates(pairs, query).union(vocab_pairs.where(F.col("word").contains(query)).select("sentence_id")).distinct()


def _within_one(word: str) -> Callable[[Column], Column]:
    return lambda x: F.levenshtein(x, F.lit(word), 1) >= 0


def candidates(sentences: DataFrame, query: str, pairs: DataFrame | None = None, grams: DataFrame | None = None, vocab: DataFrame | None = None) -> DataFrame:
    """Ids of the lines a normalized query is checked against.

    Up to five characters: lines with a trigram of it or with a word that holds it. Longer ones: lines with a trigram of
    it, or with one of its words, or - for a word that no line has - with a word one edit away. ``pairs``, ``grams`` and
    ``vocab`` are stored index tables, all or none: with them only the rows of the query's keys are read. Without them the
    lines are searched in one pass; whether a word is unknown is a subquery of the same plan.
    """
    if not query:
        return sentences.select("sentence_id").limit(0)
    line, wanted, long = F.col("normalized_text"), list(dict.fromkeys(query.split())), len(query) > SHORT_QUERY
    if pairs is not None and grams is not None and vocab is not None:
        by_trigram = grams.where(F.col("trigram").isin(trigrams_of(query))).select("sentence_id")
        if not long:
            held = [r[0] for r in vocab.where(F.col("word").contains(query)).limit(MOST_WORDS + 1).collect()]
            some = pairs.where(F.col("word").isin(held)) if len(held) <= MOST_WORDS else pairs.where(F.col("word").contains(query))
        else:
            known = {r[0] for r in vocab.where(F.col("word").isin(wanted)).collect()}  # of the query's words
            missing = [w for w in wanted if w not in known]
            near = reduce(lambda a, b: a | b, [F.levenshtein("word", F.lit(w), 1) >= 0 for w in missing], F.lit(False))
            close = vocab.where(near).select("word").distinct() if missing else vocab.select("word").limit(0)
            some = pairs.where(F.col("word").isin(wanted)).unionByName(pairs.join(close, "word", "left_semi").select(*pairs.columns))
        return by_trigram.unionByName(some.select("sentence_id")).distinct()
    found = reduce(lambda a, b: a | b, [line.contains(t) for t in trigrams_of(query)], F.lit(False))
    if not long:
        # a word holds a query without a space exactly if the line does
        return sentences.where(found | (line.contains(query) if " " not in query else F.lit(False))).select("sentence_id")
    padded = F.concat(F.lit(" "), line, F.lit(" "))
    has = {f"w{n}": padded.contains(f" {w} ") for n, w in enumerate(wanted)}
    known = sentences.agg(F.struct(*(F.coalesce(F.max(c), F.lit(False)).alias(n) for n, c in has.items()))).scalar()  # one pass for all words
    for (n, c), w in zip(has.items(), wanted, strict=True):
        found = found | c | ~known.getField(n) & F.exists(words(line), _within_one(w))
    return sentences.where(found).select("sentence_id")


def lookup(sentences: DataFrame, ids: DataFrame) -> DataFrame:
    """The lines of given ids."""
    return sentences.join(ids, "sentence_id", "left_semi")


class CorpusIndex:
    """Index tables over a sentences table; each is a plan, stored or not."""

    def __init__(self, sentences: DataFrame, words_table: DataFrame | None = None, trigram_table: DataFrame | None = None, vocab: DataFrame | None = None) -> None:
        self.sentences = sentences
        self.words = words_table if words_table is not None else word_pairs(sentences)
        self.trigrams = trigram_table if trigram_table is not None else trigram_pairs(sentences)
        self.vocabulary = vocab if vocab is not None else vocabulary(sentences)
        self._tables = (words_table, trigram_table, vocab)

    @classmethod
    def build(cls, files: DataFrame) -> CorpusIndex:
        return cls(_lines.numbered(files).drop("file_ord"))

    @classmethod
    def build_from_zip(cls, spark: SparkSession, path: str) -> CorpusIndex:
        return cls.build(read_zip(spark, path))

    def sentence(self, sentence_id: int) -> DataFrame:
        return self.sentences.where(F.col("sentence_id") == sentence_id)

    def candidates(self, query: str) -> DataFrame:
        return candidates(self.sentences, normalize_text(query), *self._tables)

    def counts(self) -> DataFrame:
        """One row: ``sentences``, ``words``, ``trigrams``; of stored tables, by their keys alone."""
        if self._tables[1] is None or self._tables[2] is None:
            return index_counts(self.sentences)
        parts = (self.sentences.agg(F.count(F.lit(1))), self.vocabulary.agg(F.count(F.lit(1))), self.trigrams.agg(F.countDistinct("trigram")))
        one = self.sentences.sparkSession.range(1)
        return one.select(*(p.scalar().alias(name) for p, name in zip(parts, ("sentences", "words", "trigrams"), strict=True)))

    def save(self, path: str, posting_tables: bool = True) -> None:
        """One Parquet table per part, on whatever file system: lines by number, posting lists by key - sorted, so that a lookup
        reads few row groups - and the vocabulary. Lists are cut by ranges of numbers, so none grows without bound."""
        spark = self.sentences.sparkSession
        self.sentences.write.mode("overwrite").parquet(f"{path}/sentences")
        if posting_tables:
            own = CorpusIndex(spark.read.parquet(f"{path}/sentences"))
            for name, key, pairs in (("word_postings", "word", own.words), ("trigram_postings", "trigram", own.trigrams)):
                lists = postings(pairs, key)
                lists.repartitionByRange(key, "part").sortWithinPartitions(key, "part").write.mode("overwrite").option("parquet.block.size", 8 << 20).parquet(f"{path}/{name}")
            spark.read.parquet(f"{path}/word_postings").select("word").distinct().write.mode("overwrite").parquet(f"{path}/vocabulary")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CorpusIndex:
        read = lambda t: spark.read.parquet(f"{path}/{t}") if exists(spark, f"{path}/{t}/_SUCCESS") else None
        pairs = lambda t, key: None if t is None else t.select(key, F.explode("ids").alias("sentence_id"))
        return cls(spark.read.parquet(f"{path}/sentences"), pairs(read("word_postings"), "word"), pairs(read("trigram_postings"), "trigram"), read("vocabulary"))

    @classmethod
    def load_or_build(cls, spark: SparkSession, zip_path: str, cache_path: str) -> CorpusIndex:
        """The stored index if it is whole, else a new one, stored; a stored one never touches the archive."""
        if not all(exists(spark, f"{cache_path}/{t}/_SUCCESS") for t in TABLES):
            cls.build_from_zip(spark, zip_path).save(cache_path)
        return cls.load(spark, cache_path)


def build_and_report(spark: SparkSession, zip_path: str) -> dict[str, float]:
    """Builds an index without storing it, prints and returns its counts and the seconds it took."""
    import time

    began = time.monotonic()
    row = CorpusIndex.build_from_zip(spark, zip_path).counts().first()
    out = {"sentences": row[0], "words": row[1], "trigrams": row[2], "seconds": time.monotonic() - began}
    print(f"{zip_path}: {out['sentences']} sentences, {out['words']} words, {out['trigrams']} trigrams, {out['seconds']:.2f} s")
    return out


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """``python -m quillspan.operators.index ARCHIVE``: what an archive's index would hold."""
    archives = list(sys.argv[1:] if argv is None else argv)
    for path in archives:
        build_and_report(spark or SparkSession.builder.getOrCreate(), path)
    return 0 if archives else 2


if __name__ == "__main__":
    raise SystemExit(main())
