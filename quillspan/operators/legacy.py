"""The older word-prefix search: lines whose first words each are within one edit of the query's words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Penalty at the first letter, what it falls by per letter, and the letter from which it stays.
REPLACED, REPLACED_STEP = 5, 1
SHIFTED, SHIFTED_STEP = 10, 2
LAST_STEP = 6


def file_offsets(lines: DataFrame) -> DataFrame:
    """``(sentence, offsets)``: equal sentences once, with a map from file to the sorted offsets in it. Two-level grouping."""
    per_file = lines.groupBy("sentence", "file").agg(F.sort_array(F.collect_list("offset")).alias("_o"))
    return per_file.groupBy("sentence").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("file", "_o")))).alias("offsets"))


def word_penalty(asked: str, word: Column) -> Column:
    """What one edit between a query word and a line's word costs, by the first letter in which they differ.

    None if they are equal or the longer one only has a letter more at its end.
    """
    a = F.lit(asked)
    n = F.least(F.length(a), F.length(word))
    first = F.lit(-1)
    for i in reversed(range(len(asked))):
        first = F.when((F.lit(i) < n) & (F.substring(word, i + 1, 1) != asked[i]), F.lit(i)).otherwise(first)
    steps = F.least(first, F.lit(LAST_STEP))
    same_length = F.length(word) == len(asked)
    cost = F.when(same_length, REPLACED - REPLACED_STEP * steps).otherwise(SHIFTED - SHIFTED_STEP * steps)
    return F.when(first < 0, F.lit(0)).otherwise(cost)


def prefix_matches(sentences: DataFrame, query: str) -> DataFrame:
    """The rows of ``(sentence, ...)`` that begin with the query's words, each within one edit, with ``score``.

    The score is twice the length of the query as typed, less the penalties of its words; every line is scored on its own.
    An empty query matches every line.
    """
    asked = query.split()
    split = F.filter(F.split("sentence", r"\s+"), lambda w: w != "")
    rows = sentences.withColumn("_w", split).where(F.size("_w") >= len(asked))
    total = F.lit(2 * len(query))
    for i, w in enumerate(asked):
        at = F.col("_w")[i]
        rows = rows.where(F.levenshtein(at, F.lit(w), 1) >= 0)
        total = total - word_penalty(w, at)
    return rows.withColumn("score", total.cast("int")).drop("_w")
