"""The k best lines for a query, for one query and for many."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import Any

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.matching import SHORT_QUERY, Compiled, any_pattern, gate, may_match, score
from ..functions.text import displayed, logged, normalize, normalize_text
from ..logs import logger

DEFAULT_K = 5
RESULT = "completed_sentence string, source_text string, offset int, score int"


def _order() -> list:
    return [F.col("score").desc(), F.col("completed_sentence").asc(), F.col("source_text").asc(), F.col("offset").asc()]


def matches(sentences: DataFrame, query: str, strict_recall: bool = False) -> DataFrame:
    """All lines that match a query with at most one edit, with their scores (which may be negative).

    ``(completed_sentence, source_text, offset, score)``. Only what a match needs is searched for in every line; the
    score's cascade runs on what is left.
    """
    q = normalize_text(query)
    if not q:
        return sentences.sparkSession.createDataFrame([], RESULT)
    line = F.col("normalized_text")
    held = sentences.where(may_match(q, line, strict_recall))
    if len(q) > 1:
        held = held.where(line.rlike(any_pattern(q)))
    found = held.withColumn("score", score(q, line)).where(F.col("score").isNotNull())
    return found.select(F.col("original_text").alias("completed_sentence"), F.col("source_path").alias("source_text"), F.col("offset").cast("int").alias("offset"), "score")


def best_completions(sentences: DataFrame, query: str, k: int = DEFAULT_K, strict_recall: bool = False, staged: bool = False) -> DataFrame:
    """The ``k`` best lines for a query: by score, then text by code point, then path and line number.

    Each task keeps its own k best (``TakeOrderedAndProject``). Fewer matches give fewer rows; a query that normalizes to
    nothing gives none. ``staged`` first looks for the query as it stands: such lines score above all others, so if there
    are k of them nothing else need be searched. That stage runs at once and brings at most k rows to the driver.
    """
    q = normalize_text(query)
    logger("completion").info("query %r", logged(query))
    if staged and q:
        exact = best_completions(sentences.where(F.col("normalized_text").contains(q)), query, k)
        rows = exact.collect()
        if len(rows) >= k:
            return sentences.sparkSession.createDataFrame(rows, exact.schema)
    return matches(sentences, query, strict_recall).orderBy(*_order()).limit(k)


def observed_completions(sentences: DataFrame, query: str, k: int = DEFAULT_K) -> tuple[DataFrame, Observation]:
    """``best_completions`` and an observation of ``candidates`` and ``verified`` lines, filled once the rows are read."""
    q = normalize_text(query)
    seen = Observation("completion")
    line = F.col("normalized_text")
    checked = sentences.where(gate(q, line)).withColumn("score", score(q, line))
    checked = checked.observe(seen, F.count(F.lit(1)).alias("candidates"), F.count("score").alias("verified"))
    rows = checked.where(F.col("score").isNotNull()).select(F.col("original_text").alias("completed_sentence"), F.col("source_path").alias("source_text"), F.col("offset").cast("int").alias("offset"), "score")
    return rows.orderBy(*_order()).limit(k), seen


def display_order_columns() -> list:
    """What results are shown in the order of, ascending."""
    return [(-F.col("score")).alias("_1"), F.lower("completed_sentence").alias("_2"), F.col("completed_sentence").alias("_3"), F.col("source_text").alias("_4"), F.col("offset").alias("_5")]


def display_order(results: DataFrame, most: int = DEFAULT_K) -> DataFrame:
    """The rows as they are shown, with ``rank`` from 1: by score, then text regardless of case, then as they were chosen.

    For the few rows of one query. ``most`` 0 means the default.
    """
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("score").desc(), F.lower("completed_sentence").asc(), F.col("completed_sentence").asc(), F.col("source_text").asc(), F.col("offset").asc())
    ranked = results.orderBy(*_order()).limit(DEFAULT_K).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= (most or DEFAULT_K))


def suggestion_lines(shown: DataFrame) -> DataFrame:
    """One numbered line of output per shown row."""
    text = F.format_string("%d. %s (%s:%d, score=%d)", "rank", displayed(F.col("completed_sentence")), "source_text", "offset", "score")
    return shown.select("rank", text.alias("line"))


#: Queries that one pass over the lines carries.
BLOCK = 20_000


class _Queries:
    """A block of queries, found together in a line: all texts of which a match needs one, in one automaton."""

    def __init__(self, queries: list[str], k: int) -> None:
        self.queries, self.k = queries, k
        self.compiled = [Compiled(q) for q in queries]
        needed: dict[str, list[int]] = {}
        for n, c in enumerate(self.compiled):
            # one edit leaves one half whole; short queries need one of their trigrams, or stand as they are
            for part in dict.fromkeys(c.halves if len(c.query) > SHORT_QUERY else c.gates):
                needed.setdefault(part, []).append(n)
        self.needed = needed
        self.search = ahocorasick.Automaton()
        for part, of in needed.items():
            self.search.add_word(part, of)
        if needed:
            self.search.make_automaton()

    def best(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k best of a task's lines for each query."""
        held: list[list[tuple[int, str, str, int]]] = [[] for _ in self.queries]
        for b in batches:
            for line, text, path, offset in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found: set[int] = set()
                for _, of in self.search.iter(line or "") if self.needed else ():
                    found.update(of)
                for n in found:
                    s = self.compiled[n].score(line)
                    if s is not None:
                        held[n].append((-s, text, path, offset))
                        if len(held[n]) > 64 + 4 * self.k:
                            held[n] = sorted(held[n])[: self.k]
        rows = [(self.queries[n], *r) for n, h in enumerate(held) for r in sorted(h)[: self.k]]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["_q", "_minus", "completed_sentence", "source_text", "offset"])


def batch_completions(sentences: DataFrame, queries: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """The ``k`` best lines for every row ``(query_id, query)``: ``(query_id, rank, completed_sentence, ...)``.

    The stated queries go to the lines, in blocks of ``BLOCK`` different ones, and every block is one pass: an automaton finds
    the queries of which a line holds what any match needs, the compiled query scores it, and a task keeps k lines of each.
    Only those are moved; lines that very many queries meet, or the other way round, cost time where they are and nothing
    else. A null query or one that normalizes to nothing has no rows; queries are told apart by their id.
    """
    spark = sentences.sparkSession
    asked = queries.where(F.col("query").isNotNull()).select("query_id", normalize(F.col("query")).alias("_q")).where(F.col("_q") != "")
    texts = sorted(r[0] for r in asked.select("_q").distinct().collect())  # what is asked, not what is searched
    lines = sentences.select("normalized_text", "original_text", "source_path", F.col("offset").cast("int"))
    schema = "_q string, _minus int, completed_sentence string, source_text string, offset int"
    found = [spark.createDataFrame([], schema)]
    for n in range(0, len(texts), BLOCK):
        block = spark.sparkContext.broadcast(texts[n : n + BLOCK])

        def run(batches: Iterator[pa.RecordBatch], block: Any = block) -> Iterator[pa.RecordBatch]:
            yield from _Queries(block.value, k).best(batches)

        found.append(lines.mapInArrow(run, schema))
    rows = reduce(DataFrame.unionByName, found).withColumn("score", -F.col("_minus"))
    own = Window.partitionBy("_q").orderBy(*_order())
    best = rows.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
    return asked.join(best, "_q").select("query_id", "rank", "completed_sentence", "source_text", "offset", "score")
