"""Lines of text files, the base table of everything else."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import LINE_SEP, is_blank, legacy_clean, normalize
from ..storage import stored


def raw_lines(files: DataFrame) -> DataFrame:
    """``(original_text, source_path, offset, file_ord)``: the lines of files that aren't blank.

    ``offset`` is the number of the line from 0, blank lines counted. Lines end where Python's ``splitlines`` ends them.
    """
    split = files.select("source_path", "file_ord", F.posexplode(F.split("text", LINE_SEP, -1)).alias("offset", "original_text"))
    return split.where(~is_blank(F.col("original_text"))).select("original_text", "source_path", "offset", "file_ord")


def sentences(files: DataFrame) -> DataFrame:
    """``raw_lines`` with ``normalized_text`` ('' for lines of punctuation only). No shuffle.

    The normalized text comes out of a generator: the optimiser would otherwise copy its expression into every search over
    it, and normalize a line again for each.
    """
    norm = F.explode(F.array(normalize(F.col("original_text")))).alias("normalized_text")
    return raw_lines(files).select("original_text", norm, "source_path", "offset", "file_ord")


def first_numbers(rows: DataFrame, order: list[str], size: str) -> DataFrame:
    """The rows without ``size`` and with ``first``: the sum of ``size`` over all rows before a row in the order of some columns.

    A range sort, running sums within its ranges, and the ranges' totals (one row per range come to the driver). No range is
    ever in one task with another.
    """
    kept = [f for f in rows.schema.fields if f.name != size]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def running(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, part = 0, TaskContext.get().partitionId()
        for b in parts:
            n = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(n) + total
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.full(len(n), part, np.int32)), pa.array(ends - n), pa.array(ends)], names=[*(f.name for f in kept), "_part", "first", "_end"])
            total = int(ends[-1]) if len(n) else total

    ordered = rows.select(*(f.name for f in kept), size).repartitionByRange(*order).sortWithinPartitions(*order)
    first = stored(ordered.mapInArrow(running, f"{schema}, _part int, first long, _end long"))
    ends = first.groupBy("_part").agg(F.max("_end").alias("n")).orderBy("_part").collect()  # one row per range
    totals, base = [], 0
    for r in ends:
        totals.append((r["_part"], base))
        base += r["n"]
    bases = F.broadcast(rows.sparkSession.createDataFrame(totals, "_part int, _base long"))
    return first.join(bases, "_part").select(*(f.name for f in kept), (F.col("_base") + F.col("first")).alias("first"))


def numbered(files: DataFrame) -> DataFrame:
    """``sentences`` with ``sentence_id``: from 0, dense, in the order of files (``file_ord``, ``source_path``) and lines.

    Only the number of lines of each file is sorted; the text stays where it is unless there are too many files for their
    first numbers to be broadcast.
    """
    kept = F.filter(F.transform(F.split("text", LINE_SEP, -1), lambda x, i: F.struct(i.alias("offset"), x.alias("original_text"))), lambda s: ~is_blank(s["original_text"]))
    counts = files.groupBy("file_ord", "source_path").agg(F.sum(F.coalesce(F.size(kept), F.lit(0))).alias("n"))
    first = first_numbers(counts, ["file_ord", "source_path"], "n").select(F.col("file_ord").alias("_o"), F.col("source_path").alias("_s"), F.col("first").alias("_first"))
    both = files.join(first, F.col("file_ord").eqNullSafe(F.col("_o")) & (F.col("source_path") == F.col("_s")))
    split = both.select("source_path", "file_ord", "_first", F.posexplode(kept).alias("_i", "_l"))
    norm = F.explode(F.array(normalize(F.col("_l.original_text")))).alias("normalized_text")
    return split.select((F.col("_first") + F.col("_i")).alias("sentence_id"), F.col("_l.original_text").alias("original_text"), norm, "source_path", F.col("_l.offset").alias("offset"), "file_ord")


LEGACY = "file string, sentence string, offset long, source_path string, line_no int"


def _legacy_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files with their cleaned lines to a row per line, with the characters before it."""
    for b in batches:
        path, sentences = b.column(0), b.column(1)
        n = pc.list_value_length(sentences).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = sentences.flatten()
        ends = np.cumsum(pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        before = np.concatenate([[0], ends])
        start = np.concatenate([[0], np.cumsum(n)])
        of = np.repeat(np.arange(len(n)), n)
        offset = before[:-1] - before[start[:-1]][of]
        paths = path.take(pa.array(of))
        names = pc.replace_substring_regex(paths, "(?s)^.*/", "")
        yield pa.RecordBatch.from_arrays([names, flat, pa.array(offset), paths, pa.array((np.arange(len(of)) - start[:-1][of]).astype(np.int32))], names=["file", "sentence", "offset", "source_path", "line_no"])


def legacy_lines(files: DataFrame) -> DataFrame:
    """``(file, sentence, offset)`` of the older index: base name, cleaned line (blank ones kept), and offset in characters.

    An offset is what the cleaned lines before it take, with one for each line end. Only ``.txt`` in lower case counts. Each
    file is one row, so offsets are summed up where it is read; nothing is moved.
    """
    own = files.where(F.col("source_path").endswith(".txt") & (F.col("text") != ""))
    # a last line end doesn't begin another line
    body = F.regexp_replace("text", r"(?:\r\n|[\n\r])\z", "")
    clean = F.transform(F.split(body, r"\r\n|[\n\r]", -1), legacy_clean)
    return own.select("source_path", clean.alias("sentences")).mapInArrow(_legacy_rows, LEGACY)
