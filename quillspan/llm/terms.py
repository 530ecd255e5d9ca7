"""Problem 5: how often, and in how many records, every term occurs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread

RUNS = pa.schema([("term", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run lengths over rows sorted by (term, record): a run of one term counts its rows, a change of record counts one.

    State between batches is the last term and record only, so a run may be of any length.
    """
    last_term: str | None = None
    last_rec: int | None = None
    occ = rec = 0
    for b in batches:
        if not b.num_rows:
            continue
        term, ids = b.column(0), b.column(1).to_numpy(zero_copy_only=False)
        n = b.num_rows
        new_term = np.ones(n, bool)
        new_rec = np.ones(n, bool)
        if n > 1:
            new_term[1:] = pc.not_equal(term.slice(1), term.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            new_rec[1:] = new_term[1:] | (ids[1:] != ids[:-1])
        same = last_term is not None and term[0].as_py() == last_term
        new_term[0] = not same
        new_rec[0] = not (same and ids[0] == last_rec)
        starts = np.flatnonzero(new_term)
        cut = np.concatenate([[0], starts]) if not (len(starts) and starts[0] == 0) else starts
        sums = np.diff(np.append(cut, n))
        recs = np.add.reduceat(new_rec.astype(np.int64), cut)
        names = term.take(pa.array(cut))
        first = 0
        if same:
            occ, rec, first = occ + int(sums[0]), rec + int(recs[0]), 1
        if len(cut) > first:
            if last_term is not None:
                yield pa.RecordBatch.from_arrays([pa.array([last_term]), pa.array([occ], pa.int64()), pa.array([rec], pa.int64())], schema=RUNS)
            if len(cut) > first + 1:
                k = slice(first, len(cut) - 1)
                yield pa.RecordBatch.from_arrays([names.slice(first, len(cut) - 1 - first), pa.array(sums[k], pa.int64()), pa.array(recs[k], pa.int64())], schema=RUNS)
            occ, rec = int(sums[-1]), int(recs[-1])
        last_term, last_rec = term[n - 1].as_py(), int(ids[n - 1])
    if last_term is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last_term]), pa.array([occ], pa.int64()), pa.array([rec], pa.int64())], schema=RUNS)


def term_counts(df: DataFrame, record_id: str, text: str) -> DataFrame:
    """``(term, occurrences, records)`` for every non-empty space-separated part of ``text``.

    Every occurrence is a pair (term, record); nothing is summed before they move. The pairs are range-partitioned by term *and* record, so a
    term that stands in a third of all rows is split over as many partitions as it needs; each partition is sorted by
    Spark's external sort and scanned for run lengths. A term cut by a range boundary leaves one partial row per
    partition, and the last, small aggregation adds those up (equal pairs never part, so records are counted exactly).

    Nulls: a null text has no terms; a null id is one record of its own kind (all such rows together count as record 0
    with the flag of a negative key, i.e. one record). Rows repeated under one id count once as a record and each time as
    occurrences. Empty texts have no terms; an empty table gives an empty result. Other columns are ignored.
    """
    words = df.where(F.col(f"`{text}`").isNotNull()).select(F.coalesce(F.col(f"`{record_id}`").cast("long"), F.lit(-(2**63))).alias("_r"), F.explode(F.split(F.col(f"`{text}`"), " ")).alias("_t"))
    pairs = words.where(F.col("_t") != "").select("_t", "_r")
    n = spread(df.sparkSession)
    runs = pairs.repartitionByRange(n, "_t", "_r").sortWithinPartitions("_t", "_r").mapInArrow(_scan, "term string, occurrences long, records long")
    return runs.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marked_terms(df: DataFrame, record_id: str, text: str, rare_records: int = 2, common_share: float = 0.05) -> DataFrame:
    """``term_counts`` with ``mark``: ``rare`` for terms in at most ``rare_records`` records, ``common`` for terms in more
    than ``common_share`` of the rows with a text, else null. If both hold (tiny tables), ``common`` wins only above
    ``rare_records``, i.e. ``rare`` comes first."""
    rows = df.agg(F.count(F.col(f"`{text}`"))).scalar()  # a subquery of the plan: no job runs before the result's own
    mark = F.when(F.col("records") <= rare_records, "rare").when(F.col("records") > common_share * rows, "common")
    return term_counts(df, record_id, text).withColumn("mark", mark)
