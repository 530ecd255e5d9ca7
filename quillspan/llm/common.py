"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stored

__all__ = ["NORMALIZED", "hot_keys", "joined", "mix", "spread", "stored", "table"]

#: The project's normalization as a SQL expression over a column name (ASCII letters, digits, single spaces).
NORMALIZED = r"trim(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9 ]', ''), ' +', ' '))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(spark: SparkSession) -> int:
    """Number of reduce partitions the session is configured for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hot_keys(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """``(key)`` of the keys with more than ``limit`` rows, counted exactly and in each task first; at most rows / ``limit``."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return counts.where(F.col("_n") > limit).select(key)


def joined(left: DataFrame, right: DataFrame, key: str, hot: DataFrame | None, how: str = "left") -> DataFrame:
    """``left`` joined with ``right``, which has a row per key at most, where a key may hold a great part of ``left``.

    Rows of null keys meet nothing and are not moved. Rows of ``hot`` keys stay where they are and the keys' few rows are
    broadcast to them; only the others are shuffled.
    """
    more = [F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema.fields if f.name != key]
    some = left.where(F.col(key).isNotNull())
    if hot is None:
        out = some.join(right, key, how)
    else:
        few = F.broadcast(hot)
        cold = some.join(few, key, "left_anti").join(right, key, how)
        warm = some.join(few, key, "left_semi").join(F.broadcast(right.join(few, key, "left_semi")), key, how)
        out = cold.unionByName(warm)
    return out if how == "inner" else out.unionByName(left.where(F.col(key).isNull()).select("*", *more))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (multiply and xor-shift) over uint64 values."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))
