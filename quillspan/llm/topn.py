"""Problem 2: the N best rows of every group under one fixed order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, group: str, score: str, ties: list[str], n: int = 5, keep: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows of each group by ``score`` descending, then ``ties`` ascending (strings by code point).

    The filter on ``row_number`` becomes the optimiser's group limit: each task keeps at most ``n`` rows of a group
    before the shuffle, so a group of any size sends ``n`` rows per task and no more.

    Nulls: a null or NaN score never counts; a null group is a group of its own; a null tie value comes first. Fully
    equal rows each take a place of their own, in either order. Fewer than ``n`` rows: all of them. An empty input gives
    an empty result. Other columns are not touched; ``keep`` (default: group and ties) names those that are returned, next
    to ``place`` (from 1); a column of that name in the input is only lost if it isn't asked for.
    """
    wanted = list(dict.fromkeys(keep or [group, score, *ties]))
    needed = list(dict.fromkeys([group, score, *ties, *wanted]))
    kind = dict(df.dtypes)[score]
    rows = df.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(needed)])
    at = {c: F.col(f"_c{i}") for i, c in enumerate(needed)}
    rows = rows.where(at[score].isNotNull())
    if kind in ("float", "double"):
        rows = rows.where(~F.isnan(at[score]))
    order = Window.partitionBy(at[group]).orderBy(at[score].desc(), *[at[t].asc_nulls_first() for t in ties])
    ranked = rows.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= n)
    place = [] if "place" in wanted else [F.col("_place").alias("place")]
    return ranked.select(*[at[c].alias(c) for c in wanted], *place)
