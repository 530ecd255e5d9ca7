"""Problem 6: records that are one and the same but for formatting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, joined, spread, stored

#: One field: a name, ``=`` or ``:``, a value without separators of fields.
FIELD = r"^[^\p{L}\p{N}]*([\p{L}_][\p{L}\p{N}_.\-]*)\s*[=:]\s*([^=:;|,]*[\p{L}\p{N}][^=:;|,]*)$"
LEAST_FIELDS = 4


def folded(text: Column) -> Column:
    """Letters and digits only, case folded (upper then lower, which also folds sharp s and final sigma)."""
    # the concat keeps the optimiser from reducing lower(upper(x)) to lower(x)
    bare = F.regexp_replace(text, r"[^\p{L}\p{N}]+", "")
    return F.translate(F.lower(F.concat(F.upper(bare), F.lit(""))), "ς", "σ")


def field_list(text: Column) -> Column:
    """The folded fields of a line of at least four ``name=value`` fields in sorted order, joined; null for other lines."""
    parts = F.filter(F.split(text, r"[;|,\t\n\r]+"), lambda p: F.regexp_replace(p, r"[^\p{L}\p{N}]+", "") != "")
    fields = (F.size(parts) >= LEAST_FIELDS) & F.forall(parts, lambda p: p.rlike(FIELD))
    own = F.transform(parts, lambda p: F.concat(folded(F.regexp_extract(p, FIELD, 1)), F.lit("="), folded(F.regexp_extract(p, FIELD, 2))))
    return F.when(text.rlike(r"(?s)[=:].*[=:].*[=:].*[=:]") & fields, F.array_join(F.array_sort(own), ";"))


def digest(c: Column) -> Column:
    """128 bits of a string."""
    return F.unhex(F.md5(F.encode(c, "UTF-8")))


def keys_of(t: Column) -> list[Column]:
    """``_k``, the key of the letters and digits of a text, and ``_kf``, that of its sorted fields, if it is a line of fields."""
    fields = field_list(t)
    return [digest(folded(t)).alias("_k"), F.when(fields.isNotNull(), digest(F.concat(F.lit("f:"), fields))).alias("_kf")]


def _keyed(df: DataFrame, record_id: str, text: str) -> DataFrame:
    t = F.col(f"`{text}`")
    rows = df.where(t.isNotNull() & F.col(f"`{record_id}`").isNotNull() & t.rlike(r"[\p{L}\p{N}]"))
    return rows.select(F.col(f"`{record_id}`").alias("_id"), *keys_of(t))


def link_keys(keyed: DataFrame) -> DataFrame:
    """``(_k, _g)``: the letters of every line of fields, once, with the key of the fields' class."""
    return keyed.where(F.col("_kf").isNotNull()).groupBy("_k").agg(F.min("_kf").alias("_g"))


def copy_classes(rows: DataFrame, limit: int, salts: int = 64) -> tuple[DataFrame, DataFrame]:
    """``(hot, classes)`` of stored ``(_id, _k, _kf)``: the hot keys, and a row ``(_k, keep_id, copies)`` per distinct key of
    letters, with the smallest id and the size of the class of copies it belongs to.

    Keys are counted exactly, with partial counts in each task. Those with more than ``limit`` rows are grouped in two
    levels, under a salt and then without; all others take one shuffle. A field line's letters belong to the class of its
    fields; those classes are grouped from rows of distinct keys, which holds for keys of fields that are hot as well.
    """
    hot = stored(hot_keys(rows, "_k", limit))
    few = F.broadcast(hot)
    of = [F.min("_m").alias("_m"), F.sum("_c").alias("_c"), F.min("_kf").alias("_g")]
    one = rows.select("_k", F.col("_id").alias("_m"), F.lit(1).cast("long").alias("_c"), "_kf", F.pmod(F.xxhash64("_id"), F.lit(salts)).alias("_s"))
    cold = one.join(few, "_k", "left_anti").groupBy("_k").agg(*of)
    salted = one.join(few, "_k", "left_semi").groupBy("_k", "_s").agg(F.min("_m").alias("_m"), F.sum("_c").alias("_c"), F.min("_kf").alias("_kf"))
    keys = stored(cold.unionByName(salted.groupBy("_k").agg(*of)))
    alone = keys.where(F.col("_g").isNull()).select("_k", F.col("_m").alias("keep_id"), F.col("_c").alias("copies"))
    linked = keys.where(F.col("_g").isNotNull()).select("_g", "_k", "_m", "_c")
    groups = linked.groupBy("_g").agg(F.min("_m").alias("keep_id"), F.sum("_c").alias("copies"))
    return hot, alone.unionByName(joined(linked.select("_g", "_k"), groups, "_g", hot_keys(linked, "_g", limit), "inner").select("_k", "keep_id", "copies"))


def _stored_keys(df: DataFrame, record_id: str, text: str, hot: int | None) -> tuple[DataFrame, int]:
    rows = stored(_keyed(df, record_id, text))
    return rows, hot or max(10_000, rows.count() // (4 * spread(df.sparkSession)))


def copy_groups(df: DataFrame, record_id: str, text: str, hot: int | None = None, salts: int = 64) -> DataFrame:
    """``(record_id, keep_id, copies)`` of every record with a letter or digit: the smallest id of its group, and the
    group's size.

    Two texts are copies if they agree in letters and digits once case, white space and punctuation are ignored; lines of
    four or more fields also if their fields agree in any order. A line of fields and a line with the same letters but
    other marks are linked through their common letters, so groups are whole classes, not chains cut short.

    The keys of all rows are computed once and stored (24 bytes a row). Keys with more than ``hot`` rows (default: a share of
    the rows that one partition would hold) are salted, and their classes broadcast to their rows, which stay where they are
    - there are at most rows / ``hot`` of them. The keeper is the minimum id.

    Nulls: rows with a null text or id, and texts without a letter or digit, are in no group and don't appear. Repeated
    ids count as copies of themselves. An empty table gives an empty result; clashing extra columns are never read.
    """
    rows, limit = _stored_keys(df, record_id, text, hot)
    keys, classes = copy_classes(rows, limit, salts)
    return joined(rows.select("_id", "_k"), classes, "_k", keys, "inner").select(F.col("_id").alias(record_id), "keep_id", "copies")


def collapsed(df: DataFrame, record_id: str, text: str, hot: int | None = None) -> DataFrame:
    """One row per group: ``(keep_id, copies)``. Rows are only grouped, never joined back."""
    rows, limit = _stored_keys(df, record_id, text, hot)
    return copy_classes(rows, limit)[1].select("keep_id", "copies").distinct()


def further_copies(df: DataFrame, record_id: str, text: str, hot: int | None = None) -> DataFrame:
    """``(keep_id, copy_id)`` for every record that is not its group's keeper; only keys of groups of several are joined."""
    rows, limit = _stored_keys(df, record_id, text, hot)
    keys, classes = copy_classes(rows, limit)
    found = joined(rows.select("_id", "_k"), classes.where(F.col("copies") > 1), "_k", keys, "inner")
    return found.where(F.col("_id") != F.col("keep_id")).select("keep_id", F.col("_id").alias("copy_id"))
