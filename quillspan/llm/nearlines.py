"""Problem 4: lines that share most of their words.

Lines with the same set of words are one class; only classes are compared. Two sets that overlap enough share two of the
rarest words of each (prefix filter for two common words), so classes meet under a hash of such a pair. What meets arrives
sorted by key and size and is compared as it streams by: only sizes that can be similar, and of those only pairs whose
hashed bitmaps leave room for the overlap (bit counts bound it from above). A key with too many rows is cut into tiles that
other tasks compare. What is left is intersected exactly, by merging sorted arrays of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NORMALIZED, joined, mix, spread, stored
from .components import components
from .copies import digest, keys_of, link_keys

#: Sets above LONG words meet under single words (the pairs of their prefix would be too many).
LONG = 64
#: Rows of a tile; a key with more than HOT rows is cut into tiles.
TILE, HOT = 4096, 8192
#: Sizes from here on are not told apart; such sets are compared exactly without a bound.
HUGE = 0x7FFF
EPS = 1e-9


def word_sets(df: DataFrame, record_id: str, text: str, least_words: int) -> DataFrame:
    """``(_id, _s, _sig, _k, _kf)``, stored: the sorted distinct words of the normalized text in a string, a 128-bit key of
    them, and the keys by which the row is a formatting copy of others. One pass over the text. ``_s`` and ``_sig`` are null
    in lines of fields that have too few words themselves: they only tell which letters and fields belong together.
    """
    t = F.col(f"`{text}`")
    rows = df.where(t.isNotNull() & F.col(f"`{record_id}`").isNotNull()).select(F.col(f"`{record_id}`").cast("long").alias("_id"), t.alias("_t"))
    words = F.sort_array(F.array_distinct(F.split(F.expr(NORMALIZED.format(c="_t")), " ")))
    # generators, so that the filter below doesn't have the words and keys computed twice
    rows = rows.select("_id", "_t", F.explode(F.array(words)).alias("_w"))
    enough = F.size("_w") >= max(2, least_words)
    rows = rows.where(enough | F.col("_t").rlike(r"[=:]")).select("_id", F.when(enough, F.array_join("_w", " ")).alias("_s"), F.explode(F.array(F.struct(*keys_of(F.col("_t"))))).alias("_x"))
    return stored(rows.where(F.col("_s").isNotNull() | F.col("_x._kf").isNotNull()).select("_id", "_s", digest(F.col("_s")).alias("_sig"), "_x.*"))


def prefix_sizes(n: int, t: float, common: int) -> tuple[int, int]:
    """Of a set of ``n`` words in order of rarity: how many it is found by as the smaller set, and as the larger one, if
    ``common`` shared words are asked for and the Jaccard similarity is at least ``t``."""
    least = ceil(2 * t / (1 + t) * n - EPS)
    return min(n, n - least + common), min(n, n - ceil(t * n - EPS) + common)


def _keys(t: float, frequent: dict[str, int]):
    """Per batch of classes: a row ``(k, rid, bits)`` for every key a class is found by. ``k`` is 48 bits of the key's hash, 15
    of the set's size and one that says whether the set is found by the key as the smaller one too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).to_numpy(zero_copy_only=False)
            lists = pc.split_pattern(b.column(1), " ")
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = lists.flatten().dictionary_encode()
            words = coded.dictionary.to_pylist()
            hashes = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
            rank = np.array([frequent.get(w, -1) for w in words], np.int64)
            rank = np.where(rank < 0, (hashes >> np.uint64(33)).astype(np.int64), rank + (1 << 32))
            index = coded.indices.to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(ids)), sizes)
            order = np.lexsort((hashes[index], rank[index], row))
            h = hashes[index][order]
            start = np.concatenate([[0], np.cumsum(sizes)])
            bits = np.bitwise_or.reduceat(np.uint64(1) << (mix(h) & np.uint64(63)), start[:-1])
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for n in np.unique(sizes):
                at = np.flatnonzero(sizes == n)
                own = h[start[at][:, None] + np.arange(n)]
                for common in ((2,) if n <= LONG * t - 1 else (2, 1) if n <= LONG else (1,)):
                    smaller, larger = prefix_sizes(int(n), t, common)
                    for pick in combinations(range(larger), common):
                        k = mix(own[:, pick[0]] + np.uint64(common))
                        if common == 2:
                            with np.errstate(over="ignore"):
                                k = mix(k * np.uint64(3) + own[:, pick[1]])
                        low = np.uint64(min(int(n), HUGE) << 1 | (pick[-1] < smaller))
                        found.append(((k & ~np.uint64(0xFFFF)) | low, at))
            at = np.concatenate([x for _, x in found])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([k for k, _ in found]).view(np.int64)), pa.array(ids[at]), pa.array(bits[at].view(np.int64))], names=["k", "rid", "bits"])

    return run


Rows = tuple[np.ndarray, np.ndarray, np.ndarray]


def _sizes(k: np.ndarray) -> np.ndarray:
    return (k >> 1) & HUGE


def _bounded(a: Rows, b: Rows, t: float) -> np.ndarray:
    """Which pairs (the smaller set in ``a``) can be similar by their sizes and the bits in which their maps differ."""
    n, m = _sizes(a[0]), _sizes(b[0])
    need = np.ceil(t / (1 + t) * (n + m) - EPS).astype(np.int64)
    most = (n + m - np.bitwise_count((a[2] ^ b[2]).view(np.uint64)).astype(np.int64)) >> 1
    return ((a[0] & 1) > 0) & ((m == HUGE) | (n >= np.ceil(t * m - EPS)) & (np.minimum(most, n) >= need))


def _groups(rows: Rows, t: float) -> list[np.ndarray]:
    """All pairs within the keys of rows sorted by key and size, by their distance in that order: as sizes only grow, a row is
    done with once the next one is too large for it."""
    k, rid, bits = rows
    key = k >> 16
    end = np.searchsorted(key, key, "right")
    found: list[np.ndarray] = []
    at, d = np.arange(len(k)), 1
    while len(at := at[end[at] > at + d]):
        m = _sizes(k[at + d])
        at = at[(m == HUGE) | (_sizes(k[at]) >= np.ceil(t * m - EPS))]
        ok = at[_bounded((k[at], rid[at], bits[at]), (k[at + d], rid[at + d], bits[at + d]), t)]
        if len(ok):
            found.append(np.stack([rid[ok], rid[ok + d]]))
        d += 1
    return found


MET = "a long, b long, h long, no int, lo int, hi int, tile binary"
MET_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("h", pa.int64()), ("no", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("tile", pa.binary())])


def _pairs(found: list[np.ndarray]) -> np.ndarray:
    both = np.unique(np.sort(np.concatenate(found, axis=1), axis=0), axis=1) if found else np.empty((2, 0), np.int64)
    return both[:, both[0] != both[1]]


def _pairs_batch(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    both = _pairs(found)
    n = both.shape[1]
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1]), *(pa.nulls(n, f.type) for f in list(MET_SCHEMA)[2:])], schema=MET_SCHEMA)


def _tile_batch(rows: Rows, no: int) -> pa.RecordBatch:
    k = rows[0]
    values = [None, None, int(k[0] >> 16), no, int(_sizes(k[:1])[0]), int(_sizes(k[-1:])[0]), np.stack(rows).tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, MET_SCHEMA, strict=True)], schema=MET_SCHEMA)


def _meet(t: float):
    """Rows with one key compared, out of a stream sorted by ``k``. A task holds one batch and the last key's rows, of which
    there are at most ``HOT``: when a key has more, they are given out as numbered tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the last key's rows that are still here
        tiles = 0  # how many of its tiles are given out

        def given(last: bool) -> Iterator[pa.RecordBatch]:
            """Gives out what is held: if it is too much for one key, or (``last``) all of it."""
            nonlocal held, tiles
            n = sum(x.shape[1] for x in held)
            if not n or not last and n <= HOT:
                return
            rows = np.concatenate(held, axis=1)
            if not tiles and n <= HOT:
                yield from _pairs_batch(_groups(tuple(rows), t))
                rows = rows[:, :0]
            while rows.shape[1] and (last or rows.shape[1] >= TILE):
                yield _tile_batch(tuple(rows[:, :TILE]), tiles)
                tiles, rows = tiles + 1, rows[:, TILE:]
            held = [rows]
            if last:
                held, tiles = [], 0

        for b in batches:
            if not b.num_rows:
                continue
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns])
            key = rows[0] >> 16
            if held and held[0][0, 0] >> 16 != key[0]:
                yield from given(True)
            first = np.searchsorted(key, key[0], "right")
            last = np.searchsorted(key, key[-1], "left")
            if first == len(key):  # one key throughout
                held.append(rows)
                yield from given(False)
                continue
            held.append(rows[:, :first])
            yield from given(True)
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            counts = np.diff(np.append(starts, len(key)))
            inner = np.repeat((counts > 1) & (counts <= HOT), counts)
            inner[:first] = inner[last:] = False
            if inner.any():
                yield from _pairs_batch(_groups(tuple(rows[:, inner]), t))
            for s, c in zip(starts[1:-1][counts[1:-1] > HOT], counts[1:-1][counts[1:-1] > HOT], strict=True):
                held = [rows[:, s : s + c]]
                yield from given(True)
            held = [rows[:, last:]]
            yield from given(False)
        yield from given(True)

    return run


def _tiles(t: float):
    """Pairs of tiles (``i``, ``j``, and the bytes of both) compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                a, z = (np.frombuffer(v, np.int64).reshape(3, -1) for v in (x, y))
                found = _groups(tuple(a), t) if i == j else []
                for n in range(z.shape[1] if i != j else 0):
                    ok = np.flatnonzero(_bounded(tuple(a), tuple(z[:, n : n + 1]), t))
                    if len(ok):
                        found.append(np.stack([a[1][ok], np.full(len(ok), z[1, n])]))
                both = _pairs(found)
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

    return run


def tile_pairs(met: DataFrame, t: float, salts: int = 16) -> DataFrame:
    """``(a, b)`` out of the tiles of hot keys. Numbers and sizes of tiles are paired first, under a salt; the rows of a tile
    are then brought to the pairs it is in."""
    tiles = met.where(F.col("tile").isNotNull())
    size = tiles.select("h", "no", "lo", "hi")
    one = size.select("h", F.pmod("no", F.lit(salts)).alias("_s"), F.col("no").alias("i"), "hi")
    two = size.select("h", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_s"), F.col("no").alias("j"), "lo")
    near = (F.col("j") >= F.col("i")) & ((F.col("lo") == HUGE) | (F.col("hi") >= F.ceil(F.col("lo") * t - EPS)))
    both = one.join(two, ["h", "_s"]).where(near).select("h", "i", "j")
    of = lambda name, to: tiles.select("h", F.col("no").alias(name), F.col("tile").alias(to))
    return both.join(of("i", "x"), ["h", "i"]).join(of("j", "y"), ["h", "j"]).select("i", "j", "x", "y").mapInArrow(_tiles(t), "a long, b long")


def _verified(t: float):
    """Pairs whose word sets are similar enough: both sorted arrays are merged, and words that stand twice counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            lists = pc.split_pattern(pa.concat_arrays([b.column(2), b.column(3)]), " ")
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            words = lists.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            merged = np.sort(np.repeat(np.tile(np.arange(n), 2), sizes) << 32 | words)
            same = np.bincount((merged[1:][merged[1:] == merged[:-1]] >> 32), minlength=n)
            ok = same >= t * (sizes[:n] + sizes[n:] - same) - EPS
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok))

    return run


def frequent_words(classes: DataFrame, most: int = 50_000) -> dict[str, int]:
    """The words in at least one of 5,000 sets, the ``most`` frequent of them, numbered from the rarest to the commonest.

    Only an order that makes rare words come first; any order gives the same pairs. At most ``most`` words come to the
    driver.
    """
    counts = classes.select(F.explode(F.split("words", " ")).alias("_t")).groupBy("_t").agg(F.count(F.lit(1)).alias("_n"))
    top = counts.where(F.col("_n") >= max(20, classes.count() // 5000)).orderBy(F.col("_n").desc(), "_t").limit(most).collect()
    return {r[0]: i for i, r in enumerate(reversed(top))}


def similar_classes(sets: DataFrame, t: float) -> tuple[DataFrame, DataFrame]:
    """``(classes, links)``, both stored: classes ``(_sig, rep, words, rows, several)`` of rows of ``word_sets`` with equal
    words (``several``: they may be more than one kind of copies), and ``(a, b)``, the representatives (smallest ids) of every
    two classes with a Jaccard similarity of at least ``t``.

    Keys and rows that meet are moved once and sorted by Spark's external sort, so a reduce task needs no more memory for
    more rows; a word list is only moved for the pairs it is in.
    """
    spark = sets.sparkSession
    groups = sets.where(F.col("_sig").isNotNull()).groupBy("_sig")
    classes = stored(groups.agg(F.min("_id").alias("rep"), F.first("_s").alias("words"), F.count(F.lit(1)).alias("rows"), (F.min("_k") != F.max("_k")).alias("several")))
    frequent = spark.sparkContext.broadcast(frequent_words(classes))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _keys(t, frequent.value)(batches)

    rows = classes.select("rep", "words").mapInArrow(keys, "k long, rid long, bits long")
    met = stored(rows.repartition(spread(spark), F.shiftright("k", 16)).sortWithinPartitions("k").mapInArrow(_meet(t), MET))
    pairs = met.where(F.col("a").isNotNull()).select("a", "b")
    if not met.where(F.col("tile").isNotNull()).isEmpty():  # without hot keys there is nothing to pair
        pairs = pairs.unionByName(tile_pairs(met, t))
    words = classes.select("rep", "words")
    both = pairs.distinct().join(words.select(F.col("rep").alias("a"), F.col("words").alias("_wa")), "a").join(words.select(F.col("rep").alias("b"), F.col("words").alias("_wb")), "b")
    return classes, stored(both.select("a", "b", "_wa", "_wb").mapInArrow(_verified(t), "a long, b long"))


def _limit(classes: DataFrame) -> int:
    return max(10_000, int(classes.agg(F.sum("rows")).first()[0] or 0) // (4 * spread(classes.sparkSession)))


def near_groups(df: DataFrame, record_id: str, text: str, t: float = 0.7, least_words: int = 14) -> DataFrame:
    """``(rec_id, class_id, group_id, links)``: a row for every record with at least ``least_words`` distinct words. Its class
    is the smallest id with the same words, its group the smallest id that chains of similar classes (Jaccard similarity of
    at least ``t``) lead to, and ``links`` the number of other classes its own is similar to.

    Records that are null, short or repeated are treated as in ``near_pairs``: the first two are in no class, and a repeated
    row is one row.
    """
    sets = word_sets(df, record_id, text, least_words)
    classes, links = similar_classes(sets, t)
    ends = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    roots = components(links).select(F.col("node").alias("rep"), F.col("root").alias("group_id"))
    own = classes.select("_sig", "rep", "rows").join(ends, "rep", "left").join(roots, "rep", "left")
    own = stored(own.select("_sig", F.col("rep").alias("class_id"), F.coalesce("group_id", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"), "rows"))
    hot = own.where(F.col("rows") > _limit(classes)).select("_sig")
    rows = sets.where(F.col("_sig").isNotNull()).select(F.col("_id").alias("rec_id"), "_sig")
    return joined(rows, own.drop("rows"), "_sig", hot, "inner").select("rec_id", "class_id", "group_id", "links").distinct()


def near_pairs(df: DataFrame, record_id: str, text: str, t: float = 0.7, least_words: int = 14) -> DataFrame:
    """``(id_a, id_b)`` with ``id_a < id_b``: records whose word sets have at least ``least_words`` words each (2 or more)
    and a Jaccard similarity of at least ``t``, unless they are copies that differ in formatting only.

    Comparison is among classes of equal word sets. Classes are then split by kind of copy, linked parts are paired, and
    only those pairs are expanded to their members, so a large group of copies never meets itself. Only classes that are
    linked, or hold several kinds of copies, take part in that.

    Nulls: rows with a null text or id have no pairs, nor have empty or short texts. Long texts are whole sets of words.
    Repeated rows of one id are no pair. An empty table gives an empty result; extra columns are not read.
    """
    sets = word_sets(df, record_id, text, least_words)
    classes, links = similar_classes(sets, t)
    some = links.select(F.explode(F.array("a", "b")).alias("rep")).distinct().withColumn("_in", F.lit(True))
    wanted = stored(classes.select("_sig", "rep", "rows", "several").join(some, "rep", "left").where(F.col("several") | F.col("_in")))
    hot = wanted.where(F.col("rows") > _limit(classes)).select("_sig")
    members = stored(joined(sets.where(F.col("_sig").isNotNull()).select("_id", "_sig", "_k"), wanted.select("_sig", "rep"), "_sig", hot, "inner").select("rep", "_k", "_id").distinct())
    # kinds of copies within a class: few rows, whatever the number of members
    kinds = members.select("rep", "_k").distinct().join(link_keys(sets), "_k", "left")
    parts = stored(kinds.select("rep", "_k", F.coalesce("_g", "_k").alias("_c")))
    left, right = (parts.select(F.col("rep").alias(x), F.col("_k").alias(f"_k{x}"), F.col("_c").alias(f"_c{x}")) for x in "ab")
    across = links.join(left, "a").join(right, "b").where(F.col("_ca") != F.col("_cb"))
    inside = left.join(right, F.col("a") == F.col("b")).where((F.col("_ka") < F.col("_kb")) & (F.col("_ca") != F.col("_cb")))
    met = across.select("a", "b", "_ka", "_kb").unionByName(inside.select("a", "b", "_ka", "_kb"))
    of_a, of_b = (members.select(F.col("rep").alias(x), F.col("_k").alias(f"_k{x}"), F.col("_id").alias(y)) for x, y in (("a", "_x"), ("b", "_y")))
    pairs = met.join(of_a, ["a", "_ka"]).join(of_b, ["b", "_kb"]).where(F.col("_x") != F.col("_y"))
    return pairs.select(F.least("_x", "_y").alias("id_a"), F.greatest("_x", "_y").alias("id_b"))
