"""Problem 9: passages of held-out items inside documents.

Every n-gram of an item may be a seed. A document's n-grams are tried against a bitmap of all items' n-grams - it has a fixed
largest size, whatever the number of items - and what passes is counted over the whole corpus. Of the n-grams that could
stand for a passage the rarest in the corpus become seeds, and seeds join documents with items in a shuffle. Around its seeds
an item is aligned with the document (Smith-Waterman, all candidates of a batch at once), which scores edited copies; the
same table tells the longest run of equal words.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, stored

WORD = re.compile(r"[^\W_]+")
#: Words of a seed: where edited copies are looked for, and where only long runs of equal words are.
GRAM, LONG_GRAM = 4, 5
SLACK = 12
MATCH, MISMATCH, GAP = 2, -1, -1
#: Bits of the bitmap: so many for every n-gram of an item, within these bounds (at most 32 MiB).
BITS_EACH, LEAST_BITS, MOST_BITS = 64, 1 << 16, 1 << 28


def words_of(t: str) -> list[str]:
    return WORD.findall(unicodedata.normalize("NFC", t).casefold() if not t.isascii() else t.lower())


class Coder:
    """Words as numbers (63 bits of their hash); remembers the words it has seen."""

    def __init__(self, most_words: int = 500_000) -> None:
        self.known: dict[str, int] = {}
        self.most = most_words

    def __call__(self, t: str) -> np.ndarray:
        known = self.known
        if len(known) > self.most:  # only frees memory
            known.clear()
        words = words_of(t)
        try:
            return np.array([known[w] for w in words], np.int64)
        except KeyError:
            known.update((w, xxhash.xxh64_intdigest(w) >> 1) for w in words if w not in known)
            return np.array([known[w] for w in words], np.int64)


def grams(line: np.ndarray, size: int) -> np.ndarray:
    """Hash of the n-gram from every word on (fewer than n words: none)."""
    if len(line) < size:
        return np.empty(0, np.int64)
    h = np.zeros(len(line) - size + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            h = h * np.uint64(0x100000001B3) + line[k : len(line) - size + 1 + k].astype(np.uint64)
    return mix(h).view(np.int64)


def align(items: list[np.ndarray], texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score and longest common run for pairs of word arrays, all pairs at once."""
    n = len(items)
    a = np.full((n, max(map(len, items))), -2, np.int64)
    b = np.full((n, max(map(len, texts))), -3, np.int64)
    for k in range(n):
        a[k, : len(items[k])], b[k, : len(texts[k])] = items[k], texts[k]
    score, run = np.zeros((n, b.shape[1] + 1), np.int32), np.zeros((n, b.shape[1] + 1), np.int32)
    best, longest = np.zeros(n, np.int32), np.zeros(n, np.int32)
    ramp = -GAP * np.arange(b.shape[1] + 1, dtype=np.int32)
    for i in range(a.shape[1]):
        same = b == a[:, i : i + 1]
        down = np.where(same, score[:, :-1] + MATCH, score[:, :-1] + MISMATCH)
        new = np.zeros_like(score)
        new[:, 1:] = np.maximum(np.maximum(down, score[:, 1:] + GAP), 0)
        new = np.maximum.accumulate(new + ramp, axis=1) - ramp  # gaps in the item: a running maximum
        score = np.maximum(new, 0)
        moved = np.zeros_like(run)
        moved[:, 1:] = np.where(same, run[:, :-1] + 1, 0)
        run = moved
        best, longest = np.maximum(best, score.max(axis=1)), np.maximum(longest, run.max(axis=1))
    return best, longest


def _item_rows(size: int):
    """Items with their words, and with their n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Coder()
        for b in batches:
            lines = [code(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.tobytes() for x in lines], pa.binary()), pa.array([grams(x, size) for x in lines], pa.list_(pa.int64()))], names=["u", "item_id", "words", "h"])

    return run


def gram_bitmap(seeds: DataFrame, count: int) -> np.ndarray:
    """A bitmap with two bits for every ``h``. Its bits are joined on the executors; what comes to the driver is no larger than
    the bitmap, which has ``MOST_BITS`` at most. Beyond that it lets more pass, and nothing is lost."""
    size = LEAST_BITS
    while size < min(MOST_BITS, BITS_EACH * count):
        size *= 2
    places = F.explode(F.array(F.col("h").bitwiseAND(size - 1), F.shiftrightunsigned("h", 32).bitwiseAND(size - 1)))
    bits = seeds.select(places.alias("p")).select(F.shiftright("p", 6).alias("i"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("b"))
    rows = bits.groupBy("i").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(size // 64, np.int64)
    out[rows["i"].to_numpy(np.int64)] = rows["b"].to_numpy(np.int64)
    return out.view(np.uint64)


def passing(h: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Which hashes have both of their bits set."""
    u, mask = h.view(np.uint64), np.uint64(len(bitmap) * 64 - 1)
    ok = np.ones(len(u), bool)
    for p in (u & mask, (u >> np.uint64(32)) & mask):
        ok &= (bitmap[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) > 0
    return ok


def in_runs(ok: np.ndarray, least: int) -> np.ndarray:
    """``ok`` where it holds at ``least`` places in a row at the least."""
    edge = np.diff(np.concatenate([[0], ok.astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out = np.zeros(len(ok), bool)
    for a, z in zip(starts, ends, strict=True):
        if z - a >= least:
            out[a:z] = True
    return out


def _hits(bitmap, size: int, run_of: int):
    """Documents that hold n-grams of items, with these and their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Coder()
        for b in batches:
            rows, places, hashes = [], [], []
            for n, t in enumerate(b.column(1).to_pylist()):
                h = grams(code(t), size)
                at = np.flatnonzero(in_runs(passing(h, bitmap.value), run_of)) if len(h) else h
                if len(at):
                    rows.append(n)
                    places.append(at)
                    hashes.append(h[at])
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(hashes, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int64()))], names=["doc_id", "text", "h", "at"])

    return run


def _aligned(least_score: int):
    """Documents with their candidates ``(item_id, words, diagonals)`` aligned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Coder()
        for b in batches:
            best: dict[tuple[int, int], tuple[int, int]] = {}
            todo = []
            for doc, t, found in zip(*(c.to_pylist() for c in b.columns), strict=True):
                line = code(t)
                for c in found:
                    own, at = np.frombuffer(c["words"], np.int64), np.sort(np.array(c["diagonals"], np.int64))
                    # seeds on nearby diagonals belong to one place
                    cut = np.flatnonzero(np.diff(at) > SLACK)
                    for f, z in zip(at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])], strict=True):
                        todo.append((doc, c["item_id"], own, line[max(0, f - SLACK) : z + len(own) + SLACK]))
            todo.sort(key=lambda x: (len(x[2]), len(x[3])))
            k = 0
            while k < len(todo):
                e, widest = k, 0
                while e < len(todo) and (e == k or (e - k + 1) * max(widest, len(todo[e][3])) < 400_000):
                    widest, e = max(widest, len(todo[e][3])), e + 1
                for (doc, item, *_), s, r in zip(todo[k:e], *(x.tolist() for x in align([x[2] for x in todo[k:e]], [x[3] for x in todo[k:e]])), strict=True):
                    old = best.get((doc, item), (0, 0))
                    best[doc, item] = (max(s, old[0]), max(r, old[1]))
                k = e
            rows = [(d, i, s, r) for (d, i), (s, r) in sorted(best.items()) if s >= least_score]
            yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in rows], kind) for n, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["doc_id", "item_id", "score", "longest_run"])

    return run


def leaks(documents: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, least_score: int = 20, window: int = 0) -> DataFrame:
    """``(doc_id, item_id, score, longest_run)`` once per pair: the best local alignment of an item with a document, in
    matched words times two less edits, and the most consecutive words both have.

    A passage is found if any four consecutive words of it are left whole, so with any one word in five changed, put in or
    left out. With ``window``, only runs of so many equal words are asked for: seeds have five words, those of a document
    count only where so many stand in a row as such a run has, and of every run of an item only the rarest in the corpus is
    one. Documents are read once, where they are; those with n-grams of items are stored. Only n-grams' hashes, candidates
    and then the stored texts are moved. Joins are Spark's: it broadcasts what it measures to be small and splits keys with
    too many rows (adaptive skew joins).

    Nulls: null texts hold nothing, items with a null id or text and documents with a null id are left out. Items shorter
    than a seed have none. Repeated documents or items of one id are one pair, with the best score. Empty tables give an
    empty result; extra columns are not read.
    """
    size = LONG_GRAM if window else GRAM
    span = max(1, window - size + 1)  # seeds of one window
    known = items.where(F.col(f"`{item_id}`").isNotNull() & F.col(f"`{item_text}`").isNotNull()).select(F.monotonically_increasing_id().alias("u"), F.col(f"`{item_id}`").cast("long").alias("item_id"), F.col(f"`{item_text}`").alias("_t"))
    asked = stored(known.mapInArrow(_item_rows(size), "u long, item_id long, words binary, h array<long>"))
    own = asked.select("u", F.posexplode("h").alias("i", "h"))
    bitmap = documents.sparkSession.sparkContext.broadcast(gram_bitmap(own, own.count()))

    docs = documents.where(F.col(f"`{doc_id}`").isNotNull() & F.col(f"`{text}`").isNotNull()).select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    holding = stored(docs.mapInArrow(_hits(bitmap, size, span), "doc_id long, text string, h array<long>, at array<long>").withColumn("c", F.monotonically_increasing_id()))
    hits = holding.select("c", F.explode(F.arrays_zip("h", "at")).alias("_x")).select("c", "_x.h", "_x.at")

    counts = hits.groupBy("h").agg(F.count(F.lit(1)).alias("n"))  # in the corpus; combined in each task
    near = Window.partitionBy("u").orderBy("i").rowsBetween(0, span - 1)
    rarest = own.join(counts, "h", "left").select("u", F.min(F.struct(F.coalesce("n", F.lit(0)), "i", "h")).over(near).alias("_s"), F.count(F.lit(1)).over(near).alias("_w"))
    seeds = rarest.where(F.col("_w") == span).select("u", "_s.i", "_s.h").distinct()
    met = hits.join(seeds, "h").groupBy("c", "u").agg(F.collect_set(F.col("at") - F.col("i")).alias("diagonals"))
    pairs = met.join(asked.select("u", "item_id", "words"), "u").groupBy("c").agg(F.collect_list(F.struct("item_id", "words", "diagonals")).alias("found"))
    rows = pairs.join(holding.select("c", "doc_id", "text"), "c").select("doc_id", "text", "found").mapInArrow(_aligned(least_score), "doc_id long, item_id long, score int, longest_run int")
    return rows.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.max("longest_run").alias("longest_run"))


def leaked_passages(documents: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, window: int = 13) -> DataFrame:
    """``(doc_id, item_id)``: pairs that have ``window`` consecutive words (five or more) in common."""
    pairs = leaks(documents, doc_id, text, items, item_id, item_text, MATCH * window, window)
    return pairs.where(F.col("longest_run") >= window).select("doc_id", "item_id")
