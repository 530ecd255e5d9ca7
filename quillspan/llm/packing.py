"""Problem 8: documents into containers of a fixed number of tokens.

Within a shard, Martello and Toth's reduction first fixes small sets that provably dominate every other set holding the
document they start from (for every packing there is one at least as good that has them); what is left is packed by best
fit, largest first. Shards hold a bounded number of documents, so a shard costs at most its last, partly filled containers.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Fixed value: how that vocabulary's tokenizer cuts text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHARD = 20_000


@lru_cache(2)
def tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, doc_id: str, text: str, path: str) -> DataFrame:
    """``(doc_id, tokens)``; a null text has none, a row with a null id is left out. ``path`` names the vocabulary file on the
    driver, which ships it to the executors."""
    df.sparkSession.sparkContext.addFile(path)
    name = os.path.basename(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(SparkFiles.get(name)).encode_ordinary
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(encode(t)) if t else 0 for t in b.column(1).to_pylist()], pa.int64())], names=["doc_id", "tokens"])

    rows = df.where(F.col(f"`{doc_id}`").isNotNull()).select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("_t"))
    return rows.mapInArrow(run, "doc_id long, tokens long")


class Sizes:
    """A multiset of sizes in order."""

    def __init__(self, sizes: list[int]) -> None:
        self.count: dict[int, int] = {}
        for s in sizes:
            self.count[s] = self.count.get(s, 0) + 1
        self.order = sorted(self.count)

    def take(self, s: int) -> None:
        self.count[s] -= 1
        if not self.count[s]:
            del self.count[s]
            del self.order[bisect_left(self.order, s)]

    def largest(self, most: int) -> int:
        """The largest size of at most ``most``; 0 if there is none."""
        i = bisect_right(self.order, most)
        return self.order[i - 1] if i else 0

    def smallest(self, k: int) -> list[int]:
        """The ``k`` smallest (fewer if there aren't as many)."""
        out: list[int] = []
        for s in self.order:
            out += [s] * min(self.count[s], k - len(out))
            if len(out) == k:
                break
        return out

    def second_of_two(self, room: int) -> int:
        """The largest size that fits next to another one at least as large, both within ``room``; 0 if no two fit."""
        i = bisect_right(self.order, room // 2) - 1
        while i >= 0:
            y = self.order[i]
            if self.count[y] > 1 or i + 1 < len(self.order) and self.order[i + 1] <= room - y:
                return y
            i -= 1
        return 0


def dominant_set(left: Sizes, largest: int, capacity: int) -> list[int] | None:
    """The sizes that, with ``largest``, dominate every set that holds it; None if none of up to three does.

    ``left`` is without ``largest``; it holds all other sizes, larger ones too. A set dominates another if the other's documents can be put, in groups, into places
    of single documents of the first that are no smaller.
    """
    room = capacity - largest
    k = left.largest(room)
    if not k:
        return []
    small = left.smallest(3)
    if k == room or len(small) < 2 or small[0] + small[1] > room:
        return [k]  # it fills the rest, or no second one can come
    if left.second_of_two(room) == 0:
        return [k]
    if len(small) < 3 or sum(small) > room:  # two more at most
        left.take(k)
        b = left.largest(room - k)
        insort_back(left, k)
        if b and b >= left.second_of_two(room):
            return [k, b]
    return None


def insort_back(left: Sizes, s: int) -> None:
    if s not in left.count:
        insort(left.order, s)
    left.count[s] = left.count.get(s, 0) + 1


def reduced(sizes: list[int], capacity: int) -> tuple[list[list[int]], list[int]]:
    """Containers that some packing with the fewest containers has, and the sizes they leave, from the largest on.

    A size without a dominating set stays in the instance, so that the sets of smaller ones are held against those with it
    as well; it is only not tried again as the start of a set.
    """
    left = Sizes(sizes)
    done: list[list[int]] = []
    j = left.largest(capacity)
    while j:
        left.take(j)
        fixed = dominant_set(left, j, capacity)
        if fixed is None:
            insort_back(left, j)
            j = left.largest(j - 1)
            continue
        for s in fixed:
            left.take(s)
        done.append([j, *fixed])
        j = left.largest(j)
    return done, [s for s in reversed(left.order) for _ in range(left.count[s])]


def pack_sizes(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers as lists of sizes (each from 1 to ``capacity``)."""
    done, rest = reduced(sizes, capacity)
    room: list[tuple[int, int]] = []  # free room of open containers, in order
    open_: list[list[int]] = []
    for s in rest:  # from the largest on
        i = bisect_left(room, (s, -1))
        if i < len(room):
            free, n = room.pop(i)
            open_[n].append(s)
        else:
            free, n = capacity, len(open_)
            open_.append([s])
        if free > s:
            insort(room, (free - s, n))
    return done + open_


def pack_shard(docs: list[tuple[int, int]], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(container, doc, piece, first token, tokens) for documents (id, tokens); only a document above the capacity is cut."""
    out: list[tuple[int, int, int, int, int]] = []
    waiting: dict[int, list[tuple[int, int, int]]] = {}
    n, empty = 0, []
    for doc, tokens in sorted(docs):
        whole, part = divmod(tokens, capacity) if tokens > capacity else (0, tokens)
        for p in range(whole):
            out.append((n, doc, p, p * capacity, capacity))
            n += 1
        if part:
            waiting.setdefault(part, []).append((doc, whole, whole * capacity))
        elif not whole:
            empty.append(doc)
    for v in waiting.values():
        v.reverse()
    for container in pack_sizes([s for s, v in waiting.items() for _ in v], capacity):
        for s in container:
            doc, piece, at = waiting[s].pop()
            out.append((n, doc, piece, at, s))
        n += 1
    return out + [(max(0, n - 1), doc, 0, 0, 0) for doc in empty]


def packed(df: DataFrame, doc_id: str, text: str, capacities: DataFrame, path: str, shard: int = SHARD, most_capacities: int = 1000) -> DataFrame:
    """``(capacity_id, container, doc_id, piece, first_token, tokens)``: every document's place for every capacity.

    The text is tokenized where it is read; only ids and sizes are moved, in shards of about ``shard`` documents.
    Capacities become part of the plan: more than ``most_capacities`` are refused, never cut; one below 1 token or null
    holds nothing and is left out. Documents without tokens take no room and lie in the shard's last container; null ids are left out; repeated
    rows are packed each; an empty table gives an empty result; extra columns are not read.
    """
    caps = capacities.select("capacity_id", "max_tokens").where(F.col("capacity_id").isNotNull() & (F.col("max_tokens") >= 1)).distinct().limit(most_capacities + 1).collect()
    if len(caps) > most_capacities:
        raise ValueError(f"more than {most_capacities} capacities")
    sizes = stored(token_counts(df, doc_id, text, path))
    shards = 1 + sizes.count() // shard
    # numbers of rows in the stored table, so that rows with one and the same id are spread as well
    spread = sizes.withColumn("_shard", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(shards)))
    each = F.array(*[F.struct(F.lit(int(c[0])).cast("long").alias("capacity_id"), F.lit(int(c[1])).cast("long").alias("_cap")) for c in caps]) if caps else F.array().cast("array<struct<capacity_id:bigint,_cap:bigint>>")
    rows = spread.select("doc_id", "tokens", "_shard", F.explode(each).alias("_c")).select("doc_id", "tokens", "_shard", "_c.*")

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        cap, s = int(part["_cap"].iloc[0]), int(key[1])
        out = pd.DataFrame(pack_shard(list(zip(part["doc_id"].tolist(), part["tokens"].tolist(), strict=True)), cap), columns=["container", "doc_id", "piece", "first_token", "tokens"])
        out["container"] += s << 32
        out.insert(0, "capacity_id", int(key[0]))
        return out

    return rows.groupBy("capacity_id", "_shard").applyInPandas(run, "capacity_id long, container long, doc_id long, piece int, first_token long, tokens long")
