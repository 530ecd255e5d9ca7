"""Operators over tables: top rows, terms, copies, near lines, packing."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspan.functions.text import normalize_text
from quillspan.llm import components, copies, nearlines, packing, terms, topn
from quillspan.llm.queries import TOKENIZER


# top rows of every group


def test_top_rows_ties_nulls_and_clashes(spark):
    rows = [("p", 5.0, "b", 1), ("p", 5.0, "B", 2), ("p", 5.0, None, 3), ("p", None, "a", 4), ("p", float("nan"), "a", 5), ("p", 7.0, "z", 6), ("p", 5.0, "b", 1), (None, 1.0, "n", 7), ("q", -1.0, "", 8)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "g string, s double, t string, id int, place string, _place int")
    got = topn.top_per_group(df, "g", "s", ["t", "id"], 3, ["g", "id"]).collect()
    assert sorted((r["g"] or "", r["place"], r["id"]) for r in got) == [("", 1, 7), ("p", 1, 6), ("p", 2, 3), ("p", 3, 2), ("q", 1, 8)]
    assert topn.top_per_group(df.limit(0), "g", "s", ["t"], 3).count() == 0
    assert "place" in topn.top_per_group(df, "g", "s", ["id"], 1, ["place"]).columns


def test_top_rows_of_a_hot_group(spark):
    df = spark.range(50_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 500)).alias("g"), (F.col("id") * 7919 % 1000).cast("double").alias("s"), "id")
    got = topn.top_per_group(df, "g", "s", ["id"], 5, ["g", "s", "id"])
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
    by = {}
    for r in df.collect():
        by.setdefault(r["g"], []).append((-r["s"], r["id"]))
    assert {g: sorted(v)[:5] for g, v in by.items()} == {g: sorted((-r["s"], r["id"]) for r in got.collect() if r["g"] == g) for g in by}


# terms


def brute_terms(rows):
    occ, rec = {}, {}
    for i, t in rows:
        for w in (t or "").split(" "):
            if w:
                occ[w] = occ.get(w, 0) + 1
                rec.setdefault(w, set()).add(i)
    return {w: (occ[w], len(rec[w])) for w in occ}


@pytest.mark.parametrize("batch", [3, 10_000])
def test_terms(spark, batch):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["the", "a", "bb", "ccc", f"w{i % 7}", "", "ü"]) for _ in range(rng.randint(0, 9)))) for i in range(300)]
    rows += [(5, "the the rep"), (5, "rep"), (400, None), (401, ""), (402, "x" * 30_000 + " the")]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "id long, txt string, term string, records int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {r["term"]: (r["occurrences"], r["records"]) for r in terms.term_counts(df, "id", "txt").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute_terms(rows)
    assert terms.term_counts(df.limit(0), "id", "txt").count() == 0


def test_marks(spark):
    df = spark.createDataFrame([(i, "the " + ("two " if i < 2 else "") + ("six" if i < 6 else "")) for i in range(100)] + [(200, None)], "id long, t string")
    got = {r["term"]: r["mark"] for r in terms.marked_terms(df, "id", "t").collect()}
    assert got == {"the": "common", "two": "rare", "six": "common"}
    five = spark.createDataFrame([(i, "x" if i < 5 else "y") for i in range(100)], "id long, t string")
    assert {r["term"]: r["mark"] for r in terms.marked_terms(five, "id", "t").collect()} == {"x": None, "y": "common"}


# copies

COPIES = [
    (3, "Die Straße, über  uns!"), (1, "DIE STRASSE ÜBER UNS"), (9, "die_strasse-über\tuns."), (4, "Die Strasse uber uns"),
    (10, "lang=de; file=a b; job=7; took=5ms"), (11, "job: 7 | took: 5MS | lang: DE | file: a b"), (12, "langde fileab job7 took5ms"), (13, "lang=de; file=a b; job=7; took=6ms"),
    (20, "a=1; b=2; c=3"), (21, "c=3; b=2; a=1"), (30, "..."), (31, "---"), (32, ""), (33, None), (40, "x"), (40, "x"),
]


@pytest.mark.parametrize("hot", [None, 1])
def test_copies(spark, hot):
    df = spark.createDataFrame([(*r, 1, "k") for r in COPIES], "id long, t string, keep_id int, _k string")
    got = {r["id"]: (r["keep_id"], r["copies"]) for r in copies.copy_groups(df, "id", "t", hot, 4).collect()}
    assert got == {3: (1, 3), 1: (1, 3), 9: (1, 3), 4: (4, 1), 10: (10, 3), 11: (10, 3), 12: (10, 3), 13: (13, 1), 20: (20, 1), 21: (21, 1), 40: (40, 2)}
    assert sorted(tuple(r) for r in copies.further_copies(df, "id", "t", hot).collect()) == [(1, 3), (1, 9), (10, 11), (10, 12)]
    assert sorted(tuple(r) for r in copies.collapsed(df, "id", "t", hot).collect()) == [(1, 3), (4, 1), (10, 3), (13, 1), (20, 1), (21, 1), (40, 2)]
    assert copies.copy_groups(df.limit(0), "id", "t").count() == 0


def test_hot_copies(spark):
    df = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, F.concat(F.lit("Same "), F.when(F.col("id") % 2 == 0, "LINE").otherwise("line!"))).otherwise(F.concat(F.lit("own "), F.col("id") % 9000)).alias("t"))
    one, two = (sorted(tuple(r) for r in copies.copy_groups(df, "id", "t", hot, 8).collect()) for hot in (10**9, 1000))
    assert one == two and (0, 0, 10_000) in one


def test_hot_fields_in_many_orders(spark):
    """A third of the rows are the same fields in other orders: no key of letters is hot, the key of fields is."""
    rng = random.Random(3)
    fields = [f"f{k}=v{k}" for k in range(8)]
    rows = [(i, "; ".join(rng.sample(fields, 8)) if i % 3 == 0 else f"own {i}") for i in range(1500)]
    got = {r["id"]: (r["keep_id"], r["copies"]) for r in copies.copy_groups(spark.createDataFrame(rows, "id long, t string"), "id", "t", 100, 8).collect()}
    assert got == {i: (0, 500) if i % 3 == 0 else (i, 1) for i in range(1500)}


# near lines


def brute_pairs(rows, t, least):
    sets = {i: frozenset(normalize_text(x).split()) for i, x in rows if x is not None}
    return {(a, b) for a, b in combinations(sorted(sets), 2) if min(len(sets[a]), len(sets[b])) >= least and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9}


def lines(rng, n, size, vocab, edits):
    base = [[f"w{rng.randrange(vocab)}" for _ in range(rng.randint(*size))] for _ in range(n // 4)]
    out = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, edits)):
            k = rng.randrange(3)
            if k == 0 and len(w) > 3:
                w.pop(rng.randrange(len(w)))
            elif k == 1:
                w[rng.randrange(len(w))] = f"w{rng.randrange(vocab)}"
            else:
                rng.shuffle(w)
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize(("t", "least", "size", "vocab"), [(0.7, 14, (14, 22), 60), (0.8, 5, (5, 12), 25), (0.7, 14, (40, 110), 400)])
def test_near_lines(spark, t, least, size, vocab):
    rows = lines(random.Random(size[1]), 160, size, vocab, 4)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows] + [(900, None, "", 0), (901, "", "", 0), (None, rows[0][1], "", 0)], "id long, txt string, a string, _id int")
    got = [tuple(r) for r in nearlines.near_pairs(df, "id", "txt", t, least).collect()]
    keys = {i: "".join(c for c in x if c.isalnum()) for i, x in rows}
    want = {p for p in brute_pairs(rows, t, least) if keys[p[0]] != keys[p[1]]}
    assert len(got) == len(set(got)) and set(got) == want and want
    assert nearlines.near_pairs(df.limit(0), "id", "txt", t, least).count() == 0


def met_rows(rng, n, keys):
    """Rows under a few keys, in the order in which they arrive."""
    k = (rng.integers(0, keys, n) << 16) | (rng.integers(14, 40, n) << 1) | 1
    bits = rng.integers(-(2**63), 2**63, n) & rng.integers(-(2**63), 2**63, n) & (0xFFFF - 2**63)
    order = np.argsort(k, kind="stable")
    return k[order], np.arange(n, dtype=np.int64), bits


def batches_of(rows, size):
    for s in range(0, len(rows[0]), size):
        yield pa.RecordBatch.from_arrays([pa.array(x[s : s + size]) for x in rows], names=["k", "rid", "bits"])


def compared(rows):
    """All pairs within a key, by definition."""
    out = set()
    k, rid, bits = rows
    for a, b in combinations(range(len(k)), 2):
        n, m = int(k[a] >> 1) & 0x7FFF, int(k[b] >> 1) & 0x7FFF
        if k[a] >> 16 == k[b] >> 16 and n >= 0.7 * m - 1e-9 and (n + m - (int(bits[a] ^ bits[b]) % 2**64).bit_count()) // 2 >= 0.7 / 1.7 * (n + m) - 1e-9:
            out.add((int(rid[a]), int(rid[b])))
    return out


@pytest.mark.parametrize("size", [1, 7, 64, 1000])
def test_sorted_keys_in_a_stream(size):
    rows = met_rows(np.random.default_rng(size), 300, 40)
    got = [p for x in nearlines._meet(0.7)(batches_of(rows, size)) for p in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True)]
    assert set(got) == compared(rows) and got


@pytest.mark.parametrize("size", [13, 60, 400])
def test_hot_key_in_tiles(spark, monkeypatch, size):
    """Rows under hot keys, given out in small tiles, make the pairs that all comparisons make; no task holds a key."""
    rows = met_rows(np.random.default_rng(5), 300, 3)
    monkeypatch.setattr(nearlines, "TILE", 16)
    monkeypatch.setattr(nearlines, "HOT", 50)
    met = pa.Table.from_batches(list(nearlines._meet(0.7)(batches_of(rows, size))), nearlines.MET_SCHEMA)
    assert met.column("tile").null_count == 0 and met.num_rows >= 18
    pairs = nearlines.tile_pairs(spark.createDataFrame(met), 0.7, 3)
    assert {tuple(r) for r in pairs.collect()} == compared(rows)


def test_huge_sets(spark):
    """Sets beyond the sizes that are told apart are compared exactly."""
    words = [f"w{i}" for i in range(40_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[1000:] + ["x"])), (3, " ".join(words[20_000:]))]
    df = spark.createDataFrame(rows, "id long, t string")
    assert [tuple(r) for r in nearlines.near_pairs(df, "id", "t").collect()] == [(1, 2)]


def test_many_equal_lines_meet_once(spark):
    text = " ".join(f"w{i}" for i in range(16))
    near = text.replace("w3 ", "other ")
    rows = [(i, text) for i in range(400)] + [(1000, near), (1001, " ".join(reversed(text.split())))]
    df = spark.createDataFrame(rows, "id long, t string")
    got = {tuple(r) for r in nearlines.near_pairs(df, "id", "t").collect()}
    assert got == {(i, 1000) for i in range(400)} | {(i, 1001) for i in range(400)} | {(1000, 1001)}


def test_near_groups_hold_every_line(spark):
    rng = random.Random(9)
    rows = lines(rng, 120, (5, 12), 25, 3)
    lone = [f"x{i}" for i in range(7)]
    rows += [(200, " ".join(lone)), (201, " ".join(reversed(lone))), (202, " ".join(lone[3:] + lone[:3])), (203, "y1 y2 y3 y4 y5"), (204, "y1 y2 y3 y4"), (200, " ".join(lone))]
    df = spark.createDataFrame([*rows, (205, None), (None, "z1 z2 z3 z4 z5")], "id long, txt string")
    got = [tuple(r) for r in nearlines.near_groups(df, "id", "txt", 0.8, 5).select("rec_id", "class_id", "group_id", "links").collect()]
    sets = {i: frozenset(normalize_text(x).split()) for i, x in rows}
    sets = {i: s for i, s in sets.items() if len(s) >= 5}
    rep = {i: min(j for j in sets if sets[j] == s) for i, s in sets.items()}
    links = {(a, b) for a, b in brute_pairs(rows, 0.8, 5) if rep[a] == a and rep[b] == b}
    root = dict(rep)
    while any(root[a] != root[b] for a, b in links):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    want = {i: (r, root[r], sum(r in p for p in links)) for i, r in rep.items()}
    assert links and len(got) == len(want) and {i: (c, g, n) for i, c, g, n in got} == want
    assert want[202][0] == 200 and want[203] == (203, 203, 0)
    assert nearlines.near_groups(df.limit(0), "id", "txt").count() == 0


@pytest.mark.parametrize("limit", [3, 10**6])
def test_components(spark, limit):
    rng = random.Random(limit)
    links = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(40)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(70)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long"), limit).collect()}
    root = {n: n for p in links for n in p}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    alone = {n for n in root if all(a == b or n not in (a, b) for a, b in links)}
    assert got == {n: r for n, r in root.items() if n not in alone}


# packing


def test_packing_invariants():
    rng = random.Random(2)
    for cap in (10, 97, 1000):
        docs = [(i, rng.choice([0, 1, cap, cap + 1, 3 * cap, rng.randint(1, cap), rng.randint(1, max(1, cap // 8))])) for i in range(400)]
        rows = packing.pack_shard(docs, cap)
        load, pieces = {}, {}
        for c, d, p, at, n in rows:
            load[c] = load.get(c, 0) + n
            pieces.setdefault(d, []).append((p, at, n))
        assert max(load.values()) <= cap
        for d, n in docs:
            own = sorted(pieces[d])
            assert sum(x[2] for x in own) == n and [x[1] for x in own] == [k * cap for k in range(len(own))]
            assert (len(own) > 1) == (n > cap)
        assert len(load) <= sum(n for _, n in docs) / cap * 1.06 + 2


def best(sizes, cap):
    """Fewest containers, by search."""
    sizes = sorted(sizes, reverse=True)
    low = [len(sizes)]

    def go(i, rooms):
        if len(rooms) >= low[0]:
            return
        if i == len(sizes):
            low[0] = len(rooms)
            return
        for r in sorted({x for x in rooms if x >= sizes[i]}):
            k = rooms.index(r)
            go(i + 1, rooms[:k] + [r - sizes[i]] + rooms[k + 1 :])
        go(i + 1, rooms + [cap - sizes[i]])

    go(0, [])
    return low[0]


def test_fixed_sets_cost_nothing():
    """Putting a dominating set aside leaves an instance whose optimum is one less."""
    rng = random.Random(4)
    fixed = 0
    for _ in range(150):
        cap = rng.randint(8, 30)
        sizes = [rng.randint(1, cap) for _ in range(8)]
        left = packing.Sizes(sizes)
        j = max(sizes)
        left.take(j)
        s = packing.dominant_set(left, j, cap)
        if s is None:
            continue
        fixed += 1
        rest = list(sizes)
        for x in (j, *s):
            rest.remove(x)
        assert best(rest, cap) == best(sizes, cap) - 1, (sizes, cap, s)
    assert fixed > 50


def test_whole_reduction_costs_nothing():
    """All sets put aside together, by search: what is left needs just the other containers."""
    assert packing.pack_sizes([45, 10, 10, 10], 100) == [[45, 10, 10, 10]]
    rng = random.Random(6)
    fixed = several = extra = 0
    for _ in range(200):
        cap = rng.randint(8, 60)
        sizes = [rng.randint(1, max(2, cap * rng.choice([1, 2]) // 3)) for _ in range(9)]
        done, rest = packing.reduced(sizes, cap)
        fewest = best(sizes, cap)
        assert sorted([*rest, *(s for c in done for s in c)]) == sorted(sizes) and all(sum(c) <= cap for c in done)
        assert len(done) + best(rest, cap) == fewest, (sizes, cap, done)
        containers = packing.pack_sizes(sizes, cap)
        assert sorted(s for c in containers for s in c) == sorted(sizes) and all(sum(c) <= cap for c in containers)
        fixed, several, extra = fixed + len(done), several + bool(done and rest), extra + len(containers) - fewest
    assert fixed > 50 and several > 20 and extra <= 10


def test_packed_table(spark):
    text = "word " * 50
    docs = spark.createDataFrame([(1, text, 9), (2, None, 9), (3, "", 9), (4, "hi there", 9), (4, "hi there", 9), (None, "x", 9), (5, "x <|endoftext|> y", 9)], "doc_id long, text string, container int")
    caps = spark.createDataFrame([(1, 20), (2, 1000), (3, None), (None, 5), (4, 0)], "capacity_id long, max_tokens long")
    rows = packing.packed(docs, "doc_id", "text", caps, TOKENIZER).collect()
    by = {}
    for r in rows:
        by.setdefault((r["capacity_id"], r["container"]), []).append(r["tokens"])
    assert {c for c, _ in by} == {1, 2} and all(sum(v) <= {1: 20, 2: 1000}[c] for (c, _), v in by.items())
    assert sorted(r["piece"] for r in rows if r["capacity_id"] == 1 and r["doc_id"] == 1) == [0, 1, 2]
    assert sum(r["doc_id"] == 4 for r in rows) == 4
    assert packing.packed(docs.limit(0), "doc_id", "text", caps, TOKENIZER).count() == 0 and packing.packed(docs, "doc_id", "text", caps.limit(0), TOKENIZER).count() == 0
    with pytest.raises(ValueError):
        packing.packed(docs, "doc_id", "text", caps, TOKENIZER, most_capacities=1)
