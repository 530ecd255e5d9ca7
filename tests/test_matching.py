import random

import pytest
from pyspark.sql import functions as F

from quillspan.functions import matching as m
from quillspan.functions.text import normalize_text
from quillspan.operators.completion import batch_completions, best_completions, display_order, matches, observed_completions, suggestion_lines

GOLDEN = "To be or not to be, that is the question."


def brute(q, s):
    """By definition: the best score over all windows and single edits."""
    if not q:
        return None
    n = len(q)
    best = 2 * n if q in s else None

    def take(v):
        nonlocal best
        best = v if best is None else max(best, v)

    for a in range(len(s) + 1):
        for p in range(1, n + 1):
            w = s[a : a + n]
            if len(w) == n and w[: p - 1] == q[: p - 1] and w[p:] == q[p:]:
                take(2 * (n - 1) - m.edit_penalty("substitution", p) if w != q else 2 * n)
            if s[a : a + n - 1] == q[: p - 1] + q[p:]:
                take(2 * (n - 1) - m.edit_penalty("deletion", p))
            w = s[a : a + n + 1]
            if len(w) == n + 1 and p > 1 and w[: p - 1] + w[p:] == q:
                take(2 * n - m.edit_penalty("insertion", p))
    return best


def gated(q, s):
    return q in s or any(q[i : i + 3] in s for i in range(len(q) - 2))


@pytest.mark.parametrize(
    ("query", "expected"),
    [("To be", 10), ("or Not", 12), ("be, that", 14), ("2o be", 3), ("to pe", 6), ("or knot", 8), ("or nt", 8), ("not be", None), ("2o pe", None)],
)
def test_golden(sentences, query, expected):
    rows = best_completions(sentences([GOLDEN]), query).collect()
    assert [r["score"] for r in rows] == ([] if expected is None else [expected])


@pytest.mark.parametrize(("query", "kind", "place"), [("2o be", "substitution", 1), ("to pe", "substitution", 4), ("or knot", "deletion", 4), ("or nt", "insertion", 5), ("to be", "exact", None)])
def test_kind_of_match(sentences, query, kind, place):
    r = sentences([GOLDEN]).select(m.match(query, F.col("normalized_text")).alias("m")).first()["m"]
    assert (r["edit_type"], r["edit_position"]) == (kind, place)


@pytest.mark.parametrize("position", [1, 2, 3, 4, 5, 6, 100])
def test_penalties(spark, position):
    place = min(position, 5) - 1
    expected = {"exact": 0, "substitution": [5, 4, 3, 2, 1][place], "insertion": [10, 8, 6, 4, 2][place], "deletion": [10, 8, 6, 4, 2][place]}
    df = spark.createDataFrame([(k, position) for k in expected], "k string, p int")
    got = {r["k"]: r["v"] for r in df.select("k", m.edit_penalty_column(F.col("k"), F.col("p")).alias("v")).collect()}
    assert got == expected == {k: m.edit_penalty(k, position) for k in expected}


def test_unknown_edit():
    with pytest.raises(ValueError):
        m.edit_penalty("swap", 1)


def test_random_pairs_against_definition(spark):
    rng = random.Random(7)
    pairs = []
    for alphabet in ("ab ", "abc ", "abcdef "):
        for _ in range(160):
            q = normalize_text("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 9))))
            s = normalize_text("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 22))))
            if q:
                pairs.append((q, s))
    for q, s in pairs:
        expected = brute(q, s)
        assert m.Compiled(q).score(s, strict_recall=True) == expected, (q, s)
        assert m.Compiled(q).score(s) == (expected if gated(q, s) else None)
    by = {}
    for q, s in pairs:
        by.setdefault(q, []).append(s)
    for q in list(by)[:12]:
        df = spark.createDataFrame([(s,) for _, s in pairs[:80]], "s string")
        got = [r["v"] for r in df.select(m.score(q, F.col("s")).alias("v")).collect()]
        assert got == [brute(q, s) for _, s in pairs[:80]], q


def test_half_split_loses_nothing(sentences):
    rng = random.Random(3)
    rows = sentences(["".join(rng.choice("abc ") for _ in range(20)) for _ in range(120)])
    for q in ("abcabc", "ab cab", "cc ab", "a b"):
        want = {r["offset"]: brute(q, r["normalized_text"]) for r in rows.collect() if gated(q, r["normalized_text"])}
        got = {r["offset"]: r["score"] for r in matches(rows, q).collect()}
        assert got == {k: v for k, v in want.items() if v is not None}


def test_short_queries_keep_their_limits(sentences):
    assert best_completions(sentences(["cat"]), "cot").isEmpty()
    assert not best_completions(sentences(["cat"]), "cot", strict_recall=True).isEmpty()
    assert best_completions(sentences(["abc"]), "x").isEmpty()


def test_substitution_needs_a_character(sentences):
    assert best_completions(sentences(["o be or"]), "2o be or").first()["score"] == 2 * 7 - 10


def test_ties_order_and_limits(sentences):
    lines = [f"{c} common word" for c in "gfedcba"]
    assert [r[0] for r in best_completions(sentences(lines), "common").collect()] == [f"{c} common word" for c in "abcde"]
    same = best_completions(sentences(["repeat me exactly"] * 2), "repeat me exactly").collect()
    assert [(r["offset"], r["score"]) for r in same] == [(0, 34), (1, 34)]
    two = best_completions(sentences(["exakt match here", "exact match here"]), "exact").collect()
    assert [r[0] for r in two] == ["exact match here", "exakt match here"] and two[0]["score"] > two[1]["score"]


@pytest.mark.parametrize("query", ["", "   ...   ", "שלום"])
def test_empty_query(sentences, query):
    df = best_completions(sentences([GOLDEN]), query)
    assert df.collect() == [] and df.columns == ["completed_sentence", "source_text", "offset", "score"]


@pytest.mark.parametrize("query", ["don't", "dont", "DON'T", "don't    know"])
def test_punctuation(sentences, query):
    assert best_completions(sentences(["I don't know the answer."]), query).count() == 1


def test_staged_equals_plain(sentences):
    lines = [f"line {i} of the harbor" for i in range(9)] + ["the harbr", "tha harbor"]
    for q in ("the harbor", "the harxor", "line 3 of", "zzz qqq"):
        rows = sentences(lines)
        assert best_completions(rows, q, staged=True).collect() == best_completions(rows, q).collect()


def test_display_order_is_within_the_chosen(sentences):
    lines = ["b match", "A match", "C match", "a match", "B match", "c match"]
    best = best_completions(sentences(lines), "match")
    assert [r[0] for r in best.collect()] == ["A match", "B match", "C match", "a match", "b match"]
    assert [(r["rank"], r["completed_sentence"]) for r in display_order(best).orderBy("rank").collect()] == [(1, "A match"), (2, "a match"), (3, "B match"), (4, "b match"), (5, "C match")]
    assert display_order(best, 2).count() == 2 and display_order(best, 0).count() == 5
    assert suggestion_lines(display_order(best)).orderBy("rank").first()["line"] == "1. A match (synthetic.txt:1, score=10)"


def test_batch_equals_single(spark, sentences):
    rng = random.Random(11)
    words = ["harbor", "quiet", "lantern", "of", "the", "a", "bridge", "moved"]
    rows = sentences([" ".join(rng.choice(words) for _ in range(6)) for _ in range(200)])
    asked = ["the quet", "harbor", "brdg", "of", "q", "", "lantren", "quiet bridge mo", "xx yy zz", "the th"]
    got = {}
    for r in batch_completions(rows, spark.createDataFrame([*enumerate(asked), (99, None)], "query_id long, query string")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], *r[2:]))
    for i, q in enumerate(asked):
        want = [(k, *r) for k, r in enumerate(best_completions(rows, q).collect(), 1)]
        assert sorted(got.get(i, [])) == want, q
    assert 99 not in got


def test_observed(sentences):
    df, seen = observed_completions(sentences([GOLDEN, "nothing at all", "to be sure"]), "to be")
    assert df.count() == 2 and seen.get == {"candidates": 2, "verified": 2}


def test_plan_takes_ordered(sentences):
    plan = best_completions(sentences([GOLDEN]), "to be")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Python" not in plan
