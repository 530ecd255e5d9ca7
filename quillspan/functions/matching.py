"""Matching with at most one edit, compiled from the query.

A normalized query of n characters matches a line in one of these ways, each a plain search in the line: as it stands
(score 2n); with its p-th character replaced by any (2(n-1) less the penalty of a substitution at p); with its p-th
character left out (2(n-1) less that of a deletion); with any character put in before its p-th one, p > 1 (2n less that of an
insertion). The score is the best of the ways that occur, so a CASE over searches in order of score computes it - no UDF.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trigrams_of

# Penalties at the first positions, and at all later ones.
SUBSTITUTION, SUBSTITUTION_LATER = (5, 4, 3, 2), 1
SHIFT, SHIFT_LATER = (10, 8, 6, 4), 2
SHORT_QUERY = 5


def edit_penalty(edit_type: str, position: int | None) -> int:
    """What an edit at a position (from 1) costs."""
    if edit_type == "exact":
        return 0
    if edit_type not in ("substitution", "insertion", "deletion"):
        raise ValueError(f"unknown edit type: {edit_type}")
    if position is None or position < 1:
        raise ValueError("an edit has a position from 1 on")
    early, later = (SUBSTITUTION, SUBSTITUTION_LATER) if edit_type == "substitution" else (SHIFT, SHIFT_LATER)
    return early[position - 1] if position <= len(early) else later


def edit_penalty_column(edit_type: Column, position: Column) -> Column:
    """``edit_penalty`` over columns; an unknown type raises."""

    def by_place(early: tuple[int, ...], later: int) -> Column:
        return F.coalesce(F.try_element_at(F.array(*map(F.lit, early)), position), F.lit(later))

    return (
        F.when(edit_type == "exact", F.lit(0))
        .when(edit_type == "substitution", by_place(SUBSTITUTION, SUBSTITUTION_LATER))
        .when(edit_type.isin("insertion", "deletion"), by_place(SHIFT, SHIFT_LATER))
        .otherwise(F.raise_error(F.concat(F.lit("unknown edit type: "), edit_type)).cast("int"))
    )


@dataclass(frozen=True)
class Variant:
    """One way to match: what is searched for (``.`` stands for any character) and what it scores."""

    score: int
    edit_type: str
    position: int | None
    matching_characters: int
    pattern: str

    @property
    def literal(self) -> bool:
        return "." not in self.pattern

    def condition(self, line: Column) -> Column:
        return line.contains(self.pattern) if self.literal else line.rlike(self.pattern)


@lru_cache(4096)
def variants(query: str) -> tuple[Variant, ...]:
    """All ways a normalized query can match, best first; of equal scores substitution, deletion, insertion."""
    n = len(query)
    if not n:
        return ()
    out = [Variant(2 * n, "exact", None, n, query)]
    for p in range(1, n + 1):
        head, tail = query[: p - 1], query[p:]
        out.append(Variant(2 * (n - 1) - edit_penalty("substitution", p), "substitution", p, n - 1, f"{head}.{tail}"))
        out.append(Variant(2 * (n - 1) - edit_penalty("deletion", p), "deletion", p, n - 1, head + tail))
        if p > 1:
            out.append(Variant(2 * n - edit_penalty("insertion", p), "insertion", p, n, f"{head}.{query[p - 1:]}"))
    rank = ("exact", "substitution", "deletion", "insertion")
    return tuple(sorted(out, key=lambda v: (-v.score, rank.index(v.edit_type), v.position or 0)))


def by_score(query: str) -> list[tuple[int, list[str], list[str]]]:
    """Per score, from the best on: the texts to look for, and the patterns."""
    groups: dict[int, tuple[list[str], list[str]]] = {}
    for v in variants(query):
        groups.setdefault(v.score, ([], []))[0 if v.literal else 1].append(v.pattern)
    return [(s, list(dict.fromkeys(a)), list(dict.fromkeys(b))) for s, (a, b) in sorted(groups.items(), reverse=True)]


def score(query: str, line: Column) -> Column:
    """The best score of a normalized query in a normalized line; null if it doesn't match with one edit at most."""
    case = None
    for points, texts, patterns in by_score(query):
        tests = [line.contains(t) for t in texts] + ([line.rlike("|".join(patterns))] if patterns else [])
        test = reduce(lambda a, b: a | b, tests)
        case = F.when(test, points) if case is None else case.when(test, points)
    return F.lit(None).cast("int") if case is None else case.cast("int")


def score_sql(query: str, line: str) -> str:
    """The same as a SQL expression for DuckDB."""
    parts = []
    for points, texts, patterns in by_score(query):
        tests = [f"contains({line}, '{t}')" for t in texts] + ([f"regexp_matches({line}, '{'|'.join(patterns)}')"] if patterns else [])
        parts.append(f"WHEN {' OR '.join(tests)} THEN {points}")
    return f"CASE {' '.join(parts)} END" if parts else "CAST(NULL AS INTEGER)"


def match(query: str, line: Column) -> Column:
    """``struct(edit_type, edit_position, matching_characters)`` of the best way to match; null if there is none."""
    case = None
    for v in variants(query):
        value = F.struct(F.lit(v.edit_type).alias("edit_type"), F.lit(v.position).cast("int").alias("edit_position"), F.lit(v.matching_characters).alias("matching_characters"))
        case = F.when(v.condition(line), value) if case is None else case.when(v.condition(line), value)
    kind = "struct<edit_type:string,edit_position:int,matching_characters:int>"
    return F.lit(None).cast(kind) if case is None else case.cast(kind)


def halves(query: str) -> tuple[str, str]:
    """One edit leaves one of the two halves whole."""
    return query[: len(query) // 2], query[len(query) // 2 :]


def gate(query: str, line: Column, strict_recall: bool = False) -> Column:
    """Whether a line is a candidate: it holds the query or one of its trigrams.

    For six characters or more no match is lost. Shorter queries do lose some (one or two characters only match as they
    stand); that is the defined behaviour, and ``strict_recall`` lifts it.
    """
    if strict_recall:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [line.contains(t) for t in (query, *trigrams_of(query))])


def may_match(query: str, line: Column, strict_recall: bool = False) -> Column:
    """The gate, and that one half of the query is whole: what any match needs, cheaper than the match."""
    if len(query) < 2:
        return gate(query, line, strict_recall)
    a, b = halves(query)
    whole = line.contains(a) | line.contains(b)
    return whole if strict_recall else whole & gate(query, line)


def gate_sql(query: str, line: str) -> str:
    return "(" + " OR ".join(f"contains({line}, '{t}')" for t in (query, *trigrams_of(query))) + ")"


@lru_cache(4096)
def any_pattern(query: str) -> str:
    """One pattern for every way to match (two characters or more). The half that an edit leaves whole stands outside the
    alternatives, so a search mostly compares one literal."""
    a, b = halves(query)
    later, earlier = [], []
    for v in variants(query):
        if v.position is None or v.position > len(a):
            later.append(v.pattern[len(a) :])
        else:
            earlier.append(v.pattern[: len(v.pattern) - len(b)])
    return f"{a}(?:{'|'.join(dict.fromkeys(later))})|(?:{'|'.join(dict.fromkeys(earlier))}){b}"


class Compiled:
    """A query's searches for Python, where every row has a query of its own."""

    def __init__(self, query: str) -> None:
        self.query = query
        self.halves = halves(query)
        self.gates = (query, *trigrams_of(query))
        self.groups = [(s, a, re.compile("|".join(b)) if b else None) for s, a, b in by_score(query)]
        self.any = re.compile(any_pattern(query)) if len(query) > 1 else None

    def score(self, line: str, strict_recall: bool = False) -> int | None:
        if not self.query or not strict_recall and not any(g in line for g in self.gates):
            return None
        if len(self.query) > 1 and self.halves[0] not in line and self.halves[1] not in line:
            return None
        if self.any and not self.any.search(line):
            return None
        for points, texts, pattern in self.groups:
            if any(t in line for t in texts) or pattern is not None and pattern.search(line):
                return points
        return None
