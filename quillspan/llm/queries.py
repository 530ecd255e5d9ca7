"""The pN_ queries and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NORMALIZED, table

#: The vocabulary file that sizes are measured with.
TOKENIZER = os.environ.get("QUILLSPAN_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


TIES = ["completed_sentence", "source_text", "offset", "result_id"]


@query
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    from .topn import top_per_group

    return top_per_group(table(spark, sf, "completions"), "prefix", "score", TIES, 5, ["prefix", "result_id"]).select("prefix", "result_id")


ORACLES["p2_found"] = """
SELECT prefix, result_id FROM completions WHERE score IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY prefix ORDER BY score DESC, completed_sentence NULLS FIRST, source_text NULLS FIRST,
 "offset" NULLS FIRST, result_id NULLS FIRST) <= 5"""


@query
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    from .terms import marked_terms

    return marked_terms(table(spark, sf, "sentences"), "sentence_id", "normalized_text").where(F.col("mark").isNotNull()).select("term", "mark")


@query
def p5_counts(spark: SparkSession, sf: str) -> DataFrame:
    from .terms import term_counts

    return term_counts(table(spark, sf, "sentences"), "sentence_id", "normalized_text")


_TERMS = """
WITH w AS (SELECT sentence_id, unnest(string_split(normalized_text, ' ')) AS term FROM sentences WHERE normalized_text IS NOT NULL),
c AS (SELECT term, count(*) AS occurrences, count(DISTINCT sentence_id) AS records FROM w WHERE term <> '' GROUP BY term)
"""
ORACLES["p5_counts"] = _TERMS + "SELECT term, occurrences, records FROM c"
ORACLES["p5_found"] = _TERMS + """
SELECT term, CASE WHEN records <= 2 THEN 'rare' ELSE 'common' END AS mark FROM c
WHERE records <= 2 OR records > 0.05 * (SELECT count(*) FROM sentences WHERE normalized_text IS NOT NULL)"""


@query
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    from .copies import further_copies

    return further_copies(table(spark, sf, "sentences"), "sentence_id", "original_text")


@query
def p6_collapsed(spark: SparkSession, sf: str) -> DataFrame:
    from .copies import collapsed

    return collapsed(table(spark, sf, "sentences"), "sentence_id", "original_text")


def _both(f: Callable[..., DataFrame], spark: SparkSession, sf: str, parts: list[tuple[str, str, str]]) -> DataFrame:
    """One operator over several tables, with the table's name in front."""
    out = [f(table(spark, sf, t), i, c).select(F.lit(t).alias("tbl"), "*") for t, i, c in parts]
    return out[0].unionByName(out[1])


GARBLED = [("sentences", "sentence_id", "original_text"), ("raw_lines", "line_id", "source_path")]
ALIKE = [("sentences", "sentence_id", "original_text"), ("search_requests", "request_id", "query")]


@query
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    from .encoding import garbled

    return _both(garbled, spark, sf, GARBLED).select("tbl", "rec_id")


@query
def p1_repaired(spark: SparkSession, sf: str) -> DataFrame:
    from .encoding import garbled

    return _both(garbled, spark, sf, GARBLED)


@query
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """The rows with such characters, less those that the search for wrong encodings finds among them."""
    from .encoding import garbled_rows
    from .lookalikes import look_alike

    return garbled_rows(_both(look_alike, spark, sf, ALIKE), "text", False).select("tbl", "rec_id").distinct()


@query
def p3_one_form(spark: SparkSession, sf: str) -> DataFrame:
    from .lookalikes import one_form

    return _both(one_form, spark, sf, ALIKE).select("tbl", "rec_id", "text")


@query
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    from .nearlines import near_pairs

    return near_pairs(table(spark, sf, "sentences"), "sentence_id", "original_text")


@query
def p4_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Every line of enough words with its class of equal word sets, its group of similar ones, and its class's links."""
    from .nearlines import near_groups

    return near_groups(table(spark, sf, "sentences"), "sentence_id", "original_text")


@query
def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    from .pairs import defective

    return defective(*(table(spark, sf, t) for t in ("search_requests", "search_responses", "suggestions")))


def _leaks(f: Callable[..., DataFrame], spark: SparkSession, sf: str) -> DataFrame:
    return f(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "benchmark"), "item_id", "text")


@query
def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    from .leaks import leaked_passages

    return _leaks(leaked_passages, spark, sf)


@query
def p9_alignments(spark: SparkSession, sf: str) -> DataFrame:
    from .leaks import leaks

    return _leaks(leaks, spark, sf)


@query
def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """The documents that the packing cuts."""
    return p8_packed(spark, sf).where(F.col("piece") == 1).select("capacity_id", "doc_id")


@query
def p8_packed(spark: SparkSession, sf: str) -> DataFrame:
    from .packing import packed

    return packed(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "capacities"), TOKENIZER)


@query
def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Containers used per capacity, and the share of their room that is filled."""
    used = p8_packed(spark, sf).groupBy("capacity_id").agg(F.countDistinct("container").alias("containers"), F.sum("tokens").alias("tokens"))
    caps = table(spark, sf, "capacities").select("capacity_id", "max_tokens")
    return used.join(caps, "capacity_id").select("capacity_id", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("max_tokens"))).alias("filled"))


@query
def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    from .personal import personal_data

    return personal_data(table(spark, sf, "documents"), "doc_id", "text").select("doc_id", "kind", "start_pos")


@query
def p10_redacted(spark: SparkSession, sf: str) -> DataFrame:
    from .personal import redacted

    return redacted(table(spark, sf, "documents"), "doc_id", "text")


_FOLDED = "regexp_replace(replace(lower({c}), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
_FIELD = "^[^\\p{L}\\p{N}]*([\\p{L}_][\\p{L}\\p{N}_.\\-]*)\\s*[=:]\\s*([^=:;|,]*[\\p{L}\\p{N}][^=:;|,]*)$"
_GROUPS = f"""
WITH t AS (SELECT sentence_id, original_text, {_FOLDED.format(c='original_text')} AS k, list_filter(string_split_regex(original_text, '[;|,\\t\\n\\r]+'), lambda p: regexp_matches(p, '[\\p{{L}}\\p{{N}}]')) AS parts FROM sentences WHERE original_text IS NOT NULL),
u AS (SELECT sentence_id, k, CASE WHEN len(parts) >= 4 AND len(list_filter(parts, lambda p: regexp_full_match(p, '{_FIELD[1:-1]}'))) = len(parts)
 THEN 'f:' || array_to_string(list_sort(list_transform(parts, lambda p: {_FOLDED.format(c=f"regexp_extract(p, '{_FIELD}', 1)")} || '=' || {_FOLDED.format(c=f"regexp_extract(p, '{_FIELD}', 2)")})), ';') END AS f FROM t WHERE k <> ''),
l AS (SELECT k, min(f) AS g FROM u WHERE f IS NOT NULL GROUP BY k),
c AS (SELECT sentence_id, coalesce(g, u.k) AS c FROM u LEFT JOIN l ON u.k = l.k),
m AS (SELECT sentence_id, min(sentence_id) OVER (PARTITION BY c) AS keep_id, count(*) OVER (PARTITION BY c) AS copies FROM c)
"""
ORACLES["p6_found"] = _GROUPS + "SELECT keep_id, sentence_id AS copy_id FROM m WHERE keep_id <> sentence_id"
ORACLES["p6_collapsed"] = _GROUPS + "SELECT keep_id, copies FROM m WHERE keep_id = sentence_id"
ORACLES["p9_found"] = """
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
v AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark),
a AS (SELECT doc_id, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w)),
b AS (SELECT item_id, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS i FROM v))
SELECT DISTINCT doc_id, item_id FROM a JOIN b USING (g)"""
# all pairs of lines by the words they share; in groups, lines of equal words are one node
_SETS = f"""s AS (SELECT sentence_id, list_sort(list_distinct(string_split({NORMALIZED.format(c="original_text").replace("'')", "'', 'g')").replace("' ')", "' ', 'g')")}, ' '))) AS w FROM sentences WHERE original_text IS NOT NULL),
b AS (SELECT sentence_id, w FROM s WHERE len(w) >= 14)
"""
_SIMILAR = """
x AS (SELECT {id} AS i, len(w) AS n, unnest(w) AS t FROM {of}),
p AS (SELECT a.i AS a, b.i AS b FROM x a JOIN x b ON a.t = b.t AND a.i < b.i AND a.n >= 0.7 * b.n AND b.n >= 0.7 * a.n GROUP BY a.i, b.i, a.n, b.n HAVING count(*) >= 0.7 * (a.n + b.n - count(*)) - 1e-9)
"""
ORACLES["p4_found"] = _GROUPS + ", " + _SETS + ", " + _SIMILAR.format(id="sentence_id", of="b") + """
SELECT a AS id_a, b AS id_b FROM p JOIN m x ON x.sentence_id = a JOIN m y ON y.sentence_id = b WHERE x.keep_id <> y.keep_id"""
ORACLES["p4_groups"] = "WITH RECURSIVE " + _SETS + ", c AS (SELECT w, min(sentence_id) AS rep FROM b GROUP BY w), " + _SIMILAR.format(id="rep", of="c") + """,
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(n, g) AS (SELECT rep, rep FROM c UNION SELECT e.b, r.g FROM r JOIN e ON e.a = r.n),
g AS (SELECT n, min(g) AS g FROM r GROUP BY n),
k AS (SELECT a, count(*) AS links FROM e GROUP BY a)
SELECT sentence_id AS rec_id, rep AS class_id, g AS group_id, coalesce(links, 0) AS links FROM b JOIN c USING (w) JOIN g ON g.n = rep LEFT JOIN k ON k.a = rep"""
# sizes keep well away from each limit, so four bytes a token tell the same documents
ORACLES["p8_found"] = "SELECT capacity_id, doc_id FROM documents, capacities WHERE strlen(text) / 4.0 > max_tokens"
