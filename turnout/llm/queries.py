"""Registered queries of the operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnout.llm import periodic_runs, secret_scan
from turnout.llm.binary_codes import search
from turnout.llm.byte_bpe import digests
from turnout.llm.common import saved, table
from turnout.llm.hard_negatives import HIGH, LOW, SCALE, hard_negatives
from turnout.llm.html_text import extract
from turnout.llm.licenses import scan
from turnout.llm.near_duplicates import near_duplicates
from turnout.llm.packing import pack
from turnout.llm.quality_rules import ENOUGH, FENCE, MAX_REPEATED, MIN_WORDS, OUTER, STEPS, rated, verdicts
from turnout.llm.substring_dedup import repeated_spans
from turnout.llm.token_counts import token_counts
from turnout.llm.toxicity import fit, score

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_spans(table(spark, folder, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL["op1_substring_dedup"] = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 49), ' ') AS k
  FROM w, unnest(range(1, len(ws) - 48)) AS u(i) WHERE len(ws) >= 50
), hit AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS source FROM win) WHERE source < doc_id
), gone AS (SELECT DISTINCT doc_id, i + j AS p FROM hit, unnest(range(0, 50)) AS u(j)
), gl AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
  sha256(CASE WHEN ps IS NULL THEN array_to_string(ws, ' ')
    ELSE array_to_string(list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda x: NOT list_contains(ps, x[2])), lambda x: x[1]), ' ') END) AS kept_sha256
FROM w LEFT JOIN gl USING (doc_id)
"""


@query
def op2_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return scan(table(spark, folder, "documents"))


@query
def op3_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return extract(table(spark, folder, "pages"))


@query
def op4_binary_codes(spark: SparkSession, folder: str) -> DataFrame:
    return search(table(spark, folder, "embeddings"))


@query
def op5_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return digests(table(spark, folder, "documents"), path, public_tokenizers.PATTERN)


@query
def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "text")
    found = verdicts(saved(rated(docs).drop("text")))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op8_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


@query
def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return score(docs, fit(docs, table(spark, folder, "labels"))).select("doc_id", "held_out", "score", "predicted")


@query
def op11_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.digests(table(spark, folder, "documents"))


@query
def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs.digests(table(spark, folder, "documents"), periodic_runs.planted)


@query
def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return hard_negatives(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


def _secrets_sql() -> str:
    """Places of matches from the texts between them; short runs of hex digits are left out at once."""
    parts = []
    for k, r in enumerate(secret_scan.RULES):
        pattern, least = (r.pattern.replace("+", f"{{{r.least},}}"), 0) if r.kind == "hex" else (r.pattern, r.least)
        pattern = pattern.replace("'", "''")
        parts.append(
            f"SELECT doc_id, {k} AS k, '{r.kind}' AS kind, {least} AS least, string_split_regex(x, '{pattern}') AS gaps, "
            f"regexp_extract_all(x, '{pattern}') AS ms, regexp_extract_all(x, '{pattern}', {r.group}) AS gs FROM t"
        )
    base = len(secret_scan.BASE)
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
m AS ({" UNION ALL ".join(parts)}
), f AS (
  SELECT doc_id, k, kind, least, length(gs[i]) AS size, length(ms[i]) AS n,
    list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda g: length(g))), 0) AS a
  FROM m, unnest(range(1, len(ms) + 1)) AS u(i)
), s AS (SELECT doc_id, k, a, concat(kind, ':', a::BIGINT, ':', (a + n)::BIGINT) AS said FROM f WHERE size >= least)
SELECT t.doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  sha256(coalesce(string_agg(said, ',' ORDER BY a, k) FILTER (k < {base}), '')) AS base_sha256, coalesce(string_agg(said, ',' ORDER BY a, k), '') AS spans
FROM t LEFT JOIN s USING (doc_id) GROUP BY t.doc_id
"""


SQL["op11_secret_scan"] = _secrets_sql()

SQL["op13_hard_negatives"] = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id, list_inner_product(a.e, c.e)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id AND len(a.e) = len(c.e)
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND {LOW} * positive_score <= {HIGH} * score AND {HIGH} * score <= {HIGH} * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""

SQL["op4_binary_codes"] = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.e, c.e) DESC, c.vec_id) AS rank
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
) WHERE rank <= 20
"""

_SHARES = {"mean_word": "word_chars / w1", "symbol_share": "n_symbols / c1", "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
           "repeat_share": "n_repeat_words / w1", "caps_share": "n_caps / c1"}


def _fences(keys: str, name: str) -> str:
    """Exact quantiles, as the sketches have up to SKETCH_K documents."""
    cols = ", ".join(
        f"round(quantile_disc({m}, 0.5) + {FENCE} * greatest(quantile_disc({m}, {OUTER}) - quantile_disc({m}, 0.5), {least}), 2) AS f_{m}"
        for m, least in STEPS.items()
    )
    return f"{name} AS (SELECT {keys + ', ' if keys else ''}count(*) AS n, {cols} FROM rated WHERE NOT base_failed {'GROUP BY ' + keys if keys else ''})"


SQL["op9_quality_rules"] = rf"""
WITH t AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS x,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS k FROM t, unnest(range(1, len(ws) - 6)) AS u(i) WHERE len(ws) >= 8
), twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1
), rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, unnest(range(0, 8)) AS u(j) GROUP BY doc_id
), base AS (
  SELECT t.doc_id, lang, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(x, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(regexp_extract_all(x, '\p{{Lu}}')) AS n_caps
  FROM t LEFT JOIN rep USING (doc_id)
), failed AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed,
    greatest(n_words, 1)::DOUBLE AS w1, greatest(word_chars, 1)::DOUBLE AS c1 FROM base
), rated AS (SELECT *, {", ".join(f"({e})::DOUBLE AS {m}" for m, e in _SHARES.items())} FROM failed
), {_fences("lang, source", "own")}, {_fences("lang", "by_lang")}, {_fences("", "whole")}
SELECT r.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(f"{m} <= CASE WHEN own.n >= {ENOUGH} THEN own.f_{m} WHEN by_lang.n >= {ENOUGH} THEN by_lang.f_{m} ELSE whole.f_{m} END" for m in STEPS)} AS kept
FROM rated r LEFT JOIN own ON own.lang IS NOT DISTINCT FROM r.lang AND own.source IS NOT DISTINCT FROM r.source
LEFT JOIN by_lang ON by_lang.lang IS NOT DISTINCT FROM r.lang, whole
"""
