"""The package's queries and, where SQL can express them, the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import html_text, jaccard, langid, licenses, mixing, pieces, quality, sharding, token_files, topk
from .common import ship, spread, table


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _on(name: str, query: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spread(table(spark, sf_dir, name)))

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_text": _on("pages", html_text.op1),
        "op2_token_files": _on("documents", lambda d: token_files.op2(d, tokenizer_path("word_bpe_49k.json"))),
        "op3_quality_rules": _on("documents", quality.op3),
        "op4_source_mix": _on("documents", mixing.op4),
        "op5_language_id": _on("documents", langid.op5),
        "op6_piece_sampling": _on("documents", lambda d: pieces.op6(d, tokenizer_path("piece_bpe_32k.model"))),
        "op7_top_k": _on("embeddings", topk.op7),
        "op8_jaccard_join": _on("documents", jaccard.op8),
        "op9_license_scan": _on("documents", licenses.op9),
        "op10_shards": _on("documents", sharding.op10),
    }


def _rule_sql(rule: quality.Rule) -> str:
    tests = [f"100 * {rule.part} < {rule.low} * {rule.whole}"] * (rule.low is not None) + [f"100 * {rule.part} > {rule.high} * {rule.whole}"] * (rule.high is not None)
    return f"(({' OR '.join(tests)}) AND n_words >= {rule.at_least})"


def _quality_sql() -> str:
    blank = r"[\x20\x09-\x0D]"
    stops = ", ".join(f"'{w}'" for w in quality.ALL_STOP_WORDS)
    rules = " OR ".join(_rule_sql(r) for r in quality.RULES)
    return rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), w AS MATERIALIZED (
  SELECT r, doc_id, t,
         list_filter(regexp_split_to_array(t, '{blank}+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '{blank}+', '', 'g') <> '') AS ls
  FROM d
), u AS (
  SELECT r, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w
), g AS (
  SELECT r, i, x || ' ' || lead(x, 1) OVER s || ' ' || lead(x, 2) OVER s AS k FROM u WINDOW s AS (PARTITION BY r ORDER BY i)
), dup AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM g WHERE k IS NOT NULL) WHERE n > 1
), cov AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY r
), m AS (
  SELECT w.r, doc_id,
         len(ws)::BIGINT AS n_words,
         length(regexp_replace(t, '{blank}+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
         length(t) - length(regexp_replace(t, '[!?]', '', 'g')) AS n_marks,
         length(t) - length(regexp_replace(t, '\p{{Lu}}+', '', 'g')) AS n_upper,
         len(list_filter(ws, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_letter_words,
         len(list_filter(ws, lambda x: lower(x) IN ({stops}))) AS n_stop_words,
         len(ls) AS n_lines,
         len(list_filter(ls, lambda x: regexp_matches(x, '^{blank}*[-*•]'))) AS n_bullet_lines,
         len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…){blank}*$'))) AS n_ellipsis_lines
  FROM w LEFT JOIN cov USING (r)
), b AS (
  SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEATED} * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR {rules}) AS kept
FROM b"""


TOP_K_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({topk.SCALE} * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 20 = 0
)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= {topk.K}"""


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": _quality_sql(), "op7_top_k": TOP_K_SQL}
