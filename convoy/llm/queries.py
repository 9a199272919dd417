"""Registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from convoy.llm.bpe import encode_documents
from convoy.llm.byte_cnn import quality_scores
from convoy.llm.common import held_out, table, trusted_ids
from convoy.llm.decontaminate import find_items
from convoy.llm.domain_lm import cross_entropy_difference
from convoy.llm.embedding_near import near_vectors
from convoy.llm.fill_in_middle import fill_in_middle, restored
from convoy.llm.line_runs import drop_repeated_runs
from convoy.llm.minhash import near_duplicates
from convoy.llm.quality_ratio import quality_rules
from convoy.llm.substrings import drop_repeated_strings
from convoy.llm.surrogates import surrogates
from convoy.llm.toxicity import toxicity_scores
from convoy.llm.vector_codes import codebook_digest, vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def query(fn=None, *, sql: str | None = None):
    """Registers a query and, where one exists, the SQL that gives the same rows."""
    if fn is None:
        return lambda f: query(f, sql=sql)
    QUERIES[fn.__name__] = fn
    if sql:
        ORACLES[fn.__name__] = sql
    return fn


SPLIT_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"

LINE_RUNS_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
), w AS (
  SELECT *, len(regexp_extract_all(line, '[^ \t\r\f\v]+')) AS words FROM l
), s AS (
  SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS stop, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM w WHERE words > 0
), g AS (
  SELECT doc_id, list(line ORDER BY pos) AS lines, list(pos ORDER BY pos) AS places FROM s GROUP BY doc_id
), f AS (
  SELECT doc_id, i, i + count(*) OVER (PARTITION BY doc_id ORDER BY stop - words RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING) - 1 AS j,
    sum(words) OVER (PARTITION BY doc_id ORDER BY stop - words RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING) AS n FROM s
  UNION
  SELECT doc_id, i - count(*) OVER (PARTITION BY doc_id ORDER BY stop RANGE BETWEEN 49 PRECEDING AND CURRENT ROW) + 1, i,
    sum(words) OVER (PARTITION BY doc_id ORDER BY stop RANGE BETWEEN 49 PRECEDING AND CURRENT ROW) FROM s
), r AS (
  SELECT doc_id, list_extract(places, i) AS a, list_extract(places, j) AS b, array_to_string(list_slice(lines, i, j), chr(10)) AS body
  FROM f JOIN g USING (doc_id) WHERE n >= 50
), m AS (
  SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, a) AS k FROM r
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS pos FROM m WHERE k > 1
), o AS (
  SELECT l.doc_id, count(*) AS n_lines, count(gone.pos) AS n_removed,
    string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE gone.pos IS NULL) AS kept
  FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.pos = gone.pos GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN o USING (doc_id)
"""

DECONTAMINATE_SQL = rf"""
WITH d AS (SELECT doc_id, {SPLIT_WORDS} AS w FROM documents),
i AS (SELECT item_id, {SPLIT_WORDS} AS w FROM benchmark),
x AS (
  SELECT item_id, list_slice(w, p, p + 9) AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT len(win) AS n FROM x),
e AS (
  SELECT doc_id, p, n, list_slice(w, p, p + n - 1) AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d JOIN sizes ON len(w) >= n)
), h AS (SELECT DISTINCT e.doc_id, e.p, e.n, x.item_id FROM e JOIN x ON e.win = x.win),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""

FILL_IN_MIDDLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s,
    regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w FROM documents
), h AS (
  SELECT doc_id, t, w, len(w) AS n, CAST('0x' || substr(s, 1, 8) AS BIGINT) % (len(w) + 1) AS x, CAST('0x' || substr(s, 9, 8) AS BIGINT) % (len(w) + 1) AS y,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || substr(s, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
      WHEN CAST('0x' || substr(s, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d
), p AS (
  SELECT doc_id, t, n, form, array_to_string(list_slice(w, 1, least(x, y)), '') AS a,
    array_to_string(list_slice(w, least(x, y) + 1, greatest(x, y)), '') AS b, array_to_string(list_slice(w, greatest(x, y) + 1, n), '') AS c FROM h
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""


def _vector_codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """A round is two tables: the nearest entry of every part (least distance, then index), and the new entries."""
    far = "list_sum(list_transform(range(1, len(p.x) + 1), lambda j: (list_extract(p.x, j) - list_extract(k.x, j)) * (list_extract(p.x, j) - list_extract(k.x, j))))"
    steps = ""
    for r in range(rounds + 1):
        steps += f""", a{r} AS MATERIALIZED (
  SELECT vec_id, p.part, any_value(p.x) AS x, min({far} * {entries} + entry) AS best FROM p JOIN k{r} k USING (part) GROUP BY vec_id, p.part
)"""
        if r < rounds:
            steps += f""", s{r} AS (
  SELECT part, best % {entries} AS entry, j, CAST(floor(sum(list_extract(x, j)) / count(*)) AS BIGINT) AS m
  FROM (SELECT part, best, x, unnest(range(1, len(x) + 1)) AS j FROM a{r}) GROUP BY ALL
), k{r + 1} AS MATERIALIZED (
  SELECT part, entry, coalesce(n.x, k.x) AS x FROM k{r} k LEFT JOIN (SELECT part, entry, list(m ORDER BY j) AS x FROM s{r} GROUP BY ALL) n USING (part, entry)
)"""
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), p AS MATERIALIZED (
  SELECT vec_id, part, list_slice(q, part * len(q) // {parts} + 1, (part + 1) * len(q) // {parts}) AS x FROM (SELECT vec_id, q, unnest(range({parts})) AS part FROM v)
), k0 AS MATERIALIZED (
  SELECT part, entry, x FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v ORDER BY vec_id LIMIT {entries}) USING (vec_id)
){steps}, c AS (
  SELECT vec_id, string_agg(printf('%02x', best % {entries}), '' ORDER BY part) AS code, CAST(sum(best // {entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id
), b AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM k{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c JOIN v USING (vec_id), b
"""


def _judged(scores: DataFrame, threshold: float) -> DataFrame:
    predicted = (F.col("score") >= threshold).cast("int")
    return scores.select("doc_id", held_out().alias("held_out"), "score", predicted.alias("predicted"))


#: Key of the registered query; a real one belongs in a secret store.
SURROGATE_KEY = b"convoy"


@query
def op1_surrogates(spark, sf_dir):
    return surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"), SURROGATE_KEY)


@query
def op2_minhash(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"), width=2)
    return found.select("doc_id", "n_shingles", "class_id", "component_id", "kept")


@query
def op3_quality_ratio(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"), trusted_ids(table(spark, sf_dir, "labels")))


@query(sql=LINE_RUNS_SQL)
def op4_line_runs(spark, sf_dir):
    kept = drop_repeated_runs(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query
def op5_toxicity(spark, sf_dir):
    return _judged(toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), 0.7)


@query
def op6_byte_cnn(spark, sf_dir):
    return _judged(quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), 0.5)


@query
def op8_domain_lm(spark, sf_dir):
    return cross_entropy_difference(table(spark, sf_dir, "documents"), trusted_ids(table(spark, sf_dir, "labels")))


@query
def op7_bpe_codec(spark, sf_dir):
    coded = encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op9_substrings(spark, sf_dir):
    cut = drop_repeated_strings(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query(sql=DECONTAMINATE_SQL)
def op10_decontaminate(spark, sf_dir):
    found = find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.col("items").cast("array<string>"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query(sql=FILL_IN_MIDDLE_SQL)
def op12_fill_in_middle(spark, sf_dir):
    made = restored(fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"),
    )


@query(sql=_vector_codes_sql())
def op11_vector_codes(spark, sf_dir):
    codes, books = vector_codes(table(spark, sf_dir, "embeddings"))
    return codes.select("vec_id", "code", "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256"))


@query
def op13_embedding_near(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))
