"""Registered queries of the corpus operators: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, line_dedup, ngram_join, secret_scan, sentencepieces, token_counts, token_files, topk, toxicity, url_filter
from millrace.llm.common import table


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secret_scan.scan(docs, secret_scan.fit(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_format")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.round_trip(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.fit(pages)).select("page_id", "host", "path", "rule", "verdict", "score")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("overlap", 6).alias("overlap"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, id_of = token_files.write_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0)
    return token_files.read_tokens(spark, manifest, id_of)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), limit=512)


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=20, every=20, scale=64)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup(docs, min_words=50, removed_col="n_removed")
    return out.select("doc_id", F.col("n_removed").cast("bigint").alias("n_removed"), F.length("text").cast("bigint").alias("n_chars_left"), F.md5("text").alias("text_md5"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [op1_secrets, op2_sentencepiece, op3_url_filter, op4_decontaminate, op5_ngram_join, op6_token_files, op7_token_counts, op8_topk, op9_line_dedup, op10_toxicity]
    return {f.__name__: f for f in ops}


#: Windows are compared by their lines themselves.
LINE_DEDUP_SQL = r"""
WITH split AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents WHERE text <> ''),
lines AS (SELECT doc_id, line, trim(body, ' ') AS body, len(regexp_extract_all(trim(body, ' '), '\S+')) AS words FROM split),
placed AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY line) - words AS before FROM lines WHERE words > 0),
spans AS (SELECT doc_id, line AS first, max(line) OVER w AS last, sum(words) OVER w AS held, list(body) OVER w AS bodies FROM placed
  WINDOW w AS (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
  UNION ALL SELECT doc_id, min(line) OVER w AS first, line AS last, sum(words) OVER w AS held, list(body) OVER w AS bodies FROM placed
  WINDOW w AS (PARTITION BY doc_id ORDER BY before + words RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
ranked AS (SELECT *, first_value(doc_id) OVER o AS origin_doc, first_value(last) OVER o AS origin_last FROM spans WHERE held >= 50 WINDOW o AS (PARTITION BY bodies ORDER BY doc_id, first)),
gone AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS line FROM ranked WHERE doc_id <> origin_doc OR first > origin_last),
kept AS (SELECT s.doc_id, string_agg(s.body, chr(10) ORDER BY s.line) AS text FROM split s ANTI JOIN gone g ON s.doc_id = g.doc_id AND s.line = g.line GROUP BY s.doc_id),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
texts AS (SELECT d.doc_id, coalesce(r.n, 0) AS n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
  FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id LEFT JOIN removed r ON d.doc_id = r.doc_id)
SELECT doc_id, n_removed, length(text) AS n_chars_left, md5(text) AS text_md5 FROM texts
"""


#: All pairs of a query and another vector, ranked.
TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""

#: Sets of equal content are one class; classes with a common shingle are compared, and links followed to the smallest id.
NGRAM_JOIN_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))) END AS s FROM words),
classes AS (SELECT min(doc_id) AS c, s FROM sets WHERE len(s) > 0 GROUP BY s),
each AS (SELECT c, len(s) AS n, unnest(s) AS g FROM classes),
met AS (SELECT a.c AS x, b.c AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS o FROM each a JOIN each b ON a.g = b.g AND a.c < b.c GROUP BY a.c, b.c),
link AS (SELECT x, y FROM met WHERE 100 * o >= 85 * (nx + ny - o) UNION ALL SELECT y, x FROM met WHERE 100 * o >= 85 * (nx + ny - o)),
reach(c, r) AS (SELECT c, c FROM classes UNION SELECT reach.c, link.y FROM reach JOIN link ON reach.r = link.x),
top AS (SELECT c, min(r) AS component FROM reach GROUP BY c)
SELECT sets.doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(top.component, sets.doc_id) AS component_id
FROM sets LEFT JOIN classes ON classes.s = sets.s LEFT JOIN top ON top.c = classes.c
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_ngram_join": NGRAM_JOIN_SQL, "op8_topk": TOPK_SQL, "op9_line_dedup": LINE_DEDUP_SQL}
