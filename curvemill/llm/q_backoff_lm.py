"""op7: stupid-backoff score of every document under the counts of all documents, with bigrams and with trigrams."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvemill.llm import backoff_lm
from curvemill.llm.q_jaccard_join import WORDS_SQL
from curvemill.llm.registered import query, table

SQL = f"""
WITH w AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
t AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word, unnest(list_concat([NULL], w[1:len(w)-1])) AS prev FROM w),
u AS (SELECT word, count(*) AS c FROM t GROUP BY word), b AS (SELECT prev, word, count(*) AS c FROM t WHERE prev IS NOT NULL GROUP BY ALL), n AS (SELECT count(*) AS n FROM t),
s AS (SELECT t.doc_id, t.prev IS NOT NULL AND b.c < 2 AS back,
        CASE WHEN t.prev IS NULL THEN ln(u.c) - ln(n) WHEN b.c >= 2 THEN ln(b.c) - ln(v.c) ELSE ln(0.4) + ln(u.c) - ln(n) END AS x
      FROM t JOIN u USING (word) LEFT JOIN u v ON v.word = t.prev LEFT JOIN b ON b.prev = t.prev AND b.word = t.word, n),
g AS (SELECT doc_id, count(*) AS n_tokens, count(*) FILTER (WHERE back) AS n_backoff, sum(x) AS x FROM s GROUP BY doc_id)
SELECT w.doc_id, coalesce(n_tokens, 0)::BIGINT AS n_tokens, coalesce(n_backoff, 0)::BIGINT AS n_backoff, round(coalesce(x, 0), 4) AS log_score, round(x / n_tokens, 6) AS mean_log_score
FROM w LEFT JOIN g USING (doc_id)
"""


@query("op7_backoff_lm", SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = backoff_lm.scores(table(spark, sf_dir, "documents"))
    return out.withColumns({"log_score": F.round("log_score", 4), "mean_log_score": F.round("mean_log_score", 6)})


SQL3 = f"""
WITH w AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
t0 AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM w),
t AS (SELECT *, lag(word) OVER d AS prev, lag(word, 2) OVER d AS prev2 FROM t0 WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
u AS (SELECT word, count(*) AS c FROM t GROUP BY word), n AS (SELECT count(*) AS n FROM t),
b AS (SELECT prev, word, count(*) AS c FROM t WHERE prev IS NOT NULL GROUP BY ALL), g3 AS (SELECT prev2, prev, word, count(*) AS c FROM t WHERE prev2 IS NOT NULL GROUP BY ALL),
c AS (SELECT t.doc_id, u.c AS c1, v.c AS before1, b.c AS c2, h.c AS before2, g3.c AS c3, n
      FROM t JOIN u USING (word) LEFT JOIN u v ON v.word = t.prev LEFT JOIN b ON b.prev = t.prev AND b.word = t.word LEFT JOIN b h ON h.prev = t.prev2 AND h.word = t.prev
      LEFT JOIN g3 ON g3.prev2 = t.prev2 AND g3.prev = t.prev AND g3.word = t.word, n),
s AS (SELECT doc_id, coalesce(c3 < 2, false) OR coalesce(c2 < 2, false) AS back,
        CASE WHEN c3 >= 2 THEN ln(c3) - ln(before2)
             ELSE CASE WHEN c3 < 2 THEN ln(0.4) ELSE 0 END + CASE WHEN c2 >= 2 THEN ln(c2) - ln(before1) ELSE CASE WHEN c2 < 2 THEN ln(0.4) ELSE 0 END + ln(c1) - ln(n) END END AS x
      FROM c),
g AS (SELECT doc_id, count(*) AS n_tokens, count(*) FILTER (WHERE back) AS n_backoff, sum(x) AS x FROM s GROUP BY doc_id)
SELECT w.doc_id, coalesce(n_tokens, 0)::BIGINT AS n_tokens, coalesce(n_backoff, 0)::BIGINT AS n_backoff, round(coalesce(x, 0), 4) AS log_score, round(x / n_tokens, 6) AS mean_log_score
FROM w LEFT JOIN g USING (doc_id)
"""


@query("op7_backoff_lm_order3", SQL3)
def op7_order3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = backoff_lm.scores(table(spark, sf_dir, "documents"), order=3)
    return out.withColumns({"log_score": F.round("log_score", 4), "mean_log_score": F.round("mean_log_score", 6)})
