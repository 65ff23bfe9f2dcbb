"""op13: the best documents for every benchmark item."""

from pyspark.sql import DataFrame, SparkSession

from curvemill.llm import mask_search
from curvemill.llm.registered import query, table

TERMS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {TERMS_SQL} AS w FROM documents),
i AS (SELECT DISTINCT item_id, text FROM benchmark),
q AS (SELECT item_id, text, unnest({TERMS_SQL}) AS term FROM i),
s AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
m AS (SELECT r, doc_id, 25 + (75 * len(w) * n) // l AS m FROM d, s WHERE len(w) > 0),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * any_value(n) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term),
v AS (SELECT r, term, w * ((1000000000 * tf) // (1000 * tf + 8 * m)) AS v FROM p JOIN f USING (term) JOIN m USING (r)),
g AS (SELECT item_id, text, r, sum(v)::BIGINT AS score FROM q JOIN v USING (term) GROUP BY ALL HAVING sum(v) > 0)
SELECT item_id, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST, r)::INT AS rank, doc_id, score FROM g JOIN m USING (r)
QUALIFY rank <= {mask_search.TOP}
"""


@query("op13_mask_search", SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("item_id", "rank", "doc_id", "score")
