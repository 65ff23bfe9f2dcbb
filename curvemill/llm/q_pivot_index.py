"""op3: near-duplicate embeddings of a label."""

from pyspark.sql import DataFrame, SparkSession

from curvemill.llm import pivot_index
from curvemill.llm.registered import query, table

SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
       AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.r, b.r AS s, a.vec_id AS a_id, b.vec_id AS b_id FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.r <> b.r
          WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT r, r AS s FROM v UNION SELECT reach.r, links.s FROM reach JOIN links ON reach.s = links.r),
low AS (SELECT reach.r, min(t.vec_id) AS component_id FROM reach JOIN v t ON reach.s = t.r GROUP BY reach.r)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE links.r = v.r)::BIGINT AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN low USING (r)
"""


@query("op3_embedding_near_dedup", SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_index.near_duplicates(table(spark, sf_dir, "embeddings"))
