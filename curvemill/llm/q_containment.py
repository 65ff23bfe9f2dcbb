"""op4: benchmark items inside documents."""

from pyspark.sql import DataFrame, SparkSession

from curvemill.llm import containment as ct
from curvemill.llm.q_jaccard_join import WORDS_SQL
from curvemill.llm.registered import query, table

SQL = f"""
WITH i AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark), d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
ik AS (SELECT *, least(len(w), 5) AS k FROM i WHERE len(w) > 0),
si AS (SELECT item_id, k, unnest(list_distinct(list_transform(range(1, (len(w) - k + 2)::BIGINT), lambda x: array_to_string(w[x:x+k-1], ' ')))) AS s FROM ik),
q AS (SELECT item_id, count(*) AS q FROM si GROUP BY item_id),
ks AS (SELECT DISTINCT k FROM ik),
sd AS (SELECT doc_id, k, unnest(list_distinct(list_transform(range(1, (len(w) - k + 2)::BIGINT), lambda x: array_to_string(w[x:x+k-1], ' ')))) AS s FROM d, ks WHERE len(w) >= k),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM si JOIN sd USING (k, s) GROUP BY ALL)
SELECT doc_id, item_id, n_shared::INT AS n_shared, n_shared::DOUBLE / q AS containment FROM m JOIN q USING (item_id) WHERE n_shared >= 0.8 * q - 1e-9
"""


@query("op4_decontamination", SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ct.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(ct.doc_id(), "item_id", "n_shared", "containment")
