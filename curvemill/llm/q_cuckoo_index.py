"""op11: exact copies among all documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvemill.llm import cuckoo_index
from curvemill.llm.registered import query, table

SQL = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{cuckoo_index.UPPER}', '{cuckoo_index.LOWER}')) AS text_sha256, row_number() OVER () AS r FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, text_sha256, row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST, r) = 1 AS kept FROM d JOIN g USING (text_sha256)
"""


@query("op11_exact_dedup", SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cuckoo_index.exact_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
