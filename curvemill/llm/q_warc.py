"""op6: every page written to WARC archives and read back."""

from pyspark.sql import DataFrame, SparkSession

from curvemill.llm import warc
from curvemill.llm.registered import query, table

SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
m AS (SELECT hex, min(page_id) AS first FROM p GROUP BY hex),
d AS (SELECT hex, list_reduce(list_transform(range(8), lambda i: list_reduce(list_transform(range(4),
        lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * i, 5))::INT >> (15 - 5 * j)) & 31)::INT, 1)),
        lambda a, b: a || b)), lambda a, b: a || b) AS payload_digest FROM m)
SELECT p.page_id, octet_length(encode(body))::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN p.page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN p.page_id <> first THEN first END AS refers_to
FROM p JOIN m USING (hex) JOIN d USING (hex)
"""


@query("op6_warc", SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
