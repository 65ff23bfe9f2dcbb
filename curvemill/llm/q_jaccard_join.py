"""op1: documents that share most of their five-word shingles."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvemill.llm import jaccard_join
from curvemill.llm.registered import query, table

WORDS_SQL = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[\x00-\x2f\x3a-\x60\x7b-\x7f]+'), lambda x: x <> '')"

SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i+4], ' ')))) AS s FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b, c = x.n AND c = y.n AS same FROM common JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
low AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, least(doc_id, (SELECT min(b) FROM links WHERE a = doc_id AND same)) AS class_id,
       (SELECT count(*) FROM links WHERE a = doc_id)::BIGINT AS n_links, component_id, doc_id = component_id AS kept FROM low
"""


@query("op1_ngram_jaccard_join", SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_join.similar_documents(table(spark, sf_dir, "documents"))
    return out.select(F.when(~F.col("nul"), F.col("d")).alias("doc_id"), "class_id", "n_links", "component_id", "kept")
