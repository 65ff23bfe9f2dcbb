"""op5: quality of every document."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curvemill.llm import attention_quality as mil
from curvemill.llm.flow import only
from curvemill.llm.registered import query, table


@query("op5_quality_classifier")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = mil.fit(docs, table(spark, sf_dir, "labels"))
    return mil.score(only(docs, "doc_id", "text"), model).select("doc_id", mil.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
