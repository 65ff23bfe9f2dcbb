"""op2: candidates for secrets in all documents, and which the forest keeps."""

from pyspark.sql import DataFrame, SparkSession

from curvemill.llm import secret_forest
from curvemill.llm.registered import query, table


@query("op2_secret_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_forest.scan(table(spark, sf_dir, "documents"))
