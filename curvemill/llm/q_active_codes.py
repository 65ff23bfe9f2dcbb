"""op12: codes of all embeddings. The SQL compares every part with every entry in every round."""

from pyspark.sql import DataFrame, SparkSession

from curvemill.llm import active_codes as ac
from curvemill.llm.registered import query, table


def _sql() -> str:
    steps = [f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding::DOUBLE[], lambda x: floor({ac.SCALE} * x)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT r, p, x[p * len(x) // {ac.PARTS} + 1:(p + 1) * len(x) // {ac.PARTS}] AS x FROM v, range({ac.PARTS}) AS t(p)),
book0 AS MATERIALIZED (SELECT p, r - 1 AS k, x FROM parts WHERE r <= {ac.ENTRIES})"""]
    near = "SELECT parts.r, parts.p, arg_min(b.k, struct_pack(d := {d}, k := b.k)) AS k, min({d}) AS d FROM parts JOIN {book} b USING (p) GROUP BY ALL"
    dist = "list_sum(list_transform(list_zip(parts.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    for n in range(ac.ROUNDS):
        steps.append(f"""near{n} AS MATERIALIZED ({near.format(d=dist, book=f"book{n}")}),
mean{n} AS (SELECT p, k, i, floor(sum(parts.x[i]) / count(*))::BIGINT AS c FROM parts JOIN near{n} USING (r, p), range(1, 10000) AS t(i) WHERE i <= len(parts.x) GROUP BY ALL),
new{n} AS (SELECT p, k, list(c ORDER BY i) AS x FROM mean{n} GROUP BY ALL),
book{n + 1} AS MATERIALIZED (SELECT p, k, coalesce(new{n}.x, b.x) AS x FROM book{n} b LEFT JOIN new{n} USING (p, k))""")
    last = ac.ROUNDS
    steps.append(f"""fin AS MATERIALIZED ({near.format(d=dist, book=f"book{last}")}),
codes AS (SELECT r, string_agg(printf('%02x', k), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM fin GROUP BY r),
sha AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM book{last})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN codes USING (r), sha""")
    return ",\n".join(steps)


@query("op12_active_codes", _sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ac.encode(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
