"""op10: documents chosen to reach target weights of domains, languages and sources."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curvemill.llm import mixing
from curvemill.llm.registered import query, table

# a source's number modulo 4 stands for its domain
DOMAIN_OF = r"mod(cast(regexp_extract(source, '([0-9]+)$', 1) as int), 4)"
WEIGHTS = mixing.Weights({"d0": 4, "d1": 3, "d2": 2, "d3": 1}, {"en": 5, "de": 2, "fr": 2}, {"src0": 2})
SHARE = 0.6


def domain() -> Column:
    return F.concat(F.lit("d"), F.expr(DOMAIN_OF.replace("regexp_extract(source, '([0-9]+)$', 1)", "nullif(regexp_extract(source, '([0-9]+)$', 1), '')")).cast("string"))


def total() -> Column:
    return F.col("all_tokens") * SHARE


def _level(name: str, children: str, budget: str, above: str, weight: str) -> str:
    """SQL of one level of the tree: children get their shares of the parent's budget."""
    part = f"PARTITION BY {above}" if above else ""
    using = f"JOIN {budget} p USING ({above})" if above else f", {budget} p"
    return f"""
{name}_0 AS (SELECT c.*, {weight} AS weight, p.budget, c.cap / ({weight}) AS r FROM {children} c {using}),
{name}_1 AS (SELECT *, (budget - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM {name}_0 WINDOW o AS ({part} ORDER BY r, {name})),
{name} AS (SELECT * EXCLUDE (budget), CASE WHEN r <= level THEN cap ELSE least(cap, weight * max(level) FILTER (WHERE r > level) OVER ({part})) END AS budget FROM {name}_1)"""


SQL = f"""
WITH t AS (SELECT doc_id, 'd' || ({DOMAIN_OF}) AS domain, lang, source, len(list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda x: x <> ''))::BIGINT AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::DOUBLE AS tokens, 2.0 * sum(n_tokens) AS cap FROM t GROUP BY ALL),
langs AS (SELECT domain, lang, sum(cap) AS cap FROM leaf GROUP BY ALL), domains AS (SELECT domain, sum(cap) AS cap FROM leaf GROUP BY ALL),
root AS (SELECT {SHARE} * sum(tokens) AS budget FROM leaf),
{_level("domain", "domains", "root", "", "CASE c.domain WHEN 'd0' THEN 4.0 WHEN 'd1' THEN 3.0 WHEN 'd2' THEN 2.0 ELSE 1.0 END::DOUBLE")},
{_level("lang", "langs", "domain", "domain", "CASE c.lang WHEN 'en' THEN 5.0 WHEN 'de' THEN 2.0 WHEN 'fr' THEN 2.0 ELSE 1.0 END::DOUBLE")},
{_level("source", "leaf", "lang", "domain, lang", "CASE c.source WHEN 'src0' THEN 2.0 ELSE 1.0 END::DOUBLE")},
plan AS (SELECT domain, lang, source, floor(budget + 1e-6) AS budget, floor(floor(budget + 1e-6) / tokens)::INT AS whole, tokens FROM source),
k AS (SELECT t.*, whole, budget - whole * tokens AS rest, md5('17:' || whole || ':' || doc_id) AS key FROM t JOIN plan USING (domain, lang, source) WHERE budget > 0),
s AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key RANGE UNBOUNDED PRECEDING) AS upto FROM k)
SELECT doc_id, domain, lang, source, n_tokens, unnest(range(0, whole + CASE WHEN upto <= rest AND whole < 2 THEN 1 ELSE 0 END))::INT AS epoch FROM s
"""


@query("op10_mixing", SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixing.mix(docs, domain(), WEIGHTS, total()).select("doc_id", "domain", "lang", "source", "n_tokens", "epoch")
