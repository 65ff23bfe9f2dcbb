"""Mixing sources to target weights by hierarchical budgets. DataFrame functions only.

Leaves are (domain, language, source). A leaf can give its tokens MAX_EPOCHS times, a node what its leaves can. From the root down, a node's budget is dealt to
its children by weight; a child that cannot fill its share gives what it can, and the rest goes to its siblings by weight (water filling). As a node never gets more
than its subtree can give, a shortage reaches a node's own siblings only when all its children are exhausted.

A leaf with budget b takes b div tokens whole epochs, and from the next epoch the longest prefix of its documents, in the order of an md5 of seed,
epoch and id, whose tokens fit. The prefix is found from sums per bin of the key: only the documents of the bin where the budget ends are sorted, so a
leaf with a third of all documents is never in one task.

Edge cases: a null domain, language or source is a value of its own; a null or empty text has no tokens and is taken where its key falls in the
order; leaves without tokens, or with weight 0, get nothing; documents without an id are ordered by their text; documents with equal keys
(repeated rows) are taken together or not at all; extra columns are carried by ``mix``; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curvemill.llm.flow import materialize, scratch, small

MAX_EPOCHS, SEED = 2, 17
LEAF = ["domain", "lang", "source"]
# hex digits of the key that make a bin
BIN = 3


class Weights(NamedTuple):
    """Weights of domains, of languages in any domain, of sources in any language; a name that is not listed has the weight ``other``."""

    domain: Mapping[str, float]
    lang: Mapping[str, float]
    source: Mapping[str, float]
    other: float = 1.0


def token_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), "[ \\t\\n\\r]+"), "")).cast("long")


def _weight(name: str, known: Mapping[str, float], other: float) -> Column:
    out = F.lit(float(other))
    for k, w in known.items():
        out = F.when(F.col(name) == k, F.lit(float(w))).otherwise(out)
    return out


def water_fill(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """``children`` (``parent`` columns, ``name``, ``cap``, ``weight``, ``budget`` of the parent) with ``share``: what each gets.

    Sorted by cap / weight, children are exhausted as long as their cap is at most weight x level; the level is what the exhausted ones leave, per unit of the
    other weights. Behind the first child that is not exhausted the figure only falls, so the largest of them is the level. A window holds the children of one node: names, not documents.
    """
    c = children.withColumn("_r", F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")))
    w = Window.partitionBy(*parent).orderBy(F.col("_r").asc_nulls_last(), F.col(name).asc_nulls_first())
    before = F.coalesce(F.sum(F.when(F.col("weight") > 0, F.col("cap"))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weights = F.sum("weight").over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    c = c.withColumn("_level", F.when(F.col("weight") > 0, (F.col("budget") - before) / weights)).withColumn("_full", F.coalesce(F.col("_r") <= F.col("_level"), F.lit(False)))
    level = F.max(F.when(~F.col("_full"), F.col("_level"))).over(Window.partitionBy(*parent))
    share = F.when(F.col("weight") <= 0, 0.0).when(F.col("_full"), F.col("cap").cast("double")).otherwise(F.least(F.col("weight") * level, F.col("cap")))
    return c.withColumn("share", F.coalesce(share, F.lit(0.0))).drop("_r", "_level", "_full")


def budgets(leaves: DataFrame, total: Column, weights: Weights, max_epochs: int) -> DataFrame:
    """``leaves`` (LEAF columns, ``tokens``) with ``budget``, in whole tokens. ``total`` may use the column ``all_tokens``."""
    cap = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    root = cap.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all_tokens")).select(total.cast("double").alias("budget"))
    node = root.withColumn("_root", F.lit(0))
    for depth, name in enumerate(LEAF):
        above = LEAF[:depth]
        known = {"domain": weights.domain, "lang": weights.lang, "source": weights.source}[name]
        child = cap.withColumn("_root", F.lit(0)).groupBy("_root", *LEAF[: depth + 1]).agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(name, known, weights.other))
        # a child without capacity or weight takes no part
        child = child.withColumn("weight", F.when(F.col("cap") > 0, F.col("weight")).otherwise(0.0))
        up = node.withColumnsRenamed({x: f"_{x}" for x in above})
        same = F.col("_root") == F.col("_up")
        for x in above:
            same &= F.col(x).eqNullSafe(F.col(f"_{x}"))
        child = child.join(up.withColumnRenamed("_root", "_up"), same).drop("_up", *[f"_{x}" for x in above])
        node = water_fill(child, ["_root", *above], name).select("_root", *LEAF[: depth + 1], F.col("share").alias("budget"))
    return node.select(*LEAF, F.floor(F.col("budget") + 1e-6).cast("long").alias("budget"))


def _named(names: list[str]) -> list[Column]:
    """A null name as its own value, for joins and groups by equality."""
    return [F.coalesce(F.concat(F.lit("="), F.col(n)), F.lit("-")).alias(f"_{n}") for n in names]


def selection(docs: DataFrame, domain: Column, weights: Weights, total: Column, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """``docs`` with ``_id`` and the leaf's ``_domain, _lang, _source, _tokens``, and the plan of each leaf: ``_full`` epochs, then up to bin ``_bin`` and key ``_key`` of the next."""
    d = docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")))))
    d = d.withColumn("_dom", domain.cast("string")).withColumn("_tokens", token_count(F.col("text")))
    narrow = materialize(d.select("_id", "_tokens", F.col("_dom").alias("domain"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source")))
    leaves = materialize(narrow.groupBy(*LEAF).agg(F.sum("_tokens").alias("tokens")))
    keys = [f"_{n}" for n in LEAF]
    plan = budgets(leaves, total, weights, max_epochs).select(*_named(LEAF), "budget").join(leaves.select(*_named(LEAF), "tokens"), keys)
    plan = plan.withColumn("_full", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("int"))
    plan = materialize(plan.withColumn("_rest", F.col("budget") - F.col("_full") * F.col("tokens")))
    one = narrow.select("_id", "_tokens", *_named(LEAF)).join(small(plan.where("budget > 0"), 200), keys)
    one = one.withColumn("_k", key(seed)).withColumn("_b", bin_of(F.col("_k"))).select(*keys, "_rest", "_k", "_b", "_tokens")
    w = Window.partitionBy(*keys).orderBy("_b")
    bins = one.groupBy(*keys, "_rest", "_b").agg(F.sum("_tokens").alias("n")).withColumn("upto", F.sum("n").over(w))
    # the first bin that does not fit
    last = bins.where("upto > _rest").groupBy(*keys).agg(F.min(F.struct("_b", (F.col("upto") - F.col("n")).alias("before"))).alias("s"))
    last = materialize(last.select(*keys, F.col("s._b").alias("_bin"), "s.before"))
    inside = one.join(small(last.withColumnRenamed("_bin", "_b"), 200), [*keys, "_b"])
    upto = F.sum("_tokens").over(Window.partitionBy(*keys).orderBy("_k").rangeBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("before")
    edge = inside.withColumn("upto", upto).where("upto <= _rest").groupBy(*keys).agg(F.max("_k").alias("_key"))
    plan = plan.join(last, keys, "left").join(edge, keys, "left").select(*keys, "budget", "_full", "_bin", "_key")
    return d.select(*docs.columns, "_id", "_tokens", *_named_from(d)), materialize(plan)


def _named_from(d: DataFrame) -> list[Column]:
    return [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")).alias(n) for c, n in (("_dom", "_domain"), ("lang", "_lang"), ("source", "_source"))]


def key(seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_full").cast("string"), F.col("_id")))


def bin_of(k: Column) -> Column:
    return F.conv(F.substring(k, 1, BIN), 16, 10).cast("int")


def mix(docs: DataFrame, domain: Column, weights: Weights, total: Column, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The chosen documents with all their columns, and ``domain, n_tokens, epoch``: a row for each epoch that a document is taken in.

    ``total``: tokens wanted, a column that may use ``all_tokens``; what all leaves can give bounds it.
    """
    clash = {c: f"_doc_{c}" for c in docs.columns if c in ("domain", "n_tokens", "epoch") or c in ("_id", "_dom", "_tokens", "_full", "_k", "_bin", "_key", "budget", "_domain", "_lang", "_source")}
    docs = docs.withColumnsRenamed(clash)
    with scratch() as keep:
        rows, plan = selection(docs, domain, weights, total, max_epochs, seed)
        plan = keep(plan)
    rows = rows.join(small(plan.where("budget > 0"), 250), [f"_{n}" for n in LEAF]).withColumn("_k", key(seed))
    partly = F.col("_bin").isNull() | (bin_of(F.col("_k")) < F.col("_bin")) | ((bin_of(F.col("_k")) == F.col("_bin")) & (F.col("_k") <= F.coalesce("_key", F.lit(""))))
    # a leaf that is used up to the last token has no bin where it ends, and no next epoch
    times = F.col("_full") + F.when(partly & (F.col("_full") < max_epochs), 1).otherwise(0)
    rows = rows.withColumn("_times", times).where("_times > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("_times") - 1)))
    dom = F.when(F.col("_domain") != "-", F.expr("substring(_domain, 2)"))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns if c not in clash.values()], dom.alias("domain"), F.col("_tokens").alias("n_tokens"), "epoch")
