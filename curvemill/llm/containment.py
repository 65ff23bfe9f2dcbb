"""Benchmark decontamination: short test items found inside long documents by MinHash containment search. DataFrame functions only.

The values of one fixed-length signature say nothing about a short item in a document a hundred times as long, so items are partitioned by size (powers of two of
their shingle count), and documents are sketched at the scale of each partition. An item's sketch are its SKETCH smallest shingle hashes; of a document, whatever
its length, only shingles with hashes up to the largest that a partition uses can matter. Each value of an item's sketch is a uniform draw from its
shingles, so it is in a document with the chance of the containment: a pair becomes a candidate if it hits as often as a
contained item does but for a chance of MISS. Candidates are verified on the texts of all shingles of the item.

A shingle has five words; an item of fewer words is one shingle of its own length, which is looked for at that length. Edge cases: a null or empty item, or one without a word, is
never found; null and empty documents hold nothing; repeated rows are documents or items of their own with the same answer
(rows of the answer are distinct); a document without an id takes part; extra columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvemill.llm import sqltext as st
from curvemill.llm import textkit as tk
from curvemill.llm.flow import materialize, only, scratch, small
from curvemill.llm.jaccard_join import keyed

SKETCH, MISS = 16, 1e-6
ID = ["nul", "d", "th"]


def hits_needed(m: int, threshold: float, all_of_it: bool) -> int:
    """How many of m sketch values a document must have: all but MISS of the contained items have as many."""
    if all_of_it:
        return max(1, -(-round(m * threshold * 1e9) // 10**9))
    r, below = 0, 0.0
    while (below := below + comb(m, r) * threshold**r * (1 - threshold) ** (m - r)) <= MISS:
        r += 1
    return max(1, r)


def sketches(items: DataFrame, k: int, threshold: float) -> DataFrame:
    """``item_id, len, q, part, need, sketch`` (sorted hashes) and ``texts`` (all shingles) of every item with a word."""
    w = only(items, "item_id", "text").withColumn("w", st.words(F.col("text"))).where(F.size("w") > 0).withColumn("len", F.least(F.size("w"), F.lit(k)))
    of = lambda f: F.coalesce(*[F.when(F.col("len") == n, f(F.col("w"), n)) for n in range(1, k + 1)])
    w = w.select("item_id", "len", F.array_sort(F.array_distinct(of(st.shingle_hashes))).alias("h"), of(st.shingle_texts).alias("texts"))
    w = w.distinct().withColumn("q", F.size("texts")).withColumn("part", F.floor(F.log2("q")).cast("int"))
    need = F.lit(hits_needed(SKETCH, threshold, False))
    for m in range(1, SKETCH + 1):
        need = F.when(F.size("h") == m, hits_needed(m, threshold, True)).otherwise(need)
    return w.select("item_id", "len", "q", "part", need.alias("need"), F.slice("h", 1, SKETCH).alias("sketch"), "texts")


def contained(docs: DataFrame, items: DataFrame, threshold: float = tk.THRESHOLD, k: int = tk.SHINGLE) -> DataFrame:
    """``nul, d, th`` (document), ``item_id, n_shared, containment`` for each item with at least ``threshold`` of its shingles in a document."""
    item = materialize(sketches(items, k, threshold))
    # one row for each partition and shingle length: how far document hashes matter
    cut = item.groupBy("len", "part").agg(F.max(F.array_max("sketch")).alias("upto")).collect()
    text = keyed(only(docs, "doc_id", "text")).select(*ID, "text")
    if not cut:
        return text.where("false").select(*ID, F.lit(None).cast("long").alias("item_id"), F.lit(0).alias("n_shared"), F.lit(0.0).alias("containment"))
    most: dict[int, int] = {}
    for r in cut:
        most[r["len"]] = max(r["upto"], most.get(r["len"], r["upto"]))
    own = text.withColumn("w", st.words(F.col("text"))).drop("text")
    # the outer explode, as for the other one Spark infers a filter on the array's size, pushes it below the split and repeats that for every word
    parts = [own.select(*ID, F.explode_outer(st.shingle_hashes(F.col("w"), n)).alias("h")).where(F.col("h") <= F.lit(upto)) for n, upto in sorted(most.items())]
    probe = parts[0]
    for p in parts[1:]:
        probe = probe.unionByName(p)
    sketch = materialize(item.select("item_id", "need", F.explode("sketch").alias("h")))
    hits = probe.join(small(sketch, 32), "h").groupBy(*ID, "item_id", "need", "h").agg(F.lit(1).alias("one"))
    cand = materialize(hits.groupBy(*ID, "item_id", "need").agg(F.count("h").alias("hits")).where("hits >= need").select(*ID, "item_id"))
    both = text.join(small(cand, 40), ID).join(item.select("item_id", "len", "q", "texts"), "item_id").withColumn("w", st.words(F.col("text"))).drop("text")
    there = F.coalesce(*[F.when(F.col("len") == n, st.shingle_texts(F.col("w"), n)) for n in sorted(most)])
    both = both.withColumn("n_shared", F.size(F.array_intersect("texts", there)))
    both = materialize(both.select(*ID, "item_id", "n_shared", "q"))  # written, so that the filter is not pushed below the split either
    return both.where(F.col("n_shared") >= threshold * F.col("q") - 1e-9).select(*ID, "item_id", "n_shared", (F.col("n_shared") / F.col("q")).alias("containment")).distinct()


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = tk.THRESHOLD, k: int = tk.SHINGLE) -> DataFrame:
    """``docs`` without the documents that contain an item."""
    with scratch() as keep:
        found = keep(contained(docs, items, threshold, k).select(*ID).distinct())
    clash = {c: f"_doc_{c}" for c in docs.columns if c in ID}
    left = keyed(docs.withColumnsRenamed(clash)).join(small(found, 24), ID, "left_anti").drop(*ID)
    return left.withColumnsRenamed({v: c for c, v in clash.items()}).select(*[F.col(f"`{c}`") for c in docs.columns])


def doc_id() -> Column:
    return F.when(~F.col("nul"), F.col("d")).alias("doc_id")
