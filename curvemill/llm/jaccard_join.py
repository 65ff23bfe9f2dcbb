"""Documents joined on the Jaccard similarity of their word n-grams, with Bayesian pruning of MinHash candidates.

1. One pass over the texts makes n-gram sets, MinHash values and band keys. Documents with equal sets become one class (a copy is never
   compared again). 2. Classes with an equal band key meet in a bucket. There, MinHash values are compared STEP at a time, and a pair goes as soon as
   the posterior probability that it reaches the threshold is below TOLERANCE. What remains ties classes to candidate groups.
3. Texts of these groups alone are read again; pairs that survive the same pruning are verified exactly on their n-gram sets. Buckets
   and groups beyond a block are dealt to pairs of blocks. Verified links are counted in the task and joined by a distributed
   union-find, so no pair is ever a row.

BANDS of ROWS values find a pair of similarity 0.8 with a chance of 1 - 3e-6, the pruning keeps it with about 1 - 1e-4.

Edge cases: a null or empty text, or one without a word, has no n-grams and links with nothing; a text of fewer than n words is one n-gram; copies and repeated rows
are linked to each other; a document without an id takes part, and never names a class or component that has a document with
one; extra columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvemill.llm import blocks as bl
from curvemill.llm import textkit as tk
from curvemill.llm.flow import materialize, offsets, only, scratch, small, whole_groups
from curvemill.llm.graph import components

BANDS, ROWS, STEP, TOLERANCE = 24, 4, 16, 1e-5
# members, and n-grams of all members, of a block
BLOCK, BLOCK_SHINGLES = 1024, 400_000


def _sketch(n: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for a, z, h, count in tk.words(f["text"].tolist()):
                s, size = tk.shingles(h, count, n)
                sets = tk.distinct(s, size)
                sig = tk.signatures(s, size, BANDS * ROWS)
                band, low = tk.bands(sig, ROWS).view(np.int64), sig.astype(np.uint16)
                keys = np.array([tk.set_key(x) for x in sets], np.int64).reshape(-1, 2)
                some = np.cumsum(size > 0) - 1
                part = f.iloc[a:z][["nul", "d", "th"]].assign(k1=keys[:, 0], k2=keys[:, 1], n=[len(x) for x in sets])
                part["bands"] = [band[k] if m else None for k, m in zip(some, size)]
                part["sig"] = [low[k].tobytes() if m else None for k, m in zip(some, size)]
                yield part

    return run


def _candidates(sig: np.ndarray, side: np.ndarray, cross: bool, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a block (or of two blocks) that survive the pruning."""
    found = [bl.survivors(sig, slice(s, s + 256), bl.pairs_allowed(slice(s, s + 256), side, cross), STEP, threshold, tolerance) for s in range(0, len(sig), 256)]
    return tuple(np.concatenate(x) for x in zip(*found))


def surviving(f: pd.DataFrame, at: np.ndarray, sig: np.ndarray, threshold: float, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    side = f["side"].to_numpy()
    return bl.group_pairs(at, f["x"].to_numpy() != f["y"].to_numpy(), lambda i, j: bl.surviving(sig, i, j, STEP, threshold, tolerance),
                          lambda a, z, cross: _candidates(sig[a:z], side[a:z], cross, threshold, tolerance))


def prune(threshold: float, tolerance: float = TOLERANCE, value: type = np.uint16):
    """LINKED rows of the members of ``key, x, y`` whose signatures (of such values) survive the pruning."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f, at in whole_groups(frames, ["key", "x", "y"]):
            i, j = surviving(f, at, np.frombuffer(b"".join(f["sig"]), value).reshape(len(f), -1), threshold, tolerance)
            if len(i):
                yield bl.linked(f["cid"].to_numpy(), i, j)

    return run


def _verify(threshold: float, n: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f, _ in whole_groups(frames, ["component", "x", "y"]):
            f = f.drop_duplicates(["component", "x", "y", "cid"], ignore_index=True)  # repeated rows of the input
            at = offsets(f, ["component", "x", "y"])
            sets, sig = [], []
            for _, _, h, count in tk.words(f["text"].tolist()):
                s, size = tk.shingles(h, count, n)
                sets += tk.distinct(s, size)
                sig.append(tk.signatures(s, size, BANDS * ROWS))
            i, j = surviving(f, at, np.concatenate(sig), threshold)
            i, j = bl.verified(sets, i, j, threshold)
            if len(i):
                cid, weight = f["cid"].to_numpy(), f["copies"].to_numpy()
                add = (np.bincount(i, weight[j], len(f)) + np.bincount(j, weight[i], len(f))).astype(np.int64)
                nodes, root = bl.roots(cid[i], cid[j])
                some = np.flatnonzero(add)  # a member of several pairs of blocks has a row for each
                yield pd.DataFrame({"cid": cid[some], "add": add[some], "root": root[np.searchsorted(nodes, cid[some])]})

    return run


def keyed(docs: DataFrame) -> DataFrame:
    """Documents with ``nul, d, th``: whether the id is null, the id or else a hash of the text, and that hash."""
    return docs.withColumn("th", F.xxhash64(F.coalesce("text", F.lit("")))).withColumns({"nul": F.col("doc_id").isNull(), "d": F.coalesce(F.col("doc_id").cast("long"), F.col("th"))})


def similar_documents(docs: DataFrame, threshold: float = tk.THRESHOLD, n: int = tk.SHINGLE) -> DataFrame:
    """``nul, d, th`` of every row of ``docs(doc_id, text)`` with ``class_id, n_links, component_id, kept``.

    A class is a set of documents with equal n-grams and named by its smallest id, a component all that links reach; ``n_links``
    counts the other documents linked directly; the document with the component's id is kept.
    """
    texts = keyed(only(docs, "doc_id", "text"))
    fields = "nul boolean, d long, th long, k1 long, k2 long, n int, bands array<long>, sig binary"
    rows = materialize(texts.select("nul", "d", "th", "text").mapInPandas(_sketch(n), fields))
    c = rows.where("n > 0").groupBy("k1", "k2", "n").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("nul", "d", "th")).alias("first"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    c = materialize(c.withColumn("cid", F.monotonically_increasing_id()))

    banded = c.select("cid", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    hits = materialize(banded.join(buckets, "key"))
    hits = hits.join(c.select("cid", "sig"), "cid")
    near = bl.deal(hits, ["key"], F.col("size") / BLOCK).select("key", "x", "y", "side", "cid", "sig").mapInPandas(prune(threshold), bl.LINKED)
    groups_ = components(near.select(F.col("cid").alias("a"), F.col("root").alias("b")))

    member = materialize(groups_.withColumnRenamed("node", "cid").join(c.select("cid", "n", "copies", "first.d", "first.th"), "cid"))
    sizes = member.groupBy("component").agg(F.greatest(F.sum("n") / BLOCK_SHINGLES, F.count(F.lit(1)) / BLOCK).alias("size"))
    member = materialize(member.join(sizes, "component"))
    read = texts.select("d", "th", "text").join(small(member, 64), ["d", "th"])
    read = bl.deal(read, ["component"], F.col("size")).select("component", "x", "y", "side", "cid", "copies", "text")
    links = materialize(read.mapInPandas(_verify(threshold, n), bl.LINKED))
    comp = components(links.select(F.col("cid").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "cid")

    done = c.select("cid", "k1", "k2", "n", "copies", "first").join(links.groupBy("cid").agg(F.sum("add").alias("add")), "cid", "left").join(comp, "cid", "left")
    done = materialize(done.withColumn("component", F.coalesce("component", "cid")))
    least = done.groupBy("component").agg(F.min("first").alias("least"))
    done = done.join(least, "component").select("k1", "k2", "n", F.col("first.d").alias("class_id"), "least", (F.col("copies") - 1 + F.coalesce("add", F.lit(0))).alias("n_links"))
    out = rows.where("n > 0").select("nul", "d", "th", "k1", "k2", "n").join(done, ["k1", "k2", "n"]).select(
        "nul", "d", "th", "class_id", "n_links", F.col("least.d").alias("component_id"), ((F.col("nul") == F.col("least.nul")) & (F.col("d") == F.col("least.d"))).alias("kept"))
    alone = rows.where("n = 0").select("nul", "d", "th", F.col("d").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("d").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(alone)


def keep_one(docs: DataFrame, threshold: float = tk.THRESHOLD, n: int = tk.SHINGLE) -> DataFrame:
    """``docs`` with one document of each component; of repeated rows (same id and text) one stays. A null id or text is a value like others."""
    with scratch() as keep:
        out = keep(similar_documents(docs, threshold, n).where("not kept").select("nul", "d", "th").distinct())
    left = keyed(docs.withColumnsRenamed({c: f"_doc_{c}" for c in docs.columns if c in ("nul", "d", "th")})).join(small(out, 24), ["nul", "d", "th"], "left_anti")
    twice = materialize(left.groupBy("nul", "d", "th").count().where("count > 1").drop("count"))
    if twice.count():
        keys = ["nul", "d", "th"]
        left = left.join(small(twice, 24), keys, "left_anti").unionByName(left.join(small(twice, 24), keys, "left_semi").dropDuplicates(keys))
    return left.drop("nul", "d", "th").withColumnsRenamed({f"_doc_{c}": c for c in docs.columns}).select(*[F.col(f"`{c}`") for c in docs.columns])
