"""Near-duplicate vectors through a pivot-permutation index.

Equal vectors of a label become one class. Each class is described by its NEAREST nearest reference points (pivots), nearest first, and
posted in an inverted list for each of them. On a list, two classes are retrieved if they share SHARED pivots at least; the pair is
handled on the list of the smallest pivot that they share, and verified by cosine in double precision. Lists beyond BLOCK rows are dealt
to pairs of blocks. A block returns one row for each class that has a link in it (copies linked, root of its local union-find), so
links are counted in full but no pair is ever written. The number of pivots grows with the square root of the classes, so that the
lists grow slower than the table; pivots are a sample of MAX_PIVOTS classes at most, every class is indexed.

Edge cases: a vector that is null, empty, zero or holds null or non-finite components, or has no label, links with nothing and is its own
component; vectors of different lengths do not link; null ids never become a component's id; repeated rows are vectors of their own;
extra columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvemill.llm.flow import groups, materialize, only, small
from curvemill.llm.graph import components, roots

COSINE = 0.98
MAX_PIVOTS = 4096
NEAREST = 8
SHARED = 2
BLOCK = 1024


def _unit(vectors) -> np.ndarray:
    m = np.vstack([np.asarray(v, np.float64) for v in vectors])
    m /= np.abs(m).max(axis=1, keepdims=True)  # no overflow or underflow of the squares
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    v = only(vectors, "vec_id", "embedding", "label").withColumns({"e": F.col("embedding").cast("array<double>"), "label": F.col("label").cast("string")})
    whole = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.withColumn("ok", F.coalesce(F.col("label").isNotNull() & (F.size("e") > 0) & whole & F.exists("e", lambda x: x != 0), F.lit(False)))
    v = v.withColumns({"h1": F.xxhash64("e"), "h2": F.xxhash64(F.lit(7), "e"), "dim": F.size("e")})
    c = v.where("ok").groupBy("label", "dim", "h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first_id"), F.first("e").alias("e"))
    return v.select("vec_id", "label", "dim", "h1", "h2", "ok"), materialize(c.withColumn("cid", F.monotonically_increasing_id()))


def _describe(classes: DataFrame, n: int) -> DataFrame:
    """Each class with its nearest pivots, nearest first."""
    size = min(MAX_PIVOTS, max(16, math.ceil(2 * math.sqrt(n))))
    picked = classes.orderBy(F.xxhash64(F.lit(11), "h1"), "h1", "cid").limit(size).select("dim", "e").toPandas()
    pivots = classes.sparkSession.sparkContext.broadcast({d: _unit(g["e"]) for d, g in picked.groupby("dim")})

    def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for dim, g in f.groupby("dim"):
                for a in range(0, len(g), BLOCK):
                    part = g.iloc[a : a + BLOCK]
                    p = pivots.value.get(dim)
                    if p is None:  # a length that the sample missed: one list for all its vectors
                        yield part.assign(pivots=[[0]] * len(part))
                        continue
                    s = -(_unit(part["e"]) @ p.T)
                    k = min(NEAREST, len(p))
                    top = np.argpartition(s, k - 1, axis=1)[:, :k]
                    top = np.take_along_axis(top, np.argsort(np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)
                    yield part.assign(pivots=list(top.astype(np.int32)))

    fields = "cid long, label string, dim int, n long, e array<double>"
    return materialize(classes.select("cid", "label", "dim", "n", "e").mapInPandas(near, fields + ", pivots array<int>"))


def _search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    out = []
    for g in groups(frames, ["label", "dim", "pivot", "x", "y"]):
        pivot, x, y = int(g["pivot"].iloc[0]), g["x"].iloc[0], g["y"].iloc[0]
        if len(g) < 2:
            continue
        unit, n, cid, side = _unit(g["e"]), g["n"].to_numpy(), g["cid"].to_numpy(), g["side"].to_numpy()
        ids, where = np.unique(np.concatenate(list(g["pivots"])), return_inverse=True)
        hot = np.zeros((len(g), len(ids)), np.float32)
        hot[np.repeat(np.arange(len(g)), [len(p) for p in g["pivots"]]), where.reshape(-1)] = 1
        before = hot[:, ids < pivot]
        links, a, b = np.zeros(len(g), np.int64), [], []
        for s in range(0, len(g), 256):  # rows at a time, so memory is 256 x the block
            z = slice(s, s + 256)
            need = min(SHARED, max(1, int(hot[z].sum(1).max())))
            near = (hot[z] @ hot.T >= need) & (before[z] @ before.T == 0) & (unit[z] @ unit.T >= COSINE)
            near[np.arange(near.shape[0]), np.arange(s, s + near.shape[0])] = False
            if x != y:
                near &= side[z][:, None] != side[None, :]
            links[z] += near @ n
            i, first = np.flatnonzero(near.any(1)), near.argmax(1)
            # one edge to the first partner of each, then the edges that still join two local components
            a.append(i + s), b.append(first[i])
            for r in i:
                js = np.flatnonzero(near[r])
                a.append(np.full(len(js), r + s)), b.append(js)
        i, j = np.concatenate(a), np.concatenate(b)
        if len(i):
            nodes, root = roots(cid[i], cid[j])
            order = np.argsort(cid)
            out.append(pd.DataFrame({"cid": nodes, "add": links[order][np.searchsorted(cid[order], nodes)], "root": root}))
        if len(out) > 200:
            yield pd.concat(out)
            out = []
    if out:
        yield pd.concat(out)


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors(vec_id, embedding, label)``."""
    rows, classes = _classes(vectors)
    described = _describe(classes, classes.count())
    posted = described.withColumn("pivot", F.explode("pivots"))
    sizes = materialize(posted.groupBy("label", "dim", "pivot").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    posted = posted.join(small(sizes, 24), ["label", "dim", "pivot"])
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    posted = posted.withColumn("blocks", blocks).withColumn("side", F.pmod(F.xxhash64("cid"), "blocks").cast("int"))
    posted = posted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    posted = posted.withColumns({"x": F.least("side", "other"), "y": F.greatest("side", "other")})
    posted = posted.select("label", "dim", "pivot", "x", "y", "side", "cid", "n", "e", "pivots")
    keys = ["label", "dim", "pivot", "x", "y"]
    found = posted.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(_search, "cid long, add long, root long")
    found = materialize(found)
    links = found.groupBy("cid").agg(F.sum("add").alias("add"))
    comp = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    c = classes.select("cid", "label", "dim", "h1", "h2", "n", "first_id").join(links, "cid", "left").join(comp.withColumnRenamed("node", "cid"), "cid", "left")
    c = materialize(c.withColumn("component", F.coalesce("component", "cid")))
    least = c.groupBy("component").agg(F.min("first_id").alias("component_id"))
    c = c.join(least, "component").select("label", "dim", "h1", "h2", (F.col("n") - 1 + F.coalesce("add", F.lit(0))).alias("n_links"), "component_id")
    out = rows.where("ok").join(c, ["label", "dim", "h1", "h2"]).select("vec_id", "n_links", "component_id")
    out = out.unionByName(rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
