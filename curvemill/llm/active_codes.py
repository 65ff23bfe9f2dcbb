"""Vector codes by active-entry Lloyd: vectors cut into PARTS parts, each part named by the nearest of ENTRIES codebook entries, all in integers.

A component x is floor(SCALE * x). A part position's codebook begins as that part of the first ENTRIES kept vectors by vec_id. A round assigns every part to its nearest
entry (squared distance, ties to the lower index) and moves each entry to the componentwise floor of the mean of its parts; an entry without parts stays.

Each part keeps its entry and the exact distance to it. Where that entry did not move, the distance still holds and no unmoved entry can be nearer, so the part is
compared with the moved entries alone: one of these wins if it is nearer, or as near and of a lower index. Other parts are compared with all entries. Distances are whole numbers: as float
products where all of them stay below 2^53, else in 64 bits.

Every round is one pass over the written vectors: a task adds up its parts by entry, Spark sums the tasks' rows (part, entry, component), and the driver holds the codebooks
alone, ENTRIES vectors. A stage is deleted once the next one is written.

Edge cases: vectors that are null, empty or hold null or non-finite components are dropped, and so are those of another length than the first kept vector. A length that PARTS does not divide is cut as
evenly as it goes. Rows without a vec_id take part and rank last; repeated rows are rows of their own, also in the first codebooks. Fewer than ENTRIES vectors make smaller codebooks. Components from 2^26 / SCALE on in
absolute value would not fit into 64-bit sums and raise an error. Null labels count as equal. Extra columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvemill.llm.flow import delete, join_counted, materialize, only, stage

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
LARGEST = 1 << 26
STATE = "vec_id long, label string, x array<int>, code array<int>, dist array<long>"
ROWS = 4096


def cuts(dim: int) -> list[tuple[int, int]]:
    at = [dim * p // PARTS for p in range(PARTS + 1)]
    return list(zip(at[:-1], at[1:]))


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` to those of ``c``."""
    top = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0))
    if 4 * int(top) ** 2 * max(1, x.shape[1]) < 1 << 53:  # every intermediate value is a whole number that a float holds
        a, b = x.astype(float), c.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    out = np.empty((len(x), len(c)), np.int64)
    for k, row in enumerate(c):
        out[:, k] = ((x - row) ** 2).sum(1)
    return out


def assign(x: np.ndarray, book: np.ndarray, moved: np.ndarray | None, code: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each part and the distance. ``moved``: which entries moved since ``code`` and ``dist`` were found; None: nothing is known yet."""
    code, dist = code.copy(), dist.copy()
    again = np.ones(len(x), bool) if moved is None else moved[code]
    if again.any():
        d = distances(x[again], book)
        code[again] = d.argmin(1)  # the first of equal ones
        dist[again] = d.min(1)
    if moved is not None and moved.any() and not again.all():
        rest, active = np.flatnonzero(~again), np.flatnonzero(moved)
        d = distances(x[rest], book[active])
        best, low = active[d.argmin(1)], d.min(1)
        wins = (low < dist[rest]) | ((low == dist[rest]) & (best < code[rest]))
        code[rest[wins]], dist[rest[wins]] = best[wins], low[wins]
    return code, dist


def _matrix(column: pd.Series, kind: type) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(kind)


def _assign(dim: int, books: list[np.ndarray], moved: list[np.ndarray] | None):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for s in range(0, len(whole), ROWS):
                f = whole.iloc[s : s + ROWS]
                x, code, dist = _matrix(f["x"], np.int64), _matrix(f["code"], np.int64), _matrix(f["dist"], np.int64)
                for p, (a, z) in enumerate(cuts(dim)):
                    code[:, p], dist[:, p] = assign(x[:, a:z], books[p], moved and moved[p], code[:, p], dist[:, p])
                yield f.assign(code=list(code.astype(np.int32)), dist=list(dist))

    return run


def _sums(dim: int):
    """Rows ``slot, total``: of each entry, dim + PARTS slots: sums of its components, then how many parts it has at each position."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((ENTRIES, dim + PARTS), np.int64)
        for f in frames:
            if not len(f):
                continue
            x, code = _matrix(f["x"], np.int64), _matrix(f["code"], np.int64)
            for p, (a, z) in enumerate(cuts(dim)):
                np.add.at(total[:, a:z], code[:, p], x[:, a:z])
                total[:, dim + p] += np.bincount(code[:, p], minlength=ENTRIES)
        slot = np.flatnonzero(total)
        yield pd.DataFrame({"slot": slot, "total": total.ravel()[slot]})

    return run


def kept(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, x`` (whole numbers) of the vectors that take part."""
    v = only(vectors, "vec_id", "embedding", "label").withColumn("e", F.col("embedding").cast("array<double>"))
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    v = v.where(F.col("e").isNotNull() & (F.size("e") > 0) & F.forall("e", lambda x: F.coalesce(sound(x), F.lit(False))))
    v = v.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.transform("e", lambda x: F.floor(x * SCALE)).alias("x"))
    wide = F.exists("x", lambda x: F.abs(x) >= LARGEST)
    message = F.lit(f"a component is too large for 64-bit sums: {LARGEST // SCALE} or more")
    v = v.withColumn("x", F.when(wide, F.raise_error(message).cast("array<int>")).otherwise(F.col("x").cast("array<int>")))
    return v


def train(vectors: DataFrame) -> tuple[DataFrame, list[np.ndarray]]:
    """``vec_id, label, code, dist`` (of each part) for the kept vectors, and the final codebooks."""
    v, path = stage(kept(vectors))
    first = v.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(ENTRIES).select("x").collect()
    if not first:
        return v.select("vec_id", "label", F.array().cast("array<int>").alias("code"), F.array().cast("array<long>").alias("dist")), [np.zeros((0, 0), np.int64)] * PARTS
    dim = len(first[0]["x"])
    if any(len(r["x"]) != dim for r in first):
        first = v.where(F.size("x") == dim).orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(ENTRIES).select("x").collect()
    start = np.array([r["x"] for r in first], np.int64)
    books, moved = [start[:, a:z] for a, z in cuts(dim)], None
    none = F.array_repeat(F.lit(0), PARTS)
    state = v.where(F.size("x") == dim).withColumns({"code": none, "dist": none.cast("array<long>")})
    for r in range(ROUNDS + 1):
        before = path
        state, path = stage(state.mapInPandas(_assign(dim, books, moved), STATE))
        delete([before])
        if r == ROUNDS:
            return state.select("vec_id", "label", "code", "dist"), books
        total = np.zeros(ENTRIES * (dim + PARTS), np.int64)
        for row in state.select("x", "code").mapInPandas(_sums(dim), "slot long, total long").groupBy("slot").agg(F.sum("total").alias("total")).collect():
            total[row["slot"]] = row["total"]
        total = total.reshape(ENTRIES, -1)[: len(start)]
        moved, new = [], []
        for p, (a, z) in enumerate(cuts(dim)):
            n = total[:, dim + p]
            mean = np.floor_divide(total[:, a:z], np.maximum(n, 1)[:, None])
            new.append(np.where(n[:, None] > 0, mean, books[p]))
            moved.append((new[p] != books[p]).any(1))
        books = new
    raise AssertionError


def fingerprint(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def encode(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, code, error, label_error, codebooks_sha256`` for the kept vectors."""
    state, books = train(vectors)
    code = F.lower(F.concat_ws("", F.transform("code", lambda c: F.lpad(F.hex(c), 2, "0"))))
    out = state.select("vec_id", "label", code.alias("code"), F.aggregate("dist", F.lit(0).cast("long"), lambda a, x: a + x).alias("error"))
    total = materialize(out.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("members")))
    size = total.agg(F.sum("members")).first()[0] or 0
    out = join_counted(out, total, ["label"], "members", size).drop("members")
    return out.withColumn("codebooks_sha256", F.lit(fingerprint(books)))
