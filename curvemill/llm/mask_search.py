"""Ranked lexical search: the TOP best documents of each item, by presence masks.

1. One pass over the texts counts every document's terms and keeps, for the terms that items ask for, how often each document has them (postings, as arrays of a
   piece of text). 2. Sums over the postings give each term's document frequency, and so its weight. 3. A task takes its postings in blocks of about BLOCK. In a block,
   every term has a bitmap of the documents that hold it. For an item, the bitmaps of its terms are laid side by side and turned: one row of bits for each document, its mask. Documents of equal mask form a group; the
   mask's terms, each at the best value that it has in the block, bound the score of the group. Groups are scored by falling bound until the TOP-th score so far in this task
   is above what is left: then none of the rest can enter, whatever its id. 4. The tasks' TOP rows of each item are ranked.

Scores are whole numbers. Terms are told apart by 64-bit hashes of their bytes. Items are searched in sets of about SET terms (an item is never split), so what is sent to the tasks
is bounded whatever the number of items, except by one item's own terms; for more items than one set holds, the steps run once for each set.

Edge cases: null and empty texts have no terms and are not counted in N; an item without a known term has no rows; equal rows of items are one item, different texts under one item_id are items
of their own; a document without an id takes part and ranks behind equal scores; repeated rows of documents are documents of their own; extra columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curvemill.llm import textkit as tk
from curvemill.llm.flow import materialize, only

TOP, SET, BLOCK = 10, 1_000_000, 2_000_000
POSTINGS = "ids binary, nul binary, n binary, term binary, doc binary, tf binary"
FOUND = "item long, nul boolean, doc_id long, score long"


def _item_terms(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for a, z, h, counts in tk.words(f["text"].tolist(), tk.ascii_lowered):
            sets = [np.unique(x, return_counts=True) for x in np.split(h, np.cumsum(counts)[:-1])]
            yield f.iloc[a:z][["item", "item_id"]].assign(hashes=[t.tobytes() for t, _ in sets], repeats=[c.tobytes() for _, c in sets], size=[len(t) for t, _ in sets])


def _postings(vocabulary: np.ndarray):
    """Rows of POSTINGS, one for each piece of text; ``n`` are all terms of a document, the rest those of ``vocabulary`` (sorted hashes)."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for a, z, h, counts in tk.words(f["text"].tolist(), tk.ascii_lowered):
                doc = np.repeat(np.arange(z - a), counts)
                at = np.minimum(np.searchsorted(vocabulary, h), max(0, len(vocabulary) - 1))
                hit = vocabulary[at] == h if len(vocabulary) else np.zeros(len(h), bool)
                key, tf = np.unique(at[hit].astype(np.int64) * (z - a) + doc[hit], return_counts=True)
                ids = f["doc_id"].iloc[a:z]
                yield pd.DataFrame([{"ids": ids.fillna(0).to_numpy(np.int64).tobytes(), "nul": ids.isna().to_numpy().tobytes(), "n": counts.astype(np.int64).tobytes(),
                                     "term": (key // (z - a)).astype(np.int32).tobytes(), "doc": (key % (z - a)).astype(np.int32).tobytes(), "tf": tf.astype(np.int32).tobytes()}])

    return run


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows ``term, df``, with term -1 for the number of documents with a term and -2 for all their terms."""
    docs = words = 0
    df = np.zeros(0, np.int64)
    for f in frames:
        for n, term in zip(f["n"], f["term"]):
            n = np.frombuffer(n, np.int64)
            docs, words = docs + np.count_nonzero(n), words + int(n.sum())
            c = np.bincount(np.frombuffer(term, np.int32))
            df = np.pad(df, (0, max(0, len(c) - len(df))))
            df[: len(c)] += c
    some = np.flatnonzero(df)
    yield pd.DataFrame({"term": np.concatenate(([-1, -2], some)), "df": np.concatenate(([docs, words], df[some]))})


def weights(df: np.ndarray, docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)


def _blocks(frames: Iterator[pd.DataFrame]) -> Iterator[dict[str, np.ndarray]]:
    """Postings of many pieces together, sorted by term."""
    kinds = {"ids": np.int64, "nul": np.bool_, "n": np.int64, "term": np.int32, "doc": np.int32, "tf": np.int32}

    def joined(held):
        first = np.cumsum([0] + [len(h["ids"]) for h in held[:-1]])
        out = {c: np.concatenate([h[c] for h in held]) for c in kinds}
        out["doc"] = np.concatenate([h["doc"] + s for h, s in zip(held, first)])
        order = np.argsort(out["term"], kind="stable")
        return out | {c: out[c][order] for c in ("term", "doc", "tf")}

    held, size = [], 0
    for f in frames:
        for row in f.itertuples(index=False):
            piece = {c: np.frombuffer(getattr(row, c), k) for c, k in kinds.items()}
            held.append(piece)
            size += len(piece["term"]) + len(piece["ids"])
            if size >= BLOCK:
                yield joined(held)
                held, size = [], 0
    if held:
        yield joined(held)


def masks(bitmaps: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct masks (rows of bits, one column for each term), the documents with a term, and the mask that each has. ``bitmaps``: a row of bits for each term."""
    some = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(bitmaps, axis=0), count=docs))
    bits = np.unpackbits(bitmaps, axis=1, count=docs)[:, some].T
    rows = np.packbits(bits, axis=1)
    rows = np.ascontiguousarray(np.pad(rows, ((0, 0), (0, -rows.shape[1] % 8)))).view(np.uint64)
    if rows.shape[1] == 1:
        _, first, group = np.unique(rows[:, 0], return_index=True, return_inverse=True)
    else:
        _, first, group = np.unique(rows, axis=0, return_index=True, return_inverse=True)
    return bits[first], some, group.reshape(-1)


class Best:
    """The TOP best rows of an item so far."""

    def __init__(self) -> None:
        self.score, self.nul, self.id = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def add(self, score: np.ndarray, nul: np.ndarray, ids: np.ndarray) -> None:
        score, nul, ids = np.concatenate([self.score, score]), np.concatenate([self.nul, nul]), np.concatenate([self.id, ids])
        best = np.lexsort((ids, nul, -score))[:TOP]
        self.score, self.nul, self.id = score[best], nul[best], ids[best]

    def least(self) -> int:
        """A document needs this score to enter."""
        return int(self.score[-1]) if len(self.score) == TOP else 1


def search_block(block: dict[str, np.ndarray], value: np.ndarray, start: np.ndarray, terms: np.ndarray, factor: np.ndarray, bitmap: dict[int, np.ndarray], top: np.ndarray, best: Best) -> int:
    """Score the documents of a block that can be among the best of an item; returns how many were scored. ``terms`` are those that the block holds, ``factor`` their weights times repeats."""
    found, some, group = masks(np.stack([bitmap[t] for t in terms]), len(block["ids"]))
    bound = found.astype(np.int64) @ (factor * top[terms])
    order = np.argsort(-bound, kind="stable")
    members = np.argsort(group, kind="stable")
    first = np.concatenate(([0], np.cumsum(np.bincount(group, minlength=len(bound)))))
    size = np.diff(first)[order]
    upto = np.concatenate(([0], np.cumsum(size)))
    at = scored = 0
    while at < len(order) and bound[order[at]] >= best.least():
        # as many groups as hold some documents, of those that can still enter
        able = int(np.searchsorted(-bound[order], -best.least(), side="right"))
        end = max(at + 1, min(able, int(np.searchsorted(upto, upto[at] + max(4 * TOP, scored)))))
        docs = some[np.concatenate([members[first[g] : first[g + 1]] for g in order[at:end]])]
        score = np.zeros(len(docs), np.int64)
        for t, w in zip(terms, factor):
            own = block["doc"][start[t] : start[t + 1]]
            place = np.minimum(np.searchsorted(own, docs), len(own) - 1)
            score += np.where(own[place] == docs, w * value[start[t] : start[t + 1]][place], 0)
        good = score >= best.least()
        best.add(score[good], block["nul"][docs[good]], block["ids"][docs[good]])
        at, scored = end, scored + len(docs)
    return scored


def _search(items: list[tuple[int, np.ndarray, np.ndarray]], used: np.ndarray, docs: int, words: int):
    """``items``: number, terms and factors (weight times repeats, above 0) of each; ``used``: which terms any of them has."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = [Best() for _ in items]
        for block in _blocks(frames):
            # (75 n N) div L in whole numbers of any size, once for each length
            n, which = np.unique(block["n"], return_inverse=True)
            m = np.array([25 + 75 * int(x) * docs // words for x in n], np.int64)[which.reshape(-1)]
            value = 1_000_000_000 * block["tf"].astype(np.int64) // (1000 * block["tf"].astype(np.int64) + 8 * m[block["doc"]])
            start = np.searchsorted(block["term"], np.arange(len(used) + 1))
            there = np.flatnonzero((start[1:] > start[:-1]) & used)
            top, bitmap = np.zeros(len(used), np.int64), {}
            for t in there:
                top[t] = value[start[t] : start[t + 1]].max()
                bits = np.zeros(len(block["ids"]), bool)
                bits[block["doc"][start[t] : start[t + 1]]] = True
                bitmap[t] = np.packbits(bits)
            for (_, terms, factor), b in zip(items, best):
                own = np.array([t in bitmap for t in terms], bool)
                if own.any() and (factor[own] * top[terms[own]]).sum() >= b.least():
                    search_block(block, value, start, terms[own], factor[own], bitmap, top, b)
        for (number, _, _), b in zip(items, best):
            if len(b.score):
                yield pd.DataFrame({"item": number, "nul": b.nul, "doc_id": b.id, "score": b.score})

    return run


def search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``item, item_id, rank, doc_id, score``: the best documents of each item."""
    spark = docs.sparkSession
    distinct = materialize(only(items, "item_id", "text").distinct().select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long"), "text"))
    asked = materialize(distinct.mapInPandas(_item_terms, "item long, item_id long, hashes binary, repeats binary, size long"))
    sets = max(1, math.ceil((asked.agg(F.sum("size")).first()[0] or 0) / SET))
    out = None
    for s in range(sets):
        some = [(r["item"], np.frombuffer(r["hashes"], np.uint64), np.frombuffer(r["repeats"], np.int64))
                for r in asked.where((F.pmod(F.xxhash64("item"), F.lit(sets)) == s) & (F.col("size") > 0)).select("item", "hashes", "repeats").collect()]
        found = _search_set(docs, some)
        out = found if out is None else out.unionByName(found)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), "nul", "doc_id")
    ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    return asked.select("item", "item_id").join(ranked, "item").select("item", "item_id", "rank", F.when(~F.col("nul"), F.col("doc_id")).alias("doc_id"), "score")


def _search_set(docs: DataFrame, some: list[tuple[int, np.ndarray, np.ndarray]]) -> DataFrame:
    vocabulary = np.unique(np.concatenate([h for _, h, _ in some])) if some else np.zeros(0, np.uint64)
    text = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    posted = materialize(text.mapInPandas(_postings(vocabulary), POSTINGS))
    df = np.zeros(len(vocabulary), np.int64)
    n = {-1: 0, -2: 0}
    for r in posted.select("n", "term").mapInPandas(_count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        if r["term"] < 0:
            n[r["term"]] = r["df"]
        else:
            df[r["term"]] = r["df"]
    w = weights(df, n[-1])
    work, used = [], np.zeros(len(vocabulary), bool)
    for number, h, repeats in some:
        terms = np.searchsorted(vocabulary, h)
        factor = w[terms] * repeats
        real = (factor > 0) & (df[terms] > 0)
        if real.any():
            work.append((number, terms[real], factor[real]))
            used[terms[real]] = True
    return materialize(posted.mapInPandas(_search(work, used, n[-1], max(1, n[-2])), FOUND))
