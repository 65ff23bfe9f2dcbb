"""Stupid-backoff scores of documents under the n-gram counts of the whole corpus.

Everything is a relation of arrays. A bundle is a row with the words of about BUNDLE tokens' worth of documents. Its different n-grams, with their counts in
the bundle, are exploded into one row for each part of the hash space; parts are shuffled by their number, each task merges one part of the count
table and joins it back to the n-grams of every bundle; the counts found go back to their bundles, where logarithms are summed for each document. So
counts combine before the first shuffle, a frequent n-gram is one entry for each bundle, and no task sees more than a part or a bundle.

An n-gram counts as seen from MIN_COUNT occurrences in the corpus on (a document's own single use is no evidence). The score of a word is
count(n-gram) / count(its first n - 1 words) for the longest n-gram seen, times ALPHA for each order given up; a single word scores
count / tokens. Contexts do not cross documents; near its start a document has shorter ones, without penalty.

N-grams are told apart by 64-bit hashes. Edge cases: a null or empty text, or one without a word, has 0 tokens, score 0 and no mean; repeated rows are documents of their
own and count as often; a document without an id is scored; extra columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvemill.llm import textkit as tk
from curvemill.llm.flow import groups, materialize, only

ORDER, ALPHA, MIN_COUNT = 2, 0.4, 2
# tokens of a bundle; n-grams of a part of the count table, before they are merged
BUNDLE, PART = 600_000, 3_000_000
# bytes that keep the distance from an n-gram's hash to the next one in a sorted part
NEAR = 7

_U = np.uint64
ROW = "bundle long, part int, a binary, b binary, c binary, d binary"


def planes(x: np.ndarray) -> bytes:
    """Bytes of the numbers by place value: the upper ones are mostly zero and compress away."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as distances, which take fewer bytes; keys too far apart for that in full. The first byte tells which."""
    far = np.diff(keys, prepend=_U(0))
    if len(far) and far.max() >> _U(8 * NEAR):
        return b"\x08" + keys.tobytes()
    return bytes([NEAR]) + np.ascontiguousarray(far.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :NEAR]).tobytes()


def unpack_keys(raw: bytes) -> np.ndarray:
    if raw[0] == 8:
        return np.frombuffer(raw, "<u8", offset=1)
    some = np.frombuffer(raw, np.uint8, offset=1).reshape(-1, NEAR)
    out = np.zeros((len(some), 8), np.uint8)
    out[:, :NEAR] = some
    return np.cumsum(out.view("<u8").reshape(-1))


def pack(counts: np.ndarray) -> tuple[bytes, bytes]:
    """Counts as bytes, those from 255 on in full behind."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes(), counts[counts >= 255].astype(np.uint64).tobytes()


def unpack(few: bytes, many: bytes) -> np.ndarray:
    out = np.frombuffer(few, np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(many, np.uint64)
    return out


def _bundle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def row(ids, hashes, counts):
        vocabulary, codes = np.unique(np.concatenate(hashes), return_inverse=True)
        ids, counts = pd.concat(ids), np.concatenate(counts)
        known = ids.notna().to_numpy()
        keys = ids.fillna(0).astype("int64").to_numpy()
        return pd.DataFrame({"a": [vocabulary.tobytes()], "b": [planes(codes.reshape(-1))], "c": [planes(counts)], "d": [keys.tobytes() + known.tobytes()], "tokens": [int(counts.sum())]})

    ids, hashes, counts, held = [], [], [], 0
    for f in frames:
        for a, z, h, n in tk.words(f["text"].tolist()):
            ids.append(f["doc_id"].iloc[a:z]), hashes.append(h), counts.append(n)
            held += len(h)
            if held >= BUNDLE:
                yield row(ids, hashes, counts)
                ids, hashes, counts, held = [], [], [], 0
    if ids:
        yield row(ids, hashes, counts)


def ngrams(h: np.ndarray, counts: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each n: positions whose word ends an n-gram of its document, and the n-gram's hash."""
    rank = np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts)
    out = []
    for n in range(1, order + 1):
        at = np.flatnonzero(rank >= n - 1)
        key = np.full(len(at), n, np.uint64)
        for j in range(n):
            key = tk.mix(key + h[at - j] * tk._PLACE[j])
        out.append((at, key))
    return out


def _opened(a: bytes, b: bytes, c: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(a, np.uint64)[unplanes(b)], unplanes(c).astype(np.int64)


def _different(h: np.ndarray, n: np.ndarray, order: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All n-grams of a bundle, each once, sorted by part and hash: hash, count, place of each occurrence among them, cuts between parts."""
    keys, place, count = np.unique(np.concatenate([k for _, k in ngrams(h, n, order)]), return_inverse=True, return_counts=True)
    part = (tk.mix(keys) % _U(parts)).astype(np.int32)
    by = np.argsort(part, kind="stable")
    new = np.empty(len(by), np.int32)
    new[by] = np.arange(len(by), dtype=np.int32)
    return keys[by], count[by], new[place.reshape(-1)], np.searchsorted(part[by], np.arange(parts + 1))


def _explode(order: int, parts: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for bundle, a, b, c in zip(f["bundle"], f["a"], f["b"], f["c"]):
                keys, count, _, cut = _different(*_opened(a, b, c), order, parts)
                some = np.flatnonzero(np.diff(cut))
                packed = [pack(count[cut[p] : cut[p + 1]]) for p in some]
                yield pd.DataFrame({"bundle": bundle, "part": some.astype(np.int32), "a": [pack_keys(keys[cut[p] : cut[p + 1]]) for p in some],
                                    "b": [x for x, _ in packed], "c": [x for _, x in packed], "d": b""})

    return run


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Merge a part of the count table, and give each bundle the counts of its n-grams: which reach MIN_COUNT, and those counts."""
    for g in groups(frames, ["part"]):
        size = np.array([len(x) for x in g["b"]])
        keys, place = np.unique(np.concatenate([unpack_keys(x) for x in g["a"]]), return_inverse=True)
        place = place.reshape(-1)
        total = np.bincount(place, np.concatenate([unpack(b, c) for b, c in zip(g["b"], g["c"])]), len(keys)).astype(np.int64)
        found = np.split(total[place], np.cumsum(size)[:-1])
        packed = [(np.packbits(t >= MIN_COUNT).tobytes(), *pack(t[t >= MIN_COUNT])) for t in found]
        for s in range(0, len(g), 64):
            z = slice(s, s + 64)
            yield pd.DataFrame({"bundle": g["bundle"].to_numpy()[z], "part": g["part"].to_numpy()[z], "a": [x[0] for x in packed[z]], "b": [x[1] for x in packed[z]],
                                "c": [x[2] for x in packed[z]], "d": b""})


def _score(order: int, parts: int, corpus: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups(frames, ["bundle"]):
            head, rest = g.iloc[0], g.iloc[1:]  # the bundle itself has part -1 and comes first
            h, n = _opened(head["a"], head["b"], head["c"])
            keys, _, place, cut = _different(h, n, order, parts)
            total = np.ones(len(keys), np.int64)
            for p, a, b, c in zip(rest["part"], rest["a"], rest["b"], rest["c"]):
                size = cut[p + 1] - cut[p]
                seen = np.unpackbits(np.frombuffer(a, np.uint8), count=size).astype(bool)
                total[cut[p] : cut[p + 1]][seen] = unpack(b, c)
            value, given_up, open_ = np.zeros(len(h)), np.zeros(len(h), np.int64), np.ones(len(h), bool)
            counts, at_of, done = [], [], 0
            for at, key in ngrams(h, n, order):
                full = np.zeros(len(h), np.int64)
                full[at] = total[place[done : done + len(at)]]
                done += len(at)
                counts.append(full), at_of.append(at)
            for k in range(order, 1, -1):
                at = at_of[k - 1][open_[at_of[k - 1]]]
                seen = counts[k - 1][at] >= MIN_COUNT
                hit, miss = at[seen], at[~seen]
                value[hit] = np.log(counts[k - 1][hit]) - np.log(counts[k - 2][hit - 1]) + given_up[hit] * math.log(ALPHA)
                open_[hit] = False
                given_up[miss] += 1
            value[open_] = np.log(counts[0][open_]) - math.log(max(corpus, 1)) + given_up[open_] * math.log(ALPHA)
            owner = np.repeat(np.arange(len(n)), n)
            ids, known = np.frombuffer(head["d"][: 8 * len(n)], np.int64), np.frombuffer(head["d"][8 * len(n) :], bool)
            score = np.bincount(owner, value, len(n))
            yield pd.DataFrame({"doc_id": pd.array(ids, "Int64").copy() if known.all() else pd.Series(ids, dtype="Int64").where(known), "n_tokens": n, "n_backoff": np.bincount(owner, given_up > 0, len(n)).astype(np.int64),
                                "log_score": score, "mean_log_score": np.where(n > 0, score / np.maximum(n, 1), np.nan)})

    return run


def scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """``doc_id, n_tokens, n_backoff`` (words whose longest n-gram is not seen), ``log_score`` and ``mean_log_score`` of every row of ``docs(doc_id, text)``."""
    d = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    bundles = d.mapInPandas(_bundle, "a binary, b binary, c binary, d binary, tokens long")
    bundles = materialize(bundles.withColumn("bundle", F.monotonically_increasing_id()), codec="zstd")
    corpus = bundles.agg(F.sum("tokens")).first()[0] or 0
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, least, -(-corpus * order // PART))
    exploded = bundles.select("bundle", "a", "b", "c").mapInPandas(_explode(order, parts), ROW)
    counted = exploded.repartition(parts, "part").sortWithinPartitions("part").mapInPandas(_count, ROW)
    own = bundles.select("bundle", F.lit(-1).alias("part"), "a", "b", "c", "d")
    both = own.unionByName(counted).repartition("bundle").sortWithinPartitions("bundle", "part")
    out = both.mapInPandas(_score(order, parts, corpus), "doc_id long, n_tokens long, n_backoff long, log_score double, mean_log_score double")
    return out.withColumn("mean_log_score", F.when(F.col("n_tokens") > 0, F.col("mean_log_score")))
