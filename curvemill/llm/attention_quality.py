"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Every passage of the whole text is encoded: byte and word statistics, a learned tanh
layer. Gated attention (tanh x sigmoid) learns from document labels alone which passages count, and the attention-weighted passage is
scored by a logistic unit. Fitting uses a documented, bounded sample: at most MAX_LABELLED labelled documents of up to MAX_FIT_CHARS characters, drawn
by a hash of the id; the sample's features come to the driver, where a small NumPy network is trained with a fixed seed. Scoring is one pass
over the documents without a shuffle; a task holds the features of about one piece of text at a time.

Inputs of a score are the text alone. Edge cases: a null or empty text is one empty passage and gets a score like any other; null labels
are not used, a document labelled twice counts twice; repeated rows are scored each; extra columns are left out; empty documents give
no rows; without any usable label every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvemill.llm import textkit as tk
from curvemill.llm.flow import only

PASSAGE = 48
# bounds of the sample that the model is fitted on
MAX_LABELLED = 6000
MAX_FIT_CHARS = 50_000
HIDDEN, GATE, EPOCHS, BATCH, RATE, DECAY = 24, 12, 30, 64, 3e-3, 1e-4
CUT = 0.3

# classes of bytes: each ASCII letter, digits, each other printable ASCII character, blanks, line ends, the rest of ASCII, non-ASCII by its high bits
_CLASS = np.zeros(256, np.int64)
_CLASS[:] = 1
for _i in range(26):
    _CLASS[0x61 + _i], _CLASS[0x41 + _i] = 2 + _i, 28
_CLASS[0x30:0x3A] = 29
_CLASS[0x20], _CLASS[0x0A] = 30, 31
for _i, _c in enumerate(c for c in range(0x21, 0x7F) if not chr(c).isalnum()):
    _CLASS[_c] = 32 + _i
_CLASS[0x80:0xC0], _CLASS[0xC0:] = 64, 65
N_CLASSES = 66
N_FEATURES = N_CLASSES + 6


def _features(raw: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Passage features of texts that end at the byte offsets ``ends``, and the number of passages of each; a text without words has one, empty."""
    b = np.frombuffer(raw, np.uint8)
    ink = np.concatenate(([False], b > 0x20, [False]))
    edge = np.flatnonzero(ink[1:] != ink[:-1])
    starts, stops = edge[::2], edge[1::2]
    n_words = np.diff(np.searchsorted(starts, ends), prepend=0)
    n = np.maximum(1, -(-n_words // PASSAGE))
    first = np.cumsum(n) - n
    rank = np.arange(len(starts)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
    of_word = np.repeat(first, n_words) + rank // PASSAGE
    x = np.zeros((int(n.sum()), N_FEATURES), np.float32)
    if not len(starts):
        return x, n
    size = np.diff(np.append(starts, len(b)))
    of_byte = np.repeat(of_word, size)
    total = int(n.sum())
    hist = np.bincount(of_byte * N_CLASSES + _CLASS[b[starts[0] :]], minlength=total * N_CLASSES).reshape(total, N_CLASSES)
    count = np.bincount(of_word, minlength=total)
    length = np.maximum(hist.sum(1), 1)
    some = np.maximum(count, 1)
    h = tk.spans_hash(b, starts, stops)
    seen = np.unique((of_word.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    unlike = np.bincount((seen >> np.uint64(40)).astype(np.int64), minlength=total)
    same = np.concatenate(([False], (h[1:] == h[:-1]) & (of_word[1:] == of_word[:-1])))
    last = b[stops - 1]
    marked = ~((last >= 0x80) | ((last | 0x20) >= 0x61) & ((last | 0x20) <= 0x7A) | (last == 0x2E) | (last == 0x2C))
    wide = stops - starts
    x[:, :N_CLASSES] = np.sqrt(hist / length[:, None])
    x[:, N_CLASSES] = unlike / some
    x[:, N_CLASSES + 1] = np.bincount(of_word, same, total) / some
    x[:, N_CLASSES + 2] = np.bincount(of_word, marked, total) / some
    x[:, N_CLASSES + 3] = np.log1p(np.bincount(of_word, wide, total) / some)
    x[:, N_CLASSES + 4] = np.bincount(of_word, wide <= 2, total) / some
    x[:, N_CLASSES + 5] = np.log1p(count)
    return x, n


def encode(texts: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(features, passages of each text)`` for consecutive texts, about a piece of bytes at a time; a longer text comes whole, built from pieces cut at spaces."""
    for a, z in tk.pieces(texts):
        raws = [(t or "").encode("utf-8", "replace") for t in texts[a:z]]
        if z == a + 1 and len(raws[0]) > 4 * tk.PIECE:
            raw, parts, at = raws[0], [], 0
            while at < len(raw):
                end = at + tk.PIECE
                if end < len(raw):
                    end = next((c for c in (raw.rfind(b" ", at + 1, end), raw.find(b" ", end)) if c > 0), len(raw))
                parts.append(_features(raw[at:end], np.array([len(raw[at:end])]))[0])
                at = end
            x = np.concatenate(parts)
            yield x, np.array([len(x)])
        else:
            yield _features(b"\n".join(raws), np.cumsum([len(r) + 1 for r in raws]))


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _forward(w: dict, x: np.ndarray, n: np.ndarray) -> dict:
    at = np.cumsum(n) - n
    h = np.tanh(x @ w["We"] + w["be"])
    t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
    s = (t * g) @ w["w"]
    e = np.exp(s - np.repeat(np.maximum.reduceat(s, at), n))
    a = e / np.repeat(np.add.reduceat(e, at), n)
    z = np.add.reduceat(h * a[:, None], at, axis=0)
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "p": _sigmoid(z @ w["c"] + w["d"])}


def predict(model: Model, x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score of each bag, attention of each passage."""
    f = _forward(model.weights, (x - model.mean) / model.scale, n)
    return f["p"], f["a"]


def fit_bags(x: np.ndarray, n: np.ndarray, y: np.ndarray, seed: int = 5) -> Model:
    """Train by Adam on the log-loss of the bags; gradients pass through the attention."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    x = ((x - mean) / scale).astype(np.float32)
    at = np.cumsum(n) - n
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    w = {"We": rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), "be": np.zeros(HIDDEN), "V": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
         "U": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "w": rng.normal(0, GATE**-0.5, GATE), "c": rng.normal(0, HIDDEN**-0.5, HIDDEN),
         "d": np.array(np.log(rate / (1 - rate)))}
    m, v, step = {k: np.zeros_like(u) for k, u in w.items()}, {k: np.zeros_like(u) for k, u in w.items()}, 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(n))
        for s in range(0, len(order), BATCH):
            bags = order[s : s + BATCH]
            nb = n[bags]
            rows = np.repeat(at[bags], nb) + np.arange(nb.sum()) - np.repeat(np.cumsum(nb) - nb, nb)
            xb = x[rows]
            f = _forward(w, xb, nb)
            dz_out = (f["p"] - y[bags]) / len(bags)
            g = {"c": f["z"].T @ dz_out, "d": dz_out.sum()}
            dz = np.repeat(dz_out[:, None] * w["c"], nb, axis=0)
            da = (dz * f["h"]).sum(1)
            ds = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, np.cumsum(nb) - nb), nb))
            tg = f["t"] * f["g"]
            g["w"] = tg.T @ ds
            dtg = ds[:, None] * w["w"]
            dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
            g["V"], g["U"] = f["h"].T @ dt, f["h"].T @ dg
            dh = dz * f["a"][:, None] + dt @ w["V"].T + dg @ w["U"].T
            de = dh * (1 - f["h"] ** 2)
            g["We"], g["be"] = xb.T @ de, de.sum(0)
            step += 1
            for k in w:
                grad = g[k] + DECAY * w[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad**2
                w[k] = w[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, {k: np.asarray(u, np.float32) for k, u in w.items()})


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of the id as text is a multiple of 5. A null id is not held out and has no label."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_labelled: int = MAX_LABELLED) -> Model | None:
    """A model from labelled documents that are not held out; None without any."""
    y = only(labels, "doc_id", label).select("doc_id", F.col(f"`{label}`").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    y = y.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_labelled)
    text = only(docs, "doc_id", "text").where(F.length(F.coalesce("text", F.lit(""))) <= MAX_FIT_CHARS)

    def sample(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            parts = [(x[a : a + k].tobytes(), int(k)) for x, n in encode(f["text"].tolist()) for a, k in zip(np.cumsum(n) - n, n)]
            yield pd.DataFrame({"doc_id": f["doc_id"], "y": f["y"], "x": [p[0] for p in parts], "n": [p[1] for p in parts]})

    rows = text.join(F.broadcast(y), "doc_id").mapInPandas(sample, "doc_id long, y int, x binary, n int").toPandas()
    if not len(rows):
        return None
    rows = rows.sort_values(["doc_id", "y", "n", "x"], kind="stable")  # the same order in every run
    x = np.concatenate([np.frombuffer(r, np.float32).reshape(-1, N_FEATURES) for r in rows["x"]])
    return fit_bags(x, rows["n"].to_numpy(np.int64), rows["y"].to_numpy(np.float64))


def score(docs: DataFrame, model: Model | None, cut: float = CUT) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (columns of that name are replaced)."""
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    if model is None:
        return docs.withColumns({"score": F.lit(0.5), "predicted": F.lit(int(cut <= 0.5))})

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = [predict(model, x, n)[0] for x, n in encode(texts.tolist())]
            yield pd.Series(np.concatenate(out).astype(np.float64) if out else np.zeros(0))

    return docs.withColumn("score", scored("text")).withColumn("predicted", (F.col("score") >= cut).cast("int"))
