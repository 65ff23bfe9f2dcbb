"""op11 to op13: edge cases, their inner parts, and brute force."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvemill.llm import active_codes as ac
from curvemill.llm import cuckoo_index as ci
from curvemill.llm import mask_search as ms

UP = str.maketrans(ci.UPPER, ci.LOWER)


# -- op11 ------------------------------------------------------------------------------------------------------------

def keys(n, start=0):
    return np.array([hashlib.sha256(str(i).encode()).digest() for i in range(start, start + n)], "S32")


def test_digests_lower_only_a_to_z(spark):
    texts = ["ABC xyz [@`{", "ÄBC İI \u212a \u0130", "Straße ÉÀ Z", "", None, "日本 ABC"]
    rows = ci.digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    low = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode() for t in texts]
    assert {r["doc_id"]: (bytes(r["digest"]), r["bytes"]) for r in rows} == {i: (hashlib.sha256(t).digest(), len(t)) for i, t in enumerate(low)}


def test_cuckoo_filter_leaves_what_cannot_fit():
    """More digests than free slots are not moved around; the filter that holds them is as large as ever."""
    f = ci.CuckooFilter(4)
    assert not f.insert(keys(65)) and not f.slots.any()
    assert f.insert(keys(40)) and not f.insert(keys(65)[40:]) and np.count_nonzero(f.slots) == 40
    assert len(ci.CuckooFilter.filled(keys(5000), 4).slots) == 2048


def test_filter_inserts_deletes_and_grows():
    f = ci.CuckooFilter(4)  # 64 slots
    assert not f.insert(keys(200))
    f = ci.CuckooFilter.filled(keys(5000), 4)
    assert f.contains(keys(5000)).all() and f.contains(keys(20000, 10**6)).mean() < 0.01
    f.delete(keys(2500))
    assert f.contains(keys(2500, 2500)).all() and f.contains(keys(2500)).mean() < 0.01
    assert f.insert(keys(2500)) and f.contains(keys(5000)).all()
    assert ci.CuckooFilter.filled(keys(0), 3).contains(keys(3)).sum() == 0


def test_filter_deletes_one_of_two_equal_fingerprints():
    a = bytearray(keys(1)[0].ljust(32, b"\0"))
    b = bytearray(a)
    b[31] ^= 1  # the same bucket and fingerprint
    two = np.array([bytes(a), bytes(b)], "S32")
    f = ci.CuckooFilter(4)
    assert f.insert(two)
    f.delete(two[:1])
    assert f.contains(two).all() and np.count_nonzero(f.slots) == 1
    f.delete(two[1:])
    assert not f.contains(two).any()


def plain_dedup(rows):
    groups = {}
    for k, (d, t) in enumerate(rows):
        groups.setdefault((t or "").translate(UP), []).append((d is None, -(d or 0), k))
    out = []
    for k, (d, t) in enumerate(rows):
        g = groups[(t or "").translate(UP)]
        best = min(g)
        out.append((d, None if best[0] else -best[1], len(g), hashlib.sha256((t or "").translate(UP).encode()).hexdigest()))
    return Counter(out), len(groups)


ROWS = [(1, "Same"), (2, "sAME"), (9, "same"), (3, "é"), (4, "É"), (5, None), (6, ""), (7, "long " * 40000), (8, "LONG " * 40000), (None, "same"), (None, "only null"), (10, "twice"), (10, "twice"), (11, "ß"), (12, "SS")]


def test_exact_duplicates(spark):
    df = spark.createDataFrame([(d, t, 0, "x") for d, t in ROWS], "doc_id long, text string, kept int, digest string").repartition(4)
    out = ci.exact_duplicates(df).collect()
    want, classes = plain_dedup(ROWS)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], bytes(r["digest"]).hex()) for r in out) == want
    assert sum(r["kept"] for r in out) == classes  # one of each, repeated rows too
    assert all(r["doc_id"] == r["keep_id"] for r in out if r["kept"])
    assert ci.exact_duplicates(df.where("false")).count() == 0


def test_index_takes_batches_removals_and_new_shards(spark, monkeypatch):
    monkeypatch.setattr(ci, "BUNDLE", 50)
    rows = [(i, f"text {i % 700}") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = ci.empty(spark)
    for part in ("doc_id < 400", "doc_id >= 400 and doc_id < 1100", "doc_id >= 1100"):
        index = ci.insert(index, ci.digests(docs.where(part)))
    live = {bytes(r["digest"]): (r["id"], r["copies"]) for r in ci.entries(index).collect()}
    want = {hashlib.sha256(f"text {k}".encode()).digest(): (max(i for i, _ in rows if i % 700 == k), sum(i % 700 == k for i, _ in rows)) for k in range(700)}
    assert live == want
    gone = ci.digests(docs.where("doc_id < 100").unionByName(spark.createDataFrame([(9999, "never seen")], "doc_id long, text string")))
    index = ci.remove(index, gone)
    assert ci.entries(index).count() == 600
    monkeypatch.setattr(ci, "SHARD_KEYS", 60)  # too full now: dealt again from the stored digests
    before = index.agg(F.max("shard")).first()[0]
    index = ci.insert(index, ci.digests(docs.where("doc_id < 50")))
    assert index.agg(F.max("shard")).first()[0] > before
    live = {bytes(r["digest"]): r["id"] for r in ci.entries(index).collect()}
    assert len(live) == 650 and live[hashlib.sha256(b"text 7").digest()] == 7


# -- op12 ------------------------------------------------------------------------------------------------------------

def plain_codes(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0]))
    x = np.array([[math.floor(ac.SCALE * v) for v in r[1]] for r in rows], np.int64)
    codes, errors = np.zeros((len(rows), 4), int), np.zeros(len(rows), np.int64)
    for p, (a, z) in enumerate(ac.cuts(x.shape[1])):
        part, book = x[:, a:z], x[: ac.ENTRIES, a:z].copy()
        for r in range(ac.ROUNDS + 1):
            d = ((part[:, None] - book[None]) ** 2).sum(-1)
            code = d.argmin(1)
            if r < ac.ROUNDS:
                for k in set(code.tolist()):
                    own = part[code == k]
                    book[k] = [int(s) // len(own) for s in own.sum(0)]
        codes[:, p], errors = code, errors + d.min(1)
    return {rows[i][0]: ("".join(f"{c:02x}" for c in codes[i]), int(errors[i])) for i in range(len(rows))}


@pytest.mark.parametrize("dim,n", [(8, 700), (6, 40), (2, 5)])
def test_codes_against_brute_force(spark, dim, n):
    rng = np.random.default_rng(dim)
    # coarse values make ties, and entries that do not move
    rows = [(int(i), (rng.integers(-3, 4, dim) / 4).tolist(), int(i) % 3 if i % 5 else None) for i in rng.permutation(n)]
    bad = [(n + 1, None, 1), (n + 2, [float("nan")] * dim, 1), (n + 3, [None] + [0.0] * (dim - 1), 2), (n + 4, [float("inf")] * dim, None), (n + 5, [], 1), (n + 6, [0.5] * (dim + 1), 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows + bad], "vec_id long, embedding array<double>, label int, code string")
    got = ac.encode(df).collect()
    want = plain_codes(rows)
    assert {r["vec_id"]: (r["code"], r["error"]) for r in got} == want
    label = {i: k for i, _, k in rows}
    total = Counter()
    for i, (_, e) in want.items():
        total[label[i]] += e
    assert all(r["label_error"] == total[label[r["vec_id"]]] for r in got) and len({r["codebooks_sha256"] for r in got}) == 1
    assert ac.encode(df.where("false")).count() == 0


def test_assignment_that_looks_at_moved_entries_only():
    rng = np.random.default_rng(1)
    x, book = rng.integers(-9, 9, (500, 4)), rng.integers(-9, 9, (60, 4))
    code, dist = ac.assign(x, book, None, np.zeros(500, int), np.zeros(500, int))
    for _ in range(6):
        moved = rng.random(60) < 0.3
        book = np.where(moved[:, None], rng.integers(-9, 9, (60, 4)), book)
        code, dist = ac.assign(x, book, moved, code, dist)
        d = ((x[:, None] - book[None]) ** 2).sum(-1)
        assert (code == d.argmin(1)).all() and (dist == d.min(1)).all()
    wide = rng.integers(-(1 << 25), 1 << 25, (20, 4))
    assert (ac.distances(wide, wide[:7]) == ((wide[:, None] - wide[None, :7]) ** 2).sum(-1)).all()


def test_too_large_components_are_refused(spark):
    df = spark.createDataFrame([(1, [1e6] * 4, 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="too large"):
        ac.encode(df).collect()


# -- op13 ------------------------------------------------------------------------------------------------------------

def terms(text):
    return [w.translate(UP) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def plain_search(docs, items):
    bags = [Counter(terms(t)) for _, t in docs]
    size = [sum(b.values()) for b in bags]
    n, total = sum(s > 0 for s in size), sum(size)
    df = Counter(w for b in bags for w in b)
    out = {}
    for item, text in items:
        scored = []
        for (d, _), b, s in zip(docs, bags, size):
            m = 25 + 75 * s * n // max(1, total)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * b[w] // (1000 * b[w] + 8 * m)) for w in terms(text) if b[w])
            if score:
                scored.append((-score, d is None, d or 0))
        out[item] = [(None if nul else d, -s) for s, nul, d in sorted(scored)[: ms.TOP]]
    return out


@pytest.mark.parametrize("block,sets", [(2_000_000, 1_000_000), (40, 60)])
def test_search_against_brute_force(spark, monkeypatch, block, sets):
    monkeypatch.setattr(ms, "BLOCK", block)
    monkeypatch.setattr(ms, "SET", sets)
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(90)] + ["Été", "été", "STRASSE", "straße", "x-y", "3.14"]
    p = 1 / np.arange(1, len(words) + 1)
    text = lambda k: " ".join(rng.choice(words, k, p=p / p.sum()))
    docs = [(int(i), text(int(rng.integers(1, 60)))) for i in rng.permutation(300)]
    docs += [(1000 + i, "w1 w5 w9 w9") for i in range(30)] + [(None, "w1 w5 w9 w9"), (2000, ""), (2001, None), (2002, "--- ..."), (2003, "w7 " * 50_000)]
    long = " ".join(words * 2)
    items = [(1, "w1 w5 W9 w9"), (2, text(70)), (3, None), (4, ""), (5, "nowhere"), (6, "Été STRASSE x-y 3.14"), (7, "w0"), (8, long)] + [(10 + i, text(12)) for i in range(12)]
    d = spark.createDataFrame([(*r, 1, "y") for r in docs], "doc_id long, text string, score int, item string").repartition(5)
    q = spark.createDataFrame([(*r, 1) for r in items + items[:2]], "item_id long, text string, rank int")
    got = {}
    for r in ms.search(d, q).orderBy("item_id", "rank").collect():
        got.setdefault(r["item_id"], []).append((r["doc_id"], r["score"]))
        assert r["rank"] == len(got[r["item_id"]])
    want = plain_search(docs, items)
    assert got == {k: v for k, v in want.items() if v}


def test_search_of_nothing(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ms.search(d.where("false"), q).count() == 0 and ms.search(d, q.where("false")).count() == 0
    # one document holds the term: ln(4 / 3) is above 0
    assert [r["doc_id"] for r in ms.search(d, q).collect()] == [1]


def test_few_documents_of_a_block_are_scored():
    rng = np.random.default_rng(3)
    bits = rng.random((5, 4000)) < np.array([0.5, 0.3, 0.02, 0.01, 0.4])[:, None]
    found, some, group = ms.masks(np.packbits(bits, axis=1), 4000)
    assert (found[group].T.astype(bool) == bits[:, some]).all() and len(np.unique(found, axis=0)) == len(found)
    wide = rng.random((130, 300)) < 0.1
    found, some, group = ms.masks(np.packbits(wide, axis=1), 300)
    assert (found[group].T.astype(bool) == wide[:, some]).all()
