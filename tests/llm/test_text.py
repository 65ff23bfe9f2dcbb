"""Duplicates, containment, language model and mixing against brute force."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from curvemill.llm import backoff_lm, blocks, containment, fuzzy_lines, jaccard_join, line_sets, mixing
from curvemill.llm import textkit as tk
from tests.llm import plain

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, d string, th int, component string, key string, score double, label int"


def made(seed=1, n=60):
    """Documents with near and exact copies, and the odd ones: null and empty texts, null and repeated ids, one word, one very long, one line."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7)))
    para = lambda k: " ".join(word() for _ in range(k))
    base = ["\n".join(para(rng.randint(3, 60)) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    texts = list(base)
    for t in base[:20]:
        w = t.split(" ")
        for _ in range(rng.randint(1, 3)):
            v = list(w)
            for _ in range(rng.randint(1, 3)):
                v[rng.randrange(len(v))] = word()
            texts.append(" ".join(v))
    long = para(30_000)
    texts += base[:5] + [base[0].upper(), base[1].replace(" ", ",  "), None, "", None, "  \n ", "One", "one", "two words here", "ÀÉÎ öü ñandú 数据 été", long, long + " end"]
    rows = [(i + 100, t) for i, t in enumerate(texts)] + [(None, base[2]), (None, base[2]), (None, "nothing like it at all in here my friend"), (100, base[0]), (100, "another text under the same id"), (None, None)]
    rng.shuffle(rows)
    return [(i, t, rng.choice(["en", "de", None]), rng.choice(["src0", "src1", "src5", None]), len(t or ""), "x", 7, "y", "z", 0.5, 1) for i, t in rows]


def rank(doc_id, text):
    return (doc_id is None, doc_id if doc_id is not None else 0)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made(), SCHEMA)


def test_shingles_and_estimates():
    texts = [r[1] for r in made(3)]
    got = []
    for a, z, h, n in tk.words(texts):
        assert list(n) == [len(plain.words(t)) for t in texts[a:z]]
        got += tk.distinct(*tk.shingles(h, n))
    sets = [plain.shingles(t) for t in texts]
    assert [len(g) for g in got] == [len(s) for s in sets]
    for i, j in [(0, 1), (0, 60), (5, 90), (3, 3)]:
        assert len(set(got[i]) & set(got[j])) == len(sets[i] & sets[j])


def test_pruning_keeps_what_reaches_the_threshold():
    for compared, need in blocks.least_matches(96, 16, 0.8, 1e-5):
        below = sum(math.comb(compared, m) * 0.8**m * 0.2 ** (compared - m) for m in range(need))
        assert below < 1e-4 and need > 0.4 * compared - 3


def test_ngram_jaccard_join(spark, docs):
    rows = made()
    sets = [plain.shingles(r[1]) for r in rows]
    linked = plain.links(sets)
    comp = plain.components(len(rows), linked)
    degree = Counter(x for p in linked for x in p)
    members = defaultdict(list)
    for i, c in enumerate(comp):
        members[c].append(i)
    want = Counter()
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in members[comp[i]] if rows[j][0] is not None]
        want[(r[0], degree[i], (min(ids) if ids else None) if sets[i] else r[0])] += 1
    out = jaccard_join.similar_documents(docs).collect()
    got = Counter((None if r["nul"] else r["d"], r["n_links"], None if r["nul"] and r["component_id"] == r["d"] else r["component_id"]) for r in out)
    hidden = {r["d"] for r in out if r["nul"]}
    got = Counter({(a, b, None if c in hidden else c): n for (a, b, c), n in got.items()})
    assert got == want
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    left = kept.select("doc_id", "text").collect()
    for members_of in members.values():
        if sets[members_of[0]]:
            assert sum(any(rows[i][:2] == (x["doc_id"], x["text"]) for i in members_of) for x in left) == 1
    assert sum(not plain.words(x["text"]) for x in left) == len({r[:2] for r in rows if not plain.words(r[1])})


def test_hot_group_in_blocks(spark, monkeypatch):
    """A group of near copies far beyond a block is linked like in one piece."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 2000)
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = []
    for i in range(90):
        v = list(base)
        for _ in range(rng.randint(0, 4)):
            v[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(v)))
    linked = plain.links([plain.shingles(t) for _, t in rows])
    degree = Counter(x for p in linked for x in p)
    got = {r["d"]: r["n_links"] for r in jaccard_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: degree[i] for i, _ in rows}


def line_units(rows):
    at = [((r[0] is None, r[0] or 0), i, x, k) for k, r in enumerate(rows) for i, x in plain.lines(r[1])]
    comp = plain.components(len(at), plain.links([plain.chars(x) for _, _, x, _ in at]))
    groups = defaultdict(list)
    for i, c in enumerate(comp):
        groups[c].append(i)
    return at, comp, groups


def test_line_dedup(spark, docs):
    rows = [r for r in made() if r[0] is not None and len(r[1] or "") < 10_000]
    few = spark.createDataFrame(rows, SCHEMA)
    at, comp, groups = line_units(rows)
    size = Counter()
    for c, members in groups.items():
        for i in members:
            size[(at[i][0][1], at[i][1], len(members))] += 1
    out = fuzzy_lines.line_components(few).collect()
    assert Counter((r["d"], r["line"], r["copies"]) for r in out) == size
    firsts = Counter(min(at[i][:2] for i in groups[c])[0][1] for c in comp)
    assert Counter(r["first"]["d"] for r in out) == firsts


def test_lines_that_share_keys_by_chance_are_no_group(spark, monkeypatch):
    """Lines of two chunks out of 30: similarity 0.3 at most, and a band key in common for one pair of seven of those, which ties all lines to each other."""
    rng = random.Random(4)
    chunks = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60)) for _ in range(30)]
    rows = [(k, chunks[i] + chunks[j]) for k, (i, j) in enumerate((i, j) for i in range(30) for j in range(i))]
    sizes = []

    def deal(members, keys, size, own=blocks.deal):
        if keys == ["component"]:
            sizes.extend(r["count"] for r in members.groupBy("component").count().collect())
        return own(members, keys, size)

    monkeypatch.setattr(blocks, "deal", deal)
    out = fuzzy_lines.line_components(spark.createDataFrame([*rows, (1000, rows[0][1] + "x")], "doc_id long, text string")).collect()
    assert sum(sizes) < 20 and 2 in sizes
    assert sorted(r["d"] for r in out if r["copies"] == 2) == [0, 1000] and {r["copies"] for r in out} == {1, 2}


def test_drop_repeated_lines(spark, docs):
    out = fuzzy_lines.drop_repeated(docs)
    assert out.columns == docs.columns
    rows = out.select("doc_id", "text", "n_chars").collect()
    assert all(r["n_chars"] == len(r["text"] or "") for r in rows)
    left = [x for r in rows for x in plain.lines(r["text"])]
    before = {x for r in made() for _, x in plain.lines(r[1])}
    assert {x for _, x in left} <= before and len(left) < sum(len(plain.lines(r[1])) for r in made())
    assert sum(not plain.lines(r["text"]) for r in rows) == sum(not plain.lines(r[1]) for r in made())


def test_containment(spark, docs):
    rows = made()
    w = plain.words(rows[0][1] or rows[1][1])
    texts = {r[0]: r[1] for r in rows if r[1]}
    some = sorted(k for k in texts if k is not None)[:12]
    items = [(1, " ".join(plain.words(texts[some[3]])[:25])), (2, "one"), (3, "Two, words here"), (4, None), (5, ""), (6, "never seen before in any of these"), (1, "öü ñandú 数据"),
             (7, " ".join(plain.words(next(t for t in texts.values() if len(t) > 50_000))[9000:9060]) + " changed tail")] + [(8, " ".join(w[:7]))] * 2
    want = set()
    for item, t in items:
        iw = plain.words(t)
        k = min(5, len(iw))
        s = {tuple(iw[i : i + k]) for i in range(len(iw) - k + 1)} if k else set()
        for r in rows:
            dw = plain.words(r[1])
            n = len(s & {tuple(dw[i : i + k]) for i in range(len(dw) - k + 1)})
            if s and n >= 0.8 * len(s):
                want.add((r[0], item, n, round(n / len(s), 9)))
    bench = spark.createDataFrame([(*x, "extra") for x in items], "item_id long, text string, doc_id string")
    got = {(None if r["nul"] else r["d"], r["item_id"], r["n_shared"], round(r["containment"], 9)) for r in containment.contained(docs, bench).collect()}
    assert got == want and len(want) > 5
    clean = containment.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not any(x[0] == r[0] for x in want) for r in rows if r[0] not in (None, 100)) + clean.where("doc_id is null or doc_id = 100").count()
    assert containment.contained(docs, bench.where("false")).count() == 0


def brute_scores(rows, alpha=0.4, least=2):
    one, two = Counter(), Counter()
    for r in rows:
        w = plain.words(r[1])
        one.update(w), two.update(zip(w, w[1:]))
    total = sum(one.values())
    out = Counter()
    for r in rows:
        w, s, back = plain.words(r[1]), 0.0, 0
        for i, x in enumerate(w):
            if i and two[(w[i - 1], x)] >= least:
                s += math.log(two[(w[i - 1], x)] / one[w[i - 1]])
            else:
                s += math.log(one[x] / total) + (math.log(alpha) if i else 0)
                back += i > 0
        out[(r[0], len(w), back, round(s, 5))] += 1
    return out


def test_backoff_scores(spark, docs, monkeypatch):
    monkeypatch.setattr(backoff_lm, "BUNDLE", 500)
    out = backoff_lm.scores(docs).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["n_backoff"], round(r["log_score"], 5)) for r in out) == brute_scores(made())
    assert all((r["mean_log_score"] is None) == (r["n_tokens"] == 0) for r in out)
    assert backoff_lm.scores(docs, order=3).count() == len(out)
    assert backoff_lm.scores(docs.where("false")).count() == 0


def brute_scores_of_order(rows, order, alpha=0.4, least=2):
    seen = Counter()
    for r in rows:
        w = plain.words(r[1])
        seen.update(tuple(w[i - n : i]) for n in range(1, order + 1) for i in range(n, len(w) + 1))
    total = sum(c for k, c in seen.items() if len(k) == 1)
    out = Counter()
    for r in rows:
        w, s, back = plain.words(r[1]), 0.0, 0
        for i in range(1, len(w) + 1):
            longest = min(order, i)
            n = next((n for n in range(longest, 1, -1) if seen[tuple(w[i - n : i])] >= least), 1)
            gram = tuple(w[i - n : i])
            s += math.log(seen[gram] / (seen[gram[:-1]] if n > 1 else total)) + (longest - n) * math.log(alpha)
            back += n < longest
        out[(r[0], len(w), back, round(s, 5))] += 1
    return out


@pytest.mark.parametrize("order", [2, 3, 4])
def test_backoff_orders(spark, docs, monkeypatch, order):
    monkeypatch.setattr(backoff_lm, "BUNDLE", 500)
    assert order > 2 or brute_scores_of_order(made(), 2) == brute_scores(made())
    out = backoff_lm.scores(docs, order=order).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["n_backoff"], round(r["log_score"], 5)) for r in out) == brute_scores_of_order(made(), order)


def test_trigrams_are_registered(spark):
    """The registered trigram query differs from the bigram one: contexts of two words count."""
    from curvemill.llm import registered
    two, three = (registered.QUERIES[n](spark, "/root/testdata/sf0.001").agg(F.sum("n_backoff"), F.sum("log_score")).first() for n in ("op7_backoff_lm", "op7_backoff_lm_order3"))
    assert three[0] > two[0] and three[1] != two[1]


def test_mixing_budgets(spark, docs):
    weights = mixing.Weights({"a": 3, "b": 1}, {"en": 2, "de": 0}, {"src1": 2})
    domain = F.when(F.col("source") == "src0", "a").when(F.col("source").isNotNull(), "b")
    out = mixing.mix(docs.drop("score"), domain, weights, F.col("all_tokens") * 0.5)
    rows = out.collect()
    assert {"doc_id", "text", "key", "domain", "n_tokens", "epoch"} <= set(out.columns)
    tokens = Counter()
    for r in rows:
        tokens[(r["domain"], r["lang"])] += r["n_tokens"]
        assert r["n_tokens"] == len((r["text"] or "").split()) and 0 <= r["epoch"] < 2 and r["lang"] != "de"
    supply = Counter()
    for r in made():
        supply[({"src0": "a", "src1": "b", "src5": "b"}.get(r[3]), r[2])] += len((r[1] or "").split())
    assert all(tokens[k] <= 2 * v for k, v in supply.items())
    assert sum(tokens.values()) <= 0.5 * sum(supply.values())
    seen = Counter((r["doc_id"], r["text"], r["source"], r["lang"], r["epoch"]) for r in rows)
    for (i, t, s, lang, e), n in seen.items():  # an epoch is begun when the one before it is whole
        assert e == 0 or seen[(i, t, s, lang, 0)] == n
    assert mixing.mix(docs.where("false"), domain, weights, F.col("all_tokens") * 0.5).count() == 0


def test_water_filling(spark):
    rows = [("p", "x", 10.0, 1.0, 100.0), ("p", "y", 1000.0, 1.0, 100.0), ("p", "z", 20.0, 2.0, 100.0), ("p", None, 50.0, 0.0, 100.0), ("q", "x", 5.0, 1.0, 100.0), ("q", "y", 7.0, 3.0, 100.0)]
    c = spark.createDataFrame(rows, "p string, name string, cap double, weight double, budget double")
    got = {(r["p"], r["name"]): r["share"] for r in mixing.water_fill(c, ["p"], "name").collect()}
    assert got == {("p", "x"): 10, ("p", "y"): 70, ("p", "z"): 20, ("p", None): 0, ("q", "x"): 5, ("q", "y"): 7}


def test_empty_tables(spark, docs):
    none = docs.where("false")
    assert jaccard_join.similar_documents(none).count() == 0
    assert fuzzy_lines.line_components(none).count() == 0
    assert fuzzy_lines.drop_repeated(none).count() == 0


def test_equal_lines_of_a_piece_are_signed_once(monkeypatch):
    texts = ["Some line that stands in many texts\nand one of its own %d\n" % (i % 50) for i in range(200)] + ["日本語の行 😀 𠀀 abc\n\n  日本語の行 😀 𠀀 ABC ", None, ""]
    signed = []
    monkeypatch.setattr(tk, "signatures", lambda s, n, size, own=tk.signatures: (signed.append(len(n)), own(s, n, size))[1])
    got = list(fuzzy_lines._band_keys(3)(iter([pd.DataFrame({"text": texts})])))
    assert sum(signed) == 52 and sum(len(x) for f in got for x in f["lines"]) == 52 * fuzzy_lines.BANDS * 8
    every, once = next(line_sets.lines(texts))[1], next(line_sets.lines(texts, distinct=True))[1]
    _, first = np.unique(every["h1"], return_index=True)
    first.sort()
    assert (every["h1"][first] == once["h1"]).all() and (every["n"][first] == once["n"]).all()
    parts = np.split(every["shingles"], np.cumsum(every["n"])[:-1])
    assert (np.concatenate([parts[i] for i in first]) == once["shingles"]).all()


def test_signatures_do_not_depend_on_the_work_space(monkeypatch):
    rng = np.random.default_rng(3)
    n = np.array([5, 0, 1, 300, 2, 40, 7])
    s = rng.integers(0, 2**64, n.sum(), dtype=np.uint64)
    want = tk.signatures(s, n, 8)
    for room in (1, 6, 50, 301):
        monkeypatch.setattr(tk, "SIGNED", room)
        assert (tk.signatures(s, n, 8) == want).all()
