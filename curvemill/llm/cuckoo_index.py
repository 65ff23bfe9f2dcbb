"""Exact deduplication with a cuckoo-filter index of live digests.

Texts are equal when identical after lower-casing A to Z; a null text counts as empty. A text's digest is SHA-256 of that form in UTF-8.

The index is a table, dealt by a hash of the digest into shards of about SHARD_KEYS live digests. A shard has a cuckoo filter (16-bit fingerprints, two possible
buckets of four slots) and, as content, the live digests sorted by bucket, each with its length in bytes, the document that stays for it and how many documents it
stands for. ``insert`` asks the filter for each digest: a miss is new and goes in; a hit is verified against the content of its bucket (all 256 bits and the length)
and joins the entry there, whose document gives way to one of a larger id; a hit that fails the check is a false positive and goes in as new. ``remove`` deletes verified digests
from filter and content. When an insertion finds no room after KICKS displacements, the filter doubles and is filled again from the stored digests.

Work and memory: a text is hashed where it is read and not shuffled; tasks reduce copies in bundles of BUNDLE rows before the shuffle, so that a text that is a third of all rows brings a row
for each bundle; a task holds one shard at a time. ``insert`` deals an index again, from its stored digests, once its shards hold more than SHARD_KEYS each.

Edge cases: null ids rank below all others; of rows with equal text and equal id, one stays (the one that the written digests number lowest); removing a digest that
is not live does nothing; extra columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvemill.llm.flow import groups, join_counted, materialize, only

SLOTS, KICKS, SHARD_KEYS, BUNDLE = 4, 200, 200_000, 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# a filter row has ``slots``, an entry has ``digest`` and what follows
INDEX = "shard int, slots binary, digest binary, bytes long, nul boolean, id long, row long, copies long"
_U = np.uint64


class CuckooFilter:
    """Fingerprints of 32-byte digests. A digest's first bits are its bucket, so digests in order are in order of buckets at every size."""

    def __init__(self, bits: int = 8, slots: bytes | None = None):
        self.slots = np.zeros((1 << bits, SLOTS), np.uint16) if slots is None else np.frombuffer(slots, np.uint16).reshape(-1, SLOTS).copy()

    def _of(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprint (never 0, the mark of a free slot) and first bucket."""
        words = np.ascontiguousarray(digests).view(">u8").reshape(-1, 4)
        bits = len(self.slots).bit_length() - 1
        fp = (words[:, 1] % _U(65535)).astype(np.uint16) + np.uint16(1)
        return fp, (words[:, 0] >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(words), np.int64)

    def _other(self, fp: np.ndarray, at: np.ndarray) -> np.ndarray:
        return at ^ ((fp.astype(np.int64) * 0x5BD1E995 >> 7) & (len(self.slots) - 1))

    def contains(self, digests: np.ndarray) -> np.ndarray:
        fp, at = self._of(digests)
        return ((self.slots[at] == fp[:, None]) | (self.slots[self._other(fp, at)] == fp[:, None])).any(axis=1)

    def insert(self, digests: np.ndarray) -> bool:
        """Add digests that are not in yet. False: some found no room, and the filter has to be filled again at another size."""
        if len(digests) > np.count_nonzero(self.slots == 0):
            return False  # without trying: KICKS rounds over all digests at each size too small were most of a shard's time
        fp, at = self._of(digests)
        rng = np.random.default_rng(1)
        for _ in range(KICKS):
            for _ in range(2):  # a free slot in this bucket, then in the other one
                order = np.argsort(at, kind="stable")
                fp, at = fp[order], at[order]
                place = np.arange(len(at)) - np.searchsorted(at, at)
                free = np.cumsum(self.slots[at] == 0, axis=1)
                fits = place < free[:, -1]
                slot = (free > place[:, None]).argmax(axis=1)
                self.slots[at[fits], slot[fits]] = fp[fits]
                fp, at = fp[~fits], at[~fits]
                at = self._other(fp, at)
            if not len(fp):
                return True
            bucket, first = np.unique(at, return_index=True)
            slot = rng.integers(0, SLOTS, len(bucket))
            out = self.slots[bucket, slot]
            self.slots[bucket, slot] = fp[first]
            fp[first], at[first] = out, self._other(out, bucket)
        return False

    def delete(self, digests: np.ndarray) -> None:
        """Take out digests that are in."""
        fp, at = self._of(digests)
        while len(fp):
            at = np.where((self.slots[at] == fp[:, None]).any(axis=1), at, self._other(fp, at))
            slot = (self.slots[at] == fp[:, None]).argmax(axis=1)
            _, first = np.unique(at * SLOTS + slot, return_index=True)  # two digests may share a fingerprint: a slot goes for one of them at a time
            self.slots[at[first], slot[first]] = 0
            fp, at = np.delete(fp, first), np.delete(at, first)

    @staticmethod
    def filled(digests: np.ndarray, bits: int) -> CuckooFilter:
        """A filter of at least ``bits`` that holds ``digests``; it doubles until all find room."""
        while not (f := CuckooFilter(bits)).insert(digests):
            bits += 1
        return f


class Shard:
    """Filter and content of one shard; content is a frame sorted by ``digest``."""

    def __init__(self, state: pd.DataFrame):
        slots, entries = state[state["digest"].isna()], state[state["digest"].notna()]
        self.entries = entries.assign(key=keys_of(entries["digest"])).sort_values("key", ignore_index=True)
        self.filter = CuckooFilter(slots=slots["slots"].iloc[0]) if len(slots) else CuckooFilter.filled(self.entries["key"].to_numpy("S32"), 8)

    def verified(self, f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """For rows with ``key`` and ``bytes``: where each one's entry is in the content, and which have one."""
        live = self.entries["key"].to_numpy("S32")
        key, at = f["key"].to_numpy("S32"), np.zeros(len(f), np.int64)
        hit = np.flatnonzero(self.filter.contains(key))
        at[hit] = np.searchsorted(live, key[hit])
        real = hit[at[hit] < len(live)]
        real = real[(live[at[real]] == key[real]) & (self.entries["bytes"].to_numpy()[at[real]] == f["bytes"].to_numpy()[real])]
        there = np.zeros(len(f), bool)
        there[real] = True
        return at, there

    def insert(self, f: pd.DataFrame) -> None:
        f = reduced(f)
        at, there = self.verified(f)
        old, new = f[there], f[~there]
        if len(old):
            live = self.entries.iloc[at[there]]
            newer = np.flatnonzero(_newer(old, live))
            for c in ("nul", "id", "row"):
                self.entries.loc[at[there][newer], c] = old[c].to_numpy()[newer]
            self.entries.loc[at[there], "copies"] += old["copies"].to_numpy()
        if len(new):
            self.entries = pd.concat([self.entries, new], ignore_index=True).sort_values("key", ignore_index=True)
            if not self.filter.insert(new["key"].to_numpy("S32")):
                self.filter = CuckooFilter.filled(self.entries["key"].to_numpy("S32"), len(self.filter.slots).bit_length())

    def remove(self, f: pd.DataFrame) -> None:
        f = f.drop_duplicates("key")
        at, there = self.verified(f)
        self.filter.delete(f["key"].to_numpy("S32")[there])
        self.entries = self.entries.drop(index=at[there]).reset_index(drop=True)

    def state(self, shard: int) -> pd.DataFrame:
        out = self.entries.drop(columns="key").assign(slots=None)
        mark = {"slots": [self.filter.slots.tobytes()], "digest": [None], "bytes": [0], "nul": [False], "id": [0], "row": [0], "copies": [0]}
        out = pd.concat([pd.DataFrame(mark), out], ignore_index=True) if len(out) else pd.DataFrame(mark)
        return out.assign(shard=shard)[["shard", "slots", "digest", "bytes", "nul", "id", "row", "copies"]]


def keys_of(digests: pd.Series) -> np.ndarray:
    return pd.Series([bytes(d) for d in digests], index=digests.index, dtype=object)


def _newer(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
    """Where the document of ``a`` stays rather than that of ``b``: an id before none, the larger id, the lower row."""
    an, bn, ai, bi = a["nul"].to_numpy(bool), b["nul"].to_numpy(bool), a["id"].to_numpy(), b["id"].to_numpy()
    return np.where(an != bn, bn, np.where(ai != bi, ai > bi, a["row"].to_numpy() < b["row"].to_numpy()))


def reduced(f: pd.DataFrame) -> pd.DataFrame:
    """One row for each digest: the document that stays, and all copies."""
    f = f.sort_values(["key", "nul", "id", "row"], ascending=[True, True, False, True], kind="stable", ignore_index=True)
    total = f.groupby("key", sort=False)["copies"].sum()
    return f.drop_duplicates("key", ignore_index=True).assign(copies=total.to_numpy())


def _reduce(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def one(held):
        f = pd.concat(held, ignore_index=True)
        return reduced(f.assign(key=keys_of(f["digest"]), copies=1)).drop(columns="key")

    held, n = [], 0
    for f in frames:
        held.append(f)
        n += len(f)
        if n >= BUNDLE:
            yield one(held)
            held, n = [], 0
    if held:
        yield one(held)


def _change(remove: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in groups(frames, ["shard"]):
            shard, f = Shard(g[~g["change"]]), g[g["change"]]
            f = f.assign(key=keys_of(f["digest"]))
            (shard.remove if remove else shard.insert)(f)
            yield shard.state(int(g["shard"].iloc[0]))

    return run


def digests(docs: DataFrame) -> DataFrame:
    """``row, doc_id, nul, id, digest, bytes`` of every document, written; ``row`` numbers the rows of the written table."""
    text = F.coalesce("text", F.lit(""))
    # one byte a character is ASCII, where lower is A to Z alone and faster
    text = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    d = only(docs, "doc_id", "text").withColumns({"row": F.monotonically_increasing_id(), "nul": F.col("doc_id").isNull(), "id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0))})
    return materialize(d.select("row", "doc_id", "nul", "id", F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("bytes")))


def empty(spark) -> DataFrame:
    return spark.createDataFrame([], INDEX)


def _apply(index: DataFrame, rows: DataFrame, remove: bool) -> DataFrame:
    """The index after ``rows`` of `digests` went in or out, written."""
    spark = rows.sparkSession
    live, new = index.where("digest is not null").count(), rows.count()
    shards = index.agg(F.max("shard")).first()[0]
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(live + (0 if remove else new)) // SHARD_KEYS))
    if shards is None or live > (shards + 1) * SHARD_KEYS:
        index, shards = index.where("digest is not null"), least  # dealt anew; the filters are filled again from the stored digests
    else:
        shards += 1
    shard = F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int")
    state = index.withColumn("change", F.lit(False)).withColumn("shard", F.coalesce(F.when(F.col("digest").isNull(), F.col("shard")), shard))
    rows = rows.select("digest", "bytes", "nul", "id", "row").mapInPandas(_reduce, "digest binary, bytes long, nul boolean, id long, row long, copies long")
    rows = rows.withColumns({"shard": shard, "slots": F.lit(None).cast("binary"), "change": F.lit(True)})
    both = state.unionByName(rows).repartition(F.col("shard")).sortWithinPartitions("shard")
    return materialize(both.mapInPandas(_change(remove), INDEX))


def insert(index: DataFrame, rows: DataFrame) -> DataFrame:
    return _apply(index, rows, False)


def remove(index: DataFrame, rows: DataFrame) -> DataFrame:
    return _apply(index, rows, True)


def entries(index: DataFrame) -> DataFrame:
    """The live digests."""
    return index.where("digest is not null").select("digest", "bytes", "nul", "id", "row", "copies")


def kept_id() -> Column:
    return F.when(~F.col("live_nul"), F.col("live_id"))


def resolve(rows: DataFrame, index: DataFrame) -> DataFrame:
    """``rows`` with ``keep_id, group_size, kept`` from the index that they are in."""
    live = entries(index).where("copies > 1").select("digest", "copies", F.col("nul").alias("live_nul"), F.col("id").alias("live_id"), F.col("row").alias("live_row"))
    out = join_counted(rows, materialize(live), ["digest"], "copies", rows.count())
    alone = F.col("copies").isNull()
    return out.select(*rows.columns, F.when(alone, F.col("doc_id").cast("long")).otherwise(kept_id()).alias("keep_id"),
                      F.coalesce("copies", F.lit(1).cast("long")).alias("group_size"), (alone | (F.col("row") == F.col("live_row"))).alias("kept"))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """``row, doc_id, ..., digest, keep_id, group_size, kept`` of every document, dropped ones too."""
    rows = digests(docs)
    return resolve(rows, insert(empty(docs.sparkSession), rows))
