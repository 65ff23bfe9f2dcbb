"""Allow and block rules on URLs, looked up in a cascade of Bloom filters.

A rule is a host and a path prefix; it fits its host, all subdomains, and every path that starts with the prefix. A URL is therefore fitted
by the rules among a few keys: its last k host labels with the first n characters of its path, for the (k, n) that rules have. Whether a
key is listed is asked of a cascade: level 1 holds the listed keys, level 2 those keys of the corpus that level 1 takes wrongly, level 3 the
listed keys that level 2 takes, and so on until a level errs on nothing. Over the keys of the corpus it was built for, the answer is exact,
and judging needs no join. Filters stay within MAX_WORDS; longer lists are looked up by a join on the same keys.

Edge cases: a null URL or one without ``://`` has an empty host and path and fits no rule; repeated rows are judged each; other
columns of the input are left out; an empty table or an empty list of rules gives no rule to any row. Rules of equal length that fit the same URL: the one with the
longer host wins; the same key in both lists: block wins.
"""

from __future__ import annotations

import string
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvemill.llm.flow import materialize, only

BITS_PER_KEY = 14
HASHES = 6
# 64-bit words of one level that may travel with the plan
MAX_WORDS = 1 << 16


class Level(NamedTuple):
    words: list[int]
    bits: int


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.coalesce(F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _places(key: Column, level: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level * HASHES + j)), F.lit(bits)) for j in range(HASHES)]


def encode(keys: DataFrame, level: int, n: int) -> Level:
    """The filter of ``n`` keys (column ``key``). Bits of a word are or-ed before the shuffle; MAX_WORDS words at most come to the driver."""
    bits = 64 * -(-max(n, 8) * BITS_PER_KEY // 64)
    place = keys.select(F.explode(F.array(*_places(F.col("key"), level, bits))).alias("p"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("p", F.lit(64)).cast("int"))
    found = place.groupBy((F.col("p") / 64).cast("int").alias("w")).agg(F.bit_or(bit).alias("v")).collect()
    words = [0] * (bits // 64)
    for r in found:
        words[r["w"]] = r["v"]
    return Level(words, bits)


def takes(key: Column, level: Level, number: int) -> Column:
    words = F.lit(level.words) if len(level.words) > 1 else F.array(F.lit(level.words[0]))
    words = words.cast("array<bigint>")
    ask = [F.call_function("shiftright", F.get(words, (p / 64).cast("int")), F.pmod(p, F.lit(64)).cast("int")).bitwiseAND(1) == 1
           for p in _places(key, number, level.bits)]
    return reduce(Column.__and__, ask)


def fits(n: int) -> bool:
    return max(n, 8) * BITS_PER_KEY <= 64 * MAX_WORDS


def cascade(listed: DataFrame, universe: DataFrame) -> list[Level] | None:
    """Filters that tell listed keys from all other keys of ``universe`` (both have the column ``key``); None if one would be too large."""
    listed = materialize(only(listed, "key").where(F.col("key").isNotNull()).distinct())
    n = listed.count()
    if not n:
        return []
    if not fits(n):
        return None
    levels = [encode(listed, 0, n)]
    wrong = only(universe, "key").where(takes(F.col("key"), levels[0], 0)).distinct()
    sides = [materialize(wrong.join(listed, "key", "left_anti")), listed]  # what the next level holds, what it may take wrongly
    while n := sides[0].count():
        if not fits(n):
            return None
        number = len(levels)
        levels.append(encode(sides[0], number, n))
        sides = [materialize(sides[1].where(takes(F.col("key"), levels[-1], number))), sides[0]]
    return levels


def is_listed(key: Column, levels: list[Level]) -> Column:
    out = F.lit(False)
    for number in range(len(levels) - 1, -1, -1):
        out = F.when(takes(key, levels[number], number), out if number < len(levels) - 1 else F.lit(number % 2 == 0)).otherwise(F.lit(number % 2 == 1))
    return F.coalesce(out, F.lit(False))


def key_columns(shapes: list[tuple[int, int]], host: Column, path: Column) -> list[Column]:
    """For each (labels, characters): that many last labels of the host with that many first characters of the path, null if there are fewer."""
    labels = F.split(host, r"\.")
    return [F.when((F.size(labels) >= k) & (F.length(path) >= n) & (host != ""),
                   F.concat(F.array_join(F.slice(labels, -k, k), "."), F.substring(path, 1, n))) for k, n in shapes]


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """``id_col, host, path, rule, verdict`` of every row. ``rules``: ``host, path, verdict`` (allow or block). Without a rule: ``default``."""
    rules = rules.select("host", "path", "verdict", F.concat("host", "path").alias("key"))
    shape = rules.select(F.size(F.split("host", r"\.")).alias("k"), F.length("path").alias("n")).distinct()
    # (labels, characters) pairs: as many as kinds of rules, not as rules; the longest key and then the longest host first
    shapes = [(r["k"], r["n"]) for r in shape.collect()]
    url = pages.select(F.col(f"`{id_col}`"), host_of(F.col(f"`{url_col}`")).alias("host"), path_of(F.col(f"`{url_col}`")).alias("path"))
    keys = key_columns(shapes, F.col("host"), F.col("path"))
    if not keys:
        return url.select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    universe = url.select(F.explode(F.array(*keys)).alias("key")).where(F.col("key").isNotNull())
    sets = {v: cascade(rules.where(F.col("verdict") == v), universe) for v in ("block", "allow")}
    if None in sets.values():
        return _by_join(url, rules, keys, id_col, default)
    found = [F.when(is_listed(k, sets["block"]), F.struct(F.length(k).alias("len"), F.lit(s[0]).alias("k"), k.alias("rule"), F.lit("block").alias("verdict")))
             .when(is_listed(k, sets["allow"]), F.struct(F.length(k).alias("len"), F.lit(s[0]).alias("k"), k.alias("rule"), F.lit("allow").alias("verdict")))
             for k, s in zip(keys, shapes)]
    best = F.array_max(F.array(*found))
    return url.select(id_col, "host", "path", best["rule"].alias("rule"), F.coalesce(best["verdict"], F.lit(default)).alias("verdict"))


def _by_join(url: DataFrame, rules: DataFrame, keys: list[Column], id_col: str, default: str) -> DataFrame:
    """The same for lists too long for filters: keys are joined to the rules, then joined back to each distinct (host, path)."""
    place = url.select("host", "path").distinct()
    asked = place.select("host", "path", F.explode(F.array(*keys)).alias("key"))
    best = asked.join(rules.select("key", "verdict", F.size(F.split("host", r"\.")).alias("k")), "key").groupBy("host", "path").agg(
        F.max(F.struct(F.length("key").alias("len"), "k", F.col("key").alias("rule"), "verdict")).alias("best"))
    out = url.join(best, ["host", "path"], "left")
    return out.select(id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
