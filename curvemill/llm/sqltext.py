"""Words and shingles as Spark expressions, for operators that use DataFrame functions only. Words are those of `textkit`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curvemill.llm.textkit import WORD_BREAK


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_BREAK), "")


def runs(words: Column, k: int) -> Column:
    """Where runs of k words begin; empty for a shorter text. ``words`` has to be a stored column, since every position reads it."""
    return F.when(F.size(words) >= k, F.sequence(F.lit(0), F.size(words) - k)).otherwise(F.array().cast("array<int>"))


def shingle_hashes(words: Column, k: int) -> Column:
    """A 64-bit hash of each run of k words, repeated ones included."""
    return F.transform(runs(words, k), lambda i: F.xxhash64(F.lit(k), *[F.get(words, i + j) for j in range(k)]))


def shingle_texts(words: Column, k: int) -> Column:
    """The different runs of k words, as text."""
    return F.array_distinct(F.transform(runs(words, k), lambda i: F.concat_ws(" ", *[F.get(words, i + j) for j in range(k)])))
