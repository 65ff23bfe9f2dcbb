"""A user function per curve, with failures as rows."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from itertools import chain

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame

ERROR_CHARS = 200


def curve_apply_safe(lc: DataFrame, fn: Callable[[str, Iterator[pd.DataFrame]], dict | None], schema: str) -> DataFrame:
    """``fn(target, batches) -> dict | None`` on every curve; ``schema`` names the dict's columns.

    ``batches`` are the samples in order of ``t``, an Arrow batch at a time, so a curve of any length is passed on without being
    held; a function that needs it whole can concatenate them. An exception becomes a row with ``error`` (at most 200
    characters), ``None`` gives no row, and neither stops the job.
    """
    names = [c.split()[0] for c in schema.split(",")]
    empty = dict.fromkeys(names)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = next(frames)
        target = first["target"].iloc[0]
        try:
            got = fn(target, chain([first], frames))
            rows = [] if got is None else [{**empty, **got, "target": target, "error": None}]
        except Exception as exc:
            rows = [{**empty, "target": target, "error": f"{type(exc).__name__}: {exc}"[:ERROR_CHARS]}]
        for _ in frames:  # what the function left unread
            pass
        yield pd.DataFrame(rows, columns=["target", *names, "error"])

    # sorted by (target, t), the input needs no other sort for the groups, so each curve comes in order
    curves = lc.repartition("target").sortWithinPartitions("target", "t")
    return curves.groupBy("target").applyInPandas(run, f"target string, {schema}, error string")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
