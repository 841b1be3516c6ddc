"""Folds of a key's rows in order, for what windows can't say: rows stream through tasks sorted, and only a key's live state is held."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fold(rows: DataFrame, keys: list[str], order: list, make: Callable[[], object], schema: str, ahead: Column | None = None) -> DataFrame:
    """What ``make().put(row)`` yields for each row of a key, in ``order``, and ``make().end()`` after its last one.

    Rows are dealt by ``keys`` and sorted within their task; batches pass one after another, whatever a key's share of them. Times come as
    pandas timestamps, missing values as None. With ``ahead``, a row has a column of that name: the least of it among the rows of its
    key still to come, for which ``order`` must be ascending.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    times = [c.split()[0] for c in schema.split(", ") if c.split()[1] == "timestamp"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None

        def frame(out: list[tuple]) -> pd.DataFrame:
            made = pd.DataFrame(out, columns=names)
            for c in times:
                made[c] = pd.to_datetime(made[c])
            return made

        for pdf in batches:
            out = []
            columns = [pdf[c].astype(object).where(pdf[c].notna(), None).tolist() for c in pdf.columns]
            for values in zip(*columns, strict=True):
                r = dict(zip(pdf.columns, values, strict=True))
                now = tuple(r[k] for k in keys)
                if state is None or now != key:
                    if state is not None:
                        out += state.end()
                    key, state = now, make()
                out += state.put(r)
            yield frame(out)
        if state is not None:
            yield frame(list(state.end()))

    rows = rows.repartition(*keys)
    if ahead is not None:
        back = [(F.col(o) if isinstance(o, str) else o).desc_nulls_last() for o in order]
        rows = rows.withColumn("ahead", F.min(ahead).over(W.partitionBy(*keys).orderBy(*back).rowsBetween(W.unboundedPreceding, -1)))
    return rows.sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
