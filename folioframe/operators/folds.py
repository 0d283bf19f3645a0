"""Folds in order over the rows of a group, many small groups a call."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _starts(rows: pd.DataFrame, by: Sequence[str]) -> np.ndarray:
    """Where a row's key is another than that of the row before; the first row opens a group."""
    new = np.zeros(len(rows), bool)
    new[:1] = True
    for c in by:
        v = rows[c]
        new[1:] |= ((v != v.shift()) & ~(v.isna() & v.shift().isna())).to_numpy(bool)[1:]
    return np.flatnonzero(new)


def folded(rows: DataFrame, by: Sequence[str], order: Sequence[str], fold: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """What `fold` makes of groups: it gets a frame of whole groups in order and their bounds, group i from bounds[i] to bounds[i + 1].

    Spark deals and sorts the rows. A worker holds a batch and the one group that goes on in the next batch, so neither many groups
    nor small ones cost a call each.
    """
    by = list(by)
    dealt = rows.repartition(*by).sortWithinPartitions(*by, *(F.col(c).asc_nulls_last() for c in order))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done(parts: list[pd.DataFrame]) -> pd.DataFrame:
            whole = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
            return fold(whole, np.append(_starts(whole, by), len(whole)))

        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            last = int(_starts(batch, by)[-1])
            if held:
                joint = pd.concat([held[-1].iloc[-1:], batch.iloc[:1]], ignore_index=True)
                if len(_starts(joint, by)) == 2:
                    yield done(held)
                    held = []
            if last:
                yield done([*held, batch.iloc[:last].reset_index(drop=True)])
                held = []
            held.append(batch.iloc[last:].reset_index(drop=True))
        if held:
            yield done(held)

    return dealt.mapInPandas(run, schema)
