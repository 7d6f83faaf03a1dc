"""Learners on streams: a state per key that survives restarts through the checkpoint."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators.subspace import Subspace

STATE = "model string"


def accumulate(df: DataFrame, key: str, vec: str, dims: int, decay: float = 1.0) -> DataFrame:
    """key, n, sums after each micro-batch, decayed once per row; rows of a batch are taken in order of arrival."""
    kind = df.schema[key].dataType.simpleString()

    def run(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, sums = state.get if state.exists else (0, [0.0] * dims)
        s = np.array(sums, float)
        for b in batches:
            for x in b["v"]:
                s = s * decay + np.asarray(x, float)
                n += 1
        state.update((n, s.tolist()))
        yield pd.DataFrame({key: [k[0]], "n": [n], "sums": [s.tolist()]})

    form = f"{key} {kind}, n long, sums array<double>"
    return df.select(key, F.col(vec).alias("v")).groupBy(key).applyInPandasWithState(run, form, "n long, sums array<double>", "update", "NoTimeout")


def anomalies(df: DataFrame, key: str, order: str, vec: str, k: int, **params) -> DataFrame:
    """key, order, residual, threshold, anomalous: each key's subspace scores a row, then learns it; rows of a micro-batch are taken in the order given."""
    kinds = [df.schema[c].dataType.simpleString() for c in (key, order)]

    def run(name, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        model = Subspace.restore(json.loads(state.get[0])) if state.exists else None
        rows = pd.concat(list(batches)).sort_values(order)
        out = []
        for x in rows["v"]:
            x = np.asarray(x, float)
            model = model or Subspace(len(x), k, **params)
            limit = model.threshold()
            r = model.update(x)
            out.append((r, limit, r > limit))
        state.update((json.dumps(model.snapshot()),))
        got = pd.DataFrame(out, columns=["residual", "threshold", "anomalous"])
        yield pd.concat([rows[[key, order]].reset_index(drop=True), got], axis=1)

    form = f"{key} {kinds[0]}, {order} {kinds[1]}, residual double, threshold double, anomalous boolean"
    return df.select(key, order, F.col(vec).cast("array<double>").alias("v")).groupBy(key).applyInPandasWithState(run, form, STATE, "append", "NoTimeout")
