"""The quality gate as a stateful stream: a rolling mean of the last scores per session, with hysteresis."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodeseam.operators.evaluate import DEGRADED, RECOVERED, ROLLING


def quality_gate_stream(scores: DataFrame) -> DataFrame:
    """``session, id, mean, degraded`` for a stream of ``session, id, score``; ids order the scores within a batch."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, degraded = state.get if state.exists else ([], False)
        last = list(last)
        rows = pd.concat(list(batches)).sort_values("id")
        out = []
        for r in rows.itertuples():
            last = [*last, float(r.score)][-ROLLING:]
            mean = round(sum(last) / len(last), 9)
            degraded = True if mean < DEGRADED else False if mean > RECOVERED else degraded
            out.append((key[0], r.id, mean, degraded))
        state.update((last, degraded))
        yield pd.DataFrame(out, columns=["session", "id", "mean", "degraded"])

    return scores.groupBy("session").applyInPandasWithState(
        update, "session string, id bigint, mean double, degraded boolean", "last array<double>, degraded boolean", "append", GroupStateTimeout.NoTimeout
    )
