"""Silence pairing on a stream of log lines."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.intervals import silence_marks


def silence_stream(log: DataFrame) -> DataFrame:
    """Intervals of a stream of (media_id, ord, line) as their ends arrive; lines of a media must arrive in order between triggers.

    The state of a media is its pending start, so it does not grow.
    """

    def pair(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending = state.get[0] if state.exists else None
        rows = []
        for r in pd.concat(list(batches)).sort_values("ord").itertuples():
            if r.kind == "S":
                pending = int(r.value)
            elif pending is not None:
                rows.append((key[0], r.ord, pending, int(r.value), int(r.value) - pending))
                pending = None
        state.update((pending,))
        yield pd.DataFrame(rows, columns=["media_id", "ord", "start_ms", "end_ms", "duration_ms"])

    return silence_marks(log).groupBy("media_id").applyInPandasWithState(
        pair, "media_id long, ord long, start_ms long, end_ms long, duration_ms long", "pending long", "append", GroupStateTimeout.NoTimeout
    )
