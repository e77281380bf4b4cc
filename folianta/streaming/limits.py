"""The request limit on a stream: state is each visitor's admitted times of the last hour."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.records import HOUR_MS, admit


def limited(requests: DataFrame, limit: int, window_ms: int = HOUR_MS) -> DataFrame:
    """visitor, at, id, used and ok for a stream of requests (visitor, at in ms, id), as ``records.rate_limit`` does for a table.

    State is pruned on every read, so a visitor holds at most ``limit`` times. An
    extension of the batch operator: requests are taken in the order of their
    micro-batches, and by time within one.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["at", "id"])
        rows["ok"], rows["used"], held = admit(rows["at"].tolist(), held, limit, window_ms)
        state.update((held,))
        yield rows[["visitor", "at", "id", "used", "ok"]]

    out = "visitor string, at bigint, id bigint, used bigint, ok boolean"
    return requests.select("visitor", "at", "id").groupBy("visitor").applyInPandasWithState(run, out, "held array<bigint>", "append", GroupStateTimeout.NoTimeout)
