"""Rows of a key in order: what stateful operators over ticks, messages and bars share."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAY_MS = 86_400_000


class InOrder(StatefulProcessor):
    """A processor that gets each trigger's rows of a key sorted by ``order``.

    A row before the last one of an earlier trigger is an error: state cannot be taken back.
    """

    def __init__(self, order: tuple[str, ...]) -> None:
        self.order = list(order)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", ", ".join(f"{c} bigint" for c in self.order))

    def sorted_rows(self, key: tuple, rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
        fresh = pd.concat(list(rows)).sort_values(self.order, ignore_index=True)
        first, last = (tuple(int(x) for x in fresh.loc[i, self.order]) for i in (0, len(fresh) - 1))
        if self.last.exists() and first <= tuple(self.last.get()):
            raise ValueError(f"rows of {key} arrived out of order")
        self.last.update(last)
        return fresh

    def end_of_day(self, ts_ms: int) -> None:
        """Have the key's state cleared when the watermark has passed the day."""
        self.handle.registerTimer((ts_ms // DAY_MS + 1) * DAY_MS)

    def close(self) -> None:
        pass
