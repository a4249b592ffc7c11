"""Failing links that ask for their next retry themselves: timers in the state store.

Every failing link has its state and one event-time timer in Spark's state store. A
timer gives the link out once its days since the first failure are over, a success takes
both away, and a link that has failed too often is given out once as permanent and forgotten
after a while. So nothing scans the table of failing links to find those that are due.

The session needs the RocksDB state store (``STORE``); state and timers survive a restart.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from pressloom.operators.links import RETRY_DAYS

#: The session setting that timers need.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: Days after its last failure at which a permanent link is forgotten.
FORGET_DAYS = 365
_DAY = 86_400_000
_STATE = StructType([StructField(c, kind()) for c, kind in (("retries", IntegerType), ("first_failed", LongType), ("last_checked", LongType), ("error", StringType), ("timer", LongType))])
_OUT = "url string, kind string, retry_count int, first_failed_at timestamp, last_checked_at timestamp, error_type string, at timestamp"


class _Link(StatefulProcessor):
    """One url: kinds of rows given out are due, permanent and forgotten."""

    def __init__(self, forget_days: int):
        self.forget = forget_days * _DAY

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("link", _STATE)

    def _row(self, key, kind: str, held: tuple, at: int) -> pd.DataFrame:
        first, last, now = (pd.Timestamp(x, unit="ms") for x in (held[1], held[2], at))
        return pd.DataFrame([(key[0], kind, held[0], first, last, held[3], now)], columns=[c.split()[0] for c in _OUT.split(", ")])

    def _set(self, held: tuple, at: int) -> None:
        """The state with its one timer at ``at``."""
        if held[4] is not None:
            self.handle.deleteTimer(held[4])
        self.handle.registerTimer(at)
        self.state.update((*held[:4], at))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        before = held
        for r in pd.concat(list(rows)).sort_values(["tried", "seq"], kind="stable").itertuples(index=False):
            if not r.failed:
                if held is not None and held[4] is not None:
                    self.handle.deleteTimer(held[4])
                held = None
            else:
                at = r.tried.value // 1_000_000
                held = (held[0] + 1, held[1], at, r.error_type, held[4]) if held else (0, at, at, r.error_type, None)
        if held is None:
            if before is not None:
                self.state.clear()
        elif held[0] < len(RETRY_DAYS):
            self._set(held, held[1] + RETRY_DAYS[held[0]] * _DAY)
        else:
            if before is None or before[0] < len(RETRY_DAYS):
                yield self._row(key, "permanent", held, held[2])
            self._set(held, held[2] + self.forget)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, at = self.state.get(), expiredTimerInfo.getExpiryTimeInMs()
        if held[0] < len(RETRY_DAYS):
            self.state.update((*held[:4], None))
            yield self._row(key, "due", held, at)
        else:
            self.state.clear()
            yield self._row(key, "forgotten", held, at)

    def close(self) -> None:
        pass


def retries(attempts: DataFrame, late: str = "0 seconds", forget_days: int = FORGET_DAYS) -> DataFrame:
    """(url, kind, retry_count, first_failed_at, last_checked_at, error_type, at): links as they fall due, by the event time of attempts(url, tried, seq, failed, error_type).

    A link is given out as due when the watermark, ``late`` behind the latest attempt, has
    passed its 7, 14 or 30 days since the first failure; once, until it fails again. Fractions of a millisecond
    are cut. Attempts later than the watermark are left out, as everywhere in a stream.
    """
    known = attempts.withWatermark("tried", late).groupBy("url")
    return known.transformWithStateInPandas(statefulProcessor=_Link(forget_days), outputStructType=StructType.fromDDL(_OUT), outputMode="Update", timeMode="EventTime")
