"""Claims that nobody reports on return by timer, and the rolling capacity of a channel, as streams with state.

Each item's state is its status and the time of its claim; a timer of event time stands at the moment its claim is over. An event that comes later than that finds the item
returned already, whether the timer has fired or not, so as long as an item's events come in order it does not matter how they fall into micro-batches. A channel's capacity is counted in
``SHARDS`` parts (a channel is one hot key), each a map from minute to claims with a timer for the minute that leaves the last 24 hours.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import constants as C

SHARDS = 64
MINUTE = 60_000
DAY = 24 * 60 * MINUTE
MOVED = "id long, status string, at timestamp, cause string"
USED = "channel string, shard int, minute timestamp, used long"


def over(claimed_ms: int, ttl_minutes: int) -> int:
    """When a claim is over: strictly after its time limit."""
    return claimed_ms + ttl_minutes * MINUTE + 1


def follow(status: str, claimed_ms: int, events: list[tuple[int, str]], ttl_minutes: int) -> tuple[str, int, list[tuple[str, int, str]]]:
    """(status, time of claim, moves) of an item after events (ms, wanted status) in order of time. A move is (status, ms, cause): ``event``, ``expired`` or, for
    what the table of moves forbids, ``refused``."""
    moves = []
    for at, wanted in events:
        if status == "claimed" and at >= over(claimed_ms, ttl_minutes):
            status = "queued"
            moves.append((status, over(claimed_ms, ttl_minutes), "expired"))
        allowed = status in (("queued",) if wanted == "claimed" else C.QUEUE_MOVES.get(wanted, ()))
        if allowed:
            status, claimed_ms = wanted, at if wanted == "claimed" else claimed_ms
        moves.append((status, at, "event" if allowed else "refused"))
    return status, claimed_ms, moves


def _frame(key, moves: list[tuple[str, int, str]]) -> pd.DataFrame:
    at = pd.to_datetime([m[1] for m in moves], unit="ms")
    return pd.DataFrame({"id": [key[0]] * len(moves), "status": [m[0] for m in moves], "at": at, "cause": [m[2] for m in moves]})


class ClaimExpiry(StatefulProcessor):
    def __init__(self, ttl_minutes: int):
        self.ttl_minutes = ttl_minutes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.item = handle.getValueState("item", "status string, claimed_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows)).sort_values(["at", "seq"])
        status, claimed_ms = self.item.get() if self.item.exists() else ("queued", 0)
        events = list(zip((got["at"].astype("datetime64[ms]").astype("int64")).tolist(), got["status"].tolist(), strict=True))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        status, claimed_ms, moves = follow(status, claimed_ms, events, self.ttl_minutes)
        self.item.update((status, claimed_ms))
        if status == "claimed":
            self.handle.registerTimer(over(claimed_ms, self.ttl_minutes))
        yield _frame(key, moves)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        status, claimed_ms = self.item.get()
        if status == "claimed" and over(claimed_ms, self.ttl_minutes) == at:
            self.item.update(("queued", claimed_ms))
            yield _frame(key, [("queued", at, "expired")])

    def close(self) -> None:
        pass


def item_moves(events: DataFrame, ttl_minutes: int = 120, late: str = "10 minutes") -> DataFrame:
    """events: id, seq, at, status (``claimed`` or a report) as a stream. Every move of every item, returns of stale claims among them. Needs the RocksDB state store."""
    keyed = events.withWatermark("at", late).groupBy("id")
    return keyed.transformWithStateInPandas(ClaimExpiry(ttl_minutes), MOVED, "Append", "EventTime")


class RollingClaims(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.minutes = handle.getMapState("minutes", "minute long", "n long")

    def _row(self, key, minute: int) -> pd.DataFrame:
        used = sum(n for (m,), (n,) in self.minutes.iterator() if m > minute - DAY)
        return pd.DataFrame({"channel": [key[0]], "shard": [key[1]], "minute": pd.to_datetime([minute], unit="ms"), "used": [used]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows))
        minutes = (got["at"].astype("datetime64[ms]").astype("int64") // MINUTE * MINUTE).value_counts()
        for minute, n in minutes.sort_index().items():
            before = self.minutes.getValue((minute,))[0] if self.minutes.containsKey((minute,)) else 0
            self.minutes.updateValue((minute,), (before + int(n),))
            self.handle.registerTimer(minute + DAY)
        yield self._row(key, int(minutes.index.max()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        if self.minutes.containsKey((at - DAY,)):
            self.minutes.removeKey((at - DAY,))
        yield self._row(key, at)

    def close(self) -> None:
        pass


def rolling_used(claims: DataFrame, late: str = "10 minutes", shards: int = SHARDS) -> DataFrame:
    """claims: channel, id, at as a stream, one row for what counts towards capacity. How much of the last 24 hours each shard of a channel has, after each change and each minute
    that leaves them; a channel's use is the sum of its shards' last rows (``channel_used``)."""
    keyed = claims.withWatermark("at", late).withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).groupBy("channel", "shard")
    return keyed.transformWithStateInPandas(RollingClaims(), USED, "Append", "EventTime")


def channel_used(rows: DataFrame) -> DataFrame:
    """channel, used: from all rows that ``rolling_used`` has written so far."""
    last = rows.groupBy("channel", "shard").agg(F.max_by("used", "minute").alias("used"))
    return last.groupBy("channel").agg(F.sum("used").alias("used"))
