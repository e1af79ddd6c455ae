"""The outreach queue as a stream: reports per item with state, and the rolling capacity count with a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import constants as C

OUTCOME = "id long, status string, accepted long, refused long"
STATE = "status string, accepted long, refused long"


def fold_reports(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """An item's state after the reports that have come so far; items start out claimed."""
    status, accepted, refused = state.get if state.exists else ("claimed", 0, 0)
    for r in pd.concat(batches).sort_values("seq").itertuples():
        if status in C.QUEUE_MOVES.get(r.status, ()):
            status, accepted = r.status, accepted + 1
        else:
            refused += 1
    state.update((status, accepted, refused))
    yield pd.DataFrame({"id": [key[0]], "status": [status], "accepted": [accepted], "refused": [refused]})


def item_states(reports: DataFrame) -> DataFrame:
    """reports: id, seq, status as a stream. Emits each touched item's state; the latest row of an item holds."""
    return reports.groupBy("id").applyInPandasWithState(fold_reports, OUTCOME, STATE, "update", GroupStateTimeout.NoTimeout)


def claims_by_window(claims: DataFrame, late: str = "1 hour", width: str = "24 hours", slide: str = "1 hour") -> DataFrame:
    """Claims counted towards capacity in sliding windows over event time; late ones count until the watermark."""
    counted = claims.where(F.col("status").isin(C.CAPACITY_STATES)).withWatermark("claimed_at", late)
    return counted.groupBy(F.window("claimed_at", width, slide), "channel").agg(F.count("*").alias("used"))


def history(stream: DataFrame, path: str, checkpoint: str):
    """Append-only history written as Parquet; each micro-batch becomes visible once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
