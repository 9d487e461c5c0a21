"""The journal as a stream: micro-batches against stored state, windows over events, sessions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerlark.operators.diff import against_state, deltas
from ledgerlark.operators.journal import ITEM, latest_per
from ledgerlark.settings import Settings

CHANGES = "source string, source_item_id string, id long, kind string"


def _changes(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Changes of one item's rows in order of id; the state is the last row's price and availability. Items are many and each has few rows."""
    price, available = state.get if state.exists else (None, None)
    seen, rows = state.exists, []
    for row in pd.concat(batches).sort_values("id").itertuples(index=False):
        now_price = None if pd.isna(row.price_cents) else int(row.price_cents)
        now_available = row.availability if isinstance(row.availability, str) else None
        if not seen:
            rows.append((*key, row.id, "first_seen"))
        else:
            if None not in (now_available, available) and now_available != available and "available" in (now_available, available):
                rows.append((*key, row.id, "became_available" if now_available == "available" else "became_unavailable"))
            if None not in (now_price, price) and now_price != price:
                rows.append((*key, row.id, "price_drop" if now_price < price else "price_rise"))
        price, available, seen = now_price, now_available, True
    state.update((price, available))
    yield pd.DataFrame(rows, columns=["source", "source_item_id", "id", "kind"])


def change_stream(observations: DataFrame) -> DataFrame:
    """All changes of a stream of observations, item by item, with state kept between batches."""
    return observations.groupBy(*ITEM).applyInPandasWithState(_changes, CHANGES, "price long, availability string", "append", GroupStateTimeout.NoTimeout)


def journal_batches(observations: DataFrame, journal_path: str, deltas_path: str, checkpoint: str, settings: Settings) -> StreamingQuery:
    """Each micro-batch is a run: compare with the stored journal, write its changes, append its rows. Both writes go to a folder
    named by the batch, so a batch that is run again replaces what it wrote."""

    def run(batch: DataFrame, batch_id: int) -> None:
        state = batch.limit(0)
        if batch_id:  # batch 0 has written a journal; what a broken run of this batch wrote doesn't count
            state = batch.sparkSession.read.parquet(journal_path).where(F.col("batch") < batch_id).select(*batch.columns)
        found = deltas(against_state(latest_per(batch), latest_per(state)), settings)
        found.select(*ITEM, "id", "kind").write.mode("overwrite").parquet(f"{deltas_path}/batch={batch_id}")
        batch.write.mode("overwrite").parquet(f"{journal_path}/batch={batch_id}")

    return observations.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def with_watermark(events: DataFrame, delay: str, ts: str = "ts") -> DataFrame:
    """Watermarks need a timestamp with a zone; the session's zone is taken."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def tumbling(events: DataFrame, width: str, by: str, ts: str = "ts", slide: str | None = None) -> DataFrame:
    """(window_start, by, n, total) over windows of time."""
    w = F.window(F.col(ts).cast("timestamp"), width, slide) if slide else F.window(F.col(ts).cast("timestamp"), width)
    return events.groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), by, "n", "total")


def sessions(events: DataFrame, gap: str, by: str, ts: str = "ts") -> DataFrame:
    """(by, session_start, session_end, n): runs of events no further apart than the gap."""
    w = F.session_window(F.col(ts).cast("timestamp"), gap)
    return events.groupBy(by, w.alias("w")).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def distinct_within(events: DataFrame, keys: list[str], delay: str, ts: str = "ts") -> DataFrame:
    """A stream's events without those that come again within the delay."""
    return with_watermark(events, delay, ts).dropDuplicatesWithinWatermark(keys)
