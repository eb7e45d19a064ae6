"""Token budgets with reservations, as state of a stream: reserve, settle, expire, and a new budget each calendar day.

A request reserves tokens before a call and settles what the call really took. Refused are requests beyond the limit of one query, and those
that what was used today, what is reserved and the request together take beyond the day's limit. A reservation that is not settled within
its time is free again: requests after that moment do not count it, and a timer removes it from the state once the watermark has
passed. Midnight (UTC) sets what was used to nothing and leaves reservations.

Requests of an account are a sequence: those of a micro-batch are ordered by time and number, micro-batches follow each other. State per account
is two numbers and its open reservations; a batch of one account meets in a task, so bound batches by ``maxFilesPerTrigger``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..sources.tablelog import Table

RESULT = "account {account}, seq long, kind string, outcome string, used long, reserved long"
#: State of arbitrary operators needs this store.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
DAY = 86_400_000_000


@dataclass(frozen=True)
class Limits:
    daily: int
    per_query: int
    hold_seconds: int = 3600


class Ledger(StatefulProcessor):
    """Rows (account, at in microseconds, seq, kind, request, tokens) to their outcomes.

    granted, per_query or daily for a reservation, settled or unknown (no open reservation of that request) for a settlement. ``used``
    and ``reserved`` are the account's state after the row.
    """

    def __init__(self, limits: Limits):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.total = handle.getValueState("total", "day long, used long")
        self.open = handle.getMapState("open", "request long", "tokens long, until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["at", "seq"], kind="stable")
        day, used = self.total.get() if self.total.exists() else (None, 0)
        before = {k[0]: tuple(v) for k, v in self.open.iterator()}
        held, out, times = dict(before), [], set()
        for r in batch.itertuples(index=False):
            if r.at // DAY != day:
                day, used = r.at // DAY, 0
            held = {k: v for k, v in held.items() if v[1] > r.at}
            reserved = sum(v[0] for v in held.values())
            if r.kind == "settle":
                known = held.pop(r.request, None)
                outcome = "settled" if known else "unknown"
                used += int(r.tokens) if known else 0
            elif r.tokens < 0 or r.tokens > self.limits.per_query:
                outcome = "per_query"
            elif used + reserved + r.tokens > self.limits.daily:
                outcome = "daily"
            else:
                outcome = "granted"
                held[r.request] = (int(r.tokens), int(r.at) + self.limits.hold_seconds * 1_000_000)
                times.add(held[r.request][1])
            out.append((int(r.seq), r.kind, outcome, used, sum(v[0] for v in held.values())))
        self.total.update((int(day), int(used)))
        for k in before.keys() - held.keys():
            self.open.removeKey((k,))
        for k, v in held.items():
            if before.get(k) != v:
                self.open.updateValue((int(k),), v)
                self.handle.registerTimer(v[1] // 1000 + 1)
        yield pd.DataFrame(out, columns=["seq", "kind", "outcome", "used", "reserved"]).assign(account=key[0])[["account", "seq", "kind", "outcome", "used", "reserved"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        for k in [k for k, v in self.open.iterator() if v[1] <= now]:
            self.open.removeKey(tuple(k))
        return iter(())

    def close(self) -> None:
        pass


def outcomes(requests: DataFrame, limits: Limits, late: str = "1 day") -> DataFrame:
    """(account, seq, kind, outcome, used, reserved) of a stream of requests (account, at in microseconds since 1970, seq, kind, request, tokens).

    Rows without a time or number are no requests; missing tokens are none.
    """
    requests.sparkSession.conf.set(*STORE)
    rows = requests.withColumn("time", F.timestamp_micros("at")).withWatermark("time", late).select("account", "time", F.col("at").cast("long"), F.col("seq").cast("long"), "kind", F.col("request").cast("long"), F.coalesce(F.col("tokens").cast("long"), F.lit(0)).alias("tokens")).where("at IS NOT NULL AND seq IS NOT NULL")
    kind = dict(requests.dtypes)["account"]
    return rows.groupBy("account").transformWithStateInPandas(Ledger(limits), RESULT.format(account=kind), "Append", "EventTime")


def record(requests: DataFrame, limits: Limits, table: Table, name: str, checkpoint: str) -> StreamingQuery:
    """Write the outcomes of a stream into a versioned table, each batch once, then stop."""

    def step(batch: DataFrame, batch_id: int) -> None:
        table.upsert(batch, batch=(name, batch_id))

    return outcomes(requests, limits).writeStream.foreachBatch(step).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
