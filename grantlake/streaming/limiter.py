"""A fixed-window request limiter whose windows begin at a client's first request.

A window lasts ``seconds`` from the request that opened it; the first request later than that opens the
next. Requests over the limit are denied; a limit of 0 or less denies none. Tumbling windows would cut
elsewhere, so state is kept for each client. A request without a time belongs to no window: its
window_start and n are null, and it is denied unless the limit is off. A null client is a client.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FOLDED = "client string, event_id long, us long, start_us long, n long"


def _fold(us: list[int], start: int | None, n: int, length: int) -> tuple[list[int], list[int]]:
    """(window start, number in the window) of requests in order of time, from an open window."""
    starts, numbers = [], []
    for t in us:
        if start is None or t > start + length:
            start, n = t, 0
        n += 1
        starts.append(start)
        numbers.append(n)
    return starts, numbers


def _timed(requests: DataFrame) -> DataFrame:
    """Clients as text, so that null and long ones pass through pandas as they are, and times in microseconds."""
    return requests.select(F.col("client").cast("string").alias("client"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


def _decided(folded: DataFrame, requests: DataFrame, limit: int) -> DataFrame:
    """Decisions from folded requests, and those of the requests without a time."""
    allowed = lambda n: F.lit(limit <= 0) | F.coalesce(n <= limit, F.lit(False))
    kind, none = requests.schema["client"].dataType, F.lit(None)

    def out(df: DataFrame, ts: Column, start: Column, n: Column) -> DataFrame:
        return df.select(F.col("client").cast(kind).alias("client"), "event_id", ts.alias("ts"), start.alias("window_start"), n.alias("n"), allowed(n).alias("allowed"))

    known = out(folded, F.timestamp_micros("us"), F.timestamp_micros("start_us"), F.col("n"))
    return known.unionByName(out(requests.filter(F.col("ts").isNull()), none.cast("timestamp"), none.cast("timestamp"), none.cast("long")))


def bursts(timed: DataFrame, length: int) -> DataFrame:
    """Adds ``burst``: the time of the last request, at or before this one, that follows a gap longer than ``length``.

    Such a request opens a window whatever came before. Gaps are found within slots of the window's
    length: a request's predecessor lies in its slot or the one before, or the gap is longer anyway. So
    a hot client is split by time, and only one row for each of its slots meets in one place.
    """
    own, slot = timed.withColumn("slot", F.floor(F.col("us") / length)), ["client", "slot"]
    order = Window.partitionBy(*slot).orderBy("us", "event_id")
    joined = lambda a, b: a.join(b, a.client.eqNullSafe(b["_c"]) & (a.slot == b["_s"]), "left").drop("_c", "_s")
    key = lambda s: [F.col("client").alias("_c"), s.alias("_s")]
    last = own.groupBy(*slot).agg(F.max("us").alias("_last")).select(*key(F.col("slot") + 1), "_last")
    before = F.coalesce(F.lag("us").over(order), F.col("_last"))
    cut = F.when(before.isNull() | (F.col("us") - before > length), F.col("us"))
    marked = joined(own, last).withColumn("_cut", cut)
    slots = marked.groupBy(*slot).agg(F.max("_cut").alias("_cut"))
    earlier = Window.partitionBy("client").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = slots.select(*key(F.col("slot")), F.max("_cut").over(earlier).alias("_carried"))
    return joined(marked.withColumn("_own", F.max("_cut").over(order)), carried).select("client", "event_id", "us", F.coalesce("_own", "_carried").alias("burst"))


def limited(requests: DataFrame, seconds: float, limit: int) -> DataFrame:
    """Decisions for a table of requests (client, event_id, ts).

    The fold runs over bursts (see ``bursts``), not over clients; rows come sorted by burst and each Arrow
    batch is folded at once, so no client or burst is held in memory. What stays in one task is one
    unbroken burst, since each of its windows begins where the one before it ends.
    """
    length = int(seconds * 1_000_000)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = start = None
        n = 0
        for b in batches:
            keys, us, starts, numbers = list(zip(b.client, b.burst)), b.us.tolist(), [], []
            begin = 0
            for at in range(1, len(keys) + 1):
                if at == len(keys) or keys[at] != keys[begin]:
                    if keys[begin] != key:
                        key, start, n = keys[begin], None, 0
                    some = _fold(us[begin:at], start, n, length)
                    starts += some[0]
                    numbers += some[1]
                    start, n, begin = starts[-1], numbers[-1], at
            yield b.drop(columns="burst").assign(start_us=starts, n=numbers)

    known = bursts(_timed(requests.filter(F.col("ts").isNotNull())), length)
    dealt = known.repartition("client", "burst").sortWithinPartitions("client", "burst", "us", "event_id")
    return _decided(dealt.select("client", "event_id", "us", "burst").mapInPandas(run, FOLDED), requests, limit)


def limited_stream(requests: DataFrame, seconds: float, limit: int, delay: str = "10 minutes") -> DataFrame:
    """The same decisions on a stream; the open window of each client is its state.

    Windows are event time, so state goes by the watermark: it is dropped once the watermark has passed the
    window's end, after which any request that still counts opens a window of its own. Requests later
    than ``delay`` get no decision. Within a micro-batch a client's requests are taken in order of time;
    one that is earlier than the open window counts in it.
    """
    length = int(seconds * 1_000_000)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(["us", "event_id"])
        starts, numbers = _fold(rows.us.tolist(), start, n, length)
        state.update((starts[-1], numbers[-1]))
        state.setTimeoutTimestamp(max((starts[-1] + length) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield rows[["client", "event_id", "us"]].assign(start_us=starts, n=numbers)

    own = requests.filter(F.col("ts").isNotNull()).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    timed = own.select(F.col("client").cast("string").alias("client"), "event_id", F.unix_micros("ts").alias("us"), "ts")
    folded = timed.groupBy("client").applyInPandasWithState(run, FOLDED, "start long, n long", "append", GroupStateTimeout.EventTimeTimeout)
    return _decided(folded, requests, limit)
