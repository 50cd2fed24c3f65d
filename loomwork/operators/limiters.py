"""Rate limiters replayed over event tables.

The fixed window needs only ranks. The others depend on what was admitted before, so rows stream through a task in order
of key and time and carry a small state; no key is ever held as a whole.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KINDS = ("fixed_window", "sliding_log", "sliding_counter", "token_bucket")


class FixedWindow:
    def __init__(self, limit: int, window: int):
        self.limit, self.window, self.at, self.n = limit, window, None, 0

    def allow(self, now: int) -> bool:
        if (at := now // self.window) != self.at:
            self.at, self.n = at, 0
        ok = self.n < self.limit
        self.n += ok
        return ok


class SlidingLog:
    """Exact: admitted times of the last window; one that is a whole window old has gone."""

    def __init__(self, limit: int, window: int):
        self.limit, self.window, self.times = limit, window, deque()

    def allow(self, now: int) -> bool:
        while self.times and now - self.times[0] >= self.window:
            self.times.popleft()
        if len(self.times) >= self.limit:
            return False
        self.times.append(now)
        return True


class SlidingCounter:
    """The last window's count, weighted by what of it is still in reach, and this window's."""

    def __init__(self, limit: int, window: int):
        self.limit, self.window, self.at, self.before, self.n = limit, window, 0, 0, 0

    def allow(self, now: int) -> bool:
        at = now // self.window
        if at != self.at:
            self.before, self.n, self.at = self.n if at == self.at + 1 else 0, 0, at
        reach = 1 - (now % self.window) / self.window
        ok = self.before * reach + self.n < self.limit
        self.n += ok
        return ok


class TokenBucket:
    def __init__(self, limit: int, window: int, capacity: float | None = None):
        self.rate, self.full = limit / window, float(capacity if capacity is not None else limit)
        self.held, self.last = self.full, None

    def allow(self, now: int) -> bool:
        if self.last is not None:
            self.held = min(self.full, self.held + (now - self.last) * self.rate)
        self.last = now
        if self.held < 1:
            return False
        self.held -= 1
        return True


CLASSES = dict(zip(KINDS, (FixedWindow, SlidingLog, SlidingCounter, TokenBucket), strict=True))


def fixed_window(events: DataFrame, keys: list[str], at: str, tie: str, limit: int, seconds: int) -> DataFrame:
    """events with `admitted`: the first `limit` of each key and aligned window."""
    us = F.unix_micros(F.col(at).cast("timestamp"))
    w = Window.partitionBy(*keys, F.floor(us / (seconds * 1_000_000))).orderBy(us, tie)
    return events.withColumn("admitted", F.row_number().over(w) <= limit)


def replay(events: DataFrame, keys: list[str], at: str, tie: str, limit: int, seconds: int, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """(keys, tie, at in microseconds as `us`) with one flag for each limiter: whether it admits the event. Times are whole microseconds."""
    nk, window = len(keys), seconds * 1_000_000
    rows = events.select(*keys, tie, F.unix_micros(F.col(at).cast("timestamp")).alias("us"))

    def run(batches):
        import pyarrow as pa

        now, limiters = None, []
        for batch in batches:
            cols, out = [batch.column(i).to_pylist() for i in range(nk + 2)], [[] for _ in kinds]
            for row in zip(*cols, strict=True):
                if row[:nk] != now or not limiters:
                    now, limiters = row[:nk], [CLASSES[k](limit, window) for k in kinds]
                for o, x in zip(out, limiters, strict=True):
                    o.append(x.allow(row[nk + 1]))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(o, pa.bool_()) for o in out]], names=[*batch.schema.names, *kinds])

    from pyspark.sql import types as T

    schema = T.StructType([*rows.schema.fields, *[T.StructField(k, T.BooleanType()) for k in kinds]])
    return rows.repartition(*keys).sortWithinPartitions(*keys, "us", tie).mapInArrow(run, schema)


def worst_windows(replayed: DataFrame, kinds: tuple[str, ...], seconds: int) -> DataFrame:
    """(limiter, worst): the most admitted events of one key in any half-open window."""
    key = [c for c in replayed.columns if c not in kinds and c != "us"][:-1]
    long = replayed.select(*key, "us", F.inline(F.filter(F.array(*[F.struct(F.lit(k).alias("limiter"), F.col(k).alias("ok")) for k in kinds]), lambda x: x["ok"])))
    w = Window.partitionBy("limiter", *key).orderBy("us").rangeBetween(0, seconds * 1_000_000 - 1)
    return long.withColumn("n", F.count(F.lit(1)).over(w)).groupBy("limiter").agg(F.max("n").alias("worst"))


def adversarial(spark, limit: int = 100, seconds: int = 60, offsets: int = 119) -> DataFrame:
    """(arrival pattern, id, ts): tight bursts at every offset in a window, whole or half before and half after a boundary."""
    p = spark.range(1, offsets + 1).select(F.col("id").alias("k")).withColumn("off", F.col("k") * seconds / (offsets + 1))
    n = 4 * limit
    one = p.select(F.concat(F.lit("burst-"), F.col("k").cast("string")).alias("pattern"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("id"), "off").select("pattern", "id", (600 + F.col("off") + F.col("id") * 1e-4).alias("s"))
    two = p.select(F.concat(F.lit("two-"), F.col("k").cast("string")).alias("pattern"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("id"), "off")
    two = two.select("pattern", "id", (600 + F.when(F.col("id") < n // 2, -F.col("off") + F.col("id") * 1e-4).otherwise((F.col("id") - n // 2) * 1e-4)).alias("s"))
    return one.unionByName(two).select("pattern", "id", F.timestamp_micros(F.round(F.col("s") * 1_000_000).cast("long")).alias("ts"))
