"""Rate limiters as stateful streams: one small state for each key, kept by the state store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.limiters import CLASSES

#: What a limiter of each kind keeps between batches.
FIELDS = {"fixed_window": ("at", "n"), "sliding_log": ("times",), "sliding_counter": ("at", "before", "n"), "token_bucket": ("held", "last")}


def limited(stream: DataFrame, key: str, event: str, at: str, kind: str, limit: int, seconds: int) -> DataFrame:
    """(key, event, us, admitted) of a stream whose batches come in order of time; inside a batch, events of a key are put in order of time and id."""
    import json

    cls, fields, window = CLASSES[kind], FIELDS[kind], seconds * 1_000_000
    rows = stream.select(F.col(key).alias("key"), F.col(event).alias("event"), F.unix_micros(at).alias("us"))
    kinds = {f.name: f.dataType for f in rows.schema.fields}

    def update(k, frames, state):
        import pandas as pd

        limiter = cls(limit, window)
        if state.exists:
            for name, value in zip(fields, json.loads(state.get[0]), strict=True):
                setattr(limiter, name, type(limiter.times)(value) if name == "times" else value)
        frame = pd.concat(list(frames)).sort_values(["us", "event"], kind="stable")
        frame["admitted"] = [limiter.allow(int(t)) for t in frame["us"]]
        state.update((json.dumps([list(getattr(limiter, n)) if n == "times" else getattr(limiter, n) for n in fields]),))
        yield frame[["key", "event", "us", "admitted"]]

    out = T.StructType([T.StructField("key", kinds["key"]), T.StructField("event", kinds["event"]), T.StructField("us", T.LongType()), T.StructField("admitted", T.BooleanType())])
    return rows.groupBy("key").applyInPandasWithState(update, out, "state string", "append", "NoTimeout").select(F.col("key").alias(key), F.col("event").alias(event), "us", "admitted")
