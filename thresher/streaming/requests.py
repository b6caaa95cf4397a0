"""Message streams: compression of requests, and repeats within a session.

A request row holds its whole message list, so compressing it is a projection without state.
Repeats are told apart by session with a state of the hashes seen, which ends after ``ttl``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import content as N
from ..functions import lists as L
from ..functions import text as X
from ..operators.config import Config
from ..sources.messages import PATHS


def compress_requests(requests: DataFrame, config: Config) -> DataFrame:
    """Request rows (method, path, body) with compressed bodies, tokens before and after; streaming or batch."""
    schema = T.StructType([T.StructField("body", T.StringType()), T.StructField("input_tokens", T.LongType()), T.StructField("output_tokens", T.LongType())])

    @F.pandas_udf(schema)
    def one(body: pd.Series) -> pd.DataFrame:
        return X.counted_rows([compress_body(b, config) for b in body], "body")

    carries = (F.col("method") == "POST") & F.regexp_like("path", F.lit(PATHS))
    if not config.active:
        carries = F.lit(False)
    done = requests.withColumn("__c", one(F.when(carries, F.col("body"))))
    kept = F.when(carries & F.col("__c.body").isNotNull(), F.col("__c.body")).otherwise(F.col("body"))
    return done.withColumns({"body": kept, "input_tokens": F.col("__c.input_tokens"), "output_tokens": F.col("__c.output_tokens")}).drop("__c")


def compress_body(body: str | None, config: Config) -> tuple[str | None, int, int]:
    """A body with its message list compressed as the pipeline does; itself where it has no message list."""
    raw = None if body is None else N.elements(body, "messages")
    messages = None if raw is None else [json.loads(m) for m in raw]
    if not messages or not all(isinstance(m, dict) for m in messages):
        return body, 0, 0
    kept, before, after, _ = L.compress_list(messages, config)
    new = L.rewrite(raw, messages, kept)
    return body if new == raw else N.splice(body, "messages", "[" + ",".join(new) + "]"), before, after


class Seen(StatefulProcessor):
    """Flags messages whose hash the session has had; each hash is an entry of its own in the state."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "hash string", "n int", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # One session's rows of one micro-batch, in their order.
        batch = pd.concat(list(rows)).sort_values("turn", kind="stable")
        flags = []
        for h in batch["hash"]:
            flags.append(h is not None and self.seen.containsKey((h,)))
            if h is not None:
                self.seen.updateValue((h,), (1,))
        yield pd.DataFrame({"session": key[0], "turn": batch["turn"].to_numpy(), "is_repeat": flags})

    def close(self) -> None:
        pass


def flag_repeats(messages: DataFrame, ttl: str = "1 hour") -> DataFrame:
    """A stream of (session, turn, role, text) with is_repeat; a hash is forgotten ``ttl`` after it was last seen.

    The state of a session is a map of its different messages, of which a batch reads and writes only its own.
    Empty texts never repeat, nor do messages of tool calls (column ``tool_linked``, if there).  The session needs the
    RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    linked = F.col("tool_linked") if "tool_linked" in messages.columns else None
    hashed = messages.select("session", "turn", X.repeat_hash(F.col("role"), F.col("text"), linked).alias("hash"))
    seen = Seen(int(pd.Timedelta(ttl).total_seconds() * 1000))
    return hashed.groupBy("session").transformWithStateInPandas(seen, "session string, turn long, is_repeat boolean", "append", "ProcessingTime")


def drop_repeats(messages: DataFrame) -> DataFrame:
    """A stream of (session, role, text, ts) without later repeats inside the watermark set on ts."""
    return messages.withColumn("__hash", X.repeat_hash(F.col("role"), F.col("text"))).dropDuplicatesWithinWatermark(["session", "__hash"]).drop("__hash")
