"""Tool-protocol traffic as rows (request_id, kind, payload): results and sampling requests compressed, the rest passed on.

Kinds: ``tools/call`` and ``tasks/result`` carry results, the second one those whose call only answered with a task
handle; ``sampling/createMessage`` carries a message list; ``tools/list``, ``tasks/get`` and any other kind carry
nothing to compress.  Each row is compressed on its own, so there is no shuffle.
"""

from __future__ import annotations

import json
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import content as N
from ..functions import lists as L
from .config import Config

RESULTS, SAMPLING = ("tools/call", "tasks/result"), "sampling/createMessage"


def compress_result(payload: str, config: Config, meta_key: str) -> tuple[str, dict | None]:
    """A result with its content compressed, and what was saved.

    ``structuredContent`` and all other bytes stay; ``_meta`` gets an entry only if tokens were saved.  Task handles and
    results whose content isn't a list pass as they are.  No turn of the list of one is protected.
    """
    result = json.loads(payload)
    if not isinstance(result, dict) or result.get("task") or not isinstance(result.get("content"), list):
        return payload, None
    kept, before, after, method = L.compress_list([{"role": "user", "content": result["content"]}], replace(config, last_turns=0))
    meta = L.telemetry(before, after, method)
    if meta is None:
        return payload, None
    content = kept[0][1]["content"]
    if isinstance(content, list):
        payload = N.put(payload, "content", N.compact(content))
    old = result.get("_meta") if isinstance(result.get("_meta"), dict) else {}
    return N.put(payload, "_meta", N.canonical_meta(old, meta_key, meta)), meta


def compress_sampling(payload: str, config: Config) -> tuple[str, dict | None]:
    """A sampling request with its messages compressed; each message keeps its own block, by its place in the list.

    A message's content is one block; a purged one becomes a text block.
    """
    raw = N.elements(payload, "messages")
    messages = [json.loads(m) for m in raw or []]
    if not messages or not all(isinstance(m, dict) for m in messages):
        return payload, None
    kept, before, after, method = L.compress_list([{"role": m.get("role"), "content": [m.get("content")]} for m in messages], config)
    new = []
    for i, m in kept:
        block = m["content"][0] if isinstance(m["content"], list) else {"type": "text", "text": m["content"]}
        new.append(raw[i] if block == messages[i].get("content") else N.put(raw[i], "content", N.compact(block)))
    return payload if new == raw else N.splice(payload, "messages", "[" + ",".join(new) + "]"), L.telemetry(before, after, method)


def compress_traffic(rows: DataFrame, config: Config, meta_key: str = "thresher") -> DataFrame:
    """``rows`` (kind, payload) with compressed payloads and tokens_saved, null where nothing was saved; malformed ones stay."""
    schema = T.StructType([T.StructField("payload", T.StringType()), T.StructField("tokens_saved", T.LongType())])

    def one(kind: str | None, payload: str | None) -> tuple[str | None, int | None]:
        try:
            if payload is not None and kind in RESULTS:
                payload, meta = compress_result(payload, config, meta_key)
            elif payload is not None and kind == SAMPLING:
                payload, meta = compress_sampling(payload, config)
            else:
                meta = None
        except ValueError:
            meta = None
        return payload, meta and meta["tokensSaved"]

    @F.pandas_udf(schema)
    def run(kind: pd.Series, payload: pd.Series) -> pd.DataFrame:
        done = [one(k, p) for k, p in zip(kind, payload)]
        return pd.DataFrame({"payload": pd.Series([d[0] for d in done], dtype=object), "tokens_saved": pd.Series([d[1] for d in done], dtype="Int64")})

    done = rows.withColumn("__c", run("kind", "payload"))
    return done.withColumns({"payload": F.col("__c.payload"), "tokens_saved": F.col("__c.tokens_saved")}).drop("__c")
