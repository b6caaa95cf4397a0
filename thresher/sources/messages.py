"""Readers of message lists and request logs, and writers back to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import messages as M

#: Fixed value: request paths that carry message lists.
PATHS = "(?:/chat/completions|/messages)$"


def read_lists(spark: SparkSession, path: str) -> DataFrame:
    """JSON files, each an array of messages -> (file, turn, role, content as JSON, text, tool_linked)."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value"))
    rows = raw.select("file", F.posexplode(M.message_list(F.concat(F.lit('{"messages":'), "value", F.lit("}")))).alias("turn", "message"))
    return with_text(rows.select("file", "turn", *_parts()))


def _parts() -> list:
    """A message as it is, its role, and its content as JSON (a string in its quotes)."""
    return ["message", F.get_json_object("message", "$.role").alias("role"), M.content_json("message").alias("content")]


def with_text(messages: DataFrame) -> DataFrame:
    return messages.withColumns({"text": M.message_text("content"), "tool_linked": M.tool_linked("content")})


def requests(log: DataFrame) -> DataFrame:
    """Of a request log (request_id, method, path, body): the messages of those that carry a list, raw and in parts."""
    hits = log.where((F.col("method") == "POST") & F.regexp_like("path", F.lit(PATHS)))
    lists = hits.select("request_id", F.posexplode(M.message_list("body")).alias("turn", "message"))
    return with_text(lists.select(F.col("request_id").alias("conv_id"), "turn", *_parts()))


def write_back(log: DataFrame, messages: DataFrame) -> DataFrame:
    """Request bodies with the content of their messages replaced by that of ``messages``, by turn.

    ``messages`` has conv_id, turn, message (raw JSON) and content.  All other bytes of a body and of a message stay
    as they are; messages that aren't among ``messages`` leave the list.
    """
    lists = messages.select(F.col("conv_id").alias("request_id"), "turn", M.with_content("message", "content").alias("m"))
    # One request's messages.
    lists = lists.groupBy("request_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "m"))), lambda s: s["m"]).alias("list"))
    joined = log.join(lists, "request_id", "left")
    spliced = M.splice_messages("body", F.concat(F.lit("["), F.array_join("list", ","), F.lit("]")))
    return joined.withColumn("body", F.when(F.col("list").isNotNull(), spliced).otherwise(F.col("body"))).select(log.columns)


def annotate(responses: DataFrame, stats: DataFrame) -> DataFrame:
    """Responses (request_id, stream, usage) with a telemetry struct, null for streams and where usage is null."""
    joined = responses.join(stats, "request_id", "left")
    telemetry = F.struct((F.col("input_tokens") - F.col("output_tokens")).alias("tokens_saved"), "ratio", "method")
    told = ~F.coalesce(F.col("stream"), F.lit(False)) & F.col("usage").isNotNull() & F.col("input_tokens").isNotNull()
    return joined.withColumn("telemetry", F.when(told, telemetry)).select(*responses.columns, "telemetry")
