"""The whole compression of message lists: strategies, threshold, routing, compression, statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import messages as M
from ..functions import text as X
from ..operators import compressors, strategies
from ..operators.config import Config

STATS = ["conv_id", "input_tokens", "output_tokens", "ratio", "method", "cost_usd"]


def compress_messages(messages: DataFrame, config: Config, extra_strategies: tuple = ()) -> DataFrame:
    """``messages`` (conv_id, turn, role, text) compressed, with input_tokens, output_tokens and method of each.

    With a column ``content`` (JSON: a string or blocks), text is taken from that and compression goes on within
    its blocks; other columns, such as the raw ``message``, pass through.  Lists below the threshold keep their text
    after the strategies.  An inactive mode returns the messages as they are.
    """
    blocks = "content" in messages.columns
    if blocks:
        messages = messages.withColumns({"text": M.message_text("content"), "tool_linked": M.tool_linked("content")})
    if not config.active:
        return messages.withColumns({"input_tokens": F.lit(0).cast("long"), "output_tokens": F.lit(0).cast("long"), "method": F.lit("passthrough")})
    # Tokens are counted before the shuffle: Spark forgets the partitioning behind a UDF, and would shuffle again.
    df = messages.withColumn("__tokens", X.token_count("text"))
    if blocks:
        df = df.withColumn("__text", F.col("text"))
    df = strategies.dedup(df) if config.dedup else df
    df = df if config.purge_after is None else strategies.purge_errors(df, config.purge_after, config.placeholder, "__tokens")
    if extra_strategies:
        df = reduce(lambda d, f: f(d), extra_strategies, df).withColumn("__tokens", X.token_count("text"))
    df = strategies.protect(df, config.last_turns).withColumn("__total", F.sum("__tokens").over(Window.partitionBy("conv_id")))
    label = F.when(F.col("protected") | (F.col("__total") < config.threshold_tokens), F.lit(None)).otherwise(X.classify(F.col("text")))
    name = F.when(F.col("__total") < config.threshold_tokens, "below-threshold").when(F.col("protected"), "verbatim").otherwise(compressors.route(label, config))
    df = df.withColumn("method", name)
    if blocks:  # what a strategy gave another text has that text as its content
        df = df.withColumn("content", F.when(F.col("text").eqNullSafe(F.col("__text")), F.col("content")).otherwise(M.text_content("text")))
        return _blocks(df, config).select(*messages.columns, "input_tokens", "output_tokens", "method")
    used = sorted({config.default_compressor, *config.routes(compressors.known()).values()} - {"verbatim"})
    # A compressor sees null for the rows of others, which costs it nothing.
    for i, c in enumerate(used):
        df = df.withColumn(f"__c{i}", compressors.get(c)(F.when(F.col("method") == c, F.col("text")), config))
    out = {"text": F.col("text"), "input_tokens": F.col("__tokens"), "output_tokens": F.col("__tokens")}
    for i, c in enumerate(used):
        out = {k: F.when(F.col("method") == c, F.col(f"__c{i}")[k]).otherwise(v) for k, v in out.items()}
    return df.withColumns(out).select(*messages.columns, "input_tokens", "output_tokens", "method")


def _blocks(df: DataFrame, config: Config) -> DataFrame:
    used = sorted({config.default_compressor, *config.routes(compressors.known()).values()} - {"verbatim"})
    for i, c in enumerate(used):
        mine = lambda col, c=c: F.when(F.col("method") == c, F.col(col))
        df = df.withColumn(f"__c{i}", compressors.of_content(c, mine("content"), mine("text"), config))
    out = {"content": F.col("content"), "input_tokens": F.col("__tokens"), "output_tokens": F.col("__tokens")}
    for i, c in enumerate(used):
        out = {k: F.when(F.col("method") == c, F.col(f"__c{i}")[k]).otherwise(v) for k, v in out.items()}
    return df.withColumns(out).withColumn("text", M.message_text("content"))


def conversation_stats(compressed: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """Statistics of each list; lists of ``conversations`` (conv_id) without messages are ``empty``."""
    out = compressed.groupBy("conv_id").agg(
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.when(F.min("method") == F.max("method"), F.min("method")).otherwise("hybrid").alias("method"),
    )
    if conversations is not None:
        out = conversations.select("conv_id").join(out, "conv_id", "left").fillna({"input_tokens": 0, "output_tokens": 0, "method": "empty"})
    ratio = F.when(F.col("input_tokens") > 0, F.col("output_tokens") / F.col("input_tokens")).otherwise(F.lit(1.0))
    return out.withColumns({"ratio": ratio, "cost_usd": F.lit(0.0)}).select(STATS)
