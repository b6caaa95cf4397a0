"""Operators on message lists: rows of (conv_id, turn, role, text), the order being turn.

All of them partition by conv_id, so Spark shuffles once for a chain of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classes as C
from ..functions import kernels as K
from ..functions import text as X


def dedup(messages: DataFrame) -> DataFrame:
    """The first of equal messages (role and text) of each list; messages without a hash all stay."""
    linked = F.col("tool_linked") if "tool_linked" in messages.columns else None
    hashed = messages.withColumn("__hash", X.repeat_hash(F.col("role"), F.col("text"), linked))
    # Messages without a hash get a window each, so they don't meet in one.
    w = Window.partitionBy("conv_id", F.coalesce("__hash", F.col("turn").cast("string"))).orderBy("turn")
    return hashed.withColumn("__n", F.row_number().over(w)).where("__n = 1 OR __hash IS NULL").drop("__hash", "__n")


def repeats(messages: DataFrame) -> DataFrame:
    """``messages`` with is_repeat: an equal message came earlier in the list."""
    linked = F.col("tool_linked") if "tool_linked" in messages.columns else None
    hashed = messages.withColumn("__hash", X.repeat_hash(F.col("role"), F.col("text"), linked))
    w = Window.partitionBy("conv_id", F.coalesce("__hash", F.col("turn").cast("string"))).orderBy("turn")
    return hashed.withColumn("is_repeat", F.col("__hash").isNotNull() & (F.row_number().over(w) > 1)).drop("__hash")


def positions(messages: DataFrame) -> DataFrame:
    """``messages`` with pos (from 0) and n, the length of the list."""
    w = Window.partitionBy("conv_id")
    return messages.withColumns({"pos": (F.row_number().over(w.orderBy("turn")) - 1).cast("int"), "n": F.count("*").over(w)})


def purge_errors(messages: DataFrame, after: int = 4, placeholder: str = C.PURGED, tokens: str | None = None) -> DataFrame:
    """Error messages before the last ``after`` have their text replaced, and their count in column ``tokens``, if given."""
    old = (F.col("pos") < F.col("n") - after) & (X.classify(F.col("text")) == "error")
    out = positions(messages).withColumn("__old", old)
    new = {"text": placeholder} | ({tokens: int(K.token_counts([placeholder])[0])} if tokens else {})
    return out.withColumns({c: F.when(F.col("__old"), F.lit(v)).otherwise(F.col(c)) for c, v in new.items()}).drop("pos", "n", "__old")


def protect(messages: DataFrame, last_turns: int = 2) -> DataFrame:
    """``messages`` with protected: a system message or one of the last turns."""
    held = (F.col("role") == "system") | (F.col("pos") >= F.col("n") - last_turns)
    return positions(messages).withColumn("protected", F.coalesce(held, F.col("pos") >= F.col("n") - last_turns)).drop("pos", "n")
