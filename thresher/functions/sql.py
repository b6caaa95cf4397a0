"""The functions under names that SQL can call."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from . import lists as L
from . import messages as M
from . import text as X


@F.pandas_udf(T.StringType())
def _label(text: pd.Series) -> pd.Series:
    return text.map(lambda t: L.label(t or ""))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _words(text: pd.Series) -> pd.Series:
    return text.map(lambda t: K.words(t or ""))


FUNCTIONS = {
    "token_count": X.token_count,
    "message_label": _label,
    "word_list": _words,
    "sentence_list": X.sentences,
    "compress_text": X.compress,
    "compress_content": M.compress_content,
    "first_last_text": X.first_last,
    "message_text": M.message_text,
    "message_list": M.message_list,
    "tool_linked": M.tool_linked,
    "canonical_json": M.canonical_json,
}


def register(spark: SparkSession) -> None:
    """Register all functions with a session."""
    for name, function in FUNCTIONS.items():
        spark.udf.register(name, function)
