"""Column functions over message content held as JSON strings (a bare string is a JSON string)."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import content as N
from .text import counted, counted_rows


def _load(raw: str | None):
    try:
        return None if raw is None else json.loads(raw)
    except ValueError:
        return None  # malformed content is no text, and never an error


@F.pandas_udf(T.StringType())
def message_text(content: pd.Series) -> pd.Series:
    return content.map(lambda c: N.content_text(_load(c)))


@F.pandas_udf(T.BooleanType())
def tool_linked(content: pd.Series) -> pd.Series:
    return content.map(lambda c: N.tool_linked(_load(c)))


@F.pandas_udf(T.StringType())
def canonical_json(value: pd.Series) -> pd.Series:
    return value.map(lambda v: None if v is None else N.canonical_json(_load(v)))


@F.pandas_udf(counted("content"))
def compress_content(content: pd.Series, ratio_millis: pd.Series) -> pd.DataFrame:
    rows = []
    for raw, ratio in zip(content, ratio_millis):
        value = _load(raw)
        short, before, after = N.compress_content(value, ratio)
        rows.append((raw if short == value else N.compact(short), before, after))
    return counted_rows(rows, "content")


@F.pandas_udf(T.ArrayType(T.StringType()))
def message_list(body: pd.Series) -> pd.Series:
    """The raw JSON of each message of a request body; null where it has no message list."""

    def one(b: str | None) -> list[str] | None:
        found = None if b is None else N.elements(b, "messages")
        return found if found is None or all(m.startswith("{") for m in found) else None

    return body.map(one)


@F.pandas_udf(T.StringType())
def content_json(message: pd.Series) -> pd.Series:
    """The raw JSON of a message's content; null where it has none."""

    def one(m: str | None) -> str | None:
        span = None if m is None else N.top_level_span(m, "content")
        return None if span is None else m[slice(*span)]

    return message.map(one)


@F.pandas_udf(T.StringType())
def with_content(message: pd.Series, content: pd.Series) -> pd.Series:
    """A message with only its content replaced; as it is where it has no content, or there is none to put in."""

    def one(m: str | None, c: str | None) -> str | None:
        return m if m is None or c is None else N.splice(m, "content", c) or m

    return pd.Series([one(m, c) for m, c in zip(message, content)], dtype=object)


@F.pandas_udf(T.StringType())
def text_content(text: pd.Series) -> pd.Series:
    """A text as the JSON of a content."""
    return text.map(lambda t: None if t is None else json.dumps(t, ensure_ascii=False))


@F.pandas_udf(T.StringType())
def splice_messages(body: pd.Series, messages: pd.Series) -> pd.Series:
    """A request body with only its messages replaced; written anew where that isn't possible."""

    def one(b: str | None, m: str | None) -> str | None:
        if b is None or m is None:  # a body without a list to put in stays as it is
            return b
        if (done := N.splice(b, "messages", m)) is not None:
            return done
        value = _load(b)
        return json.dumps({**value, "messages": json.loads(m)}, ensure_ascii=False) if isinstance(value, dict) else b

    return pd.Series([one(b, m) for b, m in zip(body, messages)])
