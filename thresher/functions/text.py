"""Scalar functions ``Column -> Column``.

Most are built-in expressions.  Token counts, sentences and compression are Arrow UDFs over whole
batches: token counting by a table of code points takes about a tenth of the time of the same count by
regular expressions in the JVM (:func:`token_count_expr`, kept as the plan-only form).
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import classes as C
from . import kernels as K

# Types as objects: a DDL string would need a session when the module is imported.
SENTENCE = T.StructType([T.StructField("idx", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("list_item", T.BooleanType()), T.StructField("tokens", T.LongType()), T.StructField("score", T.LongType())])


def counted_rows(rows: list[tuple], name: str) -> pd.DataFrame:
    """Rows of a text and two counts; texts as objects, since Arrow-backed strings may come in chunks that a struct can't hold."""
    columns = list(zip(*rows)) or [(), (), ()]
    return pd.DataFrame({name: pd.Series(columns[0], dtype=object), "input_tokens": pd.Series(columns[1], dtype="int64"), "output_tokens": pd.Series(columns[2], dtype="int64")})


def counted(name: str) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()), T.StructField("input_tokens", T.LongType()), T.StructField("output_tokens", T.LongType())])


@F.pandas_udf(T.LongType())
def token_count(text: pd.Series) -> pd.Series:
    """Estimated tokens of a text; null counts 0."""
    return pd.Series(K.token_counts(text.tolist()))


def token_count_expr(text: Column) -> Column:
    """:func:`token_count` as an expression: chunks of four, and of dense runs of n less n // 3."""
    t = F.coalesce(text, F.lit(""))
    n = F.regexp_count(t, F.lit(C.CHUNK)) - F.regexp_count(t, F.lit(C.DENSE_CHUNK))
    return F.when(F.length(t) == 0, F.lit(0)).otherwise(F.greatest(n, F.lit(1))).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(C.WORD), F.lit(0))


def bit_length(n: Column) -> Column:
    return F.when(n > 0, F.length(F.bin(n))).otherwise(F.lit(0))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, C.TRIM, "")


def mostly_ascii(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^\\x{0}-\\x{7f}]", "")) * 100 >= F.length(text) * C.ASCII_PERCENT


def _any_of(text: Column, markers: list[str]) -> Column:
    return reduce(Column.__or__, [F.contains(text, F.lit(m)) for m in markers])


def looks_structural(text: Column) -> Column:
    return _any_of(text, C.STRUCTURAL_MARKERS)


def looks_like_error(text: Column) -> Column:
    return _any_of(text, C.ERROR_MARKERS)


def looks_like_code(text: Column) -> Column:
    # Lines are split at \n first: a multiline ^ would also match after other line ends.
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.regexp_like(line, F.lit(C.CODE_LINE)))
    return F.contains(text, F.lit("```")) | (F.size(lines) >= C.CODE_LINES)


def looks_like_structured(text: Column) -> Column:
    return (F.length(text) >= C.STRUCTURED_LENGTH) & (F.regexp_count(text, F.lit(C.JSON_KEY)) * 1000 >= F.length(text))


def classify(text: Column) -> Column:
    """The label of a message's text; the first test that holds decides."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(~F.regexp_like(t, F.lit(f"[^{C.SPACE_CLASS}]")), "unknown")
        .when(looks_like_error(t), "error")
        .when(looks_like_code(t), "code")
        .when(looks_like_structured(t), "structured")
        .otherwise("prose")
    )


def repeat_hash(role: Column, text: Column, tool_linked: Column | None = None) -> Column:
    """SHA-256 of role and text; null where the text is empty or the message belongs to a tool call."""
    free = F.lit(True) if tool_linked is None else ~F.coalesce(tool_linked, F.lit(False))
    return F.when(free & (F.length(text) > 0), F.sha2(F.concat(F.coalesce(role, F.lit("")), F.lit("|"), text), 256))


def is_list_line(line: Column) -> Column:
    return F.regexp_like(line, F.lit("(?s)" + C.LIST_LINE))


def shingles(words: Column) -> Column:
    """Distinct runs of three words; all words as one where there are fewer."""

    def of(w: Column) -> Column:
        n = F.size(w)
        windows = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.concat_ws(" ", F.slice(w, i, 3)))
        return F.when(n >= 3, F.array_distinct(windows)).when(n > 0, F.array(F.concat_ws(" ", w))).otherwise(F.array().cast("array<string>"))

    # Bound as a variable: an expression within the windows' lambda would be worked out for each window.
    return F.transform(F.array(words), of)[0]


def has_digit(text: Column) -> Column:
    return F.regexp_like(text, F.lit("[0-9]"))


def has_entity(text: Column) -> Column:
    return F.regexp_like(text, F.lit(C.ENTITY_SIGNAL))


def has_quoted(text: Column) -> Column:
    return reduce(Column.__or__, [F.regexp_like(text, F.lit(p)) for p in C.QUOTED_SIGNALS])


def has_identifier(text: Column) -> Column:
    return F.regexp_like(text, F.lit(C.IDENTIFIER_SIGNAL))


def coverage(original: Column, short: Column) -> Column:
    """The share of the original's distinct terms that the short form has; 1 if there are none."""
    of = F.array_distinct(original)
    return F.when(F.size(of) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(of, short)) / F.size(of))


@F.pandas_udf(T.ArrayType(SENTENCE))
def sentences(text: pd.Series) -> pd.Series:
    """A text's sentences with their tokens and scores within that text."""

    def of(t: str | None) -> list[dict]:
        rows = K.scored(K.segment(t or ""))
        return [{"idx": i, "text": r["text"], "list_item": r["list_item"], "tokens": r["tokens"], "score": r["score"]} for i, r in enumerate(rows)]

    return text.map(of)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def selected(text: pd.Series, ratio_millis: pd.Series) -> pd.Series:
    """Indices of the sentences that compression keeps."""
    return pd.Series([K.select(rows, r) if (rows := K.segment(t or "")) else [] for t, r in zip(text, ratio_millis)])


@F.pandas_udf(counted("text"))
def compress(text: pd.Series, ratio_millis: pd.Series) -> pd.DataFrame:
    """The compressed text; blank text is left alone and counts 0."""
    rows = [K.compress_text(t, r) if t and t.strip(C.SPACE_CHARS) else (t, 0, 0) for t, r in zip(text, ratio_millis)]
    return counted_rows(rows, "text")


@F.pandas_udf(T.StringType())
def first_last(text: pd.Series, ratio_millis: pd.Series) -> pd.Series:
    return pd.Series([K.first_last(t or "", r) for t, r in zip(text, ratio_millis)])


def stats(input_tokens: Column, output_tokens: Column, method: Column, cost: Column | None = None) -> Column:
    ratio = F.when(input_tokens > 0, output_tokens / input_tokens).otherwise(F.lit(1.0))
    return F.struct(input_tokens.alias("input_tokens"), output_tokens.alias("output_tokens"), ratio.alias("ratio"), method.alias("method"), (F.lit(0.0) if cost is None else cost).alias("cost_usd"))


def stats_meta(input_tokens: Column, output_tokens: Column, method: Column) -> Column:
    """Null unless tokens were saved."""
    saved = input_tokens - output_tokens
    return F.when(saved > 0, F.struct(saved.alias("tokens_saved"), (output_tokens / input_tokens).alias("ratio"), method.alias("method")))
