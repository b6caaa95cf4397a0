"""Compressors: functions from a text column to a struct of text and token counts, by name.

``register`` adds one.  A compressor gets the text column and the Config and returns a column of
``struct<text, input_tokens, output_tokens>``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import messages as M
from ..functions import text as X
from .config import Config

Compressor = Callable[[Column, Config], Column]


def of_content(name: str, content: Column, text: Column, config: Config) -> Column:
    """The compressor ``name`` over content as JSON: struct<content, input_tokens, output_tokens>.

    Text and the tool results in blocks are compressed in place; a compressor that was registered for texts
    replaces the content by its text.
    """
    if name == "extract":
        return M.compress_content(content, F.lit(config.ratio_millis))
    done = get(name)(text, config)
    return F.struct(M.text_content(done["text"]).alias("content"), done["input_tokens"].alias("input_tokens"), done["output_tokens"].alias("output_tokens"))


def verbatim(text: Column, config: Config) -> Column:
    n = X.token_count(text)
    return F.struct(text.alias("text"), n.alias("input_tokens"), n.alias("output_tokens"))


def extract(text: Column, config: Config) -> Column:
    return X.compress(text, F.lit(config.ratio_millis))


_REGISTRY: dict[str, Compressor] = {"verbatim": verbatim, "extract": extract}


def register(name: str, compressor: Compressor) -> None:
    _REGISTRY[name] = compressor


def get(name: str) -> Compressor:
    return _REGISTRY[name]


def known() -> set[str]:
    return set(_REGISTRY)


def route(label: Column, config: Config) -> Column:
    """The compressor's name for a label."""
    out = F.lit(config.default_compressor)
    for name, compressor in config.routes(known()).items():
        out = F.when(label == name, F.lit(compressor)).otherwise(out)
    return out
