"""Compression by a language model: request builders, and operators with a transport given to them.

Nothing here opens a connection: ``transport(url, headers, body) -> (status, text)`` is the caller's.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classes import SPACE_CHARS
from ..functions.text import counted, counted_rows
from . import compressors

Transport = Callable[[str, dict, str], tuple[int, str]]

SYSTEM = "You shorten context for a language model. Keep facts, numbers, names, decisions and open questions, and nothing that isn't in the content."

# Of each provider its default model, address, and the environment variables that hold its key.
MODELS = {"anthropic": "claude-haiku-4-5", "openai": "gpt-4o-mini", "gemini": "gemini-2.5-flash"}
URLS = {"anthropic": "https://api.anthropic.com", "openai": "https://api.openai.com", "gemini": "https://generativelanguage.googleapis.com"}
KEYS = {"anthropic": ["ANTHROPIC_API_KEY"], "openai": ["OPENAI_API_KEY"], "gemini": ["GEMINI_API_KEY", "GOOGLE_API_KEY"]}
# Beginnings of the names of models that think before they answer unless told not to.
REASONING = {"openai": ("gpt-5", "o1", "o3", "o4"), "gemini": ("gemini-2.5", "gemini-3")}


@dataclass(frozen=True)
class Provider:
    """Where requests go and how long an answer may be; empty fields have the provider's defaults."""

    name: str = "anthropic"
    model: str = ""
    url: str = ""
    key: str = field(default="", repr=False)
    ratio: float = 0.3
    max_tokens: int = 500

    def __post_init__(self) -> None:
        if self.name not in MODELS:
            raise ValueError(f"unknown provider {self.name!r}: use one of {', '.join(sorted(MODELS))}")
        known = next((os.environ[k] for k in KEYS[self.name] if os.environ.get(k)), "")
        for name, value in (("model", self.model or MODELS[self.name]), ("url", (self.url or URLS[self.name]).rstrip("/")), ("key", self.key or known)):
            object.__setattr__(self, name, value)

    @property
    def thinks(self) -> bool:
        return self.model.startswith(REASONING.get(self.name, ("\0",)))

    def build(self, text: str) -> tuple[str, dict, str]:
        """URL, headers and body of a request for a shorter form of ``text``."""
        prompt = f"Shorten the content below to about {round(self.ratio * 100)}% of its length.\n\n{text}"
        headers, user = {"content-type": "application/json"}, {"role": "user", "content": prompt}
        if self.name == "anthropic":
            body = {"model": self.model, "max_tokens": self.max_tokens, "system": SYSTEM, "messages": [user]}
            return f"{self.url}/v1/messages", headers | {"x-api-key": self.key, "anthropic-version": "2023-06-01"}, json.dumps(body, ensure_ascii=False)
        if self.name == "openai":
            body = {"model": self.model, "max_completion_tokens": self.max_tokens, "messages": [{"role": "system", "content": SYSTEM}, user]}
            body |= {"reasoning_effort": "minimal"} if self.thinks else {}
            return f"{self.url}/v1/chat/completions", headers | {"authorization": f"Bearer {self.key}"}, json.dumps(body, ensure_ascii=False)
        options = {"maxOutputTokens": self.max_tokens} | ({"thinkingConfig": {"thinkingBudget": 0}} if self.thinks else {})
        body = {"system_instruction": {"parts": [{"text": SYSTEM}]}, "contents": [{"role": "user", "parts": [{"text": prompt}]}], "generationConfig": options}
        return f"{self.url}/v1beta/models/{self.model}:generateContent", headers | {"x-goog-api-key": self.key}, json.dumps(body, ensure_ascii=False)

    def parse(self, status: int, body: str) -> tuple[str, int, int]:
        """The text of a response, and the tokens that the provider counted; what a response lacks is empty or 0."""
        if not 200 <= status < 300:
            raise RuntimeError(f"{self.name} answered {status}: {body[:300]}")
        value = json.loads(body)
        first = lambda x: (x or [{}])[0]
        if self.name == "anthropic":
            text, usage, counts = first(value.get("content")).get("text"), value.get("usage"), ("input_tokens", "output_tokens")
        elif self.name == "openai":
            text, usage, counts = first(value.get("choices")).get("message", {}).get("content"), value.get("usage"), ("prompt_tokens", "completion_tokens")
        else:
            parts = first(value.get("candidates")).get("content", {}).get("parts", [])
            text, usage, counts = "".join(p.get("text", "") for p in parts), value.get("usageMetadata"), ("promptTokenCount", "candidatesTokenCount")
        return text or "", *((usage or {}).get(c, 0) for c in counts)

    def shorten(self, text: str | None, transport: Transport) -> tuple[str | None, int, int]:
        """A text shortened; blank text is left alone and counts 0."""
        if text is None or not text.strip(SPACE_CHARS):
            return text, 0, 0
        return self.parse(*transport(*self.build(text)))


def requests(texts: DataFrame, provider: Provider, text_col: str = "text") -> DataFrame:
    """``texts`` with url and body of the request that would be sent for each; keys stay out of the rows."""

    @F.pandas_udf("url string, body string")
    def built(text: pd.Series) -> pd.DataFrame:
        rows = [provider.build(t or "") for t in text]
        return pd.DataFrame({"url": pd.Series([r[0] for r in rows], dtype=object), "body": pd.Series([r[2] for r in rows], dtype=object)})

    return texts.withColumn("__r", built(text_col)).select(*texts.columns, "__r.url", "__r.body")


def compress_spans(messages: DataFrame, provider: Provider, transport: Transport) -> DataFrame:
    """Each span of messages (span_id, turn, role, text) as one message of its first role, with the provider's counts.

    Texts are joined by a blank line in the order of turn.  A span of blank texts keeps its messages and counts 0.
    """
    # One span's messages.
    rows = F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    spans = messages.groupBy("span_id").agg(rows.alias("rows"))

    def run(batches):
        for pdf in batches:
            out = []
            for span, rows in zip(pdf["span_id"], pdf["rows"]):
                whole = "\n\n".join(r["text"] for r in rows)
                short, before, after = provider.shorten(whole, transport)
                if before or after or short != whole:
                    out.append((span, rows[0]["turn"], rows[0]["role"], short, before, after))
                else:
                    out += [(span, r["turn"], r["role"], r["text"], 0, 0) for r in rows]
            yield pd.DataFrame(out, columns=["span_id", "turn", "role", "text", "input_tokens", "output_tokens"]).assign(method="selfllm")

    kind = dict(messages.dtypes)["span_id"]
    return spans.mapInPandas(run, f"span_id {kind}, turn long, role string, text string, input_tokens long, output_tokens long, method string")


def register(provider: Provider, transport: Transport, name: str = "selfllm") -> None:
    """Make the model a compressor that labels can be routed to, message by message."""

    def compressor(text: Column, config) -> Column:
        @F.pandas_udf(counted("text"))
        def run(texts: pd.Series) -> pd.DataFrame:
            return counted_rows([provider.shorten(t, transport) for t in texts], "text")

        return run(text)

    compressors.register(name, compressor)
