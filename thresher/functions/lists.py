"""The whole compression of one message list in memory, for rows that hold a list (requests, tool results).

It gives what :func:`thresher.plans.pipeline.compress_messages` gives for the same list as rows of content.
"""

from __future__ import annotations

import hashlib
import re
from typing import Any

from ..operators.config import Config
from . import classes as C
from . import content as N
from . import kernels as K

#: Compressors of content: (content, ratio in thousandths) -> (content, tokens before, tokens after).
KERNELS = {
    "verbatim": lambda content, ratio_millis: (content, *(2 * [int(K.token_counts([N.content_text(content)])[0])])),
    "extract": N.compress_content,
}


def label(text: str) -> str:
    """The label of one message, as :func:`thresher.functions.text.classify` gives it to a column."""
    if not text.strip(C.SPACE_CHARS):
        return "unknown"
    if any(m in text for m in C.ERROR_MARKERS):
        return "error"
    lines = sum(x.lstrip(C.SPACE_CHARS).startswith(tuple(C.CODE_PREFIXES)) for x in text.split("\n"))
    if "```" in text or lines >= C.CODE_LINES:
        return "code"
    return "structured" if len(text) >= C.STRUCTURED_LENGTH and len(re.findall(C.JSON_KEY, text)) * 1000 >= len(text) else "prose"


def repeat_hash(message: dict) -> str | None:
    """SHA-256 of role and text; None for empty texts and tool calls, which never repeat."""
    text = N.content_text(message.get("content"))
    if not text or N.tool_linked(message.get("content")):
        return None
    return hashlib.sha256(f"{message.get('role') or ''}|{text}".encode("utf-8", "surrogatepass")).hexdigest()


def dedup(messages: list[tuple[int, dict]]) -> list[tuple[int, dict]]:
    seen: set[str] = set()
    return [(i, m) for i, m in messages if (h := repeat_hash(m)) is None or not (h in seen or seen.add(h))]


def purge_errors(messages: list[tuple[int, dict]], after: int, placeholder: str) -> list[tuple[int, dict]]:
    old = len(messages) - after
    return [(i, {**m, "content": placeholder} if at < old and label(N.content_text(m.get("content"))) == "error" else m) for at, (i, m) in enumerate(messages)]


def compress_list(messages: list[dict], config: Config) -> tuple[list[tuple[int, dict]], int, int, str]:
    """(place in the list, message) of those that stay, tokens before and after, and the method."""
    rows = list(enumerate(messages))
    if not config.active:
        return rows, 0, 0, "passthrough"
    routes = config.routes(set(KERNELS))
    rows = dedup(rows) if config.dedup else rows
    rows = rows if config.purge_after is None else purge_errors(rows, config.purge_after, config.placeholder)
    if not rows:
        return rows, 0, 0, "empty"
    texts = [N.content_text(m.get("content")) for _, m in rows]
    total = int(K.token_counts(texts).sum())
    if total < config.threshold_tokens:
        return rows, total, total, "below-threshold"
    out, sums, methods = [], [0, 0], set()
    for at, ((i, m), text) in enumerate(zip(rows, texts)):
        held = m.get("role") == "system" or at >= len(rows) - config.last_turns
        method = "verbatim" if held else routes.get(label(text), config.default_compressor)
        content, before, after = KERNELS[method](m.get("content"), config.ratio_millis)
        out.append((i, {**m, "content": content} if content != m.get("content") else m))
        sums = [sums[0] + before, sums[1] + after]
        methods.add(method)
    return out, *sums, methods.pop() if len(methods) == 1 else "hybrid"


def rewrite(raw: list[str], messages: list[dict], kept: list[tuple[int, dict]]) -> list[str]:
    """The raw JSON of the messages that stay, with only changed content replaced."""

    def one(i: int, m: dict) -> str:
        if m is messages[i]:
            return raw[i]
        return N.put(raw[i], "content", N.compact(m["content"]))

    return [one(i, m) for i, m in kept]


def telemetry(before: int, after: int, method: str) -> dict[str, Any] | None:
    """What was saved; None unless something was."""
    return {"tokensSaved": before - after, "ratio": after / before, "method": method} if after < before else None
