"""Message content: strings, blocks of JSON, and the bodies that carry them."""

from __future__ import annotations

import json
import math
from typing import Any

from . import kernels as K
from .classes import SPACE_CHARS


def number(value: float | int) -> str:
    """A number as JavaScript writes it."""
    x = float(value)
    if not math.isfinite(x):
        return "null"
    if x == 0:
        return "0"
    digits, _, exponent = repr(x).lower().partition("e")
    whole, _, part = digits.lstrip("-").partition(".")
    part = "" if part == "0" else part
    point = len(whole) + int(exponent or 0)
    digits = (whole + part).lstrip("0")
    point -= len(whole + part) - len((whole + part).lstrip("0"))
    digits = digits.rstrip("0")
    if 0 < point <= 21:
        text = digits.ljust(point, "0")[:point] + (f".{digits[point:]}" if len(digits) > point else "")
    elif -6 < point <= 0:
        text = "0." + "0" * -point + digits
    else:
        text = digits[0] + (f".{digits[1:]}" if len(digits) > 1 else "") + f"e{point - 1:+d}"
    return ("-" if x < 0 else "") + text


def canonical_json(value: Any) -> str:
    """Compact JSON with keys in code point order and other letters than ASCII as they are."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical_json(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical_json, value)) + "]"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return number(value)
    return json.dumps(value, ensure_ascii=False)


def serialize(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else canonical_json(value)


def block_text(block: Any) -> str:
    if not isinstance(block, dict):
        return ""
    kind = block.get("type")
    if kind == "text":
        return block["text"] if isinstance(block.get("text"), str) else ""
    if kind == "tool_use":
        body, name = serialize(block.get("input")), block.get("name")
        return f"[tool_use {name}] {body}" if body and isinstance(name, str) and name else body
    if kind == "tool_result":
        return content_text(block.get("content"))
    if kind == "document":
        source = block.get("source")
        data = source.get("data") if isinstance(source, dict) else None
        direct = block.get("text")
        return direct if isinstance(direct, str) and direct else data if isinstance(data, str) else content_text(block.get("content"))
    return ""


def content_text(content: Any) -> str:
    """The text of a message's content: a string, a list of blocks, a block, or else nothing."""
    if isinstance(content, list):
        return "\n".join(filter(None, map(block_text, content)))
    return content if isinstance(content, str) else block_text(content)


def tool_linked(content: Any) -> bool:
    return isinstance(content, list) and any(isinstance(b, dict) and b.get("type") in ("tool_use", "tool_result") for b in content)


def compress_content(content: Any, ratio_millis: int) -> tuple[Any, int, int]:
    """Content with its text compressed block by block, tokens before and after."""
    if isinstance(content, str):
        return K.compress_text(content, ratio_millis) if content.strip(SPACE_CHARS) else (content, 0, 0)
    if isinstance(content, list):
        done = [_compress_block(b, ratio_millis) for b in content]
        return [d[0] for d in done], sum(d[1] for d in done), sum(d[2] for d in done)
    return content, 0, 0


def _compress_block(block: Any, ratio_millis: int) -> tuple[Any, int, int]:
    if not isinstance(block, dict):
        return block, 0, 0
    kind, field = block.get("type"), {"text": "text", "tool_result": "content"}.get(block.get("type"))
    if field is None:
        tokens = int(K.token_counts([block_text(block)])[0])
        return block, tokens, tokens
    inner = block.get(field)
    if kind == "text" and not isinstance(inner, str):
        return block, 0, 0
    if kind == "tool_result" and isinstance(inner, str) and K.structural(inner):
        tokens = int(K.token_counts([inner])[0])
        return block, tokens, tokens
    short, before, after = compress_content(inner, ratio_millis)
    return ({**block, field: short} if isinstance(inner, (str, list)) else block), before, after


def top_level_span(body: str, key: str) -> tuple[int, int] | None:
    """Where the value of a top-level key lies in a JSON object; None if it is missing, repeated or malformed."""
    decoder, found = json.JSONDecoder(), None
    skip = lambda i: i + len(body[i:]) - len(body[i:].lstrip(" \t\r\n"))
    try:
        at = skip(0)
        if body[at] != "{":
            return None
        at = skip(at + 1)
        while body[at] != "}":
            name, at = decoder.raw_decode(body, at)
            at = skip(at)
            if not isinstance(name, str) or body[at] != ":":
                return None
            start = skip(at + 1)
            _, end = decoder.raw_decode(body, start)
            if name == key:
                if found:
                    return None
                found = start, end
            at = skip(end)
            if body[at] == ",":
                at = skip(at + 1)
                if body[at] == "}":
                    return None
            elif body[at] != "}":
                return None
        return found if skip(at + 1) == len(body) else None
    except (ValueError, IndexError):
        return None


def compact(value: Any) -> str:
    """JSON without spaces, other letters than ASCII as they are."""
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def canonical_meta(old: dict, key: str, entry: dict) -> str:
    """The JSON of metadata with an entry added, its numbers as JavaScript writes them."""
    return "{" + ",".join([*(f"{compact(k)}:{compact(v)}" for k, v in old.items() if k != key), f"{compact(key)}:" + "{" + ",".join(f"{compact(k)}:{canonical_json(v)}" for k, v in entry.items()) + "}"]) + "}"


def elements(body: str, key: str) -> list[str] | None:
    """The raw JSON of each element of a top-level array; None where there is no such array."""
    span = top_level_span(body, key)
    if span is None or body[span[0]] != "[":
        return None
    decoder, out, at = json.JSONDecoder(), [], span[0] + 1
    skip = lambda i: i + len(body[i : span[1]]) - len(body[i : span[1]].lstrip(" \t\r\n,"))
    while (at := skip(at)) < span[1] - 1:
        end = decoder.raw_decode(body, at)[1]
        out.append(body[at:end])
        at = end
    return out


def put(body: str, key: str, value: str) -> str:
    """A JSON object with one top-level value replaced or, where the key is missing, added at the end."""
    if (done := splice(body, key, value)) is not None:
        return done
    whole = json.loads(body)
    if key in whole:
        return compact({**whole, key: json.loads(value)})
    at = body.rindex("}")
    return body[:at].rstrip() + ("," if whole else "") + f"{json.dumps(key)}:{value}" + body[at:]


def splice(body: str, key: str, value: str) -> str | None:
    """The body with only the bytes of one top-level value replaced."""
    span = top_level_span(body, key)
    return None if span is None else body[: span[0]] + value + body[span[1] :]
