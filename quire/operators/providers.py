"""Live model runners behind a gateway.  The transport is a parameter, so nothing here needs a network.

``send(url, headers, body) -> dict`` posts JSON and returns the parsed answer, or raises an error with ``status_code``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from ..errors import EngineError, ValidationError
from .models import PROTOCOLS

KEY, URL = "QUIRE_GATEWAY_KEY", "QUIRE_GATEWAY_URL"
Send = Callable[[str, dict, dict], dict]


@dataclass(frozen=True)
class Credentials:
    key: str
    url: str


def credentials(env: Mapping[str, str]) -> Credentials:
    """Key and base address from the environment; raises before any call when one is missing."""
    key, url = env.get(KEY, "").strip(), env.get(URL, "").strip()
    if not key or not url:
        raise EngineError("missing-api-key", f"Set {KEY} and {URL} before a run with live models.")
    return Credentials(key, url.rstrip("/"))


def request(entry: dict, own: Credentials, system: str, user: str) -> tuple[str, dict, dict]:
    """(url, headers, body) of one call, by the model's protocol."""
    extra, limit = entry.get("provider_options") or {}, entry["max_output_tokens"]
    bearer = {"Authorization": f"Bearer {own.key}"}
    if entry["protocol"] == "openai-compatible":
        chat = [{"role": "system", "content": system}, {"role": "user", "content": user}]
        return f"{own.url}/chat/completions", bearer, {"model": entry["model"], "messages": chat, "max_tokens": limit, **extra}
    if entry["protocol"] == "openai":
        return f"{own.url}/responses", bearer, {"model": entry["model"], "instructions": system, "input": user, "max_output_tokens": limit, **extra}
    if entry["protocol"] == "google":
        body = {"systemInstruction": {"parts": [{"text": system}]}, "contents": [{"role": "user", "parts": [{"text": user}]}], "generationConfig": {"maxOutputTokens": limit, **extra}}
        return f"{own.url}/models/{entry['model']}:generateContent", {"x-goog-api-key": own.key}, body
    raise ValidationError(f"Unsupported model protocol: {entry['protocol']}; known: {', '.join(PROTOCOLS)}")


def answer(entry: dict, got: dict) -> dict:
    """Text, token counts and finish reason of an answer, whatever the protocol."""
    if entry["protocol"] == "google":
        first, use = (got.get("candidates") or [{}])[0], got.get("usageMetadata") or {}
        text = "".join(p.get("text", "") for p in first.get("content", {}).get("parts", []))
        total, cached, out, stop = use.get("promptTokenCount", 0), use.get("cachedContentTokenCount", 0), use.get("candidatesTokenCount", 0), first.get("finishReason") == "MAX_TOKENS"
    elif entry["protocol"] == "openai":
        use = got.get("usage") or {}
        text = "".join(c.get("text", "") for o in got.get("output", []) for c in o.get("content", []) or [])
        total, cached, out = use.get("input_tokens", 0), (use.get("input_tokens_details") or {}).get("cached_tokens", 0), use.get("output_tokens", 0)
        stop = (got.get("incomplete_details") or {}).get("reason") == "max_output_tokens"
    else:
        first, use = (got.get("choices") or [{}])[0], got.get("usage") or {}
        text = (first.get("message") or {}).get("content") or ""
        total, cached, out = use.get("prompt_tokens", 0), (use.get("prompt_tokens_details") or {}).get("cached_tokens", 0), use.get("completion_tokens", 0)
        stop = first.get("finish_reason") == "length"
    return {"text": text, "no_cache": max(0, total - cached), "cache_read": cached, "output": out, "finish_reason": "length" if stop else "stop"}


def runner(env: Mapping[str, str], send: Send):
    """A runner for ``translate``; credentials are checked at once."""
    own = credentials(env)
    return lambda entry, system, user, markdown: answer(entry, send(*request(entry, own, system, user)))
