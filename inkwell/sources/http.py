"""A completer that asks an endpoint with the common chat API."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from urllib.parse import urlsplit


@dataclass(frozen=True)
class Endpoint:
    """Where to send prompts, and how long to insist."""

    url: str
    model: str
    key: str | None = None
    seconds: float = 120.0
    attempts: int = 3
    pause: float = 2.0
    most_tokens: int = 512


def is_local(url: str) -> bool:
    """Whether a URL names this machine, which needs no key and no proxy."""
    host = (urlsplit(url).hostname or "").lower()
    return host in ("localhost", "::1", "0.0.0.0") or host.startswith("127.")


def usage(answer: Mapping) -> tuple[int, int]:
    """Prompt and completion tokens; zeros for an answer without them."""
    found = answer.get("usage")
    found = found if isinstance(found, Mapping) else {}
    return int(found.get("prompt_tokens") or 0), int(found.get("completion_tokens") or 0)


def content(answer: Mapping) -> str | None:
    """The text of the first choice, or None."""
    try:
        found = answer["choices"][0]["message"]["content"]
    except (KeyError, IndexError, TypeError):
        return None
    return found if isinstance(found, str) and found.strip() else None


def _send(endpoint: Endpoint, prompt: str) -> Mapping:
    body = {"model": endpoint.model, "messages": [{"role": "user", "content": prompt}], "temperature": 0, "max_tokens": endpoint.most_tokens}
    heads = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {endpoint.key}"} if endpoint.key else {})
    request = urllib.request.Request(f"{endpoint.url.rstrip('/')}/chat/completions", json.dumps(body).encode(), heads)
    opener = urllib.request.build_opener(*[urllib.request.ProxyHandler({})] * is_local(endpoint.url))
    with opener.open(request, timeout=endpoint.seconds) as answer:
        return json.load(answer)


def completer(endpoint: Endpoint, send: Callable[[Endpoint, str], Mapping] = _send, sleep: Callable[[float], None] = time.sleep, metered: bool = False) -> Callable[[str], str | tuple | None]:
    """Answers a prompt, if ``metered`` with the tokens used; None once the attempts are used up, or at once for a
    request that the server rejects. Pauses grow evenly."""

    def ask(prompt: str) -> str | None:
        for n in range(1, endpoint.attempts + 1):
            try:
                answer = send(endpoint, prompt)
                return (content(answer), *usage(answer)) if metered else content(answer)
            except urllib.error.HTTPError as error:
                if error.code < 500 and error.code not in (408, 429):
                    return None
            except (OSError, ValueError):
                pass
            if n < endpoint.attempts:
                sleep(endpoint.pause * n)
        return None

    return ask
