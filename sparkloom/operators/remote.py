"""Clients of remote models for the operators that take one: made once a partition, never needed for the local rules.

Only https endpoints (http on request) without credentials in the address pass. ``chat`` asks a chat endpoint of the usual JSON form and gives back the text;
``json_object`` takes the first JSON object out of an answer.
"""

from __future__ import annotations

import json
import re
import urllib.request
from collections.abc import Callable
from urllib.parse import urlsplit


def checked(url: str, plain: bool = False) -> str:
    u = urlsplit(url)
    if u.scheme not in (("https", "http") if plain else ("https",)) or not u.hostname or u.username or u.password:
        raise ValueError(f"not an endpoint that may be called: {url!r}")
    return url


def post_json(url: str, body: dict, headers: dict | None = None, timeout: float = 30.0, opener: Callable | None = None) -> dict:
    request = urllib.request.Request(checked(url), json.dumps(body).encode(), {"Content-Type": "application/json", **(headers or {})})
    with (opener or urllib.request.urlopen)(request, timeout=timeout) as answer:
        return json.loads(answer.read())


def chat(url: str, model: str, key: str, system: str = "", timeout: float = 60.0, opener: Callable | None = None) -> Callable[[], Callable[[str], str]]:
    """A factory for generate(): each partition gets its own function from prompt to text."""
    checked(url)

    def factory():
        def ask(prompt: str) -> str:
            messages = [*([{"role": "system", "content": system}] if system else []), {"role": "user", "content": prompt}]
            got = post_json(url, {"model": model, "messages": messages}, {"Authorization": f"Bearer {key}"}, timeout, opener)
            return got["choices"][0]["message"]["content"]

        return ask

    factory.is_factory = True
    return factory


def echo(answer: str = "answer to: {prompt}") -> Callable[[], Callable[[str], str]]:
    """A stand-in for tests: no network."""

    def factory():
        return lambda prompt: answer.replace("{prompt}", prompt or "")

    factory.is_factory = True
    return factory


def json_object(text: str | None) -> dict | None:
    """The first JSON object in a text, fenced or not; null if there is none."""
    body = re.sub(r"```(?:json)?", "", text or "")
    decoder = json.JSONDecoder()
    for m in re.finditer(r"\{", body):
        try:
            got, _ = decoder.raw_decode(body, m.start())
        except ValueError:
            continue
        if isinstance(got, dict):
            return got
    return None
