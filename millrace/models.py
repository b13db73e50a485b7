"""The model call: one chat request over HTTP."""

from __future__ import annotations

import json
import urllib.request


class HttpChat:
    """A chat endpoint; ``post(path, body) -> reply`` can stand in for HTTP."""

    def __init__(self, base_url: str, timeout_s: float = 300, temperature: float = 0.2, max_tokens: int = 800, post=None):
        self.base_url, self.timeout_s, self.temperature, self.max_tokens = base_url.rstrip("/"), timeout_s, temperature, max_tokens
        self.post = post or self._post

    def _post(self, path: str, body: dict) -> dict:
        request = urllib.request.Request(self.base_url + path, json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout_s) as r:
            return json.load(r)

    def reply(self, model: str, messages: list[dict]) -> dict:
        return self.post("/api/chat", {"model": model, "messages": messages, "stream": False, "options": {"temperature": self.temperature, "num_predict": self.max_tokens}})

    def __call__(self, model: str, system: str, prompt: str) -> str:
        """The text of the answer."""
        found = self.reply(model, [{"role": "system", "content": system}, {"role": "user", "content": prompt}])
        return str((found.get("message") or {}).get("content") or "")


def unreachable(base_url: str, timeout_s: float) -> str | None:
    """Why an endpoint does not answer, or None."""
    try:
        with urllib.request.urlopen(base_url.rstrip("/") + "/api/tags", timeout=timeout_s) as r:
            return None if r.status == 200 else f"status {r.status}"
    except (OSError, ValueError) as e:
        return str(e)[:200]


def without_thinking(reply: dict) -> dict:
    """A reply for the log."""
    message = reply.get("message")
    return reply | {"message": {k: v for k, v in message.items() if k != "thinking"}} if isinstance(message, dict) else reply
