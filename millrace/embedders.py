"""Embedding providers: the plug-in surface.

A provider turns a list of texts into vectors of one dimension.  It is made
inside each Python worker from its parameters, once, by ``create``.
"""

from __future__ import annotations

import hashlib
import json
import urllib.request
from abc import ABC, abstractmethod

from .config import ConfigError, as_bool, as_int
from .functions import ids


class Embedder(ABC):
    dim: int

    @abstractmethod
    def embed_texts(self, texts: list[str]) -> list[list[float]]: ...

    @abstractmethod
    def runtime_fingerprint(self) -> str: ...

    def __call__(self, texts: list[str]) -> list[list[float]]:
        return self.embed_texts(texts)


class DigestEmbedder(Embedder):
    """Deterministic: bytes of SHA-256 over 255, repeated up to ``dim``."""

    def __init__(self, dim: int = 32):
        self.dim = dim

    def embed_texts(self, texts):
        out = []
        for t in texts:
            d = hashlib.sha256(t.encode("utf-8", "replace")).digest()
            out.append([d[i % len(d)] / 255 for i in range(self.dim)])
        return out

    def runtime_fingerprint(self):
        return ids.runtime_fingerprint(provider="digest", dim=self.dim)


def check_vectors(rows, n: int) -> list[list[float]]:
    """Numbers only (no bools), one dimension, one vector for each text."""
    if not isinstance(rows, list) or len(rows) != n:
        raise ValueError(f"{n} vectors expected")
    for r in rows:
        if not isinstance(r, list) or not r or any(isinstance(x, bool) or not isinstance(x, (int, float)) for x in r):
            raise ValueError("a vector must be a list of numbers")
    if len({len(r) for r in rows}) > 1:
        raise ValueError("vectors differ in dimension")
    return [[float(x) for x in r] for r in rows]


class HttpEmbedder(Embedder):
    """A batch endpoint; where there is none (404), one request for each text."""

    def __init__(self, base_url: str, model_id: str, timeout_s: float = 300, post=None):
        self.base_url, self.model_id, self.timeout_s, self.dim = base_url.rstrip("/"), model_id, timeout_s, 0
        self.post = post or self._post

    def _post(self, path: str, body: dict) -> tuple[int, dict]:
        request = urllib.request.Request(self.base_url + path, json.dumps(body).encode(), {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout_s) as r:
                return r.status, json.load(r)
        except urllib.error.HTTPError as e:
            return e.code, {}

    def embed_texts(self, texts):
        code, got = self.post("/api/embed", {"model": self.model_id, "input": texts})
        if code == 404:
            rows = []
            for t in texts:
                code, one = self.post("/api/embeddings", {"model": self.model_id, "prompt": t})
                rows.append(one.get("embedding"))
        else:
            rows = got.get("embeddings")
        if code != 200:
            raise RuntimeError(f"embedding endpoint answered {code}")
        rows = check_vectors(rows, len(texts))
        self.dim = len(rows[0]) if rows else self.dim
        return rows

    def runtime_fingerprint(self):
        return ids.runtime_fingerprint(provider="http", base_url=self.base_url, model_id=self.model_id)


class TorchEmbedder(Embedder):
    """Mean-pooled, normalised sentence vectors of a local model (needs torch)."""

    def __init__(self, path: str, device: str = "auto", dtype: str = "float32", max_length: int = 512, pooling: str = "mean", normalize: bool = True, offline_only: bool = True, cache_dir: str | None = None, trust_remote_code: bool = False):
        if pooling != "mean" or not normalize:
            raise ConfigError("only mean pooling with normalised vectors is supported")
        try:
            import torch
            from transformers import AutoModel, AutoTokenizer
        except ImportError as e:
            raise ConfigError("the torch provider needs torch and transformers") from e
        self.torch, self.path, self.max_length = torch, path, max_length
        self.device = device if device != "auto" else "cuda" if torch.cuda.is_available() else "cpu"
        half = dtype == "float16" and self.device.startswith("cuda")
        how = {"local_files_only": offline_only, "cache_dir": cache_dir, "trust_remote_code": trust_remote_code}
        self.tokens = AutoTokenizer.from_pretrained(path, **how)
        self.model = AutoModel.from_pretrained(path, **how, torch_dtype=torch.float16 if half else torch.float32).to(self.device).eval()
        self.dim = self.model.config.hidden_size

    def embed_texts(self, texts):
        torch = self.torch
        with torch.no_grad():
            batch = self.tokens(texts, padding=True, truncation=True, max_length=self.max_length, return_tensors="pt").to(self.device)
            mask = batch["attention_mask"].unsqueeze(-1)
            hidden = self.model(**batch).last_hidden_state
            mean = (hidden * mask).sum(1) / mask.sum(1).clamp(min=1)
            return torch.nn.functional.normalize(mean.float(), dim=1).cpu().tolist()

    def runtime_fingerprint(self):
        return ids.runtime_fingerprint(provider="torch", files=ids.model_files_fingerprint(self.path), max_length=self.max_length)


_made: dict[str, Embedder] = {}


#: Settings beside ``embed`` that a provider may need.
ENDPOINT = ("base_url", "timeout_s")


def in_worker(settings: dict) -> Embedder:
    """The provider of these settings (of ``embed`` alone, or with those of
    ``ENDPOINT``), made once in each Python worker."""
    key = json.dumps(settings, sort_keys=True, default=str)
    if key not in _made:
        _made[key] = create(settings if "embed" in settings else {"embed": settings})
    return _made[key]


def create(cfg: dict) -> Embedder:
    e = cfg["embed"]
    if as_int(e.get("batch_size"), 0) <= 0:
        raise ConfigError("embed.batch_size must be > 0")
    for key, framing in (("chunk_preprocess_sig", ids.CHUNK_FRAMING), ("query_preprocess_sig", ids.QUERY_FRAMING)):
        if e.get(key) and e[key] != ids.preprocess_sig(framing, e["preprocess"]):
            raise ConfigError(f"embed.{key} does not match the preprocessing")
    kind = e.get("provider")
    if kind == "digest":
        return DigestEmbedder(as_int(e.get("dim"), 32))
    if kind in ("http", "ollama"):
        url, model = e.get("base_url") or cfg.get("base_url"), e.get("model_id")
        for name, value in (("base_url", url), ("embed.model_id", model)):
            if not isinstance(value, str) or not value.strip():
                raise ConfigError(f"{name} must be set for the provider {kind}")
        return HttpEmbedder(url.strip(), model.strip(), max(1, as_int(e.get("timeout_s"), as_int(cfg.get("timeout_s"), 300))))
    if kind == "torch":
        t = e.get("torch") if isinstance(e.get("torch"), dict) else {}
        path = t.get("local_model_path") or e.get("model_id")
        if not path:
            raise ConfigError("embed.torch.local_model_path or embed.model_id must be set for the provider torch")
        return TorchEmbedder(
            str(path), str(t.get("device") or "auto"), str(t.get("dtype") or "float16"), as_int(t.get("max_length"), 512), str(t.get("pooling") or "mean"),
            as_bool(t.get("normalize"), True), as_bool(t.get("offline_only"), True), t.get("cache_dir") or None, as_bool(t.get("trust_remote_code"), False),
        )
    raise ConfigError("embed.provider must be one of: digest, http, ollama, torch")
