"""Embedding providers, called for whole batches of rows.

A provider has ``dimension`` and ``embed(texts) -> array (n, dimension)``.  ``hashing`` needs
no model; ``HttpProvider`` posts batches to any endpoint of the common JSON shape; any other
object can be passed in.  A failing batch gives null vectors, so that search falls back to
the other channels.
"""

from __future__ import annotations

import json
import re
import urllib.request
from collections import OrderedDict
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import HUMP


PART = re.compile("[0-9a-z]+")


class Provider(Protocol):
    dimension: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingProvider:
    """Signed hashing of words and their parts, normalised."""

    def __init__(self, dimension: int = 256):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> np.ndarray:
        import xxhash

        out = np.zeros((len(texts), self.dimension), np.float32)
        for i, t in enumerate(texts):
            for w in PART.findall(re.sub(HUMP, r"\1 \2", t or "").lower()):
                h = xxhash.xxh64_intdigest(w)
                out[i, h % self.dimension] += 1.0 if h >> 63 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)


class HttpProvider:
    """POSTs {"model", "input"} and reads data[i].embedding."""

    def __init__(self, url: str, model: str, dimension: int, key: str = "", timeout: float = 30, send_dimension: bool = False):
        self.url, self.model, self.dimension, self.key, self.timeout, self.send_dimension = url, model, dimension, key, timeout, send_dimension

    def embed(self, texts: list[str]) -> np.ndarray:
        body = json.dumps({"model": self.model, "input": texts, **({"dimensions": self.dimension} if self.send_dimension else {})}).encode()
        head = {"Content-Type": "application/json", **({"Authorization": f"Bearer {self.key}"} if self.key else {})}
        with urllib.request.urlopen(urllib.request.Request(self.url, body, head), timeout=self.timeout) as r:
            rows = json.load(r)["data"]
        return np.array([x["embedding"] for x in sorted(rows, key=lambda x: x.get("index", 0))], np.float32)


class OneByOneProvider(HttpProvider):
    """For endpoints that take one text a request: {"model", "prompt"} and embedding."""

    def embed(self, texts: list[str]) -> np.ndarray:
        out = []
        for t in texts:
            req = urllib.request.Request(self.url, json.dumps({"model": self.model, "prompt": t}).encode(), {"Content-Type": "application/json"})
            with urllib.request.urlopen(req, timeout=self.timeout) as r:
                out.append(json.load(r)["embedding"])
        return np.array(out, np.float32)


class LocalProvider:
    """A transformer encoder of the local disk: masked mean of the last layer, normalised.  Needs torch and transformers, and loads them in each worker at first use."""

    def __init__(self, path: str, dimension: int = 768, most_tokens: int = 8192):
        self.path, self.dimension, self.most_tokens, self._held = path, dimension, most_tokens, None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_held": None}

    def embed(self, texts: list[str]) -> np.ndarray:
        import torch
        from transformers import AutoModel, AutoTokenizer

        if self._held is None:
            try:
                tokenizer = AutoTokenizer.from_pretrained(self.path)
            except ValueError:  # no fast form of this tokenizer
                tokenizer = AutoTokenizer.from_pretrained(self.path, use_fast=False)
            self._held = tokenizer, AutoModel.from_pretrained(self.path).eval()
        tokenizer, model = self._held
        given = tokenizer(texts, padding=True, truncation=True, max_length=self.most_tokens, return_tensors="pt")
        with torch.no_grad():
            last = model(**given).last_hidden_state
        mask = given["attention_mask"].unsqueeze(-1).to(last.dtype)
        mean = (last * mask).sum(1) / mask.sum(1).clamp(min=1e-9)
        return torch.nn.functional.normalize(mean, dim=1).numpy().astype(np.float32)


#: Endpoints by name: where, and what a vector of theirs is.
ENDPOINTS = {
    "jina": dict(url="https://api.jina.ai/v1/embeddings", model="jina-embeddings-v3", dimension=1024, send_dimension=True),
    "jina-code": dict(url="https://api.jina.ai/v1/embeddings", model="jina-embeddings-v2-base-code", dimension=768),
    "openai": dict(url="https://api.openai.com/v1/embeddings", model="text-embedding-3-small", dimension=1536),
    "ollama": dict(url="http://localhost:11434/api/embeddings", model="nomic-embed-text", dimension=768),
    "nomic": dict(url="http://localhost:11434/api/embeddings", model="nomic-embed-text", dimension=768),
}


def create_provider(name: str, **options) -> Provider | None:
    """A provider by name; ``options`` replace its url, model, dimension or key.  None for an unknown name or options that don't fit: searches then do without vectors."""
    kinds = {"hashing": HashingProvider, "local": LocalProvider}
    try:
        if name in kinds:
            return kinds[name](**options)
        if name in ENDPOINTS:
            return (OneByOneProvider if name in ("ollama", "nomic") else HttpProvider)(**{**ENDPOINTS[name], **options})
    except TypeError:
        pass
    return None


class EmbeddingCache:
    """Remembers the vectors of the ``size`` texts used last; a batch asks the provider only for texts that it doesn't know, each once."""

    def __init__(self, provider: Provider | None = None, size: int = 10_000):
        self.provider, self.size, self.held = provider, size, OrderedDict()

    @property
    def available(self) -> bool:
        return self.provider is not None

    @property
    def dimension(self) -> int:
        return self.provider.dimension if self.provider else 0

    def __len__(self) -> int:
        return len(self.held)

    def set_provider(self, provider: Provider | None) -> None:
        """Another provider's vectors are others: all that is held goes."""
        self.provider = provider
        self.invalidate()

    def invalidate(self) -> None:
        self.held.clear()

    def embed(self, texts: list[str]) -> list[np.ndarray | None]:
        """A vector for each text; None where there is no provider, or where it failed."""
        new = [t for t in dict.fromkeys(texts) if t not in self.held]
        if new and self.provider:
            try:
                self.held.update(zip(new, self.provider.embed(new)))
            except Exception:  # noqa: BLE001 - a provider may fail in any way
                pass
        out = [self.held.get(t) for t in texts]
        for t in dict.fromkeys(texts):
            if t in self.held:
                self.held.move_to_end(t)
        while len(self.held) > self.size:
            self.held.popitem(last=False)
        return out


def embed(rows: DataFrame, key: str, text: str, provider: Provider, batch: int = 32, limit: int = 2048) -> DataFrame:
    """key, embedding array<float>: each distinct text is embedded once and joined back by hash."""
    kind = dict(rows.dtypes)[key]
    cut = rows.select(F.col(key), F.substring(F.coalesce(text, F.lit("")), 1, limit).alias("t")).withColumn("h", F.sha2("t", 256))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), batch):
                part = pdf.iloc[lo : lo + batch]
                try:
                    v = [x.tolist() for x in provider.embed(part["t"].tolist())]
                except Exception:  # noqa: BLE001 - a provider may fail in any way
                    v = [None] * len(part)
                yield pd.DataFrame({"h": part["h"].tolist(), "embedding": v})

    vectors = cut.select("h", "t").dropDuplicates(["h"]).mapInPandas(run, "h string, embedding array<float>")
    return cut.select(F.col(key).cast(kind), "h").join(vectors, "h").select(key, "embedding")
