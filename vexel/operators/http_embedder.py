"""Embedding by a service that speaks the common /embeddings protocol."""

from __future__ import annotations

import json
import math
import urllib.error
import urllib.request
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from vexel.operators.remote import embed_table

MOST_BYTES = 64 << 20
#: (url, body, headers, seconds) -> (status, body)
Transport = Callable[[str, bytes, dict[str, str], float], tuple[int, bytes]]


class EmbeddingError(RuntimeError):
    pass


def post(url: str, body: bytes, headers: dict[str, str], timeout: float) -> tuple[int, bytes]:
    request = urllib.request.Request(url, body, headers, method="POST")
    try:
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            return reply.status, reply.read(MOST_BYTES)
    except urllib.error.HTTPError as e:
        return e.code, e.read(MOST_BYTES)
    except OSError as e:
        raise EmbeddingError(f"no answer from {url}: {e}") from e


@dataclass(frozen=True)
class HTTPEmbedder:
    """Settings that travel to the workers. ``dims`` is 0 until ``probe`` or the caller says.

    ``embed`` probes where nobody said, so all tasks hold answers to one length.
    """

    base_url: str
    model: str
    dims: int = 0
    api_key: str = field(default="", repr=False)
    headers: dict[str, str] = field(default_factory=dict, repr=False)
    normalize: bool = False
    timeout: float = 30.0
    batch: int = 256
    transport: Transport | None = field(default=None, repr=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "base_url", self.base_url.rstrip("/"))
        object.__setattr__(self, "dims", max(self.dims, 0))

    def with_api_key(self, key: str) -> HTTPEmbedder:
        return replace(self, api_key=key)

    def with_header(self, name: str, value: str) -> HTTPEmbedder:
        """Extra headers come last and may replace others."""
        return replace(self, headers=self.headers | {name: value})

    def with_transport(self, transport: Transport | None) -> HTTPEmbedder:
        return self if transport is None else replace(self, transport=transport)

    def with_normalize(self) -> HTTPEmbedder:
        return replace(self, normalize=True)

    def embed_batch(self, texts: Sequence[str]) -> list[list[float]]:
        """One request for all texts, answered in their order; none for no texts."""
        if not texts:
            return []
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {}) | self.headers
        status, body = (self.transport or post)(f"{self.base_url}/embeddings", json.dumps({"model": self.model, "input": list(texts)}).encode(), head, self.timeout)
        try:
            reply = json.loads(body[:MOST_BYTES])
            if not isinstance(reply, dict):
                raise ValueError("not an object")
        except ValueError as e:
            raise EmbeddingError(f"status {status}" if status != 200 else f"the answer can't be read: {e}") from None
        if (error := reply.get("error")) and error.get("message"):
            raise EmbeddingError(error["message"])
        if status != 200:
            raise EmbeddingError(f"status {status}")
        data = sorted(reply.get("data") or [], key=lambda x: x.get("index", 0))
        if len(data) != len(texts):
            raise EmbeddingError(f"{len(data)} embeddings for {len(texts)} texts")
        if [x.get("index", 0) for x in data] != list(range(len(texts))):
            raise EmbeddingError("the indices aren't 0 to n-1")
        vectors = [[float(v) for v in x.get("embedding") or []] for x in data]
        if not vectors[0]:
            raise EmbeddingError("an empty embedding")
        if len({*map(len, vectors)}) > 1:
            raise EmbeddingError("embeddings of different lengths in one answer")
        if self.dims and len(vectors[0]) != self.dims:
            raise EmbeddingError(f"{len(vectors[0])} dimensions, not {self.dims}")
        if self.normalize:
            for v in vectors:
                if norm := math.sqrt(sum(x * x for x in v)):
                    v[:] = [x / norm for x in v]
        return vectors

    def embed_text(self, text: str) -> list[float]:
        return self.embed_batch([text])[0]

    def probe(self, text: str = "dimension") -> HTTPEmbedder:
        """Ask once, on the driver, and keep the length of the answer for all workers to check."""
        return self if self.dims else replace(self, dims=len(self.embed_text(text)))

    def embed(self, texts: DataFrame, text_col: str = "text", out_col: str = "embedding") -> DataFrame:
        """texts with a vector column: one request for every ``batch`` texts. Cancel it as a Spark job."""
        sure = self.probe()
        return embed_table(texts, text_col, out_col, self.batch, lambda: sure.embed_batch)
