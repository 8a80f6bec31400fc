"""Embedding by a local BERT-like ONNX model: mean over real positions, unit length."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import lru_cache
from typing import Any

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from vexel.operators.remote import embed_table
from vexel.operators.wordpiece import WordPiece, padded

INPUTS = {"input_ids", "attention_mask", "token_type_ids"}


@lru_cache(4)
def _session(name: str) -> Any:
    """One session in each worker process; a failed start may be tried again."""
    try:
        import onnxruntime
    except ImportError as e:
        raise RuntimeError("onnxruntime isn't installed on this worker") from e
    return onnxruntime.InferenceSession(SparkFiles.get(name), providers=["CPUExecutionProvider"])


def pick_output(names: list[str]) -> str:
    return next((n for n in ("sentence_embedding", "last_hidden_state") if n in names), names[0])


def pool(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Vectors of unit length from the model's output; zero stays zero."""
    if hidden.ndim not in (2, 3) or len(hidden) != len(mask) or hidden.ndim == 3 and hidden.shape[1] != mask.shape[1]:
        raise ValueError(f"the model's output has shape {hidden.shape}")
    if hidden.ndim == 3:
        weight = mask[:, :, None].astype(np.float64)
        hidden = (hidden * weight).sum(axis=1) / np.maximum(weight.sum(axis=1), 1)
    norm = np.sqrt((hidden.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    return np.divide(hidden, norm, out=np.zeros(hidden.shape), where=norm > 0)


def run_batch(session: Any, tokenizer: WordPiece, texts: list[str], max_length: int) -> np.ndarray:
    wanted = {i.name for i in session.get_inputs()}
    if not {"input_ids", "attention_mask"} <= wanted <= INPUTS:
        raise ValueError(f"the model asks for {sorted(wanted)}")
    ids, mask = padded([tokenizer.encode(t, max_length) for t in texts], tokenizer.ids["[PAD]"])
    feed = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
    out = pick_output([o.name for o in session.get_outputs()])
    return pool(session.run([out], {k: v for k, v in feed.items() if k in wanted})[0], mask)


@dataclass(frozen=True)
class OnnxEmbedder:
    """``model`` names a file that executors have fetched; ``open`` makes a session of it in a worker."""

    model: str
    tokenizer: WordPiece
    max_length: int = 256
    batch: int = 32
    dims: int = 0
    open: Callable[[str], Any] = _session

    @classmethod
    def load(cls, spark: SparkSession, model_path: str, vocab_path: str, cased: bool = False) -> OnnxEmbedder:
        """Send the model's file to every executor and read the vocabulary."""
        spark.sparkContext.addFile(model_path)
        return cls(model_path.rstrip("/").rpartition("/")[2], WordPiece.read(spark, vocab_path, lower=not cased))

    def with_max_length(self, n: int) -> OnnxEmbedder:
        """Ignored unless there is room for a token between the two marks."""
        return replace(self, max_length=n) if n > 2 else self

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        return run_batch(self.open(self.model), self.tokenizer, texts, self.max_length).tolist() if texts else []

    def probe(self) -> OnnxEmbedder:
        return replace(self, dims=len(self.embed_batch(["dimension"])[0]))

    def embed(self, texts: DataFrame, text_col: str = "text", out_col: str = "embedding") -> DataFrame:
        return embed_table(texts, text_col, out_col, self.batch, lambda: self.embed_batch)
