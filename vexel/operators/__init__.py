"""Stores, nearest neighbours and text embedders."""

from vexel.operators.embedder import Embedder
from vexel.operators.http_embedder import EmbeddingError, HTTPEmbedder
from vexel.operators.onnx_embedder import OnnxEmbedder
from vexel.operators.random_projection import RandomProjection
from vexel.operators.store import VectorStore
from vexel.operators.wordpiece import WordPiece

__all__ = ["Embedder", "EmbeddingError", "HTTPEmbedder", "OnnxEmbedder", "RandomProjection", "VectorStore", "WordPiece"]
