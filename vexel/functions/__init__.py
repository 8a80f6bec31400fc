"""Vector algebra, metrics and text functions as Column expressions and SQL functions."""

from vexel.functions.metric import Metric, distance
from vexel.functions.sql import register
from vexel.functions.text import tokenize
from vexel.functions.vector import add, clone, cosine, cosine_distance, dims, dot, equal, equal_eps, euclidean, manhattan, norm, normalize, scale, sub

__all__ = [
    "Metric", "add", "clone", "cosine", "cosine_distance", "dims", "distance", "dot", "equal", "equal_eps",
    "euclidean", "manhattan", "norm", "normalize", "register", "scale", "sub", "tokenize",
]
