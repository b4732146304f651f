"""A Spark-native engine for retrieval and structural analytics over text and source code."""

from importlib import import_module
from typing import Any

#: Public names and where they are defined; they are imported at first use, so that workers load only what they need.
_WHERE = {
    "Engine": "api", "Config": "api", "Cache": "sources.cache", "Index": "sources.store", "Provider": "sources.embedding", "HashingProvider": "sources.embedding", "HttpProvider": "sources.embedding", "LocalProvider": "sources.embedding",
    "EmbeddingCache": "sources.embedding", "create_provider": "sources.embedding", "parse_files": "sources.parse", "scan": "sources.store", "Budget": "operators.context", "structured_context": "operators.context", "search_context": "operators.context",
    "bm25": "operators.bm25", "bm25_batch": "operators.bm25", "knn_one": "operators.knn", "knn_batch": "operators.knn", "fuse": "operators.fusion", "rerank": "operators.rerank", "rerank_v2": "operators.rerank", "route": "operators.routing",
    "communities": "operators.graph", "cycles": "operators.graph", "impact": "operators.graph", "layers": "operators.graph", "flows": "operators.dataflow", "search_documents": "functions.documents", "watch": "streaming.watch",
}
__all__ = sorted(_WHERE)


def __getattr__(name: str) -> Any:
    if name in _WHERE:
        return getattr(import_module(f"{__name__}.{_WHERE[name]}"), name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
