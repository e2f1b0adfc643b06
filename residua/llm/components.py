"""Connected components of links between documents, vectors or urls."""

from residua.functions.graph import connected_components

__all__ = ["connected_components"]
