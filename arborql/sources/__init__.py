from .files import documents, scan
from .nodes import nodes

__all__ = ["documents", "nodes", "scan"]
