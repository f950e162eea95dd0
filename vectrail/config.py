"""Policy of a graph handle."""

from __future__ import annotations

from dataclasses import dataclass, replace

#: No traversal follows more edges than this.
MAX_HOPS = 64


@dataclass(frozen=True)
class GraphConfig:
    indexed_properties: tuple[tuple[str, str], ...] = ()
    scan_ceiling: int = 100_000
    default_max_hops: int = 5
    read_only: bool = False
    max_embedding_dim: int | None = None
    file_lock: bool = False

    def with_indexed_property(self, node_type: str, key: str) -> GraphConfig:
        """Keep (node_type, key) as a typed column in stored graphs, for pushdown."""
        return replace(self, indexed_properties=(*self.indexed_properties, (node_type, key)))

    def as_read_only(self) -> GraphConfig:
        return replace(self, read_only=True)
