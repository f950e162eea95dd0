"""The graph handle: two DataFrames and two small label dictionaries. Changes give a new handle."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import GraphConfig
from .errors import InvalidNodeType, NodeNotFound, Storage
from .functions.scalars import PROPS

NODES = f"node_id bigint, node_type string, type_id int, props {PROPS}, embedding array<float>"
EDGES = f"edge_id bigint, src bigint, dst bigint, edge_type string, etype_id int, weight float, props {PROPS}"


@dataclass(frozen=True)
class Lookup:
    """How a graph whose ids are computed from key columns reads only the rows of some ids: functions of the ids, valid for
    exactly these DataFrames, so changed graphs don't use them."""

    nodes: DataFrame
    edges: DataFrame
    nodes_with: Callable[[Sequence[int]], DataFrame]
    edges_with: Callable[[Sequence[int]], DataFrame]
    edges_at: Callable[[Sequence[int], str], DataFrame]


@dataclass(frozen=True)
class PropertyGraph:
    """A typed property graph. ``node_types`` maps labels to (id, embedding dimension or None), in the order of
    registration; ``edge_types`` maps labels to ids in the order of first use. Ids of removed rows aren't used again."""

    nodes: DataFrame
    edges: DataFrame
    node_types: dict[str, tuple[int, int | None]] = field(default_factory=dict)
    edge_types: dict[str, int] = field(default_factory=dict)
    config: GraphConfig = GraphConfig()
    next_node_id: int = 0
    next_edge_id: int = 0
    pending: tuple = ()
    lookup: Lookup | None = None

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    @staticmethod
    def in_memory(spark: SparkSession, config: GraphConfig = GraphConfig()) -> PropertyGraph:
        """An empty graph."""
        return PropertyGraph(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES), config=config)

    def plain_nodes(self) -> DataFrame:
        """The nodes without the columns of indexed properties, which only stored graphs have; changes start here."""
        return self.nodes.select("node_id", "node_type", "type_id", "props", "embedding")

    def writable(self) -> None:
        if self.config.read_only:
            raise Storage("the graph is read-only")

    def type_of(self, label: str) -> tuple[int, int | None]:
        if label not in self.node_types:
            raise InvalidNodeType(label)
        return self.node_types[label]

    def register_node_type(self, label: str, dim: int | None = None) -> PropertyGraph:
        """Register a node type; again with the same dimension is no change, with another an error."""
        self.writable()
        if dim is not None and self.config.max_embedding_dim is not None and dim > self.config.max_embedding_dim:
            raise InvalidNodeType(f"{label}: dimension {dim} exceeds {self.config.max_embedding_dim}")
        if label in self.node_types:
            if self.node_types[label][1] != dim:
                raise InvalidNodeType(f"{label} is registered with dimension {self.node_types[label][1]}")
            return self
        return replace(self, node_types=self.node_types | {label: (len(self.node_types), dim)}, pending=(*self.pending, ("register_node_type", label)))

    def nodes_with(self, ids: Sequence[int]) -> DataFrame:
        """The nodes of some ids: a comparison of key columns that reaches the scan."""
        if self.lookup is not None and self.lookup.nodes is self.nodes:
            return self.lookup.nodes_with(ids)
        return self.nodes.filter(F.col("node_id").isin(*ids))

    def edges_with(self, ids: Sequence[int]) -> DataFrame:
        if self.lookup is not None and self.lookup.edges is self.edges:
            return self.lookup.edges_with(ids)
        return self.edges.filter(F.col("edge_id").isin(*ids))

    def edges_at(self, ids: Sequence[int], end: str) -> DataFrame:
        """The edges whose end, "src" or "dst", is one of some nodes."""
        if self.lookup is not None and self.lookup.edges is self.edges:
            return self.lookup.edges_at(ids, end)
        return self.edges.filter(F.col(end).isin(*ids))

    def need_nodes(self, *ids: int) -> None:
        """Raise NodeNotFound for the first id that has no node; one pushed-down lookup."""
        found = {r.node_id for r in self.nodes_with(ids).select("node_id").collect()}
        for i in ids:
            if i not in found:
                raise NodeNotFound(str(i))

    def type_table(self) -> DataFrame:
        """label, type_id, dim of the registered node types."""
        return self.spark.createDataFrame([(k, i, d) for k, (i, d) in self.node_types.items()], "label string, type_id int, dim int")
