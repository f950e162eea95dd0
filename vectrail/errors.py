"""Errors of the graph engine, one class for each kind of failure."""

from __future__ import annotations


class GraphError(Exception):
    """Base of all errors that graph operations raise."""


class Storage(GraphError):
    """Reading or writing stored graphs failed, or the handle may not write."""


class Codec(GraphError):
    """Stored data don't fit their manifest."""


class NodeNotFound(GraphError):
    """A referenced node does not exist."""


class EdgeNotFound(GraphError):
    """A referenced edge does not exist."""


class InvalidNodeType(GraphError):
    """A node type is not registered, or was registered with another dimension."""


class InvalidEdgeType(GraphError):
    """An edge type label is malformed."""


class InvalidPropertyValue(GraphError):
    """A value violates a constraint, such as finiteness."""


class DimensionMismatch(GraphError):
    """An embedding's dimension differs from its node type's."""


class DanglingEdge(GraphError):
    """Removing a node would leave edges without an end."""


class IndexCorruption(GraphError):
    """An index map and the graph disagree."""


class UnsupportedQuery(GraphError):
    """A query exceeds what the configuration allows."""


class VersionMismatch(GraphError):
    """Stored data have another format version."""


class GenerationMismatch(GraphError):
    """A delta was written against a newer base than the stored one."""


class LockConflict(GraphError):
    """Another writer holds the lock."""
