"""Schemas, values, names and errors of versioned vector collections.

A collection is an append-only log of operations: upserts of a record (id,
vector, JSON metadata) and deletions of an id, each with a sequence number.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

Scalar = str | int | float | bool | None

COSINE, DOT, L2 = "cosine", "dot", "l2"
METRICS = (COSINE, DOT, L2)
MUTABLE_UNIT = "mutable-delta"
DEFAULT_DATABASE = "default"

VECTOR = T.ArrayType(T.FloatType(), False)
#: A row of the log; metadata stays the JSON text it was written as.
LOG = T.StructType([
    T.StructField("seq_no", T.LongType(), False), T.StructField("op", T.StringType(), False), T.StructField("id", T.StringType(), False),
    T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("metadata", T.StringType()),
])
#: A row of a unit's index: a visible record of the unit, with the norm of its vector.
INDEXED = T.StructType([T.StructField("id", T.StringType()), T.StructField("seq_no", T.LongType()), LOG["vector"], LOG["metadata"], T.StructField("norm", T.FloatType())])


class CollectionError(Exception):
    """Any error of this engine."""


class NotFound(CollectionError):
    """No such database, collection, unit or policy."""


class AlreadyExists(CollectionError):
    """A name is taken."""


class InvalidArgument(CollectionError, ValueError):
    """A request that can never be served."""


class EmptyBatch(InvalidArgument):
    """A batch without operations."""


class InvalidPredicate(InvalidArgument):
    """A malformed predicate."""


class DimensionMismatch(InvalidArgument):
    """A vector of the wrong length."""


class InvalidSnapshot(InvalidArgument):
    """A read boundary outside what the collection holds."""


class BarrierNotSatisfied(CollectionError):
    """The collection has not reached the read barrier."""


class Unauthenticated(CollectionError):
    """No usable credentials."""


class PermissionDenied(CollectionError):
    """Credentials without the needed role."""


@dataclass(frozen=True, order=True)
class Snapshot:
    """A read boundary: a manifest generation and the last visible sequence number."""

    generation: int
    visible_seq_no: int

    def satisfies(self, barrier: Snapshot) -> bool:
        return self.generation >= barrier.generation and self.visible_seq_no >= barrier.visible_seq_no


@dataclass(frozen=True)
class CommitAck:
    last_seq_no: int
    applied_ops: int
    snapshot: Snapshot


@dataclass(frozen=True)
class Descriptor:
    """What is fixed when a collection is created."""

    database: str
    name: str
    dimensions: int
    metric: str
    flush_ops: int = 10_000
    flush_bytes: int = 64 << 20
    compact_units: int = 4
    remote: dict | None = field(default=None)

    def __post_init__(self):
        check_name(self.database)
        check_name(self.name)
        if self.dimensions <= 0:
            raise InvalidArgument("dimensions must be greater than zero")
        if self.metric not in METRICS:
            raise InvalidArgument(f"unknown metric {self.metric!r}")
        if self.flush_ops <= 0 or self.flush_bytes <= 0:
            raise InvalidArgument("flush thresholds must be greater than zero")
        if self.compact_units <= 1:
            raise InvalidArgument("the compaction threshold must be greater than one")


def check_name(name: str) -> str:
    if not name or "/" in name or name in (".", ".."):
        raise InvalidArgument(f"invalid name {name!r}")
    return name


def parse_reference(reference: str) -> tuple[str, str]:
    """`name` in the default database, or `database/name`."""
    parts = reference.split("/")
    if len(parts) == 1:
        parts = [DEFAULT_DATABASE, *parts]
    if len(parts) != 2:
        raise InvalidArgument(f"invalid collection reference {reference!r}")
    return check_name(parts[0]), check_name(parts[1])
