"""Gives executors this package; see `quillvec.ship`."""

from quillvec.ship import ship

__all__ = ["ship"]
