"""Versions: which operation on each id a read sees.

A predicate on metadata may only be applied to what these return.  Below the
window only the sequence bound, the units and the ids themselves are safe.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillvec.model import MUTABLE_UNIT


def at(log: DataFrame, visible_seq_no: int | None = None, units: Sequence[str] | None = None, include_mutable: bool = True) -> DataFrame:
    """The log up to a sequence number, in some units; an empty list of units means no immutable ones."""
    if visible_seq_no is not None:
        log = log.where(F.col("seq_no") <= visible_seq_no)
    if units is not None:
        chosen = [*units, MUTABLE_UNIT] if include_mutable else list(units)
        log = log.where(F.col("unit_id").isin(chosen) if chosen else F.lit(False))
    elif not include_mutable:
        log = log.where(F.col("unit_id") != MUTABLE_UNIT)
    return log


def latest(log: DataFrame, *keys: str) -> DataFrame:
    """The newest operation on each id (or on each of `keys`), deletions included.

    A ranking limit of one, which Spark also applies before the shuffle.
    """
    window = Window.partitionBy(*(keys or ("id",))).orderBy(F.desc("seq_no"))
    return log.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")


def live(log: DataFrame) -> DataFrame:
    return latest(log).where(F.col("op") == "put")


def deleted(log: DataFrame) -> DataFrame:
    return latest(log).where(F.col("op") == "delete")


def scan(log: DataFrame, visible_seq_no: int | None = None, units: Sequence[str] | None = None, include_mutable: bool = True) -> DataFrame:
    """Visible records, ordered by id; without vectors if the log has none."""
    shown = [c for c in ("id", "vector", "metadata", "seq_no") if c in log.columns]
    return live(at(log, visible_seq_no, units, include_mutable)).select(*shown).orderBy("id")


def lookup(log: DataFrame, ids: DataFrame) -> DataFrame:
    """Visible records of `ids(id)`; the semi-join runs below the window, as the id is its key."""
    return live(log.join(ids.select("id").distinct(), "id", "left_semi"))


def compact_image(log: DataFrame) -> DataFrame:
    """What compaction keeps: the newest operation on each id in immutable units, tombstones too."""
    return latest(at(log, include_mutable=False))


def unit_visible(log: DataFrame) -> DataFrame:
    """What an index of each unit covers: its newest operation on each id, if that is a put."""
    return latest(log, "unit_id", "id").where(F.col("op") == "put")


def merge_latest(*sides: DataFrame) -> DataFrame:
    """One row an id from several candidate sets: the largest sequence number, ties to the later set."""
    marked = [d.withColumn("_side", F.lit(k)) for k, d in enumerate(sides)]
    both = marked[0]
    for d in marked[1:]:
        both = both.unionByName(d)
    window = Window.partitionBy("id").orderBy(F.desc("seq_no"), F.desc("_side"))
    return both.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank", "_side")
