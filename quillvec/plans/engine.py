"""Answers a query over a log: statistics, plan, one DataFrame, diagnostics.

The plan decides which DataFrame is built; Catalyst does the physical work.
Counts for diagnostics run as jobs of their own, only where they are asked for.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillvec.model import DimensionMismatch, InvalidArgument, Scalar
from quillvec.operators import ann, mvcc, ranking
from quillvec.operators.predicate import Predicate, combine, compile_predicate, validate
from quillvec.plans import planner
from quillvec.plans.stats import UnitStats

EXPLAIN = ("none", "plan", "profile")
STAGES = ("planning", "prefilter", "candidate_generation", "postfilter", "rerank", "merge")


@dataclass
class Diagnostics:
    chosen_plan: str
    planner_reason: str
    estimated_selectivity: float
    units_considered: int
    units_pruned: int
    units_scanned: int
    candidates_before_filter: int
    candidates_after_filter: int
    candidates_reranked: int
    candidates_merged: int
    rerank_count: int
    fallback_reason: str | None
    unit_scan_mix: dict[str, int]
    stage_timings: dict[str, int] | None = None


@dataclass
class Result:
    """The matches, best first, and the diagnostics if asked for."""

    matches: DataFrame
    plan: str
    diagnostics: Diagnostics | None = None


def execute(
    log: DataFrame, units: Sequence[UnitStats], vector: Sequence[float], metric: str, k: int, *, dimensions: int | None = None, filters: dict[str, Scalar] | None = None, predicate: Predicate | None = None,
    visible_seq_no: int | None = None, precision: str = "f32", explain: str = "none", index: Callable[[list[str], float], tuple[DataFrame, bool]] | None = None,
) -> Result:
    """The best `k` visible records that satisfy filters and predicate.

    `units` are the statistics of the log's units at the snapshot; they hold at
    least what `planner.named` lists for the predicate.  `index` gives the indexed
    records of some units that a query has to look at, for so many times the usual
    lists, and whether that is all of them; without it, candidates are generated
    from the log.
    """
    started = time.perf_counter()
    if explain not in EXPLAIN:
        raise InvalidArgument(f"unknown explain mode {explain!r}")
    if k < 0:
        raise InvalidArgument("top_k must not be negative")
    if dimensions is not None and len(vector) != dimensions:
        raise DimensionMismatch(f"query vector dimension mismatch: expected {dimensions}, found {len(vector)}")
    whole = combine(filters, predicate)
    if whole is not None:
        validate(whole)
    test = None if whole is None else compile_predicate(whole, F.col("metadata"))
    selection = planner.select_units(whole, units)
    share = planner.selectivity(whole, units)
    plan = planner.choose_plan(whole, share, k, selection)
    planned = time.perf_counter()

    bounded = mvcc.at(log, visible_seq_no)
    if plan in planner.EXACT_PLANS:
        records = mvcc.live(mvcc.at(bounded, None, selection.immutable, selection.include_mutable))
        matches = ranking.top_k(records, vector, metric, k, precision, test)
        count = None if explain == "none" else lambda clock: exact_counts(records, test, plan, clock)
    else:
        size = planner.budget(k, share)
        if index is not None:
            found = indexed_candidates(index, selection.immutable, vector, metric, size, precision, test, float(share))
        else:
            frozen = mvcc.at(bounded, None, selection.immutable, include_mutable=False)
            found = ranking.unit_candidates(frozen, vector, metric, size, precision, test)
        fresh = mvcc.lookup(bounded, found)
        fresh = fresh if test is None else fresh.where(test)
        sides = [fresh]
        if plan == planner.HYBRID:
            mutable = mvcc.live(mvcc.at(bounded, None, [], True))
            sides.append(mutable if test is None else mutable.where(test))
        merged = mvcc.merge_latest(*sides)
        matches = ranking.top_k(merged, vector, metric, k, precision)
        count = None if explain == "none" else lambda clock: ann_counts(found, sides, merged, clock)
    if count is None:
        return Result(matches, plan)
    clock = Clock()
    before, after, reranked, together, rerank_count = count(clock)
    timings = None
    if explain == "profile":
        clock.took["planning"] = planned - started
        with clock("rerank"):
            matches.write.format("noop").mode("overwrite").save()
        timings = {f"{name}_micros": int(clock.took.get(name, 0) * 1e6) for name in STAGES}
    return Result(matches, plan, Diagnostics(
        plan, planner.REASONS[plan], float(share), selection.considered, selection.pruned, selection.scanned, before, after, reranked, together, rerank_count,
        planner.FALLBACKS.get(plan), planner.scan_mix(plan, selection), timings,
    ))


def indexed_candidates(
    index: Callable[[list[str], float], tuple[DataFrame, bool]], units: list[str], vector: Sequence[float], metric: str, size: int, precision: str, test: Column | None, share: float
) -> DataFrame:
    """Candidates from indexes.  Under a predicate more lists are read, twice as many each time, until `size` records pass or all lists are read."""
    wide = 1.0 if test is None else 1 / max(share, 1e-6)
    while True:
        lists, whole = index(units, wide)
        found = ann.candidates(lists, vector, metric, size, precision, test)
        if test is None or whole:
            return found
        rows = found.collect()  # at most `size`
        if len(rows) >= size:
            return lists.sparkSession.createDataFrame(rows, found.schema)
        wide *= 2


class Clock:
    """Seconds by stage, each measured as a job of its own; stages that a plan lacks stay at zero."""

    def __init__(self):
        self.took: dict[str, float] = {}

    @contextmanager
    def __call__(self, stage: str) -> Iterator[None]:
        started = time.perf_counter()
        yield
        self.took[stage] = time.perf_counter() - started


def exact_counts(records: DataFrame, test, plan: str, clock: Clock) -> tuple[int, int, int, int, int]:
    passed = F.lit(True) if test is None else test
    first = plan in (planner.PREDICATE_FIRST, planner.TINY)
    with clock("prefilter" if first else "postfilter"):
        row = records.agg(F.count("*").alias("before"), F.count_if(passed).alias("after")).first()
    return row["before"], row["after"], row["after"] if first else row["before"], row["after"], 0


def ann_counts(found: DataFrame, sides: list[DataFrame], merged: DataFrame, clock: Clock) -> tuple[int, int, int, int, int]:
    with clock("candidate_generation"):
        candidates = found.count()
    with clock("postfilter"):
        sizes = [s.count() for s in sides]
    with clock("merge"):
        together = merged.count()
    return candidates + sum(sizes[1:]), sum(sizes), together, together, 1
