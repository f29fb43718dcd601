import numpy as np
import pytest

from quillvec.model import MUTABLE_UNIT
from quillvec.operators.predicate import And, Not, Or, where
from quillvec.plans import planner as P
from quillvec.plans.stats import FieldStats, UnitStats, summary_key


def unit(name, rows, deletes=0, seqs=(1, 1), index="hnsw"):
    u = UnitStats(name, "mutable" if name == MUTABLE_UNIT else "immutable", "raw" if name == MUTABLE_UNIT else index, *seqs, len(rows), deletes)
    for row in rows:
        for k, v in row.items():
            u.fields.setdefault(k, FieldStats()).add(v)
    return u


KEEP = where("kind", "eq", "keep")


def plan(p, units, k):
    s, share = P.select_units(p, units), P.selectivity(p, units)
    return P.choose_plan(p, share, k, s), s, share


def test_selective_predicate_prunes_the_oldest_unit():
    units = [unit(MUTABLE_UNIT, [{"kind": "keep"}], seqs=(3, 3)), unit("seg-keep", [{"kind": "keep"}], seqs=(2, 2)), unit("seg-drop", [{"kind": "drop"}], seqs=(1, 1))]
    chosen, s, _ = plan(KEEP, units, 2)
    assert chosen == P.TINY and (s.considered, s.pruned, s.scanned) == (3, 1, 2)


def test_broad_predicate_merges():
    units = [unit(MUTABLE_UNIT, [{"score": 2}], seqs=(3, 3)), unit("seg", [{"score": 3}, {"score": 1}], seqs=(1, 2))]
    assert plan(where("score", "gte", 1), units, 1)[0] == P.HYBRID


def test_plans_without_predicate():
    segment, raw, mutable = unit("a", [{}], seqs=(2, 2)), unit("b", [{}], seqs=(1, 1), index="raw"), unit(MUTABLE_UNIT, [{}], seqs=(3, 3))
    assert plan(None, [segment, unit(MUTABLE_UNIT, [])], 2)[0] == P.VECTOR_ANN
    assert plan(None, [segment, mutable], 2)[0] == P.HYBRID
    chosen, s, _ = plan(None, [segment, raw, unit(MUTABLE_UNIT, [])], 2)
    assert chosen == P.UNFILTERED and P.scan_mix(chosen, s) == {"immutable_exact": 2}


def test_deletes_and_newer_units_stop_pruning():
    units = [unit(MUTABLE_UNIT, [], deletes=1, seqs=(2, 2)), unit("seg", [{"kind": "keep"}], seqs=(1, 1))]
    _, s, _ = plan(KEEP, units, 2)
    assert (s.pruned, s.scanned) == (0, 2)
    hidden = [unit(MUTABLE_UNIT, []), unit("new-drop", [{"kind": "drop"}], seqs=(2, 2)), unit("old-keep", [{"kind": "keep"}], seqs=(1, 1))]
    _, s, _ = plan(KEEP, hidden, 2)
    assert s.pruned == 0 and s.immutable == ["new-drop", "old-keep"]
    with_delete = [unit("x", [{"kind": "drop"}], deletes=1, seqs=(1, 1))]
    assert plan(KEEP, with_delete, 1)[1].pruned == 0


def test_sparse_ne():
    units = [unit(MUTABLE_UNIT, []), unit("c", [{"kind": "drop"}], seqs=(3, 3)), unit("b", [{}], seqs=(2, 2)), unit("a", [{"kind": "keep"}], seqs=(1, 1))]
    chosen, s, share = plan(where("kind", "ne", "keep"), units, 1)
    assert chosen == P.TINY and share == pytest.approx(1 / 3) and s.pruned == 2 and s.immutable == ["c"]


def test_cooperative_and_exact_choices():
    rows = [{"kind": "keep" if i % 4 == 0 else "drop"} for i in range(12)]
    assert plan(KEEP, [unit("s", rows)], 2)[0] == P.COOPERATIVE
    assert plan(Not(KEEP), [unit("s", rows)], 2)[0] == P.VECTOR_ANN
    assert plan(KEEP, [unit("s", rows, index="raw")], 2)[0] == P.PREDICATE_FIRST
    assert plan(Not(KEEP), [unit("s", rows, index="raw")], 2)[0] == P.VECTOR_FIRST
    assert plan(KEEP, [unit("s", rows)], 3)[0] == P.TINY


def test_selectivity_rules():
    u = unit("s", [{"n": 1}, {"n": 5}, {"n": "a"}, {}])
    at = lambda p: float(P.unit_selectivity(p, u))
    # the greatest value is a string, so nothing bounds the numbers
    assert at(where("n", "lt", 1)) == pytest.approx(0.3, abs=1e-6) and at(where("n", "gte", 0)) == pytest.approx(0.5 * 0.6, abs=1e-6)
    n = unit("s", [{"n": 1}, {"n": 5}])
    at = lambda p: float(P.unit_selectivity(p, n))
    assert at(where("n", "gte", 1)) == 1 and at(where("n", "gt", 5)) == 0 and at(where("n", "lte", 3)) == pytest.approx(0.6)
    assert at(And((where("n", "eq", 1), where("n", "eq", 5)))) == 0.25 and at(Or((where("n", "eq", 1), where("n", "eq", 5)))) == 0.75 and at(where("m", "exists")) == 0
    assert isinstance(P.selectivity(where("n", "eq", 1), [n]), np.float32)


@pytest.mark.parametrize(("k", "share", "size"), [(1, 0.1, 16), (10, 0.2, 100), (10, 0.45, 80), (10, 0.9, 60), (0, 0.9, 16)])
def test_budget(k, share, size):
    assert P.budget(k, np.float32(share)) == size


def test_summary_keys():
    assert [summary_key(v) for v in (None, True, 7, 7.0, "x", 1e21, 1e-7)] == ["null", "bool:true", "number:7", "number:7.0", "string:x", "number:1e21", "number:1e-7"]
