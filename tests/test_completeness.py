"""Runs that a table lacks, and the states that runs begin with."""

from __future__ import annotations

from itertools import product
from random import Random

import pytest

from copycensus.operators import completeness

SCHEMA = "study string, condition string, seed long, note string"


def gaps(spark, rows, fan_out):
    out = completeness.run_gaps(spark.createDataFrame(rows, SCHEMA), ["study"], fan_out=fan_out)
    assert out.columns == ["study", "condition", "seed"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def expected(rows):
    runs = {r[:3] for r in rows if r[1] is not None and r[2] is not None}
    full = product(*({r[i] for r in runs} for i in range(3)))
    return sorted(set(full) - runs, key=repr)


@pytest.mark.parametrize("fan_out", [2, 3, 1024])
def test_gaps_are_the_combinations_that_are_not_there(spark, fan_out):
    draw = Random(fan_out)
    rows = [(s, c, e, "x") for s, c, e in product(["a", "b", None], ["full", "clean", "odd"], range(7)) if draw.random() < 0.6]
    # A complete study, one with a single run, a run twice, and rows that name no run.
    rows += [("whole", c, e, "x") for c, e in product(["full", "clean", "odd"], range(7))]
    rows += [("one", "odd", 6, "x"), ("one", "odd", 6, "y"), ("none", None, 3, "x"), ("none", "full", None, "x")]
    found = gaps(spark, rows, fan_out)
    assert found == expected(rows)
    assert not any(r[0] in ("whole", "none") for r in found) and sum(r[0] == "one" for r in found) == 20


def test_a_run_that_is_taken_away_is_found(spark):
    rows = [(s, c, e, None) for s, c, e in product("ab", ["full", "clean"], range(5))]
    assert gaps(spark, rows, 4) == []
    rows.remove(("b", "clean", 3, None))
    assert gaps(spark, rows, 4) == [("b", "clean", 3)]
    # A condition that no study has is no longer expected.
    assert gaps(spark, [r for r in rows if r[1] == "full"], 4) == []


def test_empty_and_single_tables_have_no_gaps(spark):
    assert gaps(spark, [], 4) == [] and gaps(spark, [("a", "full", 1, "x")] * 3, 4) == []


def test_starts_are_compared_by_the_first_step(spark):
    steps = spark.createDataFrame([
        ("a", 1, "full", 0, "s"), ("a", 1, "full", 1, "later"), ("a", 1, "clean", 5, "s"),
        ("a", 2, "full", 0, "s"), ("a", 2, "clean", 0, "t"), ("b", 1, "odd", 0, None), ("b", 1, "odd", 0, None),
        ("b", 1, "clean", 0, ""), (None, 1, "full", 3, "u"),
    ], "study string, seed long, condition string, step int, state string")
    runs = completeness.first_states(steps, ["study", "seed", "condition"], ["step"], "state")
    found = {tuple(r)[:2]: tuple(r)[2:] for r in completeness.unpaired_starts(runs, ["study", "seed"]).collect()}
    assert found == {("a", 1): (2, 1, "clean", 1), ("a", 2): (2, 2, "clean", 0), ("b", 1): (2, 2, "clean", 0), (None, 1): (1, 1, "full", 1)}
    assert completeness.unpaired_starts(completeness.first_states(steps.limit(0), ["study", "seed", "condition"], ["step"], "state"), ["study"]).count() == 0
