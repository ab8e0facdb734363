"""Missing runs of a study, expected from the table itself: relational division by counts.

The expected runs are all combinations of the conditions and the seeds that occur anywhere, in every study that occurs.
Conditions and seeds are numbered, so a run is one number of its study, and the numbers are the leaves of a tree of
``FAN_OUT`` children a node. A node with all of its children is complete and is not looked into; one with fewer gives the
children that it lacks, and each of those stands for all runs below it. No combination is formed that is not itself a
missing run, and no group holds more than ``FAN_OUT`` numbers, however many runs a study has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copycensus.operators.ranking import positions
from copycensus.session import materialize

FAN_OUT = 1024


def _numbered(runs: DataFrame, column: str, number: str) -> tuple[DataFrame, int]:
    """Distinct values of a column with numbers from 0, in their order, and how many there are."""
    values = materialize(positions(runs.select(column).distinct(), [], [column], number).select(
        column, (F.col(number) - 1).alias(number)))
    return values, values.count()


def _children(node: Column, below: int, fan_out: int) -> Column:
    """Numbers of a node's children where its level has ``below`` of them in all."""
    first = node * fan_out
    return F.sequence(first, F.least(first + fan_out, F.lit(below).cast("long")) - 1)


def run_gaps(runs: DataFrame, study: list[str], condition: str = "condition", seed: str = "seed", fan_out: int = FAN_OUT) -> DataFrame:
    """Rows ``*study, condition, seed`` of the expected runs that are not there.

    Repeated runs count once. A null study is a study of its own; a row without a condition or a seed is no run and
    makes no study. An empty table has no gaps; other columns are ignored.
    """
    named = runs.where(F.col(condition).isNotNull() & F.col(seed).isNotNull()).select(*study, condition, seed)
    cells = materialize(named.distinct())
    conditions, n_conditions = _numbered(cells, condition, "_condition")
    seeds, n_seeds = _numbered(cells, seed, "_seed")
    sizes = [max(1, n_conditions * n_seeds)]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // fan_out))
    level = cells.join(conditions, condition).join(seeds, seed).select(
        *study, (F.col("_condition") * n_seeds + F.col("_seed")).alias("_node"))
    lacking = []
    for below in sizes[:-1]:
        level = level.select(*study, "_node", F.floor(F.col("_node") / fan_out).alias("_parent")).groupBy(*study, "_parent").agg(
            F.collect_list("_node").alias("_there")).select(*study, F.col("_parent").alias("_node"), "_there")
        level = materialize(level)
        every = _children(F.col("_node"), below, fan_out)
        lacking.append(level.where(F.size("_there") < F.size(every)).select(
            *study, F.explode(F.array_except(every, "_there")).alias("_node")))
        level = level.select(*study, "_node")
    # From the top down: a node that is missing lacks all that is below it.
    missing = None
    for below, own in zip(reversed(sizes[:-1]), reversed(lacking), strict=True):
        if missing is not None:
            under = missing.select(*study, F.explode(_children(F.col("_node"), below, fan_out)).alias("_node"))
            own = own.unionByName(under)
        missing = own
    if missing is None:  # one combination in all, so nothing can lack it
        return cells.where(F.lit(False)).select(*study, condition, seed)
    return missing.select(
        *study, F.floor(F.col("_node") / n_seeds).alias("_condition"), (F.col("_node") % n_seeds).alias("_seed")
    ).join(conditions, "_condition").join(seeds, "_seed").select(*study, condition, seed)


def first_states(steps: DataFrame, run: list[str], order: list[str], state: str) -> DataFrame:
    """The state of each run's first step as ``initial_state_sha256``, and its number of steps.

    ``order`` tells the steps of a run apart; where it does not, the least state counts. A null state is a state of its own.
    """
    digest = F.sha2(F.coalesce(F.concat(F.lit("="), F.col(state).cast("string")), F.lit("")), 256)
    first = F.min(F.struct(*order, digest.alias("_state"))).alias("_first")
    return steps.groupBy(*run).agg(first, F.count(F.lit(1)).alias("steps")).select(
        *run, F.col("_first._state").alias("initial_state_sha256"), "steps")


def unpaired_starts(runs: DataFrame, pair: list[str], condition: str = "condition") -> DataFrame:
    """Per pair: its runs, distinct initial states and whether all conditions began in the same state."""
    by_state = runs.groupBy(*pair, "initial_state_sha256").agg(F.count(F.lit(1)).alias("_runs"), F.min(condition).alias("_least"))
    return by_state.groupBy(*pair).agg(
        F.sum("_runs").alias("runs"), F.count(F.lit(1)).alias("initial_states"), F.min("_least").alias("first_condition")
    ).withColumn("paired", (F.col("initial_states") == 1).cast("int"))
