"""Spreading small inputs: a table of few partitions is dealt over all cores before it is parsed."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

#: Plan nodes that leave the partitions of their input as they are.
_PLAIN = frozenset("Project Filter LogicalRelation LogicalRDD LocalRelation Range Generate Union MapInArrow MapInPandas SubqueryAlias".split())


def _nodes(plan) -> Iterator:
    """A plan's nodes, the root first."""
    stack = [plan]
    while stack:
        node = stack.pop()
        yield node
        below = node.children()
        stack += [below.apply(k) for k in range(below.size())]


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores, if it is a plain scan of fewer.

    A scan of a large table has more partitions than that and is left alone, so nothing large is shuffled.
    A plan with a shuffle has partitions of its own making, and counting them would run it.
    """
    if df.isStreaming or any(n.nodeName().partition(" ")[0] not in _PLAIN for n in _nodes(df._jdf.queryExecution().optimizedPlan())):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def certainly_empty(df: DataFrame) -> bool:
    """Whether the plan alone shows that there is no row."""
    most = df._jdf.queryExecution().optimizedPlan().maxRows()
    return most.isDefined() and most.get() == 0
