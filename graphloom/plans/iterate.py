"""The fixpoint loop that iterative graph programs share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from graphloom.plans.scratch import Scratch


def iterate(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], scratch: Scratch, times: int, every: int = 4, done: Callable[[DataFrame, DataFrame], bool] | None = None) -> DataFrame:
    """Applies step up to ``times`` times, cutting the lineage every ``every`` steps and at the end.

    With ``done`` the lineage is cut at each step, and the loop ends as soon as
    done(old, new) holds; it must ask for a bounded result only.
    """
    saved = None
    for i in range(times):
        new = step(state, i)
        if done or (i + 1) % every == 0 or i + 1 == times:
            new = scratch.save(new)
            if done and done(state, new):
                scratch.drop(saved)
                return new
            scratch.drop(saved)
            saved = new
        state = new
    return state if saved is state else scratch.save(state)
