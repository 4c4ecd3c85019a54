"""Rows dealt by a join key once and kept, with the rows of a hub spread over several parts.

An iterative program joins the same edges with a new state each time. Dealing
the edges by key beforehand leaves only the state to be shuffled, but puts all
rows of a key into one task; so keys of more than ``hub`` rows are split, and
their state is repeated for each part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.scratch import Scratch

#: Rows of a key that one task may hold.
HUB = 1_000_000


class Dealt:
    """rows dealt by one key column or several. They are kept first and counted then, so rows are made once, and rows that come dealt so aren't shuffled again."""

    def __init__(self, rows: DataFrame, key: str | list[str], scratch: Scratch, hub: int | None = None):
        hub = hub or HUB
        self.keys = [key] if isinstance(key, str) else key
        self.rows = rows.repartition(*self.keys).persist()
        hubs = self.rows.groupBy(*self.keys).agg(F.count("*").alias("n")).filter(F.col("n") > hub)
        self.hubs = scratch.save(hubs.select(*self.keys, F.ceil(F.col("n") / hub).alias("_parts")))
        self.split = bool(self.hubs.take(1))
        if self.split:
            salt = F.pmod(F.xxhash64(*rows.columns), F.coalesce("_parts", F.lit(1)))
            whole = self.rows
            self.rows = whole.join(self.hubs, self.keys, "left").withColumn("_salt", salt).drop("_parts").repartition(*self.keys, "_salt").persist()
            self.rows.count()
            whole.unpersist()

    def join(self, state: DataFrame) -> DataFrame:
        """Inner join with state, which has the key as columns."""
        if not self.split:
            return self.rows.join(state, self.keys)
        spread = state.join(self.hubs, self.keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)).cast("long") - 1))).drop("_parts")
        return self.rows.join(spread, [*self.keys, "_salt"]).drop("_salt")

    def close(self) -> None:
        self.rows.unpersist()
