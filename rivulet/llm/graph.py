"""Connected components of a link table, without bringing links or labels to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: A key is hot from so many rows on, or from this share of all rows if that is more; so there are at most 1 / HOT_SHARE hot keys.
HOT_ROWS, HOT_SHARE = 2_000, 1e-5
#: Link tables of so many rows, both directions counted, meet in one task; shuffles of hundreds of nearly empty partitions in every
#: round would only fill the driver with what it keeps of tasks, stages and plans.
ONE_TASK = 100_000


def lookup(rows: DataFrame, key: str | list[str], table: DataFrame) -> DataFrame:
    """rows left join table (one row for each key). What table has for hot keys is broadcast, at most 1 / HOT_SHARE rows, so no task
    gets all rows of a hot key; keys are counted with a sum in each task first."""
    keys = [key] if isinstance(key, str) else key
    counts = cut(rows.groupBy(*keys).agg(F.count("*").alias("rows")).where(F.col("rows") > HOT_ROWS))
    if counts.isEmpty():
        return rows.join(table, keys, "left")
    hot = F.broadcast(counts.where(F.col("rows") > HOT_SHARE * rows.count()).select(*keys, F.lit(True).alias("hot")))
    marked = rows.join(hot, keys, "left")
    own = F.broadcast(table.join(hot, keys).drop("hot"))
    return marked.where("hot").drop("hot").join(own, keys, "left").unionByName(marked.where("hot is null").drop("hot").join(table, keys, "left"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b): component is the smallest node that links reach.

    Each round hooks every node's label to the smallest label among its neighbours and then takes the label of the label, so
    the number of rounds grows with the logarithm of the longest path. Minima are taken per task before each shuffle, and labels of
    hubs and of large components are looked up by a bounded broadcast, so neither is a hot key; a round's result is checkpointed.
    Tables of ONE_TASK rows or fewer stay in one partition and are broadcast, so their rounds shuffle nothing.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = cut(both)
    keep, find, small = cut, lookup, lambda df: df
    if both.count() <= ONE_TASK:
        keep = lambda df: cut(df).coalesce(1)  # noqa: E731  # of one partition already; this tells the planner
        find = lambda rows, key, table: rows.join(F.broadcast(table), key, "left")
        small = F.broadcast
        both = keep(both.coalesce(1))
    label = keep(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("label")))
    while True:
        near = find(both, "b", label.select(F.col("node").alias("b"), "label")).groupBy("a").agg(F.min("label").alias("near"))
        lowered = label.join(small(near.select(F.col("a").alias("node"), "near")), "node").select("node", "label", F.least("label", "near").alias("new"))
        # what a node learns is told to the node that its label names as well
        told = lowered.where("new < label").groupBy(F.col("label").alias("node")).agg(F.min("new").alias("told"))
        hooked = lowered.join(small(told), "node", "left").select("node", F.col("label").alias("old"), F.least("new", F.coalesce("told", "new")).alias("label"))
        hooked = keep(hooked)
        jump = hooked.select(F.col("node").alias("label"), F.col("label").alias("root"))
        new = keep(find(hooked, "label", jump).select("node", "old", F.least("label", F.coalesce("root", "label")).alias("label")))
        label = new.select("node", "label")
        if new.where("label <> old").isEmpty():
            return label.select("node", F.col("label").alias("component"))
