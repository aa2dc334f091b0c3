"""Connected components by minimum-label propagation with pointer jumping, in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.llm.common import discard, stash


def components(links: DataFrame) -> DataFrame:
    """(id, label) for every id in links (columns u, v: longs); label is the smallest id it is connected with.

    Each round is written to the shared folder, so lineage stays short and lost
    executors cost one round at most. Loops, repeats and either direction do no
    harm; no links give no rows."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct()
    both = stash(both, "links")
    labels = stash(both.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("m")).select("id", F.least("id", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("v"), "label"), "v").groupBy(F.col("u").alias("id")).agg(F.min("label").alias("m"))
        lower = labels.join(near, "id").select("id", F.least("label", "m").alias("up"), F.col("label").alias("was"))
        jump = labels.select(F.col("id").alias("up"), F.col("label").alias("top"))
        made = stash(lower.join(jump, "up", "left").select("id", F.least("up", F.coalesce("top", "up")).alias("label"), "was"), "labels")
        done = made.where("label <> was").isEmpty()
        discard(labels, *([both] if done else []))
        labels = made.select("id", "label")
        labels._stashed = made._stashed
        if done:
            return labels
