"""Connected components of an edge table, by minimum labels with pointer jumping; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lekhya.session import materialise


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(id, component) for every id of edges(a, b); component is the least id reachable. Null ends and loops are ignored.

    Each round every vertex takes the least label among its neighbours' and its own, then its label's label. The
    messages are pre-aggregated before the shuffle (min), so a vertex of any degree costs one row per map task.
    Written to the shared folder after each round.
    """
    both = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    both = materialise(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialise(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("n"))
        step = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "n").alias("m"))
        jump = labels.select(F.col("id").alias("m"), F.col("component").alias("mm"))
        new = materialise(step.join(jump, "m", "left").select("id", "old", F.least("m", F.coalesce("mm", "m")).alias("component")), "labels")
        done = new.filter("component <> old").limit(1).count() == 0
        labels = new.select("id", "component")
        if done:
            return labels
    raise RuntimeError("components did not settle; raise max_rounds")
