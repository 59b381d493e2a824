"""Connected components of an edge table by label propagation with pointer jumping, all in joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import staged


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in edges(a, b); component is the smallest id reachable.

    Each round takes the smallest label among the neighbours, then follows the label's own label, so distances halve.
    Labels are staged in the shared folder; only the number of changes reaches the driver.
    """
    both = staged(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = staged(
        both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low")).select("id", F.least("id", "low").alias("component")),
        "labels",
    )
    while True:
        near = (
            both.join(labels.select(F.col("id").alias("b"), "component"), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("component").alias("near"))
        )
        hooked = labels.join(near, "id").select("id", "component", F.least("component", "near").alias("next"))
        jump = hooked.select(F.col("id").alias("next"), F.col("next").alias("further"))
        stepped = staged(
            hooked.join(jump, "next", "left").select("id", F.col("component").alias("old"), F.coalesce("further", "next").alias("component")),
            "labels",
        )
        changed = stepped.filter("old <> component").count()
        labels = stepped.select("id", "component")
        if not changed:
            return labels
