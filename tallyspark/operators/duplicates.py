"""Decisions on groups of possible duplicates, each bound to a digest of the members that the user saw."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.text import snippet

AMBIGUOUS = "ambiguous_count_mismatch"
CHOICES = ("same-event", "keep-all")


def review_groups(members: DataFrame) -> DataFrame:
    """group_id, n and review_group_id of members (group_id, id): an id that changes with the membership.

    The digest is of the group, its size and sums of member digests, so it needs no order and partial sums travel, not members.
    """
    digest = F.sha2(F.col("id").cast("string"), 256)
    part = lambda at: F.sum(F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(20,0)"))
    sums = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), *(part(1 + 15 * i).alias(f"d{i}") for i in range(4)))
    named = F.sha2(F.concat_ws(":", F.col("group_id").cast("string"), "n", *(F.col(f"d{i}").cast("string") for i in range(4))), 256)
    return sums.select("group_id", "n", F.concat(F.lit("dup_"), named).alias("review_group_id"))


def judged_decisions(decisions: DataFrame, groups: DataFrame, issued: DataFrame) -> DataFrame:
    """decisions (review_group_id, choice) with their group and what becomes of them.

    groups: group_id, review_group_id, provenance_status, decision (null: open), as they are now; issued: review_group_id,
    all ids that were ever shown. invalid: no such choice; stale: the members have changed since, or the counts agree now;
    unknown: never shown; conflict: decided otherwise before; already: decided so before; else applied.
    """
    open_ = groups.filter(F.col("provenance_status") == AMBIGUOUS).select("review_group_id", "group_id", F.col("decision").alias("before"))
    shown = issued.select("review_group_id").union(groups.select("review_group_id")).distinct().withColumn("shown", F.lit(True))
    found = decisions.join(open_, "review_group_id", "left").join(shown, "review_group_id", "left")
    outcome = (
        F.when(~F.coalesce(F.col("choice").isin(*CHOICES), F.lit(False)), "invalid")
        .when(F.col("group_id").isNull(), F.when(F.col("shown"), "stale").otherwise("unknown"))
        .when(F.col("before").isNull(), "applied")
        .when(F.col("before") == F.col("choice"), "already")
        .otherwise("conflict")
    )
    return found.withColumn("outcome", outcome).drop("before", "shown")


def decided_groups(groups: DataFrame, judged: DataFrame) -> DataFrame:
    """groups with the decisions that apply; two different ones for one group leave it open."""
    choice = judged.filter("outcome = 'applied'").groupBy("group_id").agg(F.min("choice").alias("lo"), F.max("choice").alias("hi"))
    new = choice.select("group_id", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("chosen"))
    return groups.join(new, "group_id", "left").withColumn("decision", F.coalesce("decision", "chosen")).drop("chosen")


def open_occurrences(groups: DataFrame, occurrences: DataFrame, evidence: list[str]) -> DataFrame:
    """One row for each occurrence of the ambiguous groups without a decision: the group's id, the occurrence's, bounded evidence."""
    open_ = groups.filter((F.col("provenance_status") == AMBIGUOUS) & F.col("decision").isNull()).select("group_id", "review_group_id")
    shown = [snippet(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in evidence]
    return occurrences.join(open_, "group_id").select("review_group_id", "group_id", F.col("id").alias("occurrence_id"), *shown)
