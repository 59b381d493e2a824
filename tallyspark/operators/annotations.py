"""Flags, reasons and review state that duplicate groups and overlaps leave on rows, and their removal.

Rows have an id, the arrays flags and review_reasons, the text reason, and the boolean needs_review.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.text import add_reason, add_token, drop_tokens, remove_reason
from tallyspark.operators.policy import with_reason

# Flags and reason texts.
IDENTITY_FLAGS = ("duplicate_suspected", "identity_migration_ambiguous", "overlap_count_ambiguous", "overlap_history_ambiguous")
DUPLICATE, PROMOTED = "duplicate_suspected", "duplicate_review_promoted"
COUNT_AMBIGUOUS, PRIOR_REVIEW, HISTORY = "overlap_count_ambiguous", "overlap_prior_review", "overlap_history_ambiguous"
DUPLICATE_REASON = "Duplicate candidate ["
LEGACY_REASON = "Possible duplicate transaction"
COUNT_REASON = "Sources report different numbers of this record"
IDENTITY = "identity_issue"


def _reviewed(rows: DataFrame, reasons: Column, flags: Column, reason: Column, touched: Column | None = None) -> DataFrame:
    """The rows with new state; needs_review follows the reasons (of touched rows)."""
    open_ = F.size(reasons) > 0
    state = {"review_reasons": reasons, "flags": flags, "reason": reason, "needs_review": open_ if touched is None else F.when(touched, open_).otherwise(F.col("needs_review"))}
    return rows.select(*(state[c].alias(c) if c in state else F.col(c) for c in rows.columns))


def _without_duplicate_reasons(reason: Column) -> Column:
    return F.array_join(F.filter(F.split(reason, "; "), lambda x: (x != "") & (x != LEGACY_REASON) & ~x.startswith(DUPLICATE_REASON)), "; ")


def clear_duplicates(rows: DataFrame) -> DataFrame:
    """Rows without anything that an earlier look for duplicates left; other identity flags keep their review reason."""
    flags = drop_tokens(F.col("flags"), DUPLICATE, PROMOTED)
    reason = _without_duplicate_reasons(F.coalesce("reason", F.lit("")))
    reasons = with_reason(F.col("review_reasons"), IDENTITY, F.arrays_overlap(flags, F.array(*map(F.lit, IDENTITY_FLAGS))))
    return _reviewed(rows, reasons, flags, reason)


def annotate_duplicates(rows: DataFrame, members: DataFrame, final: DataFrame) -> DataFrame:
    """Rows whose duplicate state is that of members(id, group_id, n): cleared, then set anew.

    Members come to review, except those in final(id), whose review is closed; what is promoted by this is marked.
    """
    found = members.select("id", F.col("group_id").alias("__group"), F.col("n").alias("__n"))
    cleared = clear_duplicates(rows).join(found, "id", "left").join(final.select("id", F.lit(True).alias("__final")), "id", "left")
    member, open_ = F.col("__group").isNotNull(), F.col("__final").isNull()
    flags = add_token(F.col("flags"), PROMOTED, member & open_ & ~F.col("needs_review"))
    flags = add_token(flags, DUPLICATE, member)
    reasons = F.when(member & open_, F.array_union("review_reasons", F.array(F.lit(IDENTITY)))).otherwise(F.col("review_reasons"))
    why = F.concat(F.lit(DUPLICATE_REASON), F.col("__group"), F.lit("] of "), F.col("__n").cast("string"))
    reason = F.when(member, add_reason(F.col("reason"), why)).otherwise(F.col("reason"))
    return _reviewed(cleared, reasons, flags, reason).drop("__group", "__n", "__final").select(*rows.columns)


def enforce_overlap_review(rows: DataFrame, resolved: DataFrame) -> DataFrame:
    """Rows whose record is counted differently by its sources come to review, unless their group is in resolved(group_id).

    rows also have group_id and provenance_status. Review that was open before is remembered and restored later. Rows
    without a group lose what a look for duplicates left in flags and reason. Rows that no rule touches keep needs_review.
    """
    joined = rows.join(resolved.select("group_id", F.lit(True).alias("__resolved")), "group_id", "left")
    ambiguous = (F.coalesce("provenance_status", F.lit("")) == "ambiguous_count_mismatch") & F.col("__resolved").isNull()
    had, prior = F.array_contains("flags", COUNT_AMBIGUOUS), F.array_contains("flags", PRIOR_REVIEW)
    history, corrected = F.array_contains("flags", HISTORY), F.array_contains("flags", "manual_correction")
    alone = F.coalesce("group_id", F.lit("")) == ""
    flags = drop_tokens(F.col("flags"), COUNT_AMBIGUOUS, PRIOR_REVIEW)
    flags = F.when(alone, drop_tokens(flags, DUPLICATE, PROMOTED)).otherwise(flags)
    flags = add_token(flags, PRIOR_REVIEW, ambiguous & ((~had & F.col("needs_review")) | prior))
    flags = add_token(flags, COUNT_AMBIGUOUS, ambiguous)
    bare = remove_reason(F.col("reason"), COUNT_REASON)
    bare = F.when(alone, _without_duplicate_reasons(bare)).otherwise(bare)
    reason = F.when(ambiguous, add_reason(bare, F.lit(COUNT_REASON))).otherwise(bare)
    wanted = ambiguous | history
    kept = F.when(had & ~corrected, with_reason(F.col("review_reasons"), IDENTITY, prior)).otherwise(F.col("review_reasons"))
    reasons = F.when(wanted, F.array_union("review_reasons", F.array(F.lit(IDENTITY)))).otherwise(kept)
    touched = wanted | (had & ~corrected)
    return _reviewed(joined, reasons, flags, reason, touched).drop("__resolved").select(*rows.columns)


def is_source_data_token(token: Column) -> Column:
    """Flags that say something is wrong with the source itself, page marks included."""
    named = token.isin("invalid_amount", "source_provenance_ambiguous", "source_provenance_inconsistent", "statement_opening_balance_conflict", "statement_closing_balance_conflict")
    return named | token.rlike(r"^statement_(opening|closing)_balance_conflict_page_\d+\z")


def repair_source_flags(rows: DataFrame, evidence: DataFrame) -> DataFrame:
    """Rows whose source data flags are exactly those of their evidence(id, flags), with the review reason to match."""
    flags = evidence.select("id", F.explode("flags").alias("flag")).filter(is_source_data_token(F.col("flag"))).groupBy("id").agg(F.array_sort(F.collect_set("flag")).alias("__flags"))
    joined = rows.join(flags, "id", "left")
    now = F.coalesce("__flags", F.array().cast("array<string>"))
    kept = F.filter("flags", lambda f: ~is_source_data_token(f))
    reasons = with_reason(F.col("review_reasons"), "source_data_issue", F.size(now) > 0)
    return _reviewed(joined, reasons, F.concat(kept, now), F.col("reason")).drop("__flags").select(*rows.columns)
