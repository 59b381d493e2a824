"""Statement balances, the review queue, corrections and provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STATEMENT_KEY = ["account_id", "source_id", "section", "currency"]


def balances(rows: DataFrame) -> DataFrame:
    """One row per statement: opening, activity, closing, calculated, difference, status.

    rows: STATEMENT_KEY, account_type, posted_amount, opening, closing (null where a row states none). A statement of credit
    card rows only may count activity against a liability: opening less activity.
    """
    s = rows.groupBy(*STATEMENT_KEY).agg(
        F.sum("posted_amount").cast("decimal(30,2)").alias("activity"),
        F.count_if(F.col("posted_amount").isNull()).alias("unknown"),
        F.countDistinct("opening").alias("openings"), F.countDistinct("closing").alias("closings"),
        F.min("opening").alias("opening"), F.min("closing").alias("closing"),
        F.bool_and(F.col("account_type") == "credit_card").alias("liability"),
    )
    plus, minus = F.col("opening") + F.col("activity"), F.col("opening") - F.col("activity")
    use_minus = F.col("liability") & ((minus == F.col("closing")) | ((plus != F.col("closing")) & (F.col("opening") >= 0) & (F.col("closing") >= 0)))
    s = s.withColumn("calculated", F.when(use_minus, minus).otherwise(plus).cast("decimal(31,2)"))
    status = (
        F.when(F.col("currency").isNull() | (F.col("unknown") > 0), "unavailable")
        .when((F.col("openings") > 1) | (F.col("closings") > 1), "conflicting_evidence")
        .when(F.col("opening").isNull() & F.col("closing").isNull(), "missing_both")
        .when(F.col("opening").isNull(), "missing_opening")
        .when(F.col("closing").isNull(), "missing_closing")
        .when(F.col("calculated") == F.col("closing"), "matched")
        .otherwise("mismatched")
    )
    return s.select(*STATEMENT_KEY, "opening", "activity", "closing", "calculated", (F.col("calculated") - F.col("closing")).cast("decimal(32,2)").alias("difference"), status.alias("status"))


def balance_rollup(statements: DataFrame) -> DataFrame:
    """Accounts: any mismatch is a difference, all matched is reconciled, else unavailable."""
    return statements.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("statements"),
        F.count_if(F.col("status") == "matched").alias("matched"),
        F.when(F.bool_or(F.col("status") == "mismatched"), "difference").when(F.bool_and(F.col("status") == "matched"), "reconciled").otherwise("unavailable").alias("status"),
    )


def complete_statements(everything: DataFrame, chosen: DataFrame, key: list[str]) -> DataFrame:
    """All rows of the statements that the chosen rows belong to."""
    return everything.join(chosen.select(*key).distinct(), key, "left_semi")


def review_reasons(rows: DataFrame) -> DataFrame:
    """review_reasons (sorted) and needs_review from the evidence of each row.

    rows: category, flow_type, owner, flags (array), review_reasons (array), needs_review. Reasons stay derived: a known
    category drops the category decision, a known owner the ownership, and so on.
    """
    pending = F.col("needs_review") | (F.size("review_reasons") > 0)
    unknown = F.coalesce("category", F.lit("")).isin("", "Unknown")
    owner_known = ~F.coalesce("owner", F.lit("")).isin("", "Unknown")
    flagged = lambda *names: F.arrays_overlap("flags", F.array(*map(F.lit, names)))
    had = lambda name: F.array_contains("review_reasons", name)
    reasons = F.array_compact(
        F.array(
            F.when(pending & unknown, "category_decision"),
            F.when(had("category_suggestion") & pending & ~unknown, "category_suggestion"),
            F.when(pending & (F.col("flow_type") == "unresolved"), "accounting_flow"),
            F.when(flagged("identity_ambiguous", "duplicate_membership_changed"), "identity_issue"),
            F.when(flagged("invalid_amount", "statement_balance_conflict"), "source_data_issue"),
            F.when(had("ownership") & ~owner_known, "ownership"),
        )
    )
    return rows.withColumn("review_reasons", F.array_sort(reasons)).withColumn("needs_review", F.size("review_reasons") > 0)


def reason_histogram(rows: DataFrame, column: str = "review_reasons") -> DataFrame:
    return rows.select(F.explode(column).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def apply_patches(rows: DataFrame, patches: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Non-null fields of the patch override."""
    p = patches.select(key, *(F.col(f).alias(f"__{f}") for f in fields))
    joined = rows.join(p, key, "left")
    return joined.select(*(F.coalesce(f"__{c}", c).alias(c) if c in fields else F.col(c) for c in rows.columns))


def merge_patches(stored: DataFrame, new: DataFrame, removed: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Field-wise upsert of new over stored, without the removed ids."""
    n = new.select(F.col(key), *(F.col(f).alias(f"__{f}") for f in fields))
    merged = stored.join(n, key, "full_outer").select(key, *(F.coalesce(f"__{f}", f).alias(f) for f in fields))
    return merged.join(removed.select(key), key, "left_anti")


def provenance(canonical: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """Sources behind each canonical row; complete if as many as it claims (source_count)."""
    found = evidence.groupBy(key).agg(F.count(F.lit(1)).alias("found"), F.array_sort(F.collect_list("source_row")).alias("rows"))
    joined = canonical.join(found, key, "left")
    ok = F.coalesce("found", F.lit(0)) == F.col("source_count")
    return joined.select(key, F.coalesce("found", F.lit(0)).alias("found"), F.array_join("rows", ",").alias("rows"), F.when(ok, "complete").otherwise("incomplete").alias("provenance"))


def in_period(rows: DataFrame, start: str | None, end: str | None, column: str = "date") -> DataFrame:
    """Inclusive; rows without a date are out. Literal bounds reach the scan."""
    rows = rows.filter(F.col(column).isNotNull())
    if start:
        rows = rows.filter(F.col(column) >= F.lit(start).cast("date"))
    return rows.filter(F.col(column) <= F.lit(end).cast("date")) if end else rows


def owned_by(rows: DataFrame, owners: list[str]) -> DataFrame:
    return rows.filter(F.col("owner").isin(*owners)) if owners else rows


def ranked_by_size(totals: DataFrame, amount: str, name: str) -> DataFrame:
    """Totals (one row a category, so few) with their place by absolute amount, largest first."""
    return totals.withColumn("place", F.row_number().over(Window.orderBy(F.abs(amount).desc(), name)))
