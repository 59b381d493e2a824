"""What a category may be used for, what a model may decide, structural rows, and where categories came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.text import add_reason, add_token, drop_tokens
from tallyspark.operators.classify import structural

# Categories whose use is settled, and the kinds of use.
PROTECTED = ("Income", "Credit Card Payment", "Internal Transfer", "Savings", "Investments")
MANUAL_ONLY = ("Other", "Unknown")
SPENDING = (
    "Rent/Mortgage", "Utilities", "Groceries", "Dining", "Transport", "Octopus", "Cash", "Shopping", "Travel", "Health",
    "Subscriptions", "Entertainment", "Insurance", "Taxes", "Gifts", "Household",
)
KINDS = ("spending", "accounting", "manual_only")
# Texts that name no merchant, and flags of rows whose history is not certain.
GENERIC = ("unknown", "other", "none", "n a", "n/a", "na", "not applicable", "payment", "card payment", "credit card payment", "transfer", "transaction")
AMBIGUOUS = ("identity_migration_ambiguous", "overlap_count_ambiguous", "overlap_history_ambiguous")
STRUCTURAL_REASONS = {"Other": "cashback rebate", "Income": "interest", "Cash": "ATM withdrawal", "Credit Card Payment": "card payment"}


def is_unknown(cell: Column) -> Column:
    return F.coalesce(cell, F.lit("")).isin("", "Unknown")


def policies(categories: DataFrame, overrides: DataFrame) -> DataFrame:
    """category, kind and problem: overrides(category, kind) win over what a category is by itself; a protected category may
    not be relaxed to spending. Categories that nobody knows are for manual review."""
    category, given = F.col("category"), F.col("given")
    own = F.when(category.isin(*PROTECTED), "accounting").when(category.isin(*SPENDING), "spending").otherwise("manual_only")
    problem = F.when(~given.isin(*KINDS), "unknown_kind").when(category.isin(*PROTECTED) & (given == "spending"), "relaxes_protected")
    joined = categories.join(overrides.select("category", F.col("kind").alias("given")), "category", "left")
    return joined.select("category", F.coalesce(given, own).alias("kind"), problem.alias("problem"))


def judged_suggestions(rows: DataFrame, policy: DataFrame, threshold: float | None) -> DataFrame:
    """rows with outcome: what becomes of a model's suggestion. rows: suggested, suggested_confidence, amount, owner, flags.

    Only spending of a known owner, without a suspected duplicate, at or above a calibrated threshold, is accepted.
    """
    amount = F.col("amount")
    open_ = amount.isNull() | (amount >= 0) | is_unknown(F.col("owner")) | F.array_contains("flags", "duplicate_suspected")
    unsure = F.lit(True) if threshold is None else F.col("suggested_confidence") < threshold
    outcome = F.when(F.col("kind").isNull(), "invalid").when(F.col("kind") != "spending", "rejected").when(open_ | unsure, "reviewable").otherwise("accepted")
    return rows.join(policy.select(F.col("category").alias("suggested"), "kind"), "suggested", "left").withColumn("outcome", outcome).drop("kind")


def with_reason(reasons: Column, token: str, when: Column) -> Column:
    """The review reasons with the token where the condition holds and without it elsewhere."""
    return F.when(when, F.array_union(reasons, F.array(F.lit(token)))).otherwise(drop_tokens(reasons, token))


def structural_rows(rows: DataFrame) -> DataFrame:
    """Open rows that are cashback, interest, cash withdrawals or card payments take category, flow and provenance.

    rows: category, flow_type, flow_source, confidence, owner, needs_review, merchant, original_description, amount,
    account_type, reason, and the arrays flags and review_reasons. Rows that a rule matched or that may be duplicates stay.
    """
    text = F.concat_ws(" ", F.nullif("merchant", F.lit("")), F.nullif("original_description", F.lit("")))
    ruled = F.exists("flags", lambda f: f.startswith("matched_rule:") | (f == "duplicate_suspected"))
    found = F.split(F.when((F.col("category") == "Unknown") & F.col("needs_review") & ~ruled, structural(text, F.col("amount"), F.col("account_type"))), ">")
    rows = rows.withColumn("__found", found)
    hit, category = F.col("__found").isNotNull(), F.element_at("__found", 1)
    reasons = with_reason(drop_tokens(F.col("review_reasons"), "category_decision"), "category_suggestion", category == "Other")
    reasons = with_reason(reasons, "ownership", is_unknown(F.col("owner")))
    why = F.lit("")
    for name, label in STRUCTURAL_REASONS.items():
        why = F.when(category == name, label).otherwise(why)
    set_to = {
        "category": category,
        "flow_type": F.element_at("__found", 2),
        "flow_source": F.lit("structural"),
        "confidence": F.lit("1.00"),
        "review_reasons": reasons,
        "needs_review": F.size(reasons) > 0,
        "flags": add_token(F.col("flags"), "structural_classification", F.lit(True)),
        "reason": add_reason(F.col("reason"), F.concat(F.lit("Structural classification: "), why)),
    }
    return rows.select(*(F.when(hit, set_to[c]).otherwise(F.col(c)).alias(c) if c in set_to else F.col(c) for c in rows.columns if c != "__found"))


def provenance_bucket(flags: Column, needs_review: Column, category: Column) -> Column:
    """Where the category of a row came from: the first of correction, memory, model, nothing, rules."""
    return (
        F.when(F.array_contains(flags, "manual_correction"), "exact_correction")
        .when(F.array_contains(flags, "local_memory_categorized"), "memory")
        .when(F.array_contains(flags, "model_categorized"), F.when(needs_review, "reviewable_model").otherwise("accepted_model"))
        .when(is_unknown(category), "unresolved")
        .otherwise("deterministic")
    )


def learnable(rows: DataFrame, identity: list[str]) -> DataFrame:
    """Rows that rules may be learned from: no ambiguous history, and no empty or generic text in any identity column."""
    clear = ~F.arrays_overlap("flags", F.array(*map(F.lit, AMBIGUOUS))) & (F.coalesce("provenance_status", F.lit("")) != "ambiguous_count_mismatch")
    for c in identity:
        text = F.lower(F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " ")))
        clear = clear & (text != "") & ~text.isin(*GENERIC)
    return rows.filter(clear)
