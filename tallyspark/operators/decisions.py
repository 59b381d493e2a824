"""Review decisions in batches: filters, normal forms, plans, aliases of source rows and projected corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.text import direction, drop_tokens
from tallyspark.operators.review import in_period

# What each decision sets.
DECISIONS = {
    "income": ("Income", "income"),
    "refund": (None, "refund"),
    "internal-transfer": ("Internal Transfer", "internal_transfer"),
    "credit-card-payment": ("Credit Card Payment", "credit_card_payment"),
    "investment-transfer": ("Investments", "investment_transfer"),
    "expense": (None, "expense"),
    "unresolved": (None, "unresolved"),
}
BATCH_REASON = "Batch accounting decision"
FLOW_REASON = "accounting_flow"


def review_filter(rows: DataFrame, categories: list[str] = (), flows: list[str] = (), way: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows that meet every filter that is given: period, category, flow and direction."""
    if start or end:
        rows = in_period(rows, start, end)
    if categories:
        rows = rows.filter(F.col("category").isin(*categories))
    if flows:
        rows = rows.filter(F.col("flow_type").isin(*flows))
    return rows.filter(direction(F.col("amount_base"), F.col("posted_amount")) == way) if way else rows


def normal_decision(text: Column) -> Column:
    """The decision that a text names, or null."""
    bare = F.replace(F.lower(F.trim(text)), F.lit("_"), F.lit("-"))
    bare = F.when(bare == "leave-unresolved", "unresolved").otherwise(bare)
    return F.when(bare.isin(*DECISIONS), bare)


def _sets(decision: Column, which: int) -> Column:
    out = F.lit(None).cast("string")
    for name, fields in DECISIONS.items():
        if fields[which] is not None:
            out = F.when(decision == name, fields[which]).otherwise(out)
    return out


def decision_holds(decision: Column) -> Column:
    """Whether a row has everything that the decision would set."""
    category = _sets(decision, 0)
    return (F.col("flow_type") == _sets(decision, 1)) & (category.isNull() | (F.col("category") == category))


def plan_decisions(entries: DataFrame, ledger: DataFrame, aliases: DataFrame) -> DataFrame:
    """What each entry(index, transaction_id, decision) of a batch comes to: index, id, decision, outcome.

    Ids may be aliases(alias, id) of ledger rows. The first entry of an id counts, later ones are duplicates. outcome is
    applied, unchanged, or the first error that holds; a batch with any error is to be refused as a whole.
    ledger: id, category, flow_type, reason, amount_base, posted_amount and the array review_reasons.
    """
    given = entries.withColumn("given", F.trim("transaction_id")).drop("transaction_id")
    known = given.join(aliases.select(F.col("alias").alias("given"), F.col("id").alias("target")), "given", "left").withColumn("id", F.coalesce("target", F.nullif("given", F.lit(""))))
    first = known.filter("id is not null").groupBy("id").agg(F.min("index").alias("first"))
    rows = known.join(first, "id", "left").join(ledger.withColumn("__there", F.lit(True)), "id", "left").withColumn("normal", normal_decision(F.col("decision")))
    normal = F.col("normal")
    pending = F.array_contains("review_reasons", FLOW_REASON)
    outcome = (
        F.when(F.col("id").isNull(), "invalid_transaction_id")
        .when(F.col("index") != F.col("first"), "duplicate_transaction_id")
        .when(F.col("__there").isNull(), "stale_transaction_id")
        .when(normal.isNull(), "unsupported_decision")
        .when(~pending, F.when(decision_holds(normal), "unchanged").otherwise("stale_review_state"))
        .when((F.coalesce("reason", F.lit("")) == BATCH_REASON) & decision_holds(normal), "unchanged")
        .when((normal == "income") & F.coalesce(direction(F.col("amount_base"), F.col("posted_amount")) != "inflow", F.lit(True)), "decision_not_applicable")
        .otherwise("applied")
    )
    return rows.select("index", "id", normal.alias("decision"), outcome.alias("outcome"))


def decision_patches(plan: DataFrame, ledger: DataFrame) -> DataFrame:
    """The patches of the entries that apply: id, category and flow_type (null: as it is), confidence, reason, review_reasons."""
    rows = plan.filter("outcome = 'applied'").join(ledger.select("id", "review_reasons"), "id")
    category, flow = _sets(F.col("decision"), 0), _sets(F.col("decision"), 1)
    left = drop_tokens(F.col("review_reasons"), FLOW_REASON)
    left = F.when(category.isNotNull(), drop_tokens(left, "category_decision", "category_suggestion")).otherwise(left)
    left = F.when(F.col("decision") == "unresolved", F.array_union(left, F.array(F.lit(FLOW_REASON)))).otherwise(left)
    return rows.select(
        "id", category.alias("category"), flow.alias("flow_type"), F.lit("1.00").alias("confidence"), F.lit(BATCH_REASON).alias("reason"), left.alias("review_reasons"), (F.size(left) > 0).alias("needs_review")
    )


def proven_aliases(members: DataFrame, slots: DataFrame) -> DataFrame:
    """(alias, id): source rows of groups with exactly one active row. members: group_id, id; slots: group_id, canonical_id, active."""
    single = slots.filter("active").groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.min("canonical_id").alias("target")).filter("n = 1")
    targets = members.join(single, "group_id").groupBy(F.col("id").alias("alias")).agg(F.min("target").alias("id"), F.max("target").alias("__high"))
    return targets.filter("id = __high").select("alias", "id")


def project_corrections(members: DataFrame, canonical: DataFrame, corrections: DataFrame, fields: list[str]) -> DataFrame:
    """Corrections of source rows carried to canonical rows: id, fields, how (own, projected, ambiguous).

    members: group_id, id (source rows); canonical: group_id, canonical_id; corrections: id, fields. A correction of the
    canonical row itself holds. Else the corrections of its group's source rows have to be one: for a group of one
    canonical row any of them will do, for a larger group every source row must have it.
    """
    patch = F.struct(*fields)
    by_group = (
        members.join(corrections.select("id", patch.alias("patch"), F.lit(True).alias("has")), "id", "left")
        .groupBy("group_id")
        .agg(F.count(F.lit(1)).alias("n"), F.count("has").alias("patched"), F.min("patch").alias("low"), F.max("patch").alias("high"))
        .filter("patched > 0")
    )
    sizes = canonical.groupBy("group_id").agg(F.count(F.lit(1)).alias("slots"))
    own = corrections.select(F.col("id").alias("canonical_id"), patch.alias("own"), F.lit(True).alias("has_own"))
    rows = canonical.join(own, "canonical_id", "left").join(by_group, "group_id", "left").join(sizes, "group_id")
    agreed = F.col("low").eqNullSafe(F.col("high")) & ((F.col("slots") == 1) | (F.col("patched") == F.col("n")))
    how = F.when(F.col("has_own"), "own").when(F.col("n").isNull(), F.lit(None)).when(agreed, "projected").otherwise("ambiguous")
    chosen = F.when(F.col("has_own"), F.col("own")).when(agreed, F.col("low"))
    return rows.withColumn("how", how).filter("how is not null").select(F.col("canonical_id").alias("id"), *(chosen[f].alias(f) for f in fields), "how")


def migrated_reviews(rows: DataFrame, prior: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """rows of a replacement with the open review state of prior rows of the same key, where the key is single on both sides."""
    single = lambda df: df.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).filter("__n = 1").drop("__n")
    state = prior.join(single(prior), key, "left_semi").filter(F.size("review_reasons") > 0).select(*key, *(F.col(f).alias(f"__{f}") for f in fields), F.lit(True).alias("__open"))
    joined = rows.join(single(rows).withColumn("__single", F.lit(True)), key, "left").join(state, key, "left")
    carry = F.col("__single") & F.col("__open")
    return joined.select(*(F.when(carry, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in rows.columns), F.coalesce(carry, F.lit(False)).alias("migrated"))
