"""Reconciliation of a ledger with write-back: what pairs with what, and what that leaves on the rows.

Stages claim rows one after the other: pairs that were set by hand, currency exchanges, then transfers. A stage takes its
rows out of what the next one sees; rows whose mark is no longer valid stay reserved. What a run leaves on a row the next
run takes back first, review state included, so a second run pairs the same and review that it opened closes again.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.text import add_reason, add_token, add_tokens, drop_tokens, remove_reason
from tallyspark.operators import flows
from tallyspark.operators.annotations import PROMOTED
from tallyspark.operators.policy import with_reason
from tallyspark.operators.review import review_reasons
from tallyspark.sources.staging import staged

# Flags, reasons, review reasons and states of reconciliation.
AMBIGUOUS_FLAG, PRIOR_FLAG = "reconciliation_ambiguous", "reconciliation_ambiguous_prior_review"
MANUAL_INVALID, EXCHANGE_FLAG = "manual_transfer_pair_invalid", "cross_currency_exchange"
AMBIGUOUS_REASON = "Ambiguous transfer candidates"
MANUAL_REASON = "Manual transfer pair no longer matches current facts"
FLOW_REVIEW = "accounting_flow"
RESULT = ("transfer_group_id", "paired_id", "reconciliation_status", "reconciliation_confidence")


@dataclass(frozen=True)
class Reconciled:
    """rows: the rows as they came, with RESULT. claims: id, partner, flow, confidence, how of all that paired.

    Both are plans: write what is used more than once."""

    rows: DataFrame
    claims: DataFrame

    def summary(self) -> DataFrame:
        """One row of counts."""
        status = lambda name: F.count_if(F.col("reconciliation_status") == name)
        return self.rows.agg(
            F.count(F.lit(1)).alias("transactions"), status("paired").alias("paired"), F.count_distinct("transfer_group_id").alias("groups"),
            status("ambiguous").alias("ambiguous"), status("unmatched").alias("unmatched"), F.count_if(F.col("flow_type") == "unresolved").alias("unresolved"),
        )


def _set(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    new = [c for c in values if c not in rows.columns]
    return rows.select(*(values[c].alias(c) if c in values else F.col(c) for c in rows.columns), *(values[c].alias(c) for c in new))


def taken_back(rows: DataFrame) -> DataFrame:
    """rows without what an earlier reconciliation left; review that was open before it stays open."""
    had, prior = F.array_contains("flags", AMBIGUOUS_FLAG), F.array_contains("flags", PRIOR_FLAG)
    flags = drop_tokens(F.col("flags"), AMBIGUOUS_FLAG, PRIOR_FLAG)
    flags = F.when(had & prior & F.col("needs_review"), drop_tokens(flags, PROMOTED)).when(had, flags).otherwise(F.col("flags"))
    reasons = F.when(had, with_reason(F.col("review_reasons"), FLOW_REVIEW, prior)).otherwise(F.col("review_reasons"))
    derived = F.coalesce(F.col("flow_source") == "reconciliation", F.lit(False))
    none = F.lit(None).cast("string")
    return _set(rows, {
        "flags": flags, "review_reasons": reasons, "reason": F.when(had, remove_reason(F.col("reason"), AMBIGUOUS_REASON)).otherwise(F.col("reason")),
        "needs_review": F.when(had, F.size(reasons) > 0).otherwise(F.col("needs_review")),
        "flow_type": F.when(derived, none).otherwise(F.col("flow_type")), "flow_source": F.when(derived, none).otherwise(F.col("flow_source")),
        "transfer_group_id": none, "paired_id": none, "reconciliation_status": F.lit("not_applicable"), "reconciliation_confidence": F.lit(None).cast("decimal(4,2)"),
    })


def with_flow(rows: DataFrame, trusted: Column, refund_text: Column) -> DataFrame:
    """rows with the flow that category, amount and account give, where nobody set one."""
    flow = flows.flow_type(F.col("category"), F.col("amount_base"), F.col("account_type"), trusted, refund_text, F.col("flow_source"), F.col("flow_type"), F.col("posted_amount"))
    explicit = F.coalesce(F.col("flow_source").isin(*flows.EXPLICIT) & F.col("flow_type").isNotNull(), F.lit(False))
    return _set(rows, {"flow_type": flow, "flow_source": F.when(explicit, F.col("flow_source")).otherwise("deterministic")})


def prepared(rows: DataFrame, trusted: Column, refund_text: Column) -> DataFrame:
    """What the stages look at: rows without what an earlier run left, with their flow. Each row for itself."""
    return with_flow(taken_back(rows), trusted, refund_text)


CLAIM = "id, partner, flow, confidence, how"


def _claim(id_: Column, partner: Column, flow: Column, confidence: Column, how: Column) -> list[Column]:
    return [id_.cast("string").alias("id"), partner.cast("string").alias("partner"), flow.alias("flow"), confidence.cast("decimal(4,2)").alias("confidence"), how.alias("how")]


def _both(pairs: DataFrame, a: str, b: str, flow: Column, confidence: Column, how: str) -> DataFrame:
    """One claim for either side of pairs(a, b)."""
    side = lambda x, y: pairs.select(*_claim(F.col(x), F.col(y), flow, confidence, F.lit(how)))
    return side(a, b).union(side(b, a))


def _group_id(a: str, b: str) -> Column:
    ids = F.array_sort(F.array(F.col(a).cast("string"), F.col(b).cast("string")))
    return F.concat(F.lit("xfer_"), F.substring(F.sha2(F.concat_ws("|", ids), 256), 1, 16))


@dataclass(frozen=True)
class Claims:
    """claims: id, partner, flow, confidence, how of all that is claimed, `invalid` without a partner among them, and paid (what
    the base side of an exchange paid). reach(id): everything that had a partner in reach when transfers were looked for."""

    claims: DataFrame
    reach: DataFrame


def claims_of(rows: DataFrame, exchange: DataFrame | None = None, window: int = 3, tolerance: float = 0.10) -> Claims:
    """What prepared rows claim. exchange: what flows.exchange_pairs takes, or None.

    Every marked row is claimed, as one of a pair or as `invalid`, so transfers are looked for among the rows without a mark.
    """
    marks = flows.manual_pairs(rows).select("marker", "ids", F.coalesce("valid", F.lit(False)).alias("valid"))
    other = F.when(F.col("valid"), F.when(F.col("id") == F.element_at("ids", 1), F.element_at("ids", 2)).otherwise(F.element_at("ids", 1)))
    named = lambda yes, no: F.when(F.col("valid"), yes).otherwise(no)
    by_hand = rows.select("id", "marker").join(marks, "marker").select(*_claim(F.col("id"), other, named("internal_transfer", "unresolved"), named(1, 0), named("manual", "invalid")))
    paid = F.lit(None).cast(rows.schema["amount_base"].dataType).alias("paid")
    claims, free = [by_hand.withColumn("paid", paid)], rows.filter("marker is null")
    if exchange is not None:
        key = F.col("id").cast("string")
        unclaimed = exchange.join(by_hand.select(F.col("id").alias("__id")), key == F.col("__id"), "left_anti")
        pairs = staged(flows.exchange_pairs(unclaimed, tolerance), "exchanges")
        both = _both(pairs, "out_id", "in_id", F.lit("internal_transfer"), F.lit(1), "exchange")
        # The foreign side of an exchange is worth what the base side paid.
        worth = rows.select(key.alias("partner"), F.abs("amount_base").alias("paid"))
        claims.append(both.join(worth, "partner", "left").select(*by_hand.columns, F.col("paid").cast(rows.schema["amount_base"].dataType).alias("paid")))
        free = free.join(both.select(F.col("id").alias("__id")), key == F.col("__id"), "left_anti")
    candidates = staged(flows.transfer_candidates(free, window), "candidates")
    found = _both(flows.transfer_pairs(candidates), "out_id", "in_id", F.col("flow"), F.col("confidence"), "transfer")
    claims.append(found.withColumn("paid", paid))
    reach = candidates.select(F.col("out_id").cast("string").alias("id")).distinct().union(candidates.select(F.col("in_id").cast("string").alias("id")).distinct())
    return Claims(reduce(DataFrame.union, claims), reach)


def met(rows: DataFrame, found: Claims, prefix: str = "__") -> DataFrame:
    """rows with their claim and whether a partner was in reach: what settled needs, named with the prefix."""
    key = F.col("id").cast("string")
    named = found.claims.select(*(F.col(c).alias(f"{prefix}{c}") for c in ("id", "partner", "flow", "confidence", "how", "paid")))
    near = found.reach.select(F.col("id").alias(f"{prefix}near"))
    return rows.join(named, key == F.col(f"{prefix}id"), "left").join(near, key == F.col(f"{prefix}near"), "left").drop(f"{prefix}id")


def settled(rows: DataFrame, prefix: str = "__") -> DataFrame:
    """Prepared rows that were met, with what their claims leave on them. Each row for itself."""
    fact = lambda c: F.col(f"{prefix}{c}")
    how = F.coalesce(fact("how"), F.lit(""))
    set_by_pair, invalid, transfer = how.isin("manual", "exchange"), how == "invalid", how == "transfer"
    ambiguous = (how == "") & fact("near").isNotNull()
    explicit = F.coalesce(F.col("flow_source").isin("rule", "correction"), F.lit(False))
    ours = F.when(how == "manual", "correction").otherwise("reconciliation")
    takes = set_by_pair | invalid | (transfer & ~explicit)
    flow = F.when(takes, fact("flow")).when(ambiguous & ~explicit, "unresolved").otherwise(F.col("flow_type"))
    source = F.when(takes, ours).when(ambiguous & ~explicit, "reconciliation").otherwise(F.col("flow_source"))
    status = F.when(set_by_pair | transfer, "paired").when(ambiguous, "ambiguous").when(invalid | flow.isin(*flows.TRANSFERS), "unmatched").otherwise("not_applicable")

    # Review that was open for another reason is remembered, so that taking the ambiguity back does not close it.
    open_before = F.col("needs_review") & (F.size("review_reasons") > 0) & ~F.array_contains("review_reasons", FLOW_REVIEW) & ~F.array_contains("flags", PROMOTED)
    flags = F.when(set_by_pair, drop_tokens(F.col("flags"), "uncategorized", MANUAL_INVALID)).when(ambiguous, drop_tokens(add_token(F.col("flags"), PRIOR_FLAG, open_before), PROMOTED)).otherwise(F.col("flags"))
    flags = add_tokens(flags, {EXCHANGE_FLAG: how == "exchange", MANUAL_INVALID: invalid, AMBIGUOUS_FLAG: ambiguous})
    reasons = F.when(set_by_pair, drop_tokens(F.col("review_reasons"), "category_decision", "category_suggestion", FLOW_REVIEW)).otherwise(with_reason(F.col("review_reasons"), FLOW_REVIEW, F.array_contains("review_reasons", FLOW_REVIEW) | ambiguous | invalid))
    reasons = F.when(transfer, drop_tokens(reasons, FLOW_REVIEW)).otherwise(reasons)
    touched = (how != "") | ambiguous
    why = F.when(how == "manual", remove_reason(F.col("reason"), MANUAL_REASON)).when(invalid, add_reason(F.col("reason"), F.lit(MANUAL_REASON))).when(ambiguous, add_reason(F.col("reason"), F.lit(AMBIGUOUS_REASON))).otherwise(F.col("reason"))
    done = _set(rows, {
        "category": F.when(set_by_pair, "Internal Transfer").otherwise(F.col("category")), "flow_type": flow, "flow_source": source,
        "amount_base": F.when((how == "exchange") & (F.col("posted_amount") > 0), fact("paid")).otherwise(F.col("amount_base")),
        "flags": flags, "review_reasons": reasons, "needs_review": F.when(touched, F.size(reasons) > 0).otherwise(F.col("needs_review")), "reason": why,
        "transfer_group_id": F.when(how == "manual", F.col("marker")).when(fact("partner").isNotNull(), _group_id("id", f"{prefix}partner")), "paired_id": fact("partner"), "reconciliation_status": status,
        "reconciliation_confidence": F.when(touched, F.coalesce(fact("confidence"), F.lit(0).cast("decimal(4,2)"))),
    }).drop(*(f"{prefix}{c}" for c in ("partner", "flow", "confidence", "how", "paid", "near")))
    return review_reasons(done)


def reconcile(rows: DataFrame, trusted: Column, refund_text: Column, exchange: DataFrame | None = None, window: int = 3, tolerance: float = 0.10) -> Reconciled:
    """rows: id (unique), date, account_id, account_type, institution, owner, category, posted_amount, posted_currency,
    amount_base, flow_type, flow_source, marker, reason, needs_review and the arrays flags and review_reasons.

    What is looked for takes narrow columns of the rows along; the rows themselves travel once, to what was found."""
    base = prepared(rows, trusted, refund_text)
    found = claims_of(base, exchange, window, tolerance)
    return Reconciled(settled(met(base, found)), found.claims.filter("how <> 'invalid'").drop("paid"))
