"""Flow derivation, transfer pairing, manual pairs and cross-currency exchange matching."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Categories that decide the flow, and kinds of source that outrank derivation.
CATEGORY_FLOWS = {"Income": "income", "Credit Card Payment": "credit_card_payment", "Internal Transfer": "internal_transfer", "Savings": "investment_transfer", "Investments": "investment_transfer"}
EXPLICIT = ("rule", "correction", "structural")
EXTERNAL = ("income", "expense", "refund")
TRANSFERS = ("internal_transfer", "credit_card_payment", "investment_transfer")


def flow_type(category: Column, amount: Column, account_type: Column, trusted: Column, refund_text: Column, source: Column, given: Column, posted: Column | None = None) -> Column:
    """The first rule that applies: explicit, category with trusted origin, unresolved, refund, expense, unresolved.

    Where the amount is missing the posted amount tells the direction.
    """
    amount = amount if posted is None else F.coalesce(amount, posted)
    by_category = F.lit(None).cast("string")
    for name, flow in CATEGORY_FLOWS.items():
        by_category = F.when(category == name, flow).otherwise(by_category)
    vague = F.coalesce(category, F.lit("")).isin("", "Unknown", "Other")
    refund = (amount > 0) & ((account_type == "credit_card") | ((account_type == "bank") & refund_text))
    return (
        F.when(source.isin(*EXPLICIT) & given.isNotNull(), given)
        .when(by_category.isNotNull(), F.when(trusted, by_category).otherwise("unresolved"))
        .when(amount.isNull() | (amount == 0) | vague, "unresolved")
        .when(refund, "refund")
        .when(amount < 0, "expense")
        .otherwise("unresolved")
    )


def transfer_candidates(ledger: DataFrame, window: int = 3) -> DataFrame:
    """(out_id, in_id, days, flow) of opposite amounts at most window days apart in different accounts.

    ledger: id, date, account_id, account_type, amount_base, flow_type, flow_source. Days fall into buckets of 2 * (window + 1)
    days; an inflow is offered to the buckets of the days in its reach (two at most), so the join is by equality on amount
    and bucket and a common amount is spread over time.
    """
    bucket = lambda days: F.floor(days / F.lit(2 * (window + 1))).cast("int")
    day = F.datediff("date", F.lit("1970-01-01"))
    usable = ledger.filter("amount_base <> 0 and account_id is not null and account_type in ('bank', 'credit_card', 'investment') and date is not null")
    # A flow that a rule or a person set has to be the pair's; two flows that the rows alone make external do not pair.
    fixed = F.when(F.coalesce(F.col("flow_source").isin("rule", "correction"), F.lit(False)), F.coalesce("flow_type", F.lit("")))
    external = F.coalesce(F.col("flow_type").isin(*EXTERNAL) & (F.col("flow_source") == "deterministic"), F.lit(False))
    side = lambda df, p: df.select(F.col("id").alias(f"{p}_id"), day.alias(f"{p}_day"), F.col("account_id").alias(f"{p}_account_id"), F.substring("account_type", 1, 1).alias(f"{p}_kind"), fixed.alias(f"{p}_fixed"), external.alias(f"{p}_external"), F.abs("amount_base").alias("amount"))
    out = side(usable.filter("amount_base < 0"), "out").withColumn("bucket", bucket(F.col("out_day")))
    reach = F.array_distinct(F.array(bucket(F.col("in_day") - window), bucket(F.col("in_day") + window)))
    inn = side(usable.filter("amount_base > 0"), "in").withColumn("bucket", F.explode(reach))
    days = F.abs(F.col("out_day") - F.col("in_day"))
    kinds = F.concat("out_kind", "in_kind")
    flow = F.when(kinds == "bc", "credit_card_payment").when(kinds == "bb", "internal_transfer").when(kinds.isin("bi", "ib"), "investment_transfer")
    agrees = lambda p: F.coalesce(F.col(f"{p}_fixed") == F.col("flow"), F.lit(True))
    pairs = out.join(inn, ["amount", "bucket"]).filter((days <= window) & (F.col("out_account_id") != F.col("in_account_id"))).withColumn("flow", flow)
    return pairs.filter(F.col("flow").isNotNull() & agrees("out") & agrees("in") & ~(F.col("out_external") & F.col("in_external"))).select("out_id", "in_id", days.alias("days"), "flow")


def _nearest(candidates: DataFrame, own: str, other: str) -> DataFrame:
    """The partner at the smallest distance of every row, and whether no other shares that distance.

    The first and the last partner at the smallest distance tell that, so one aggregate serves.
    """
    found = candidates.groupBy(own).agg(F.min(F.struct("days", other, "flow")).alias("low"), F.max(F.struct((-F.col("days")).alias("days"), other)).alias("high"))
    return found.select(own, F.col("low.days").alias("days"), (F.col(f"low.{other}") == F.col(f"high.{other}")).alias("unique"), F.col(f"low.{other}").alias(other), F.col("low.flow").alias("flow"))


def transfer_pairs(candidates: DataFrame) -> DataFrame:
    """(out_id, in_id, days, flow, confidence, group_id) of rows that are each other's only nearest candidate."""
    out = _nearest(candidates, "out_id", "in_id").filter("unique")
    inn = _nearest(candidates, "in_id", "out_id").filter("unique")
    ids = F.array_sort(F.array(F.col("out_id").cast("string"), F.col("in_id").cast("string")))
    return out.join(inn.select("in_id", "out_id"), ["out_id", "in_id"]).select(
        "out_id", "in_id", "days", "flow",
        F.when(F.col("days") == 0, F.lit(1.00)).otherwise(F.lit(0.95)).cast("decimal(4,2)").alias("confidence"),
        F.concat(F.lit("xfer_"), F.substring(F.sha2(F.concat_ws("|", ids), 256), 1, 16)).alias("group_id"),
    )


def transfer_status(ledger: DataFrame, candidates: DataFrame, pairs: DataFrame) -> DataFrame:
    """id and reconciliation_status of every row: paired, ambiguous (had a candidate), unmatched (a transfer), not_applicable."""
    both = lambda df: df.select(F.col("out_id").alias("id")).union(df.select(F.col("in_id").alias("id"))).distinct()
    rows = ledger.join(both(pairs).withColumn("paired", F.lit(True)), "id", "left").join(both(candidates).withColumn("had", F.lit(True)), "id", "left")
    status = F.when(F.col("paired"), "paired").when(F.col("had"), "ambiguous").when(F.col("flow_type").isin(*TRANSFERS), "unmatched").otherwise("not_applicable")
    return rows.select("id", status.alias("reconciliation_status"))


def manual_pairs(ledger: DataFrame) -> DataFrame:
    """Markers with the ids of their rows if there are two (else null) and whether they are valid.

    Valid are exactly two rows of one account and currency, opposite and equal, with compatible owners.
    """
    loose = F.coalesce("owner", F.lit("")).isin("", "Unknown", "Household")
    strict = F.when(~loose, F.col("owner"))
    one = lambda c: F.coalesce(F.min(c) == F.max(c), F.lit(False))
    return ledger.filter("marker is not null").groupBy("marker").agg(
        F.when(F.count(F.lit(1)) == 2, F.array(F.min("id"), F.max("id"))).alias("ids"),
        (
            (F.count(F.lit(1)) == 2) & one("account_id") & one("posted_currency")
            & (F.sum("posted_amount") == 0) & (F.max("posted_amount") > 0) & F.min(strict).eqNullSafe(F.max(strict))
        ).alias("valid"),
    )


def exchange_pairs(legs: DataFrame, tolerance: float = 0.10) -> DataFrame:
    """(out_id, in_id) of currency exchanges: legs(id, date, institution, currency, amount, is_base, reference).

    Per day and institution base outflows meet as many foreign inflows of one currency. Where no reference rate is given
    the mean of the institution's events in that currency serves, if there are two or more within the tolerance. The
    perfect matching within the tolerance has to be the only one. One task has the legs of a day and institution.
    """
    cell = legs.groupBy("date", "institution").agg(
        F.count_if(F.col("is_base")).alias("n_out"), F.count_if(~F.col("is_base")).alias("n_in"), F.countDistinct(F.when(~F.col("is_base"), F.col("currency"))).alias("kinds"),
        F.sum(F.when(F.col("is_base"), F.abs("amount"))).alias("out_sum"), F.sum(F.when(~F.col("is_base"), F.abs("amount"))).alias("in_sum"),
        F.max(F.when(~F.col("is_base"), F.col("currency"))).alias("kind"), F.max("reference").alias("given"),
    ).filter("n_out = n_in and n_out > 0 and kinds = 1 and in_sum > 0").withColumn("rate", F.try_divide("out_sum", "in_sum"))
    mean = cell.groupBy("institution", "kind").agg(F.avg("rate").alias("mean"), F.count(F.lit(1)).alias("events"), F.min("rate").alias("low"), F.max("rate").alias("high"))
    usable = mean.filter((F.col("events") >= 2) & (F.col("high") <= F.col("mean") * (1 + tolerance)) & (F.col("low") >= F.col("mean") * (1 - tolerance)))
    known = cell.join(usable.select("institution", "kind", "mean"), ["institution", "kind"], "left").withColumn("rate_ref", F.coalesce("given", "mean")).filter("rate_ref is not null")
    rows = legs.join(known.select("date", "institution", "rate_ref"), ["date", "institution"]).withColumn("leg", F.struct(F.abs("amount").cast("double").alias("amount"), F.col("id").cast("string").alias("id")))
    side = lambda of: F.array_sort(F.collect_list(F.when(of, F.col("leg"))))
    cells = rows.groupBy("date", "institution").agg(side(F.col("is_base")).alias("out"), side(~F.col("is_base")).alias("in"), F.max(F.col("rate_ref").cast("double")).alias("rate"))

    def match(batches):
        for batch in batches:
            pairs = []
            for out, inn, out_ids, in_ids, rate in zip(*(batch[c] for c in ("out", "in", "out_ids", "in_ids", "rate")), strict=True):
                # What an outflow may have bought is a range of the sorted inflows.
                low = np.searchsorted(inn, out / (rate * (1 + tolerance)) * (1 - 1e-12))
                high = np.searchsorted(inn, out / (rate * (1 - tolerance)) * (1 + 1e-12), side="right") if tolerance < 1 else np.full(len(out), len(inn))
                with np.errstate(divide="ignore", invalid="ignore"):
                    edges = [set((a + np.flatnonzero(np.abs(x / inn[a:b] - rate) <= tolerance * rate)).tolist()) for x, a, b in zip(out, low, high, strict=True)]
                found = only_matching(edges, len(inn))
                pairs += [(out_ids[i], in_ids[j]) for i, j in enumerate(found)] if found is not None else []
            yield pd.DataFrame(pairs, columns=["out_id", "in_id"])

    lists = cells.select(F.col("out.amount").alias("out"), F.col("in.amount").alias("in"), F.col("out.id").alias("out_ids"), F.col("in.id").alias("in_ids"), "rate")
    return lists.mapInPandas(match, "out_id string, in_id string")


def only_matching(edges: list[set[int]], n: int) -> list[int] | None:
    """The partner of every row if there is exactly one perfect matching with the n others, else None.

    A bipartite graph with a single perfect matching has a row with one choice left; taking that choice leaves a graph with
    a single perfect matching again. So the choices are forced one after the other, or there is none or more than one.
    """
    back: list[set[int]] = [set() for _ in range(n)]
    for i, js in enumerate(edges):
        for j in js:
            back[j].add(i)
    left, partner = [set(js) for js in edges], [-1] * len(edges)
    forced = [i for i, js in enumerate(left) if len(js) == 1]
    while forced:
        i = forced.pop()
        if partner[i] >= 0 or len(left[i]) != 1:
            continue
        j = next(iter(left[i]))
        partner[i] = j
        for other in back[j]:
            if other != i:
                left[other].discard(j)
                if partner[other] < 0 and len(left[other]) == 1:
                    forced.append(other)
    return partner if n == len(edges) and all(j >= 0 for j in partner) and len(set(partner)) == n else None
