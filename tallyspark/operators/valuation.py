"""Base-currency valuation: exact dated rates, bounded as-of rates, fixed rates, and the summaries over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.text import MONEY, money

#: Days that an observed rate stays usable (fixed value).
MAX_RATE_AGE = 7
RATE = "decimal(17,8)"


def merge_rates(*observations: DataFrame) -> DataFrame:
    """Union on (currency, date): one rate with all its providers; conflict marks keys with different rates."""
    union = observations[0]
    for more in observations[1:]:
        union = union.unionByName(more)
    return union.groupBy("currency", "date").agg(
        F.min("rate").alias("rate"), F.array_sort(F.collect_set("provider")).alias("providers"), (F.countDistinct("rate") > 1).alias("conflict")
    )


def unpivot_rates(wide: DataFrame, key: str, currencies: list[str], provider: str) -> DataFrame:
    """One row per day and currency from a table with a column per currency; missing cells make no row."""
    long = wide.unpivot(key, currencies, "currency", "rate").filter("rate is not null")
    return long.select(F.upper("currency").alias("currency"), F.col(key).alias("date"), F.col("rate").cast(RATE).alias("rate"), F.lit(provider).alias("provider"))


def asof_rates(requests: DataFrame, rates: DataFrame, max_age: int = MAX_RATE_AGE) -> DataFrame:
    """requests(currency, date, ...) with the latest rate observed on or up to max_age days before the date.

    Every observation is offered to the max_age + 1 days it serves, so the join is by equality and no currency's history
    has to be sorted in one task.
    """
    offered = rates.select("currency", F.col("date").alias("observed"), "rate", F.explode(F.sequence("date", F.date_add("date", max_age))).alias("date"))
    latest = offered.groupBy("currency", "date").agg(F.max("observed").alias("rate_date"), F.max_by("rate", "observed").alias("asof_rate"))
    return requests.join(latest, ["currency", "date"], "left")


def value_cascade(ledger: DataFrame, dated: DataFrame, observed: DataFrame, fixed: DataFrame, base: str) -> DataFrame:
    """amount_base, valuation_source, valuation_status and rate_date: matched exchange, same currency, dated, cached, fixed.

    Without a posted amount an existing amount_base stays (actual in base currency, estimated otherwise). Only same
    currency and matched exchange are actual. A row without any rate is missing and flagged.
    """
    rows = ledger.withColumn("currency", F.col("posted_currency"))
    rows = rows.join(dated.select("currency", "date", F.col("rate").alias("dated_rate")), ["currency", "date"], "left")
    rows = asof_rates(rows, observed).join(fixed.select("currency", F.col("rate").alias("fixed_rate")), "currency", "left")
    matched = F.col("valuation_source") == "matched_exchange"
    absent = F.col("posted_amount").isNull()
    source = (
        F.when(matched, "matched_exchange")
        .when(absent & F.col("amount_base").isNotNull(), F.when(F.col("currency") == base, "statement").otherwise("fixed"))
        .when(absent, "missing")
        .when(F.col("currency") == base, "same_currency")
        .when(F.col("dated_rate").isNotNull(), "dated")
        .when(F.col("asof_rate").isNotNull(), "cached")
        .when(F.col("fixed_rate").isNotNull(), "fixed")
        .otherwise("missing")
    )
    rows = rows.withColumn("valuation_source", source)
    by = F.col("valuation_source")
    posted = F.col("posted_amount").cast(MONEY)
    times = lambda rate: money(posted * F.col(rate).cast(RATE))
    keep = matched | (absent & F.col("amount_base").isNotNull())
    value = F.when(keep, F.col("amount_base")).when(by == "same_currency", posted).when(by == "dated", times("dated_rate")).when(by == "cached", times("asof_rate")).when(by == "fixed", times("fixed_rate"))
    status = F.when(by.isin("matched_exchange", "same_currency", "statement"), "actual").when(by == "missing", "missing").otherwise("estimated")
    return rows.select(
        *[c for c in ledger.columns if c not in ("amount_base", "valuation_source", "valuation_status", "rate_date")],
        value.cast(MONEY).alias("amount_base"), "valuation_source", status.alias("valuation_status"),
        F.when(by == "dated", F.col("date")).when(by == "cached", F.col("rate_date")).alias("rate_date"),
    )


def _sum(amount: Column, when: Column) -> Column:
    return F.coalesce(F.sum(F.when(when, amount)), F.lit(0)).cast("decimal(30,2)")


def cash_flow(ledger: DataFrame, *keys: str) -> DataFrame:
    """Income, spending (expenses alone), refunds and net by keys; net adds the signed amounts. Partial sums before the shuffle."""
    flow, amount = F.col("flow_type"), F.col("amount_base")
    measures = []
    for name, when in (("actual", F.col("valuation_status") == "actual"), ("estimated", F.col("valuation_status") == "estimated"), ("combined", F.lit(True))):
        measures += [
            _sum(amount, when & (flow == "income")).alias(f"income_{name}"),
            _sum(amount, when & (flow == "expense")).alias(f"spending_{name}"),
            _sum(amount, when & (flow == "refund")).alias(f"refunds_{name}"),
            _sum(amount, when & flow.isin("income", "expense", "refund")).alias(f"net_{name}"),
        ]
    return ledger.groupBy(*keys).agg(*measures)


def missing_breakdown(ledger: DataFrame, *keys: str) -> DataFrame:
    """What the rows without a value mean: excluded transfers, unresolved, zero, blocking, other."""
    gone, flow = F.col("amount_base").isNull(), F.col("flow_type")
    counted = flow.isin("income", "expense", "refund")
    zero = counted & (F.col("posted_amount") == 0)
    transfers = flow.isin("internal_transfer", "credit_card_payment", "investment_transfer")
    blocking = gone & counted & ~F.coalesce(zero, F.lit(False))
    return ledger.groupBy(*keys).agg(
        F.count_if(gone).alias("missing"),
        F.count_if(F.col("valuation_status") == "estimated").alias("estimated"),
        F.count_if(blocking).alias("blocking"),
        F.count_if(gone & transfers).alias("excluded"),
        F.count_if(gone & (flow == "unresolved")).alias("unresolved"),
        F.count_if(gone & zero).alias("zero"),
        F.count_if(gone & ~counted & ~transfers & (flow != "unresolved")).alias("other"),
        (F.count_if(blocking) == 0).alias("complete"),
    )


def headline(ledger: DataFrame, *keys: str) -> DataFrame:
    """Tiles: spending with refunds, income, net, unresolved flows each way, rows without a category."""
    flow, amount = F.col("flow_type"), F.col("amount_base")
    open_ = flow == "unresolved"
    return ledger.groupBy(*keys).agg(
        _sum(amount, flow.isin("expense", "refund")).alias("spending"),
        _sum(amount, flow == "income").alias("income"),
        _sum(amount, flow.isin("income", "expense", "refund")).alias("net"),
        _sum(amount, open_ & (amount > 0)).alias("unresolved_inflow"),
        _sum(amount, open_ & (amount < 0)).alias("unresolved_outflow"),
        F.count_if(F.coalesce("category", F.lit("")).isin("", "Unknown")).alias("uncategorized"),
    )


def histogram(ledger: DataFrame, column: str, vocabulary: list[str]) -> DataFrame:
    """Counts over a closed vocabulary, zero where nothing has the value."""
    words = ledger.sparkSession.createDataFrame([(w,) for w in vocabulary], f"{column} string")
    counts = ledger.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return words.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))
