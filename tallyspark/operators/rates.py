"""New rate observations applied to a valued ledger: only rows whose rate moves are valued again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.valuation import MAX_RATE_AGE, asof_rates, value_cascade

KEY = ("currency", "date")


@dataclass(frozen=True)
class Application:
    """rows: the ledger after it; touched: the ids that were valued again; cache: all observations after it."""

    rows: DataFrame
    touched: DataFrame
    cache: DataFrame


def changed_days(before: DataFrame, after: DataFrame, max_age: int = MAX_RATE_AGE) -> DataFrame:
    """(currency, date) whose latest usable rate differs between two sets of observations(currency, date, rate).

    Only the days that an added, altered or removed observation serves are looked at.
    """
    side = lambda df, name: df.select(*KEY, F.col("rate").alias(name))
    moved = side(before, "old").join(side(after, "new"), list(KEY), "full_outer").filter(~F.col("old").eqNullSafe(F.col("new")))
    days = moved.select("currency", F.explode(F.sequence("date", F.date_add("date", max_age))).alias("date")).distinct()
    found = asof_rates(asof_rates(days, before, max_age).withColumnsRenamed({"rate_date": "old_date", "asof_rate": "old_rate"}), after, max_age)
    same = F.col("old_rate").eqNullSafe(F.col("asof_rate")) & F.col("old_date").eqNullSafe(F.col("rate_date"))
    return found.filter(~same).select(*KEY)


def apply_observations(ledger: DataFrame, dated: DataFrame, cache: DataFrame, new: DataFrame, fixed: DataFrame, base: str) -> Application:
    """ledger: what value_cascade gave with cache(currency, date, rate). New observations replace those of their day."""
    after = cache.join(new.select(*KEY), list(KEY), "left_anti").select(*KEY, "rate").unionByName(new.select(*KEY, "rate"))
    days = changed_days(cache, after)
    # A rate of the day itself and the base currency come before the cache: such rows do not move.
    open_ = days.join(dated.select(*KEY), list(KEY), "left_anti").filter(F.col("currency") != base)
    hit = open_.select(F.col("currency").alias("posted_currency"), "date", F.lit(True).alias("__moves"))
    rows = ledger.join(hit, ["posted_currency", "date"], "left").withColumn("__moves", F.coalesce("__moves", F.lit(False)) & F.col("posted_amount").isNotNull() & (F.coalesce("valuation_source", F.lit("")) != "matched_exchange"))
    moves = rows.filter("__moves").drop("__moves")
    fresh = value_cascade(moves.drop("rate_date", "valuation_status").withColumn("amount_base", F.lit(None).cast(ledger.schema["amount_base"].dataType)), dated, after, fixed, base)
    kept = rows.filter("not __moves").drop("__moves")
    return Application(kept.select(*ledger.columns).unionByName(fresh.select(*ledger.columns)), moves.select("id"), after)
