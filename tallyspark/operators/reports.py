"""What reports and listings show: review queue, status, labels, requested rates, restricted groups, first errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.text import direction
from tallyspark.operators.policy import is_unknown

# What a reviewer is asked for by each review reason, and how valuation sources are called.
REVIEW_LABELS = {
    "category_decision": "Choose a category",
    "category_suggestion": "Approve the suggested category",
    "accounting_flow": "Resolve the accounting flow",
    "identity_issue": "Resolve a transaction identity conflict",
    "source_data_issue": "Fix source data",
    "ownership": "Choose an owner",
    "other": "Make another recorded decision",
}
VALUATION_LABELS = {
    "statement_posted": "Statement-posted",
    "matched_exchange_leg": "Matched exchange leg",
    "configured_dated_rate": "Dated rate estimate",
    "hkma_daily_reference_rate": "HKMA reference estimate",
    "configured_fixed_rate": "Fixed rate estimate",
    "missing": "Missing",
}
DECIDED = ("category", "flow_type", "owner", "payment_method")
#: Sources in a piece of evidence, bytes of evidence for a task on average, and tasks at most. None is a limit of what is listed.
PIECE, TEXT_OF_TASK, MOST_TASKS = 1024, 1 << 17, 10_000


def _labels(names: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for item in names.items() for x in item))


def review_labels(reasons: Column) -> Column:
    """The labels of an array of review reasons, in order; reasons without a label are left out."""
    return F.array_compact(F.transform(F.array_distinct(reasons), lambda r: F.try_element_at(_labels(REVIEW_LABELS), r)))


def review_queue(rows: DataFrame) -> DataFrame:
    """Rows that need review: decided columns move to suggested_ ones and are blank for the reviewer; labels say what to do."""
    decided = [c for c in DECIDED if c in rows.columns]
    kept = [F.lit("").alias(c) if c in decided else F.col(c) for c in rows.columns]
    return rows.filter("needs_review").select(*kept, *(F.col(c).alias(f"suggested_{c}") for c in decided), F.array_join(review_labels(F.col("review_reasons")), "; ").alias("review_reason_labels"))


def valuation_label(status: Column, source: Column, date: Column, provider: Column) -> Column:
    """How a row was valued, with the date and provider of its rate where it has them."""
    filled = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("missing"))
    name = F.coalesce(F.try_element_at(_labels(VALUATION_LABELS), filled(source)), source)
    details = F.concat_ws(" · ", F.nullif(date, F.lit("")), F.nullif(provider, F.lit("")))
    return F.concat_ws(" · ", F.concat(name, F.lit(" ("), filled(status), F.lit(")")), F.nullif(details, F.lit("")))


def requested_rates(rows: DataFrame, base: str) -> DataFrame:
    """Distinct (currency, date) of dated rows in another currency than the base."""
    currency = F.upper(F.trim(F.coalesce("posted_currency", F.lit(""))))
    return rows.select(currency.alias("currency"), "date").filter((F.col("currency") != "") & (F.col("currency") != base) & F.col("date").isNotNull()).distinct()


def source_occurrences(rows: DataFrame) -> DataFrame:
    """total: occurrences behind the rows, a canonical group counted once, by its first row; a count below 1 counts as 1.

    rows: group_id (null or blank: none), position, source_occurrence_count.
    """
    count = F.greatest(F.coalesce("source_occurrence_count", F.lit(1)), F.lit(1))
    grouped = F.coalesce("group_id", F.lit("")) != ""
    # Rows without a group stand alone; their sum needs no shuffle by a key that all of them share.
    alone = rows.filter(~grouped).agg(F.sum(count).alias("n"))
    once = rows.filter(grouped).groupBy("group_id").agg(F.min_by(count, "position").alias("n")).agg(F.sum("n").alias("n"))
    return alone.unionByName(once).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))


def status_summary(rows: DataFrame, start: str, end: str) -> DataFrame:
    """One row: rows in the period, outside and undated, statements and review counts, unresolved inflow and outflow in it."""
    inside = F.coalesce(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")), F.lit(False))
    way = direction(F.col("amount_base"), F.col("posted_amount"))
    open_ = inside & (F.col("flow_type") == "unresolved")
    return rows.agg(
        F.count_if(inside).alias("in_period"), F.count_if(F.col("date").isNotNull() & ~inside).alias("outside"), F.count_if(F.col("date").isNull()).alias("undated"),
        F.countDistinct(F.when(inside, F.coalesce(F.nullif("source_id", F.lit("")), F.col("source_file")))).alias("statements"),
        F.count_if(inside & F.col("needs_review")).alias("pending"), F.count_if(inside & is_unknown(F.col("category"))).alias("uncategorized"),
        F.count_if(open_ & (way == "inflow")).alias("unresolved_in"), F.count_if(open_ & (way == "outflow")).alias("unresolved_out"),
    )


def missing_valuations(rows: DataFrame, evidence: DataFrame) -> DataFrame:
    """Rows without a value, each with the sources that support it (as many as it has, in order): id, evidence.

    A group's text is made once, from pieces of PIECE sources, and its rows come to it. Groups are dealt to so many tasks that
    the texts of one stay well under what a Parquet writer keeps as a dictionary (1 MB): it then holds and writes each once.
    """
    context, source = rows.sparkSession.sparkContext, lambda file, row: F.concat_ws(":", file, row.cast("string"))
    size = evidence.agg(F.sum(F.octet_length(source(F.col("source_file"), F.col("source_row"))) + 1)).first()[0] or 0
    tasks = max(context.defaultParallelism, min(1 + size // TEXT_OF_TASK, MOST_TASKS))
    missing = rows.filter("amount_base is null").select("id", "group_id")
    grouped = missing.filter("group_id is not null")
    order = Window.partitionBy("group_id").orderBy("source_file", "source_row")
    piece = F.floor((F.row_number().over(order) - 1) / PIECE)
    wanted = evidence.join(grouped.select("group_id").distinct(), "group_id", "left_semi").repartition(tasks, "group_id")
    support = wanted.select("group_id", "source_file", "source_row", piece.alias("piece"))
    named = F.transform(F.array_sort(F.collect_list(F.struct("source_file", "source_row"))), lambda e: source(e["source_file"], e["source_row"]))
    pieces = support.groupBy("group_id", "piece").agg(F.concat_ws(",", named).alias("text"))
    texts = pieces.groupBy("group_id").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("piece", "text"))), lambda p: p["text"])).alias("evidence"))
    # Neighbours are of different groups. Where texts outgrow the dictionary after all, the writer finds out at once and not after
    # thousands of rows of one group, each of which it would then hold in full. (The filter lets all rows pass; below a join
    # Spark leaves out a sort unless something that is not deterministic lies between.)
    mixed = grouped.repartition(tasks, "group_id").sortWithinPartitions(F.xxhash64("id")).filter(F.monotonically_increasing_id() >= 0)
    found = mixed.join(texts.hint("shuffle_hash"), "group_id", "left").select("id", F.coalesce("evidence", F.lit("")).alias("evidence"))
    return found.unionByName(missing.filter("group_id is null").select("id", F.lit("").alias("evidence")))


def touching_groups(members: DataFrame, canonical: DataFrame, selected: DataFrame) -> DataFrame:
    """Groups that a selected canonical row belongs to, recounted: group_id, n_source, n_canonical (selected ones)."""
    chosen = canonical.join(selected.select(F.col("id").alias("canonical_id")), "canonical_id", "left_semi").groupBy("group_id").agg(F.count(F.lit(1)).alias("n_canonical"))
    sources = members.join(chosen, "group_id", "left_semi").groupBy("group_id").agg(F.count(F.lit(1)).alias("n_source"))
    return chosen.join(sources, "group_id", "left").select("group_id", F.coalesce("n_source", F.lit(0)).alias("n_source"), "n_canonical")


def supporting_rows(members: DataFrame, canonical: DataFrame, selected: DataFrame) -> DataFrame:
    """The source rows behind selected canonical rows, each once."""
    groups = canonical.join(selected.select(F.col("id").alias("canonical_id")), "canonical_id", "left_semi").select("group_id").distinct()
    return members.join(groups, "group_id", "left_semi")


def duplicate_counts(members: DataFrame, canonical: DataFrame) -> DataFrame:
    """One row: groups with more source rows than canonical rows, and their source rows."""
    # One aggregate over both: a task holds one table of groups instead of two and the sorts of their join. A null is no canonical group.
    sides = members.selectExpr("group_id", "1L AS source", "0L AS slot").union(canonical.filter("group_id IS NOT NULL").selectExpr("group_id", "0L", "1L"))
    counted = sides.groupBy("group_id").agg(F.sum("source").alias("n_source"), F.sum("slot").alias("n_canonical"))
    more = counted.filter("n_source > n_canonical")
    return more.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("n_source"), F.lit(0)).alias("occurrences"))


def first_error(diagnostics: DataFrame) -> DataFrame:
    """The diagnostic of the smallest (code, display), if there is any."""
    return diagnostics.agg(F.min(F.struct("code", "display")).alias("e")).filter("e is not null").select("e.code", "e.display")


def top_details(details: DataFrame, key: list[str], k: int = 5) -> DataFrame:
    """By key the first k distinct details in order, and how many more there are: k rows of a key travel, and a count."""
    distinct = details.select(*key, "detail").distinct()
    place = F.row_number().over(Window.partitionBy(*key).orderBy("detail"))
    shown = distinct.withColumn("place", place).filter(F.col("place") <= k).groupBy(*key).agg(F.array_sort(F.collect_list("detail")).alias("shown"))
    number = distinct.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return shown.join(number, key).select(*key, "shown", F.greatest(F.col("n") - k, F.lit(0)).alias("more"))


def owner_list(rows: DataFrame) -> DataFrame:
    return rows.filter(F.coalesce("owner", F.lit("")) != "").select("owner").distinct()
