"""Records that several sources report: duplicate candidates, multiset consolidation, identity across imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.text import canonical_decimal, framed_hmac, framed_sha256
from tallyspark.sources.staging import staged


def record_fingerprint(*parts: Column) -> Column:
    """The id of what a record says, whoever reports it: decimals canonical, text trimmed and lower-case."""
    return framed_sha256("fp_", "record", *parts)


def ledger_fingerprint() -> Column:
    text = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " ")))
    return record_fingerprint(
        F.col("date").cast("string"), text("account_id"), text("institution"), canonical_decimal(F.col("posted_amount")), F.upper("posted_currency"), text("merchant"), text("original_description")
    )


def duplicate_candidates(rows: DataFrame, fingerprint: list[str], source: str, member: str) -> DataFrame:
    """Fingerprints that two or more sources report, with their members in order. Sources are counted before members meet."""
    reported = rows.groupBy(*fingerprint, source).agg(F.count(F.lit(1)).alias("n")).groupBy(*fingerprint).agg(F.count(source).alias("sources"))
    several = reported.filter("sources >= 2")
    members = rows.join(several, fingerprint).groupBy(*fingerprint).agg(F.first("sources").alias("sources"), F.array_sort(F.collect_list(member)).alias("members"))
    return members.select(*fingerprint, "sources", "members")


def overlap_counts(rows: DataFrame, fingerprint: list[str], source: str) -> DataFrame:
    """Per fingerprint: sorted per-source counts, how many slots each decision keeps, and the status.

    Two levels: counts per (fingerprint, source) are combined before the shuffle, so a record that one source repeats
    often costs one row; then a fingerprint has one row per source.
    """
    per = rows.groupBy(*fingerprint, source).agg(F.count(F.lit(1)).alias("n"))
    counts = per.groupBy(*fingerprint).agg(F.array_sort(F.collect_list("n")).alias("source_counts"))
    c = F.col("source_counts")
    single = F.size(c) == 1
    return counts.select(
        *fingerprint,
        c,
        F.element_at(c, -1).alias("keep_all"),
        F.when(single, F.element_at(c, -1)).otherwise(F.try_element_at(c, F.lit(-2))).alias("same_event"),
        F.when(single, "single_source").when(F.element_at(c, -1) == 1, "exact_one_to_one").when(F.element_at(c, 1) == F.element_at(c, -1), "pooled_equal_count").otherwise("ambiguous_count_mismatch").alias("status"),
    )


def overlap_slots(counts: DataFrame, decisions: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """Slots 1..n per fingerprint with their support (sources that report at least so many) and whether they are active."""
    chosen = F.lit("keep_all")
    if decisions is not None:
        counts = counts.join(decisions, keys, "left")
        chosen = F.coalesce(F.col("decision"), chosen)
    active = F.when(chosen == "same_event", F.col("same_event")).otherwise(F.col("keep_all"))
    rows = counts.withColumn("active_slots", active).withColumn("slot", F.explode(F.sequence(F.lit(1), F.col("keep_all").cast("int"))))
    return rows.withColumn("support", F.size(F.filter("source_counts", lambda n: n >= F.col("slot")))).withColumn("active", F.col("slot") <= F.col("active_slots"))


def slot_id(key: bytes) -> Column:
    """The lasting id of a slot: growth of a group never renumbers the slots before."""
    return framed_hmac(key, "txn_", "slot", F.col("group_id"), F.col("slot").cast("string"))


def agreed(column: str, fallback: Column | None = None) -> Column:
    """The one value of a group, or the fallback where members disagree."""
    return F.when(F.countDistinct(column) + F.max(F.col(column).isNull().cast("int")) == 1, F.min(column)).otherwise(fallback if fallback is not None else F.lit(None))


def resolve_sources(incoming: DataFrame, prior: DataFrame, replace: bool) -> DataFrame:
    """incoming(namespace, revision) against prior(source_id, namespace, revision): source_id and what happened.

    The same namespace reuses its source on replace and is an error on import; on replace a source of the same revision
    under another namespace is reused if there is one only.
    """
    exact = incoming.join(prior.select("namespace", F.col("source_id").alias("exact_id")), "namespace", "left")
    by_revision = prior.groupBy("revision").agg(F.count(F.lit(1)).alias("n"), F.min("source_id").alias("revision_id"))
    rows = exact.join(by_revision, "revision", "left")
    new = framed_sha256("src_", "source", F.col("namespace"))
    if replace:
        action = F.when(F.col("exact_id").isNotNull(), "reuse").when(F.col("n") == 1, "reuse_revision").when(F.col("n") > 1, "error_ambiguous").otherwise("error_not_found")
        chosen = F.when(F.col("exact_id").isNotNull(), F.col("exact_id")).when(F.col("n") == 1, F.col("revision_id"))
    else:
        action = F.when(F.col("exact_id").isNotNull(), "error_already_imported").otherwise("new")
        chosen = F.when(F.col("exact_id").isNull(), new)
    return rows.select("namespace", "revision", action.alias("action"), chosen.alias("source_id"))


def resolve_records(incoming: DataFrame, prior: DataFrame) -> DataFrame:
    """incoming(locator, fingerprint) and prior(record_id, locator, fingerprint): one row per record of either side.

    Equal locator and fingerprint keep the id; then fingerprints that are single on both remaining sides; what is left is
    new, retired, or ambiguous where a fingerprint is left on both sides but not one to one.
    """
    both = incoming.withColumn("arrives", F.lit(True)).join(prior, ["locator", "fingerprint"], "full_outer")
    met = staged(both.select("locator", "fingerprint", "record_id", F.coalesce("arrives", F.lit(False)).alias("arrives")), "records")
    apart = met.filter(~(F.col("arrives") & F.col("record_id").isNotNull()))
    counts = apart.groupBy("fingerprint").agg(F.count_if("arrives").alias("n_in"), F.count_if(~F.col("arrives")).alias("n_out"), F.min("record_id").alias("moved_id"))
    one = (F.col("n_in") == 1) & (F.col("n_out") == 1)
    found = apart.join(counts, "fingerprint")
    action = F.when(F.col("arrives"), F.when(one, "moved").when(F.col("n_out") == 0, "new").otherwise("ambiguous")).when(F.col("n_in") == 0, "retired")
    identity = F.when(~F.col("arrives"), F.col("record_id")).when(one, F.col("moved_id"))
    rest = found.select("locator", "fingerprint", identity.alias("record_id"), action.alias("action")).filter("action is not null")
    return met.filter(F.col("arrives") & F.col("record_id").isNotNull()).select("locator", "fingerprint", "record_id", F.lit("same").alias("action")).unionByName(rest)


def agreement(ledger: DataFrame, manifest: DataFrame, key: str, compare: list[str]) -> DataFrame:
    """Rows on which ledger and manifest disagree: missing on one side or different in a compared column."""
    a, b = ledger.select(key, *compare), manifest.select(F.col(key), *(F.col(c).alias(f"m_{c}") for c in compare))
    joined = a.withColumn("in_ledger", F.lit(True)).join(b.withColumn("in_manifest", F.lit(True)), key, "full_outer")
    differs = ~F.array(*map(F.col, compare)).eqNullSafe(F.array(*(F.col(f"m_{c}") for c in compare)))
    problem = F.when(F.col("in_ledger").isNull(), "missing_in_ledger").when(F.col("in_manifest").isNull(), "missing_in_manifest").when(differs, "different")
    return joined.select(key, problem.alias("problem")).filter("problem is not null")
