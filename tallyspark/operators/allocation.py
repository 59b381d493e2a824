"""Which ids the records of arriving sources get: kept, revived, moved or new, and which stored records retire.

A stored record knows its origin (revision, contract and locator under which its id was given) and, while it is active, its
present locator. Everything is decided for all sources at once by joins on keys and counts; what has to be the same
irrespective of order (a source's records, the how-manieth of its fingerprint) is a digest or a rank by locator.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.text import digest_sums, framed_sha256
from tallyspark.sources.staging import staged

INTENTS = ("import", "replace", "reset")
RECORD = ("source_id", "record_id", "fingerprint", "state", "locator", "origin_revision", "origin_contract", "origin_locator", "ordinal")


@dataclass(frozen=True)
class Allocation:
    """rows: source_id, locator, fingerprint, ordinal, record_id, action (kept, revived, moved, new) of every arriving record.
    records: RECORD, all records after it. problems: source_id, problem of the sources that were refused and stay as they
    were. reset: record_id of everything that was decided under the sources to be forgotten (only of a reset)."""

    rows: DataFrame
    records: DataFrame
    problems: DataFrame
    reset: DataFrame


def _sums(rows: DataFrame, prefix: str) -> DataFrame:
    """Digests by source of its fingerprints and of its located fingerprints, with their number."""
    located = F.concat_ws("|", F.col("locator").cast("string"), "fingerprint")
    sums = [*digest_sums(F.col("fingerprint")), *digest_sums(located)]
    folded = rows.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), *(s.alias(f"s{i}") for i, s in enumerate(sums)))
    text = lambda low, high: F.concat_ws(":", "n", *(F.col(f"s{i}").cast("string") for i in range(low, high)))
    return folded.select("source_id", text(0, 4).alias(f"{prefix}_prints"), text(4, 8).alias(f"{prefix}_located"))


def source_modes(incoming: DataFrame, records: DataFrame, sources: DataFrame, allow_unmatched: bool, allow_upgrade: bool) -> DataFrame:
    """source_id, revision, contract of the arriving sources, safe (new ids may replace ambiguous ones), by_locator and problem.

    The same revision under the same contract has to give the active records exactly. Otherwise reallocation is safe
    where the caller says so, or where the caller expects a changed parser and one is proven: by another contract, or by
    other fingerprints from the same bytes.
    """
    active = records.filter("state = 'active'")
    prior = sources.select("source_id", F.col("revision").alias("prior_revision"), F.col("contract").alias("prior_contract"))
    found = (
        incoming.select("source_id", "revision", "contract").distinct()
        .join(prior, "source_id", "left")
        .join(_sums(incoming, "now"), "source_id", "left")
        .join(_sums(active, "was"), "source_id", "left")
    )
    same_revision = F.coalesce(F.col("revision") == F.col("prior_revision"), F.lit(False))
    same_contract = F.coalesce(F.col("contract") == F.col("prior_contract"), F.lit(False))
    other_prints = ~F.col("now_prints").eqNullSafe(F.col("was_prints"))
    proven = F.col("prior_revision").isNotNull() & (~same_contract | (same_revision & other_prints))
    safe = F.lit(allow_unmatched) | (F.lit(allow_upgrade) & proven)
    exact = same_revision & same_contract
    agrees = F.col("now_located").eqNullSafe(F.col("was_located"))
    problem = F.when(exact & ~agrees & ~safe, "exact_state_mismatch")
    return found.select("source_id", "revision", "contract", safe.alias("safe"), ((exact & agrees) | (safe & same_revision)).alias("by_locator"), problem.alias("problem"))


def allocate(incoming: DataFrame, records: DataFrame, sources: DataFrame, intent: str, allow_unmatched: bool = False, allow_upgrade: bool = False) -> Allocation:
    """incoming(source_id, revision, contract, locator, fingerprint) against records(RECORD) and sources(source_id, revision, contract).

    In order: an active record at the same place with the same fingerprint keeps its id (same bytes, where that is proof);
    a retired record of the same origin is revived; a fingerprint that is left once on either side moves. What is then left
    on both sides is ambiguous: the source is refused, or, where reallocation is safe, its new records get new ids and the
    old ones retire, without pairing. The rest is new or retired. An import takes new sources only.
    """
    if intent not in INTENTS:
        raise ValueError(f"unknown intent: {intent}")
    modes = source_modes(incoming, records, sources, allow_unmatched, allow_upgrade)
    if intent == "import":
        stored = sources.select("source_id").distinct().withColumn("stored", F.lit(True))
        modes = modes.join(stored, "source_id", "left").withColumn("problem", F.when(F.col("stored"), "already_imported").otherwise(F.col("problem"))).drop("stored")
    # Arriving and stored rows go together, once, to their source and fingerprint; each place there is one window.
    plan = modes.select("source_id", "revision", "contract", "safe", "by_locator", F.col("problem").isNull().alias("live"))
    came = incoming.select("source_id", "fingerprint", "locator", F.lit(None).cast("string").alias("state"), F.lit(None).cast("string").alias("record_id"), *(F.lit(None).cast(records.schema[c].dataType).alias(c) for c in RECORD[5:]), F.lit(True).alias("arrives"))
    both = came.unionByName(records.select(*RECORD, F.lit(False).alias("arrives"))).join(plan, "source_id", "left").filter(F.col("live") | ~F.col("arrives"))
    live, arrives, active = F.coalesce("live", F.lit(False)), F.col("arrives"), F.coalesce(F.col("state") == "active", F.lit(False))
    revivable = (F.col("state") == "retired") & (F.col("origin_revision") == F.col("revision")) & (F.col("origin_contract") == F.col("contract"))
    record = F.struct("record_id", *RECORD[5:])
    spot = F.when(F.col("state") == "retired", F.col("origin_locator")).otherwise(F.col("locator"))
    place = Window.partitionBy("source_id", "fingerprint", "spot")
    group = Window.partitionBy("source_id", "fingerprint")
    placed = live & F.col("spot").isNotNull()
    met = both.withColumn("spot", spot).select(
        "*",
        F.max(F.when(placed & active & F.col("by_locator"), record)).over(place).alias("old"), F.max(F.when(placed & revivable, record)).over(place).alias("back"),
        F.max(placed & arrives).over(place).alias("met"),
    )
    left_in = arrives & F.col("old").isNull() & F.col("back").isNull()
    left_out = live & active & ~(F.col("met") & F.col("by_locator"))
    counts = met.select(
        "*",
        F.sum(arrives.cast("int")).over(group.orderBy(F.col("spot")).rowsBetween(Window.unboundedPreceding, 0)).cast("int").alias("nth"),
        F.count(F.when(left_in, F.lit(1))).over(group).alias("n_in"), F.count(F.when(left_out, F.lit(1))).over(group).alias("n_out"), F.min(F.when(left_out, record)).over(group).alias("left"),
    )
    one = (F.col("n_in") == 1) & (F.col("n_out") == 1)
    own = F.when(arrives, F.when(F.col("old").isNotNull(), "kept").when(F.col("back").isNotNull(), "revived").when(one, "moved").otherwise("new"))
    taken_id = F.when(F.col("met") & F.col("old").isNotNull(), F.col("old.record_id")).when(F.col("met"), F.col("back.record_id"))
    claimed = F.coalesce(F.col("record_id") == taken_id, F.lit(False)) | (left_out & one)
    found = staged(counts.select(
        "source_id", "fingerprint", "locator", "state", "record_id", *RECORD[5:], "arrives", "revision", "contract", live.alias("live"), F.coalesce("safe", F.lit(False)).alias("safe"), "nth", own.alias("action"),
        F.when(arrives, F.coalesce("old", "back", F.when(one, F.col("left")))).alias("was"), (~arrives & claimed).alias("claimed"),
        ((F.col("n_in") > 0) & (F.col("n_out") > 0) & ~one).alias("ambiguous"), ((F.col("n_in") > 0) & ~one).alias("renewed"),
    ), "allocation")
    refused = found.filter("live and ambiguous and not safe").select("source_id").distinct()
    problems = modes.filter("problem is not null").select("source_id", "problem").unionByName(refused.select("source_id", F.lit("record_match_ambiguous").alias("problem")))

    taken = found.join(refused.withColumn("refused", F.lit(True)), "source_id", "left").withColumn("live", F.col("live") & F.col("refused").isNull())
    new_id = framed_sha256("rec_", "record", *(F.col(c).cast("string") for c in ("source_id", "revision", "contract", "locator", "nth", "fingerprint")))
    settled = taken.filter("arrives and live").withColumn("record_id", F.coalesce("was.record_id", new_id))
    rows = settled.select("source_id", "locator", "fingerprint", F.col("nth").alias("ordinal"), "record_id", "action")

    present = settled.select(
        "source_id", "record_id", "fingerprint", F.lit("active").alias("state"), "locator", F.coalesce("was.origin_revision", "revision").alias("origin_revision"),
        F.coalesce("was.origin_contract", "contract").alias("origin_contract"), F.coalesce("was.origin_locator", "locator").alias("origin_locator"), F.coalesce("was.ordinal", "nth").alias("ordinal"),
    )
    known = taken.filter("not arrives")
    stays = known.filter("not live").select(*RECORD)
    gone = known.filter("live and not claimed").withColumns({"state": F.lit("retired"), "locator": F.lit(None).cast(records.schema["locator"].dataType)})
    # A new id names its source and fingerprint, so only where such a group got one it may be that of a record that goes.
    renewed = settled.filter("action = 'new'").select("record_id")
    gone = gone.filter("not renewed").select(*RECORD).unionByName(gone.filter("renewed").join(renewed, "record_id", "left_anti").select(*RECORD))
    after = stays.unionByName(present).unionByName(gone)
    reset = known.filter("live").select("record_id") if intent == "reset" else records.limit(0).select("record_id")
    return Allocation(rows, after, problems, reset)
