"""Canonical rows of records that several sources report, over successive imports.

A record (fingerprint) has numbered slots. A slot's id is a keyed digest of the record and the number, so growth never
renumbers; a slot that an import no longer supports is retired, not forgotten, and comes back under its id. What an import
needs of the ones before is an OverlapState: every slot ever given out, every membership ever seen with what was decided
for it, and the rows as they are now. A decision counts for the exact membership it was made for and for no other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.functions.text import add_token, digest_sums, drop_tokens, packed, remove_reason, snippet, unpacked
from tallyspark.operators.annotations import COUNT_AMBIGUOUS, COUNT_REASON, HISTORY, PRIOR_REVIEW
from tallyspark.operators.duplicates import AMBIGUOUS, CHOICES
from tallyspark.operators.overlap import slot_id
from tallyspark.sources.staging import staged

SAME_EVENT, KEEP_ALL = CHOICES
OPEN = "unresolved"
SLOTS = "fingerprint string, slot int, slot_id string"
MEMBERSHIPS = "fingerprint string, membership string, resolution string"


@dataclass(frozen=True)
class OverlapState:
    """slots: SLOTS. memberships: MEMBERSHIPS. rows: slot_id and at least the mutable columns (None before the first import)."""

    slots: DataFrame
    memberships: DataFrame
    rows: DataFrame | None = None

    @classmethod
    def empty(cls, spark: SparkSession) -> OverlapState:
        # limit(0): the planner sees that nothing is there and drops the joins with it, and their shuffles.
        return cls(spark.createDataFrame([], SLOTS).limit(0), spark.createDataFrame([], MEMBERSHIPS).limit(0))


@dataclass(frozen=True)
class Canonical:
    """groups: one row a record; slots: every slot with its state; memberships; rows: one for each active slot, with keep_all of its record."""

    groups: DataFrame
    slots: DataFrame
    memberships: DataFrame
    rows: DataFrame

    def state(self) -> OverlapState:
        return OverlapState(self.slots.select("fingerprint", "slot", "slot_id"), self.memberships, self.rows)


def overlap_groups(occurrences: DataFrame, state: OverlapState, least: dict[str, Column] | None = None, most: dict[str, Column] | None = None) -> DataFrame:
    """One row a record of the occurrences or the state: counts, status, membership, decision and how many slots are active.

    changed marks an open ambiguous record for which another membership was decided before. least and most: what else is
    wanted of a record's occurrences, the smallest and largest values by name. The narrow occurrences travel once, to their
    record; digests and extremes, which are wider than what they are made of, are made there.
    """
    names = [f"d{i}" for i in range(4)]
    least, most = least or {}, most or {}
    extra = [*least, *most]
    extremes = lambda of: [*(F.min(of(c, x)).alias(c) for c, x in least.items()), *(F.max(of(c, x)).alias(c) for c, x in most.items())]
    dealt = occurrences.repartition("fingerprint")
    per = dealt.groupBy("fingerprint", "source").agg(F.count(F.lit(1)).alias("n"), *(x.alias(d) for x, d in zip(digest_sums(F.col("id")), names, strict=True)), *extremes(lambda c, x: x))
    # The rows of a record lie together then, in order of source: windows take them as they are, where an aggregate with a list would sort these wide rows again.
    record = Window.partitionBy("fingerprint")
    of_record = {"source_counts": F.array_sort(F.collect_list("n").over(record)), "source_occurrence_count": F.sum("n").over(record)} | {d: F.sum(d).over(record) for d in names} | {c: F.min(c).over(record) for c in least} | {c: F.max(c).over(record) for c in most}
    now = per.select("fingerprint", *(x.alias(c) for c, x in of_record.items()), F.row_number().over(record.orderBy("source")).alias("place")).filter("place = 1").drop("place")
    before = state.slots.groupBy("fingerprint").agg(F.max("slot").alias("known_slots"))
    # A record has as many memberships as imports saw it change.
    seen = state.memberships.groupBy("fingerprint").agg(F.bool_or(F.col("resolution") != OPEN).alias("decided_before"), F.collect_list(F.struct("membership", "resolution")).alias("seen"))
    rows = now.join(before, "fingerprint", "full_outer").join(seen, "fingerprint", "left")
    c = F.col("source_counts")
    keep_all = F.coalesce(F.element_at(c, -1), F.lit(0))
    same_event = F.when(F.size(c) > 1, F.try_element_at(c, F.lit(-2))).otherwise(keep_all)
    status = F.when(F.size(c) == 1, "single_source").when(keep_all == 1, "exact_one_to_one").when(F.element_at(c, 1) == keep_all, "pooled_equal_count").when(c.isNotNull(), AMBIGUOUS)
    rows = rows.select("*", keep_all.cast("int").alias("keep_all"), same_event.cast("int").alias("same_event"), status.alias("provenance_status"))
    frame = F.concat_ws(":", "fingerprint", F.array_join(F.transform(c, lambda n: n.cast("string")), ","), "keep_all", "same_event", *(F.col(d).cast("string") for d in names))
    rows = rows.withColumn("membership", F.when(c.isNotNull(), F.concat(F.lit("dup_"), F.sha2(frame, 256)))).drop(*names)
    same = F.filter("seen", lambda m: m["membership"] == F.col("membership"))
    found = rows.withColumn("resolution", F.try_element_at(same, F.lit(1))["resolution"])
    decision = F.when(F.col("resolution").isin(*CHOICES), F.col("resolution"))
    active = F.when(decision == SAME_EVENT, F.col("same_event")).otherwise(F.col("keep_all"))
    open_ = (F.col("provenance_status") == AMBIGUOUS) & decision.isNull()
    return found.select(
        "fingerprint", "source_counts", F.coalesce("source_occurrence_count", F.lit(0)).alias("source_occurrence_count"), "keep_all", "same_event", "provenance_status", "membership",
        F.col("resolution").isNotNull().alias("known"), decision.alias("decision"), active.alias("active"), F.greatest("keep_all", F.coalesce("known_slots", F.lit(0))).alias("slots"),
        F.coalesce(open_ & F.col("decided_before"), F.lit(False)).alias("changed"), *extra,
    )


def canonicalize(occurrences: DataFrame, state: OverlapState, key: bytes, immutable: list[str], mutable: dict[str, Column]) -> Canonical:
    """The canonical rows of occurrences(id, fingerprint, source, processed, immutable columns, mutable columns).

    An immutable column has the one value of the record's occurrences, or null where they differ. A mutable column has the
    value of the slot's row so far; for a new slot the one value of the occurrences that were processed (or of all, if none
    was), else the default that `mutable` gives. New slots of records whose occurrences differ in that get the history flag.
    """
    every, processed = (*immutable, *mutable), F.col("processed")
    least = {f"lo_{c}": F.struct(c) for c in every} | {f"plo_{c}": F.when(processed, F.struct(c)) for c in mutable}
    most = {f"hi_{c}": F.struct(c) for c in every} | {f"phi_{c}": F.when(processed, F.struct(c)) for c in mutable} | {"any_processed": processed}
    facts = overlap_groups(occurrences, state, least, most)
    low = {c: F.when(F.col("any_processed"), F.col(f"plo_{c}")).otherwise(F.col(f"lo_{c}")) for c in mutable}
    high = {c: F.when(F.col("any_processed"), F.col(f"phi_{c}")).otherwise(F.col(f"hi_{c}")) for c in mutable}
    agreed = {c: low[c] == high[c] for c in mutable}
    differ = F.lit(False)
    for c in mutable:
        differ = differ | ~agreed[c]
    # Written once: slots, memberships and rows are all read from a record's row.
    given = [c for c in facts.columns if c not in least and c not in most]
    facts = staged(facts.select(
        *(packed(F.col(c)).alias(c) if c == "membership" else c for c in given),
        differ.alias("differ"),
        *(F.when(F.col(f"lo_{c}") == F.col(f"hi_{c}"), F.col(f"lo_{c}.{c}")).alias(c) for c in immutable),
        *(F.when(agreed[c], low[c][c]).otherwise(default).alias(c) for c, default in mutable.items()),
    ), "records")
    groups = facts.select(*(unpacked(F.col(c)).alias(c) if c == "membership" else c for c in given))
    numbered = facts.filter("slots > 0").withColumn("resolved", F.col("decision").isNotNull()).withColumn("slot", F.explode(F.sequence(F.lit(1), "slots")))
    numbered = (
        numbered.join(state.slots, ["fingerprint", "slot"], "left")
        .withColumn("group_id", F.col("fingerprint"))
        .withColumn("slot_id", F.coalesce("slot_id", slot_id(key)))
        .withColumn("state", F.when(F.col("slot") <= F.col("active"), "active").otherwise("retired"))
    )
    slots = numbered.select("fingerprint", "slot", "slot_id", "state")
    fresh = groups.filter((F.col("provenance_status") == AMBIGUOUS) & ~F.col("known")).select("fingerprint", "membership", F.lit(OPEN).alias("resolution"))
    memberships = state.memberships.unionByName(fresh)
    rows = numbered.filter("state = 'active' and source_counts is not null").select("slot_id", "fingerprint", "slot", "keep_all", "provenance_status", "source_occurrence_count", "resolved", "differ", *immutable, *mutable)
    if state.rows is None:
        rows = rows.withColumn("flags", add_token(F.col("flags"), HISTORY, F.col("differ"))) if "flags" in mutable else rows
    else:
        prior = state.rows.select(F.col("slot_id").alias("prior_id"), *(F.col(c).alias(f"prior_{c}") for c in mutable))
        rows = rows.join(prior, F.col("slot_id") == F.col("prior_id"), "left")
        kept = F.col("prior_id").isNotNull()
        first = {c: F.col(c) for c in mutable}
        if "flags" in mutable:
            first["flags"] = add_token(F.col("flags"), HISTORY, F.col("differ"))
        rows = rows.select(*(F.when(kept, F.col(f"prior_{c}")).otherwise(first[c]).alias(c) if c in mutable else F.col(c) for c in rows.columns if not c.startswith("prior_")))
    return Canonical(groups, slots, memberships, rows.drop("differ"))


def listing(canonical: Canonical, occurrences: DataFrame, evidence: list[str]) -> tuple[DataFrame, DataFrame]:
    """What a user is shown of the ambiguous records without a decision: (groups, occurrences).

    groups: membership, source_counts, keep_all, same_event and the ids of the active slots, in order; occurrences: one
    row each, with bounded evidence, so that no record's occurrences have to fit in one row. Both are dealt by fingerprint,
    so they meet by it without another shuffle.
    """
    open_ = canonical.groups.filter((F.col("provenance_status") == AMBIGUOUS) & F.col("decision").isNull())
    active = canonical.slots.filter("state = 'active'").join(open_.select("fingerprint"), "fingerprint", "left_semi")
    ids = active.groupBy("fingerprint").agg(F.array_sort(F.collect_list("slot_id")).alias("slot_ids"))
    groups = open_.join(ids, "fingerprint").select("fingerprint", "membership", "source_counts", "keep_all", "same_event", "slot_ids")
    shown = [snippet(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in evidence]
    return groups, occurrences.join(open_.select("fingerprint", "membership"), "fingerprint").select("fingerprint", "membership", F.col("id").alias("occurrence_id"), *shown)


def decided(memberships: DataFrame, decisions: DataFrame) -> DataFrame:
    """memberships with decisions(membership, choice); what is decided stays, and two different choices leave it open."""
    chosen = decisions.filter(F.col("choice").isin(*CHOICES)).groupBy("membership").agg(F.min("choice").alias("lo"), F.max("choice").alias("hi"))
    joined = memberships.join(chosen, "membership", "left")
    new = F.when((F.col("resolution") == OPEN) & (F.col("lo") == F.col("hi")), F.col("lo")).otherwise(F.col("resolution"))
    return joined.select("fingerprint", "membership", new.alias("resolution"))


def _history(columns: list[str], value) -> Column:
    """A digest of what was decided about a row, without what overlap review itself wrote."""
    own = {"flags": lambda c: F.array_join(F.array_sort(drop_tokens(c, COUNT_AMBIGUOUS, PRIOR_REVIEW)), ";"), "reason": lambda c: remove_reason(c, COUNT_REASON)}
    return F.sha2(F.to_json(F.struct(*(own.get(c, lambda x: x)(value(c)).alias(c) for c in columns)), {"ignoreNullFields": "false"}), 256)


def tail_corrections(rows: DataFrame, groups: DataFrame, patches: DataFrame, fields: list[str], mutable: list[str]) -> tuple[DataFrame, DataFrame]:
    """What keeping only same_event slots does to stored corrections: (verdicts, changes).

    rows: fingerprint, slot, slot_id, mutable columns; groups: fingerprint, same_event; patches: slot_id, fields (null: not
    set). Slots beyond same_event would go. verdicts(fingerprint, verdict): `clean`, no correction goes; `removed`,
    the going slots' corrections repeat what stays; `moved`, the one correction goes over to the only slot that stays;
    `conflict`, something that was decided about a going row would be lost. changes(fingerprint, slot_id, action, fields):
    delete, or set with the fields, of records without a conflict. A row travels to its correction and from there to its
    record, where all is found in windows; verdicts and changes are read from what is written of that.
    """
    slot = packed(F.col("slot_id")).alias("slot_id")
    # No id is like the fallback; without it Spark would make each id once more to leave out nulls.
    given = patches.select(F.coalesce(packed(F.col("slot_id")), F.lit(b"\2")).alias("slot_id"), F.struct(*fields).alias("patch"))
    all_ = rows.select("fingerprint", "slot", slot, *mutable).join(given, "slot_id", "left")
    all_ = all_.join(groups.select("fingerprint", "same_event"), "fingerprint").withColumn("tail", F.col("slot") > F.col("same_event"))
    text, record = F.to_json("patch", {"ignoreNullFields": "false"}), Window.partitionBy("fingerprint")
    facts = {
        "n": F.count(F.lit(1)), "patched": F.count("patch"), "tail_patched": F.count(F.when(F.col("tail"), F.col("patch"))),
        "stay": F.count(F.when(~F.col("tail"), F.lit(1))), "lo": F.min(text), "hi": F.max(text), "one": F.max("patch"),
    }
    single = (F.col("stay") == 1) & (F.col("patched") > 0)
    joined = all_.select("*", *(x.over(record).alias(c) for c, x in facts.items())).withColumn("single", single)
    projected = {f: F.coalesce(F.col(f"one.{f}"), F.col(f)) for f in fields if f in mutable}
    if "flags" in mutable:
        projected["flags"] = add_token(F.col("flags"), "manual_correction", F.lit(True))
    if "flow_source" in mutable and "flow_type" in fields:
        projected["flow_source"] = F.when(F.col("one.flow_type").isNotNull(), "correction").otherwise(F.col("flow_source"))
    history = F.when(F.col("single"), _history(mutable, lambda c: projected.get(c, F.col(c)))).otherwise(_history(mutable, F.col))
    one_patch = F.col("lo") == F.col("hi")
    lost = F.when(single, (F.col("tail_patched") > 1) | ~one_patch).otherwise((F.col("tail_patched") > 0) & ((F.col("patched") < F.col("n")) | ~one_patch))
    verdict = F.when(lost, "conflict").when(single & (F.col("patched") == F.col("tail_patched")), "moved").when(F.col("tail_patched") > 0, "removed").otherwise("clean")
    judged = joined.withColumn("verdict", verdict)
    action = F.when(F.col("tail") & F.col("patch").isNotNull(), "delete").when((F.col("verdict") == "moved") & ~F.col("tail"), "set")
    # Little is left of a row for the second sort.
    kinds = judged.select("fingerprint", F.unhex(history).alias("history"), "tail", "verdict", action.alias("action"), "slot_id", *(F.when(action == "set", F.col(f"one.{f}")).alias(f) for f in fields))
    kinds = kinds.withColumn("stays", F.bool_or(~F.col("tail")).over(Window.partitionBy("fingerprint", "history")))
    # What was decided about a going row is also there on a row that stays.
    safe = kinds.withColumn("safe", F.bool_and("stays").over(record)).withColumn("place", F.row_number().over(record.orderBy("history")))
    found = safe.withColumn("verdict", F.when(~F.col("safe"), "conflict").otherwise(F.col("verdict"))).withColumn("action", F.when(F.col("verdict") != "conflict", F.col("action"))).filter("place = 1 or action is not null")
    # Written once, by record a row with the verdict and one for each change.
    found = staged(found.select(
        "fingerprint", F.when(F.col("place") == 1, F.col("verdict")).alias("verdict"), "action", F.when(F.col("action").isNotNull(), F.col("slot_id")).alias("slot_id"),
        *(F.when(F.col("action").isNotNull(), F.col(f)).alias(f) for f in fields),
    ), "tails")
    return found.filter("verdict is not null").select("fingerprint", "verdict"), found.filter("action is not null").select("fingerprint", unpacked(F.col("slot_id")).alias("slot_id"), "action", *fields)


def agreement(stored: OverlapState, occurrences: DataFrame, key: bytes, immutable: list[str], mutable: dict[str, Column]) -> DataFrame:
    """slot_id and problem where the stored rows are not what the occurrences and the stored decisions give.

    missing, excess, repeated (a slot with several rows), altered (a row that says something else than its sources), and
    slot_missing, slot_excess, slot_altered for the slots themselves. No row: they agree.
    """
    want = canonicalize(occurrences, OverlapState(stored.slots, stored.memberships), key, immutable, mutable)
    compared = ["fingerprint", "slot", "provenance_status", "source_occurrence_count", *immutable]
    # Rows travel once, before their smallest and largest form make two of them.
    have = stored.rows.select("slot_id", *compared).repartition("slot_id").groupBy("slot_id").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct(*compared)).alias("have"), F.max(F.struct(*compared)).alias("also"))
    both = have.join(want.rows.select("slot_id", F.struct(*compared).alias("want")), "slot_id", "full_outer")
    problem = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "excess").when(F.col("times") > 1, "repeated").when(F.col("have") != F.col("want"), "altered")
    slots = stored.slots.select("fingerprint", "slot", "slot_id").repartition("fingerprint", "slot").groupBy("fingerprint", "slot").agg(F.min("slot_id").alias("had"), F.max("slot_id").alias("also"))
    # Slots that the key and the record alone give, for those that the state should hold.
    own = slots.select("fingerprint", "slot", "had", "also").join(want.slots.select("fingerprint", "slot", "slot_id"), ["fingerprint", "slot"], "full_outer")
    made = own.withColumn("group_id", F.col("fingerprint")).withColumn("made", slot_id(key))
    slot_problem = F.when(F.col("slot_id").isNull(), "slot_excess").when(F.col("had").isNull(), "slot_missing").when((F.col("had") != F.col("made")) | (F.col("also") != F.col("made")), "slot_altered")
    rows = both.select("slot_id", problem.alias("problem")).union(made.select(F.coalesce("had", "slot_id").alias("slot_id"), slot_problem.alias("problem")))
    return rows.filter("problem is not null")
