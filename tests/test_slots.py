import re

import pytest
from pyspark.sql import functions as F

from tallyspark.functions.text import packed, unpacked
from tallyspark.operators import slots

SCHEMA = "id string, fingerprint string, source string, processed boolean, amount int, category string, flags array<string>"
KEY = b"k"


def occurrences(spark, *counts, **more):
    """counts of record f by source, in order."""
    rows = [(f"{s}{i}", "f", f"s{s}", False, 5, "Dining", []) for s, n in enumerate(counts) for i in range(n)]
    return spark.createDataFrame(rows + more.get("rows", []), SCHEMA)


def run(spark, occ, state=None):
    return slots.canonicalize(occ, state or slots.OverlapState.empty(spark), KEY, ["amount"], {"category": F.lit("Unknown"), "flags": F.array().cast("array<string>")})


def ids(canonical, state="active"):
    return [r.slot_id for r in canonical.slots.filter(F.col("state") == state).orderBy("slot").collect()]


def test_shrink_then_growth_gives_back_the_same_ids(spark):
    first = run(spark, occurrences(spark, 3, 2))
    second = run(spark, occurrences(spark, 1, 1), first.state())
    gone = run(spark, spark.createDataFrame([], SCHEMA), second.state())
    third = run(spark, occurrences(spark, 4, 2), gone.state())
    assert len(set(ids(first))) == 3 and ids(second) == ids(first)[:1] and ids(second, "retired") == ids(first)[1:]
    assert ids(gone) == [] and ids(third)[:3] == ids(first) and len(ids(third)) == 4
    assert gone.rows.count() == 0 and third.rows.count() == 4


def test_decisions_hold_for_their_membership_only(spark):
    first = run(spark, occurrences(spark, 3, 1))
    state = first.state()
    one = state.memberships.first()
    assert one.resolution == slots.OPEN
    choice = spark.createDataFrame([(one.membership, "same-event")], "membership string, choice string")
    known = slots.OverlapState(state.slots, slots.decided(state.memberships, choice), state.rows)
    again = run(spark, occurrences(spark, 3, 1), known)
    assert len(ids(again)) == 1 and len(ids(again, "retired")) == 2
    grown = run(spark, occurrences(spark, 4, 1), again.state())
    group = grown.groups.first()
    assert len(ids(grown)) == 4 and group.changed and group.decision is None
    assert {(r.resolution) for r in grown.memberships.collect()} == {"same-event", slots.OPEN}
    back = run(spark, occurrences(spark, 3, 1), grown.state())
    assert len(ids(back)) == 1
    both = spark.createDataFrame([(one.membership, "same-event"), (one.membership, "keep-all")], "membership string, choice string")
    assert slots.decided(state.memberships, both).first().resolution == slots.OPEN


def test_rows_take_what_occurrences_agree_on(spark):
    more = [("x", "g", "s0", True, 1, "Travel", []), ("y", "g", "s1", False, 2, "Gifts", []), ("z", "h", "s0", False, 3, "Gifts", []), ("w", "h", "s1", False, 3, None, [])]
    rows = {r.fingerprint: r for r in run(spark, occurrences(spark, 1, rows=more)).rows.collect()}
    assert (rows["g"].amount, rows["g"].category, rows["g"].flags) == (None, "Travel", [])
    assert (rows["h"].amount, rows["h"].category, rows["h"].flags) == (3, "Unknown", ["overlap_history_ambiguous"])


def test_rows_keep_what_was_decided(spark):
    first = run(spark, occurrences(spark, 2, 1))
    state = first.state()
    changed = slots.OverlapState(state.slots, state.memberships, state.rows.withColumn("category", F.concat(F.lit("mine"), F.col("slot").cast("string"))))
    assert [r.category for r in run(spark, occurrences(spark, 3, 1), changed).rows.orderBy("slot").collect()] == ["mine1", "mine2", "Dining"]


@pytest.mark.parametrize(
    ("stay", "categories", "patches", "verdict", "changes"),
    [
        (1, ["a", "a"], {}, "clean", []),
        (1, ["a", "b"], {}, "conflict", []),
        (1, ["a", "a"], {2: "P"}, "moved", [(1, "set", "P"), (2, "delete", None)]),
        (1, ["a", "b"], {2: "P"}, "moved", [(1, "set", "P"), (2, "delete", None)]),
        (1, ["a", "a"], {1: "P", 2: "P"}, "removed", [(2, "delete", None)]),
        (1, ["a", "a"], {1: "P", 2: "Q"}, "conflict", []),
        (1, ["a", "a", "a"], {2: "P", 3: "P"}, "conflict", []),
        (2, ["a", "a", "a"], {1: "P", 2: "P", 3: "P"}, "removed", [(3, "delete", None)]),
        (2, ["a", "a", "a"], {3: "P"}, "conflict", []),
        (2, ["a", "b", "b"], {1: "P"}, "clean", []),
        (2, ["a", "b", "c"], {}, "conflict", []),
    ],
)
def test_corrections_of_going_slots(spark, stay, categories, patches, verdict, changes):
    rows = spark.createDataFrame([("f", i + 1, f"t{i + 1}", c, []) for i, c in enumerate(categories)], "fingerprint string, slot int, slot_id string, category string, flags array<string>")
    groups = spark.createDataFrame([("f", stay)], "fingerprint string, same_event int")
    given = spark.createDataFrame([(f"t{k}", v) for k, v in patches.items()], "slot_id string, category string")
    verdicts, found = slots.tail_corrections(rows, groups, given, ["category"], ["category", "flags"])
    assert [r.verdict for r in verdicts.collect()] == [verdict]
    assert sorted((int(r.slot_id[1:]), r.action, r.category) for r in found.collect()) == changes


def test_agreement_of_an_untouched_state(spark):
    occ = occurrences(spark, 3, 2)
    state = run(spark, occ).state()
    args = (occ, KEY, ["amount"], {"category": F.lit("Unknown"), "flags": F.array().cast("array<string>")})
    assert slots.agreement(state, *args).count() == 0
    forged = slots.OverlapState(state.slots.withColumn("slot_id", F.concat("slot_id", F.lit("x"))), state.memberships, state.rows)
    assert {r.problem for r in slots.agreement(forged, *args).collect()} >= {"slot_altered"}


def test_slots_and_rows_are_read_from_one_pass_over_the_occurrences(spark):
    done = run(spark, occurrences(spark, 3, 2))
    for frame in (done.groups, done.slots, done.memberships, done.rows):
        assert "Aggregate" not in frame._jdf.queryExecution().optimizedPlan().toString()
    assert (done.groups.count(), done.slots.count(), done.memberships.count(), done.rows.count()) == (1, 3, 1, 3)


def test_a_listing_meets_by_fingerprint(spark):
    from tallyspark.operators import slots

    groups = spark.createDataFrame([("f", "dup_1", [1, 2], 2, 1, slots.AMBIGUOUS, None)], "fingerprint string, membership string, source_counts array<long>, keep_all int, same_event int, provenance_status string, decision string")
    given = spark.createDataFrame([("f", 1, "x", "active"), ("f", 2, "y", "active")], "fingerprint string, slot int, slot_id string, state string")
    found, shown = slots.listing(slots.Canonical(groups, given, None, None), spark.createDataFrame([("a", "f", "t"), ("b", "g", "t")], "id string, fingerprint string, text string"), ["text"])
    met = found.join(shown.drop("membership"), "fingerprint").collect()
    assert [(r.membership, r.slot_ids, r.occurrence_id, r.text) for r in met] == [("dup_1", ["x", "y"], "a", "t")]


def test_verdicts_and_changes_are_read_from_one_pass_over_the_rows(spark):
    """Rows and corrections are joined once and written; before, each of both results joined and dealt them several times anew."""
    made = {f"{f}{i}": "txn_" + f"{i}{ord(f):x}".ljust(64, "0") for f in "fg" for i in (1, 2)}
    rows = spark.createDataFrame([(k[0], int(k[1]), v, "a", []) for k, v in made.items()], "fingerprint string, slot int, slot_id string, category string, flags array<string>")
    groups = spark.createDataFrame([("f", 1), ("g", 1), ("h", 1)], "fingerprint string, same_event int")
    given = spark.createDataFrame([(made["f2"], "P"), (made["g1"], "P"), (made["g2"], "Q"), ("elsewhere", "R"), (None, "S")], "slot_id string, category string")
    verdicts, changes = slots.tail_corrections(rows, groups, given, ["category"], ["category", "flags"])
    for frame in (verdicts, changes):
        assert not {"Join", "Aggregate", "Window"} & set(re.findall("Join|Aggregate|Window", frame._jdf.queryExecution().optimizedPlan().toString()))
    assert {tuple(r) for r in verdicts.collect()} == {("f", "moved"), ("g", "conflict")}
    assert {tuple(r) for r in changes.collect()} == {("f", made["f1"], "set", "P"), ("f", made["f2"], "delete", None)}


def test_ids_travel_packed(spark):
    digest = "0123456789abcdef" * 4
    ids = [f"txn_{digest}", f"dup_{digest}", f"txn_{digest}\n", f"txn_{digest.upper()}", f"txn_{digest[:-1]}", f"Txn_{digest}", "", "t1", "\x01txn_", "ü_", None]
    got = spark.createDataFrame([(i,) for i in ids], "i string").select("i", packed(F.col("i")).alias("p")).select("*", unpacked(F.col("p")).alias("u")).collect()
    assert [r.u for r in got] == ids and len({bytes(r.p) for r in got if r.p is not None}) == len(ids) - 1
    assert [len(r.p) for r in got[:2]] == [37, 37]


def test_a_first_import_joins_no_state(spark):
    groups = slots.overlap_groups(occurrences(spark, 3, 2), slots.OverlapState.empty(spark))
    assert "Join" not in groups._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.slots, r.known, r.changed) for r in groups.collect()] == [(3, False, False)]


def test_occurrences_of_a_record_are_sorted_once(spark):
    """Counts, digests and extremes of a record are taken from rows that lie together: one sort, no list aggregate that sorts wide rows again (and spills them)."""
    extremes = {"lo": F.struct("category")}, {"hi": F.struct("category")}
    rows = [("a", "f", "s0", False, 5, "Dining", []), ("b", "f", "s1", False, 5, "Travel", []), ("c", "f", "s1", False, 5, None, []), ("d", None, None, False, 5, "Gifts", [])]
    groups = slots.overlap_groups(spark.createDataFrame(rows, SCHEMA), slots.OverlapState.empty(spark), *extremes)
    plan = groups._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and len(re.findall(r"[^a-zA-Z]Sort \[", plan)) == 1
    assert {(r.fingerprint, tuple(r.source_counts), r.source_occurrence_count, r.lo.category, r.hi.category) for r in groups.collect()} == {("f", (1, 2), 3, None, "Travel"), (None, (1,), 1, "Gifts", "Gifts")}
