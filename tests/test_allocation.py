from pyspark.sql import functions as F

from tallyspark.operators import allocation

INCOMING = "source_id string, revision string, contract string, locator long, fingerprint string"
RECORDS = "source_id string, record_id string, fingerprint string, state string, locator long, origin_revision string, origin_contract string, origin_locator long, ordinal int"
SOURCES = "source_id string, revision string, contract string"


def run(spark, lines, before=None, revision="r1", contract="c1", intent="replace", stored=("r1", "c1"), **allow):
    """lines: (locator, fingerprint) of source s; before: the allocation of an earlier run."""
    incoming = spark.createDataFrame([("s", revision, contract, at, f) for at, f in lines], INCOMING)
    records = spark.createDataFrame(before or [], RECORDS)
    sources = spark.createDataFrame([("s", *stored)] if before is not None else [], SOURCES)
    return allocation.allocate(incoming, records, sources, intent, **allow)


def first(spark, lines):
    return [tuple(r) for r in run(spark, lines).records.collect()]


def ids(found):
    return {r.locator: r.record_id for r in found.rows.collect()}


def states(found):
    return {r.record_id: r.state for r in found.records.collect()}


def test_a_changed_parser_reallocates_repeats_without_pairing(spark):
    old = first(spark, [(2, "x"), (3, "x")])
    upgraded = run(spark, [(8, "x")], old, "r2", "c2", allow_upgrade=True)
    assert not set(ids(upgraded).values()) & {r[1] for r in old}
    assert sorted(states(upgraded).values()) == ["active", "retired", "retired"]
    same_parser = run(spark, [(8, "x")], old, "r2", allow_upgrade=True)
    assert [r.problem for r in same_parser.problems.collect()] == ["record_match_ambiguous"]
    assert same_parser.rows.count() == 0 and states(same_parser) == {r[1]: "active" for r in old}
    assert not run(spark, [(8, "x")], old, "r2", allow_unmatched=True).problems.count()


def test_a_retired_origin_comes_back_and_another_one_is_new(spark):
    old = first(spark, [(2, "x")])
    gone = [tuple(r) for r in run(spark, [(5, "y")], old, "r2").records.collect()]
    assert {r[1]: r[3] for r in gone}[old[0][1]] == "retired"
    back = run(spark, [(2, "x")], gone, "r1", stored=("r2", "c1"))
    assert ids(back)[2] == old[0][1] and {r.action for r in back.rows.collect()} == {"revived"}
    later = run(spark, [(9, "x")], gone, "r3", stored=("r2", "c1"))
    assert ids(later)[9] != old[0][1] and states(later)[old[0][1]] == "retired"


def test_single_fingerprints_move(spark):
    old = first(spark, [(2, "x"), (3, "y"), (4, "z")])
    found = run(spark, [(7, "x"), (2, "y"), (9, "w")], old, "r2")
    by_locator = {r[4]: r[1] for r in old}
    assert ids(found)[7] == by_locator[2] and ids(found)[2] == by_locator[3]
    assert {(r.locator, r.action) for r in found.rows.collect()} == {(7, "moved"), (2, "moved"), (9, "new")}
    assert states(found)[by_locator[4]] == "retired"


def test_the_same_bytes_have_to_give_the_same_records(spark):
    old = first(spark, [(2, "x"), (3, "x")])
    again = run(spark, [(3, "x"), (2, "x")], old)
    assert ids(again) == {r[4]: r[1] for r in old} and {r.action for r in again.rows.collect()} == {"kept"}
    assert [r.problem for r in run(spark, [(2, "x")], old).problems.collect()] == ["exact_state_mismatch"]
    upgraded = run(spark, [(2, "x"), (4, "z")], old, allow_upgrade=True)
    assert ids(upgraded)[2] == old[0][1] if old[0][4] == 2 else old[1][1]
    assert sorted(states(upgraded).values()) == ["active", "active", "retired"]


def test_reset_lists_active_and_retired_ids(spark):
    old = first(spark, [(2, "x"), (3, "y")])
    after = [tuple(r) for r in run(spark, [(8, "y")], old, "r2").records.collect()]
    found = run(spark, [(8, "y")], after, "r2", intent="reset", stored=("r2", "c1"))
    assert {r.record_id for r in found.reset.collect()} == {r[1] for r in old}
    assert run(spark, [(8, "y")], after, "r2", stored=("r2", "c1")).reset.count() == 0


def test_order_changes_nothing_and_ordinals_follow_the_locator(spark):
    one, two = run(spark, [(9, "x"), (2, "x")]), run(spark, [(2, "x"), (9, "x")])
    assert sorted(map(tuple, one.records.collect())) == sorted(map(tuple, two.records.collect()))
    assert {r.locator: r.ordinal for r in one.rows.collect()} == {2: 1, 9: 2}


def test_an_import_takes_new_sources_only(spark):
    old = first(spark, [(2, "x")])
    assert [r.problem for r in run(spark, [(3, "x")], old, "r2", intent="import").problems.collect()] == ["already_imported"]
    assert run(spark, [(3, "x")], intent="import").rows.filter(F.col("action") == "new").count() == 1


def test_rows_are_dealt_to_their_fingerprint_once(spark):
    """Arriving and stored rows meet in one shuffle, and what follows reads the result."""
    old = first(spark, [(2, "x"), (3, "y")])
    found = run(spark, [(2, "x"), (7, "y")], old, "r2")
    assert {r.action for r in found.rows.collect()} == {"moved"}
    for frame in (found.rows, found.records):
        assert "Window" not in frame._jdf.queryExecution().executedPlan().toString()
        assert frame._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 6


def test_a_new_id_that_a_leaving_record_has_stays_one_record(spark):
    """Reallocated under the same origin, a record gets the id it had and does not retire as well."""
    old = [(*r[:4], r[4] + 100, *r[5:]) for r in first(spark, [(2, "x"), (3, "x")])]
    found = run(spark, [(2, "x"), (3, "x"), (4, "x")], old, "r1", "c1", stored=("r0", "c1"), allow_unmatched=True)
    assert len(states(found)) == found.records.count() == 3 and set(states(found).values()) == {"active"}
    assert {r.action for r in found.rows.collect()} == {"new"} and set(ids(found).values()) >= {r[1] for r in old}
