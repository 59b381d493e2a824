import itertools
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallyspark.operators import annotations, bindings, decisions, flows, identity, policy, reports, statement_balances
from tallyspark.plans import catalogue
from tests.conftest import duck, same_rows

SF = "/root/testdata/sf0.001"
STATE_ROW = "id long, flags array<string>, review_reasons array<string>, reason string, needs_review boolean"


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_queries_without_sql_run_whole(spark, name):
    frame = entry.queries()[name](spark, SF)
    assert all(len(r) == len(frame.columns) for r in frame.collect())


def test_only_matching_agrees_with_all_permutations():
    r = random.Random(4)
    for _ in range(400):
        n = r.randint(0, 5)
        edges = [{j for j in range(n) if r.random() < 0.45} for _ in range(n)]
        all_ = [list(p) for p in itertools.permutations(range(n)) if all(j in edges[i] for i, j in enumerate(p))]
        assert flows.only_matching(edges, n) == (all_[0] if len(all_) == 1 else None)
    assert flows.only_matching([set(range(i + 1)) for i in range(3000)], 3000) == list(range(3000))


def _reduced(spark, rows):
    full = [("f", "a", "s", "HKD", k, Decimal(v), p, n) for n, (k, v, p) in enumerate(rows)]
    got = statement_balances.reduce_over_pages(spark.createDataFrame(full, statement_balances.OBSERVED)).collect()
    return sorted((r.kind, int(r.value), r.page) for r in got)


def test_balances_roll_over_pages(spark):
    chain = [("opening", 1, 1), ("closing", 2, 1), ("opening", 2, 2), ("closing", 5, 2), ("opening", 5, 3), ("closing", 9, 3)]
    assert _reduced(spark, chain) == [("closing", 9, 3), ("opening", 1, 1)]
    broken = [*chain[:4], ("opening", 6, 3), chain[5]]
    assert _reduced(spark, broken) == sorted(broken)
    two_on_a_page = [*chain, ("opening", 7, 3)]
    assert _reduced(spark, two_on_a_page) == sorted(two_on_a_page)
    unused = [*chain[:2], ("closing", 3, 2), ("opening", 2, 3), ("closing", 9, 4)]
    assert _reduced(spark, unused) == sorted(unused)
    assert _reduced(spark, [("opening", 4, 1), ("opening", 4, 2)]) == [("opening", 4, 1), ("opening", 4, 2)]


def test_duplicate_state_is_replaced(spark):
    rows = spark.createDataFrame(
        [(1, ["duplicate_suspected", "x"], ["identity_issue"], "noted; Duplicate candidate [old] of 2", True), (2, [], [], None, False), (3, [], [], "", False), (4, ["overlap_history_ambiguous"], [], "Possible duplicate transaction", False)], STATE_ROW
    )
    members = spark.createDataFrame([(2, "g", 2), (3, "g", 2)], "id long, group_id string, n long")
    got = {r.id: r for r in annotations.annotate_duplicates(rows, members, spark.createDataFrame([(3,)], "id long")).collect()}
    assert (got[1].flags, got[1].review_reasons, got[1].reason, got[1].needs_review) == (["x"], [], "noted", False)
    assert (got[2].flags, got[2].review_reasons, got[2].needs_review) == (["duplicate_review_promoted", "duplicate_suspected"], ["identity_issue"], True)
    assert (got[3].flags, got[3].needs_review, got[3].reason) == (["duplicate_suspected"], False, "Duplicate candidate [g] of 2")
    assert (got[4].review_reasons, got[4].reason) == (["identity_issue"], "")
    empty = rows.limit(0)
    assert annotations.annotate_duplicates(empty, members, members.select("id")).count() == 0


def test_glob_patterns(spark):
    import fnmatch

    names = ["a.csv", "ab.csv", "x[1].csv", "a b.CSV", "", "n\nl", "é.pdf", "a-b"]
    for pattern in ("*", "*.csv", "?.csv", "[a-c]*", "[!a]*", "x[[]1].csv", "a[b-]*", "n?l", "a+b"):
        want = [n for n in names if fnmatch.fnmatchcase(n, pattern)]
        rows = spark.createDataFrame([(n,) for n in names], "name string")
        assert sorted(r.name for r in rows.filter(F.col("name").rlike(bindings.glob_pattern(pattern))).collect()) == sorted(want)


def test_no_mappings_no_rows(spark):
    row = spark.createDataFrame([("a",)], "name string").select(bindings.filename_mapping(F.col("name"), []).alias("m")).first().m
    assert (row.profile, row.binding, row.status) == (None, None, "none")


def test_structural_texts(spark):
    texts = {"CashBack earned": "Other>refund", "cash-rebate": "Other>refund", "cash back": None, "Interesting": None, "card settlement": "Credit Card Payment>credit_card_payment", "payment received": None}
    from tallyspark.operators.classify import structural

    rows = spark.createDataFrame(list(texts), "string").select("value", structural(F.col("value"), F.lit(1), F.lit("credit_card")).alias("f"))
    assert {r.value: r.f for r in rows.collect()} == texts


def test_missing_base_amount_takes_the_posted_one(spark):
    flow = flows.flow_type(F.lit("Dining"), F.lit(None).cast("double"), F.lit("bank"), F.lit(False), F.lit(False), F.lit(""), F.lit(None).cast("string"), F.lit(-3.0))
    assert spark.range(1).select(flow).first()[0] == "expense"


def test_states_of_identities(spark):
    full = ("src_" + "0" * 64, "ns_" + "a" * 64, "rev_" + "b" * 64, "rec_" + "c" * 64, "txn_" + "d" * 32)
    rows = [full, ("", None, "", "", "old"), (*full[:3], "", full[4]), (*full[:4], full[4] + "\n")]
    got = spark.createDataFrame(rows, "source_id string, source_namespace_id string, source_revision string, source_record_id string, transaction_id string").select(identity.identity_state(), identity.is_stable()).collect()
    assert [tuple(r) for r in got] == [("full", True), ("empty", False), ("partial", False), ("full", False)]


def test_decisions_normal_form(spark):
    rows = spark.createDataFrame([(" Internal_Transfer ",), ("leave-unresolved",), ("sell",), (None,)], "d string")
    assert [r[0] for r in rows.select(decisions.normal_decision(F.col("d"))).collect()] == ["internal-transfer", "unresolved", None, None]


def test_policy_without_threshold_accepts_nothing(spark):
    rows = spark.createDataFrame([("Dining", 1.0, -5.0, "o", [])], "suggested string, suggested_confidence double, amount double, owner string, flags array<string>")
    kinds = spark.createDataFrame([("Dining", "spending")], "category string, kind string")
    assert policy.judged_suggestions(rows, kinds, None).first().outcome == "reviewable" and policy.judged_suggestions(rows, kinds, 0.9).first().outcome == "accepted"


def test_no_diagnostics_no_first_error(spark):
    assert reports.first_error(spark.createDataFrame([], "code string, display string")).count() == 0


def test_fingerprint_matches_sql_on_all_bytes(spark):
    same_rows(catalogue.QUERIES["record_fingerprint"](spark, SF), duck(SF), catalogue.ORACLE_SQL["record_fingerprint"])


def test_the_evidence_of_a_group_is_written_out_once(spark):
    """Rows of a group share its text; it is not made anew for each of them after the join."""
    rows = spark.createDataFrame([(1, "g", None), (2, "g", None), (3, "g", 5), (4, None, None), (5, "h", None)], "id long, group_id string, amount_base int")
    evidence = spark.createDataFrame([("g", "f2", 1), ("g", "f1", 9), ("g", "f1", 10)], "group_id string, source_file string, source_row long")
    found = reports.missing_valuations(rows, evidence)
    assert {r.id: r.evidence for r in found.collect()} == {1: "f1:9,f1:10,f2:1", 2: "f1:9,f1:10,f2:1", 4: "", 5: ""}
    assert "array_join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_the_evidence_of_a_group_is_made_of_pieces_in_order(spark):
    n = 2 * reports.PIECE + 5
    evidence = spark.range(n).selectExpr("'g' AS group_id", "concat('f', CAST(id % 2 AS STRING)) AS source_file", f"id * 7 % {n} AS source_row").repartition(5)
    rows = spark.createDataFrame([(1, "g", None), (2, "h", None), (3, None, None)], "id long, group_id string, amount_base int")
    given = sorted((f"f{i % 2}", i * 7 % n) for i in range(n))
    assert {r.id: r.evidence for r in reports.missing_valuations(rows, evidence).collect()} == {1: ",".join(f"{f}:{row}" for f, row in given), 2: "", 3: ""}


def test_a_parquet_writer_holds_the_evidence_of_a_group_once(spark, tmp_path):
    """64 groups with texts of 36 kB, 40 rows each: 93 MB row by row, 2.3 MB in dictionaries, if no task has more than one holds."""
    groups, sources = 64, 3000
    evidence = spark.range(groups * sources).selectExpr(f"concat('g', CAST(id % {groups} AS STRING)) AS group_id", "'source' AS source_file", "id AS source_row")
    rows = spark.range(groups * 40).selectExpr("id", f"concat('g', CAST(id % {groups} AS STRING)) AS group_id", "CAST(NULL AS INT) AS amount_base")
    found = reports.missing_valuations(rows, evidence)
    found.write.parquet(str(tmp_path / "out"))
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 4_000_000
    written = spark.read.parquet(str(tmp_path / "out")).selectExpr("count(*) AS n", "count(DISTINCT evidence) AS texts", "min(size(split(evidence, ','))) AS sources").first()
    assert tuple(written) == (groups * 40, groups, sources)


def test_observations_travel_once(spark):
    rows = [(reader, "f", "a", "s", "HKD", "opening", Decimal(v), p) for reader, v, p in (("r", 1, 3), ("r", 1, 1), ("w", 1, 1), ("w", 2, None), (None, 2, 5), (None, 2, 5))]
    merged = statement_balances.merge_observations(spark.createDataFrame(rows, "reader string, file string, account_id string, section string, currency string, kind string, value decimal(20,2), page int"))
    assert sorted((int(r.value), r.n, r.pages) for r in merged.collect()) == [(1, 2, [1, 3]), (2, 2, [5])]
    # As many exchanges as there are tables: none before or after the one to the target.
    stated = merged.groupBy(*statement_balances.TARGET, "kind").count()
    assert stated._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_duplicate_counts_in_one_aggregate(spark):
    """Groups with more source rows than canonical ones, without a join of two tables of groups; a null is no canonical group."""
    members = spark.createDataFrame([(i, g) for i, g in enumerate([1, 1, 1, 2, 3, 3, None, None])], "id long, group_id long")
    canonical = spark.createDataFrame([(1, -1), (1, -2), (2, -3), (4, -4), (None, -5), (None, -6)], "group_id long, canonical_id long")
    counts = reports.duplicate_counts(members, canonical)
    assert [tuple(r) for r in counts.collect()] == [(3, 7)]
    assert "Join" not in counts._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in reports.duplicate_counts(members.limit(0), canonical).collect()] == [(0, 0)]
