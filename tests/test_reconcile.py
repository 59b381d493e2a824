from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from tallyspark.operators import flows, reconcile

SCHEMA = """id string, date date, account_id string, account_type string, institution string, owner string, category string, posted_amount decimal(18,2), posted_currency string, amount_base decimal(18,2),
    flow_type string, flow_source string, marker string, reason string, needs_review boolean, flags array<string>, review_reasons array<string>"""


def row(id, day, account, amount, kind="bank", currency="HKD", base=True, **more):
    amount = Decimal(amount)
    values = {
        "id": id, "date": date(2024, 1, day), "account_id": account, "account_type": kind, "institution": "b", "owner": "me", "category": "Unknown", "posted_amount": amount, "posted_currency": currency,
        "amount_base": amount if base else None, "flow_type": None, "flow_source": None, "marker": None, "reason": "", "needs_review": False, "flags": [], "review_reasons": [],
    }
    return tuple((values | more).values())


def run(rows, exchange=None):
    return reconcile.reconcile(rows, F.lit(True), F.lit(False), exchange)


def by_id(frame):
    return {r.id: r for r in frame.collect()}


def test_pairs_leave_the_candidates_of_later_stages(spark):
    rows = spark.createDataFrame([row("a", 1, "x", "-5", marker="m"), row("b", 1, "x", "5", marker="m"), row("c", 1, "y", "5"), row("d", 2, "z", "-5"), row("e", 9, "x", "-7", marker="n")], SCHEMA)
    got = by_id(run(rows).rows)
    # Without the claim of the pair set by hand, b and d would both be candidates.
    assert {k: r.paired_id for k, r in got.items()} == {"a": "b", "b": "a", "c": "d", "d": "c", "e": None}
    assert got["a"].flow_source == "correction" and got["c"].reconciliation_confidence == Decimal("0.95")
    assert (got["e"].reconciliation_status, got["e"].flags, got["e"].review_reasons) == ("unmatched", ["manual_transfer_pair_invalid"], ["accounting_flow", "category_decision"])


def test_running_twice_pairs_the_same(spark):
    known = {"category": "Dining"}
    rows = [row("o", 1, "x", "-5", **known), row("i", 2, "y", "5", **known), row("j", 2, "z", "5", needs_review=True, review_reasons=["ownership"], owner="Unknown", **known), row("p", 3, "q", "-9"), row("r", 3, "s", "9", kind="credit_card"), row("k", 7, "x", "-8", marker="m")]
    once = run(spark.createDataFrame(rows, SCHEMA)).rows
    twice = run(once.drop(*reconcile.RESULT)).rows
    kept = lambda frame: {k: (r.flow_type, r.flow_source, r.category, *(r[c] for c in reconcile.RESULT)) for k, r in by_id(frame).items()}
    assert kept(twice) == kept(once)
    assert by_id(once)["o"].reconciliation_status == "ambiguous" and by_id(once)["r"].flow_type == "credit_card_payment"


def test_taking_back_restores_the_review_of_before(spark):
    rows = [row("o", 1, "x", "-5"), row("i", 2, "y", "5"), row("j", 2, "z", "5", needs_review=True, review_reasons=["ownership"], owner="Unknown", category="Dining"), row("k", 2, "w", "5", category="Dining")]
    marked = run(spark.createDataFrame(rows, SCHEMA)).rows
    got = by_id(marked)
    assert got["j"].flags == ["reconciliation_ambiguous_prior_review", "reconciliation_ambiguous"] and got["k"].review_reasons == ["accounting_flow"]
    alone = by_id(run(marked.filter("id in ('j', 'k')").drop(*reconcile.RESULT)).rows)
    assert (alone["k"].flags, alone["k"].review_reasons, alone["k"].needs_review, alone["k"].reason) == ([], [], False, "")
    assert alone["j"].flags == [] and alone["j"].needs_review and "ownership" in alone["j"].review_reasons


def test_an_exchange_values_its_foreign_side(spark):
    rows = spark.createDataFrame([row("o", 1, "x", "-780"), row("f", 1, "y", "100", currency="USD", base=False), row("t", 1, "z", "780", kind="investment")], SCHEMA)
    legs = rows.filter("id <> 't'").select("id", "date", "institution", F.col("posted_currency").alias("currency"), F.col("posted_amount").alias("amount"), (F.col("posted_currency") == "HKD").alias("is_base"), F.lit(7.8).alias("reference"))
    got = by_id(run(rows, legs).rows)
    assert got["f"].amount_base == Decimal(780) and got["f"].flags == ["cross_currency_exchange"] and got["o"].paired_id == "f"
    assert got["t"].reconciliation_status == "not_applicable"


def test_explicit_flows_stay(spark):
    rows = spark.createDataFrame([row("o", 1, "x", "-5", flow_type="internal_transfer", flow_source="rule"), row("i", 1, "y", "5"), row("u", 9, "x", "-6", flow_type="internal_transfer", flow_source="correction")], SCHEMA)
    got = by_id(run(rows).rows)
    assert (got["o"].flow_source, got["i"].flow_source, got["u"].reconciliation_status) == ("rule", "reconciliation", "unmatched")


def test_only_candidates_are_written_on_the_way(spark, monkeypatch):
    """Wide rows are not staged: they travel once, to what was found on narrow columns."""
    names, kept = [], reconcile.staged
    monkeypatch.setattr(reconcile, "staged", lambda rows, name: (names.append(name), kept(rows, name))[1])
    rows = spark.createDataFrame([row("a", 1, "x", "-5", marker="m"), row("b", 1, "x", "5", marker="m"), row("c", 1, "y", "5"), row("d", 2, "z", "-5")], SCHEMA)
    assert by_id(run(rows).rows)["c"].paired_id == "d" and names == ["candidates"]


def test_candidates_over_all_edges_of_buckets(spark):
    days = range(1, 29)
    rows = spark.createDataFrame([row(f"o{d}", d, "x", "-5") for d in days] + [row(f"i{d}", d, "y", "5") for d in days], SCHEMA)
    got = sorted((r.out_id, r.in_id, r.days) for r in flows.transfer_candidates(rows).collect())
    assert got == sorted((f"o{a}", f"i{b}", abs(a - b)) for a in days for b in days if abs(a - b) <= 3)
