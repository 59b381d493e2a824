import hashlib
import hmac
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import text
from tallyspark.operators import classify, flows, overlap, review, valuation
from tallyspark.sources import statements
from tallyspark.sources.generations import Generations
from tallyspark.sources.tables import read_csv, write_csv


def one(spark, column, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column.alias("x")).first().x


def test_cells(spark):
    c = F.col("c")
    assert one(spark, text.parsed_amount(c), "1,234.50 CR") == Decimal("1234.5") and one(spark, text.parsed_amount(c), "12.5DR") == Decimal("-12.5")
    assert one(spark, text.safe_decimal(c), "NaN") is None and one(spark, text.safe_decimal(c), "") is None
    assert one(spark, text.iso_date(c), "2026") is None and one(spark, text.iso_date(c), "2026-5-1") is None and str(one(spark, text.iso_date(c), "2026-05-01")) == "2026-05-01"
    assert one(spark, text.money(c), Decimal("2.345"), "decimal(10,3)") == Decimal("2.34") and one(spark, text.money(c), Decimal("2.355"), "decimal(10,3)") == Decimal("2.36")
    assert one(spark, text.canonical_decimal(c), Decimal("-0.00"), "decimal(10,2)") == "0" and one(spark, text.canonical_decimal(c), Decimal("10.50"), "decimal(10,2)") == "10.5"
    assert one(spark, text.folded("NFKC")(c), "  Straße\tÉ ") == "strasse é"
    assert one(spark, text.csv_plain(text.csv_safe(c)), "=1+1") == "=1+1" and one(spark, text.csv_safe(c), " -x").startswith(text.SAFE_PREFIX)


def test_digests(spark):
    parts = [F.lit("a"), F.lit("é")]
    frame = b"tally1\0" + (3).to_bytes(4, "big") + b"dom" + (2).to_bytes(4, "big") + (1).to_bytes(8, "big") + b"a" + (2).to_bytes(8, "big") + "é".encode()
    assert one(spark, text.framed_sha256("p_", "dom", *parts)) == "p_" + hashlib.sha256(frame).hexdigest()
    assert one(spark, text.framed_hmac(b"key", "k_", "dom", *parts)) == "k_" + hmac.new(b"key", frame, "sha256").hexdigest()


def test_rate_age(spark):
    rates = spark.sql("select 'USD' currency, date'2024-01-10' date, cast(7.8 as decimal(17,8)) rate")
    asked = spark.sql("select 'USD' currency, explode(array(date'2024-01-09', date'2024-01-10', date'2024-01-17', date'2024-01-18')) date")
    got = {str(r.date): r.asof_rate for r in valuation.asof_rates(asked, rates).collect()}
    assert [got[d] is not None for d in sorted(got)] == [False, True, True, False]


def test_transfers(spark):
    rows = [("o1", "2024-01-01", "a", -5), ("i1", "2024-01-02", "b", 5), ("i2", "2024-01-03", "c", 5), ("o3", "2024-02-01", "a", -7), ("i3", "2024-02-02", "b", 7), ("i4", "2024-02-02", "c", 7), ("o5", "0001-01-01", "a", -9), ("i5", "9999-12-31", "b", 9), ("o6", "2024-03-01", "a", -3), ("i6", "2024-03-01", "a", 3)]
    df = spark.createDataFrame([(i, d, a, "bank", Decimal(x), "unresolved", "deterministic") for i, d, a, x in rows], "id string, date string, account_id string, account_type string, amount_base decimal(18,2), flow_type string, flow_source string").withColumn("date", F.to_date("date"))
    candidates = flows.transfer_candidates(df)
    pairs = flows.transfer_pairs(candidates)
    assert [(r.out_id, r.in_id, r.confidence) for r in pairs.collect()] == [("o1", "i1", Decimal("0.95"))]
    status = {r.id: r.reconciliation_status for r in flows.transfer_status(df, candidates, pairs).collect()}
    assert status["i2"] == status["o3"] == status["i3"] == "ambiguous" and status["o5"] == status["o6"] == "not_applicable"


def test_exchange_needs_one_matching(spark):
    def leg(i, day, base, amount):
        return (i, day, "bank", "HKD" if base else "USD", float(amount), base, 7.8)

    legs = spark.createDataFrame([leg("a", "d1", True, -780), leg("b", "d1", False, 100), leg("c", "d2", True, -780), leg("d", "d2", True, -781), leg("e", "d2", False, 100), leg("f", "d2", False, 100.1)], "id string, date string, institution string, currency string, amount double, is_base boolean, reference double")
    assert [(r.out_id, r.in_id) for r in flows.exchange_pairs(legs).collect()] == [("a", "b")]


def test_exchange_without_inflow_has_no_rate(spark):
    """Where all inflows of a day are 0 there is no rate: no pair and no division by zero."""
    def leg(i, day, base, amount):
        return (i, day, "bank", "HKD" if base else "USD", Decimal(amount), base, 1.0)

    rows = [leg("a", "d1", True, "-5.00"), leg("b", "d1", False, "0.00"), leg("c", "d2", True, "-4.00"), leg("d", "d2", False, "4.00"), leg("e", "d3", True, "0.00"), leg("f", "d3", True, "-2.00"), leg("g", "d3", False, "0.00"), leg("h", "d3", False, "2.00")]
    legs = spark.createDataFrame(rows, "id string, date string, institution string, currency string, amount decimal(18,2), is_base boolean, reference double")
    assert [(r.out_id, r.in_id) for r in flows.exchange_pairs(legs).collect()] == [("c", "d")]


def test_overlap_and_slots(spark):
    rows = spark.createDataFrame([("f", "s1")] * 2 + [("f", "s2")] + [("g", "s1")], "fp string, source string")
    counts = overlap.overlap_counts(rows, ["fp"], "source")
    got = {r.fp: (r.source_counts, r.keep_all, r.same_event, r.status) for r in counts.collect()}
    assert got == {"f": ([1, 2], 2, 1, "ambiguous_count_mismatch"), "g": ([1], 1, 1, "single_source")}
    keyed = overlap.overlap_slots(counts).withColumn("group_id", F.col("fp")).withColumn("slot_id", overlap.slot_id(b"k"))
    assert keyed.select("slot_id").distinct().count() == 3


def test_rules(spark):
    rules = [classify.Rule("m", category="A", patterns=["x"], fields=["t"], priority=9, managed=True), classify.Rule("n", category="B", patterns=["x"], fields=["t"])]
    assert [r.id for r in classify.ranked(rules)] == ["n", "m"]
    got = [r.rule_id for r in classify.apply_rules(spark.createDataFrame([("xx",), (None,)], "t string"), rules).collect()]
    assert got == ["n", None]
    with pytest.raises(ValueError):
        classify.validate_rules([classify.Rule("a"), classify.Rule("a")])


def test_balances(spark):
    rows = [("a", "s", "m", "HKD", "bank", Decimal(5), Decimal(10), None), ("a", "s", "m", "HKD", "bank", Decimal(-2), None, Decimal(13)), ("c", "s", "m", "HKD", "credit_card", Decimal(-5), Decimal(10), Decimal(15)), ("d", "s", "m", None, "bank", Decimal(1), None, None)]
    s = review.balances(spark.createDataFrame(rows, "account_id string, source_id string, section string, currency string, account_type string, posted_amount decimal(18,2), opening decimal(20,2), closing decimal(20,2)"))
    assert {r.account_id: r.status for r in s.collect()} == {"a": "matched", "c": "matched", "d": "unavailable"}


def test_statement_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Date,Description,Amount,Currency\n2024-01-02,"two\nlines",-5.00,usd\n2024-01-03,Opening balance,9,usd\nbad,x,oops,\n')
    profile = statements.Profile("p", {"date": "Date", "description": "Description", "amount": "Amount", "currency": "Currency"}, currency="HKD")
    raw = statements.csv_rows(statements.files(spark, str(tmp_path)))
    rows = statements.normalize(raw, profile).orderBy("logical_row").collect()
    assert [(r.physical_row, r.logical_row, r.posted_amount, r.posted_currency) for r in rows] == [(2, 1, Decimal("-5.00"), "USD"), (5, 3, Decimal("0.00"), "HKD")]
    assert rows[1].date_raw == "bad" and "invalid_amount" in rows[1].flags and "source_data_issue" in rows[1].review_reasons
    assert statements.profile_for({"Date", "Description", "Amount", "Currency"}, [profile]) is profile


def test_extracted_pages(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"pages": [{"tables": [[["01 Jan\\n02 Jan", "a\\nb", "5"]]]}]}')
    (tmp_path / "w.words").write_text('{"pages": [[{"text": "b", "x0": 60, "top": 11}, {"text": "a", "x0": 10, "top": 10}, {"text": "c", "x0": 10, "top": 20}]]}')
    cells = [r.cells for r in statements.table_rows(statements.files(spark, str(tmp_path), "*.json"), ["d", "t", "n"]).orderBy("line").collect()]
    assert cells == [{"d": "01 Jan", "t": "a", "n": "5"}, {"d": "02 Jan", "t": "b", "n": ""}]
    lines = statements.word_lines(statements.files(spark, str(tmp_path), "*.words"), {"l": (0, 50), "r": (50, 99)}).orderBy("line").collect()
    assert [r.cells for r in lines] == [{"l": "a", "r": "b"}, {"l": "c", "r": ""}]


def test_rate_document(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"result": {"records": [{"end_of_day": "2024-01-02", "usd": 7.8, "eur": null}]}}')
    got = statements.rate_document(statements.files(spark, str(tmp_path), "*.json"), ["usd", "eur"]).collect()
    assert [(r.currency, str(r.date), r.rate) for r in got] == [("USD", "2024-01-02", Decimal("7.80000000"))]


def test_tables(spark, tmp_path):
    rows = spark.createDataFrame([("=x", Decimal("-5.00"), ["a", "b"]), (None, None, [])], "merchant string, posted_amount decimal(20,2), flags array<string>")
    write_csv(rows, str(tmp_path / "c"), ["merchant", "posted_amount", "flags"])
    back = sorted(tuple(r) for r in read_csv(spark, str(tmp_path / "c"), ["merchant", "posted_amount", "flags", "notes"]).collect())
    assert back == [("", "", "", ""), ("=x", "-5.00", "a;b", "")]
    g = Generations(spark, str(tmp_path / "g"))
    assert g.current() is None
    first = g.commit({"ledger": rows}, None)
    second = g.commit({"ledger": rows.limit(1)}, first)
    assert g.current() == second and g.read("ledger").count() == 1 and g.read("ledger", first).count() == 2
    with pytest.raises(RuntimeError):
        g.commit({"ledger": rows}, first)
