import json
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark.functions.text import canonical_json
from tallyspark.sources import batches, sections, statements

SAVINGS = sections.Sections(
    accounts={"Savings": sections.Account("a1", "Savings one", "HKD"), "Foreign Currency": sections.Account("a2", "Foreign", "", True)},
    columns={"description": (50, 200), "deposit": (200, 300), "withdrawal": (300, 400), "currency": (400, 500)},
    date_regex=r"^(?P<day>\d{1,2}) (?P<month>[A-Z][a-z]{2})\b", year_regex=r"Statement (?P<statement_day>\d+) (?P<statement_month>\w+) (?P<year>\d{4})", file_year_regex=r"(?P<year>\d{4})",
    header=["date", "deposit"], ends=["total summary"], skip=["balance"], table_ends=["closing balance"],
)


def _lines(spark, *pages, path="f"):
    """Lines of words given as text@x0."""
    rows = []
    for p, page in enumerate(pages):
        for n, line in enumerate(page):
            words = [(w.rsplit("@", 1)[0], float(w.rsplit("@", 1)[1]), float(n)) for w in line.split("|")]
            rows.append((path, p, n, " ".join(w[0] for w in words), words))
    return spark.createDataFrame(rows, f"path string, page int, line int, text string, words {statements.WORDS}")


def test_section_rows(spark):
    one = ["Statement 31 March 2024@0", "5 Jan@0|ignored@60|1.00@210", "Account: SAVINGS@0", "Date@0|Deposit@210", "30 Dec@0|Salary@60", "of May@60|1,000.00@210", "Fee@60|2.50@310", "Zero@60|0.00@310", "5.00@310"]
    two = ["Foreign  Currency@0", "Date@0|Deposit@210", "2 Feb@0|USD@410|Swap@60|7.00@310", "Closing balance@60", "3 Feb@0|late@60|9.00@210", "Savings@0", "Date@0|Deposit@210", "Back@60|4.00@210", "Total Summary@0", "9.00@210"]
    got = [tuple(r)[1:] for r in sections.section_rows(_lines(spark, one, two).repartition(3), SAVINGS).orderBy("page", "line").collect()]
    savings, foreign = ("a1", "Savings one", "Savings", "HKD"), ("a2", "Foreign", "Foreign Currency", "USD")
    assert got == [
        (0, 5, date(2023, 12, 30), "Salary of May", "1,000.00", "", *savings), (0, 6, date(2023, 12, 30), "Fee", "", "2.50", *savings), (0, 8, date(2023, 12, 30), "Bank transaction", "", "5.00", *savings),
        (1, 2, date(2024, 2, 2), "Swap", "", "7.00", *foreign), (1, 7, date(2023, 12, 30), "Back", "4.00", "", *savings),
    ]


@pytest.mark.parametrize("page", [["Savings@0", "Date@0|Deposit@210", "x@60|1.00@210"], ["Foreign Currency@0", "Date@0|Deposit@210", "2 Feb@0|1.00@210"], ["Savings@0", "Date@0|Deposit@210", "2 Feb@0|1.00@210|1.00@310"]])
def test_section_rows_refuse(spark, page):
    with pytest.raises(Exception, match="amount before its date or currency|deposit and withdrawal in one line"):
        sections.section_rows(_lines(spark, page, path="s2024"), SAVINGS).collect()
    with pytest.raises(Exception, match="no statement year"):
        sections.section_rows(_lines(spark, page), SAVINGS).collect()


def test_section_rows_sort_twice(spark):
    """What a task sorts at once does not grow with the windows: one order of lines, one of runs, and the lines are read once."""
    rows = sections.section_rows(_lines(spark, ["Statement 31 March 2024@0", "Savings@0", "Date@0|Deposit@210", "30 Dec@0|Salary@60|5.00@210"]), SAVINGS)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") <= 2 and plan.count("Exchange hashpartitioning") == 1


def test_section_rows_interleaved(spark):
    """Days and currencies go on by account, also where two sections are one account's and the other's lines stand between."""
    layout = sections.Sections(**{**vars(SAVINGS), "accounts": {"Savings": sections.Account("a1", "One", "HKD"), "Foreign": sections.Account("a2", "Two", "EUR"), "Time": sections.Account("a1", "One", "HKD")}})
    head, page = ["Date@0|Deposit@210"], ["Statement 31 March 2024@0", "Savings@0"]
    page += [*head, "1 Jan@0|USD@410|a@60|1.00@210", "Foreign@0", *head, "2 Feb@0|b@60|2.00@210", "Time@0", *head, "c@60|3.00@210", *head, "closing balance@60", "d@60|4.00@210", *head, "e@60|5.00@210", "Foreign@0", *head, "f@60|6.00@310"]
    got = [(r.description, r.date, r.currency, r.account_id) for r in sections.section_rows(_lines(spark, page), layout).orderBy("line").collect()]
    first, second = (date(2024, 1, 1), "USD", "a1"), (date(2024, 2, 2), "EUR", "a2")
    assert got == [("a", *first), ("b", *second), ("c", *first), ("e", *first), ("f", *second)]


def test_balance_observations(spark):
    lines = _lines(spark, ["Savings@0", "Opening balance 10.00@0", "Foreign Currency fee@0", "Closing balance 1,250.5 DR@0", "Closing balance 3.00@0", "Now Foreign Currency@0", "USD total 5.00@0"], ["EUR total 6.00 cr@0", "Total summary@0", "Opening balance 9.00@0"])
    pages = spark.createDataFrame([("f", 0, [[["Savings\nOpening balance 10.00", "\nx"]]]), ("f", 1, [[["Opening balance 8.00"]]])], "path string, page int, tables array<array<array<string>>>")
    amount = r"(?P<balance>[\d,.]+) ?(?P<balance_sign>CR|DR)?"
    mappings = [sections.BalanceLine(f"opening balance {amount}", f"closing balance {amount}", section="Savings", currency="hkd", closing_requires_opening=True), sections.BalanceLine(closing=f"(?P<cur>[A-Z]{{3}}) total {amount}", account_id="a2", currency_group="cur")]
    got = sections.balance_observations(sections.balance_lines(pages, lines), SAVINGS, mappings)
    rows = sorted((r.reader, r.account_id, r.section, r.currency, r.kind, r.value, r.page) for r in got.collect())
    assert rows == [
        ("tables", "a1", "Savings", "HKD", "opening", Decimal("10.00"), 0),
        ("words", "a1", "Savings", "HKD", "closing", Decimal("-1250.50"), 0), ("words", "a1", "Savings", "HKD", "opening", Decimal("10.00"), 0),
        ("words", "a2", "Foreign Currency", "EUR", "closing", Decimal("6.00"), 1), ("words", "a2", "Foreign Currency", "USD", "closing", Decimal("5.00"), 0),
    ]


def test_cells(spark, tmp_path):
    (tmp_path / "w.json").write_text(json.dumps({"pages": [[{"text": "5", "x0": 60, "top": 1}, {"text": "1.00", "x0": 61, "top": 1}, {"text": "a", "x0": 1, "top": 1}]]}))
    found = statements.files(spark, str(tmp_path), "*.json")
    rows = statements.word_lines(found, {"d": (0, 50), "n": (50, 99)}, amounts={"n": r"^\d+\.\d\d$"})
    assert rows.first().cells == {"d": "a", "n": "1.00"}
    more = statements.joined_cells(rows, "all", ["d", "n"], "/")
    assert more.first().cells["all"] == "a/1.00" and statements.joined_cells(more, "all", ["d"]).first().cells["all"] == "a"
    assert statements.required_cells(rows, ["d", "n"]).count() == 1 and statements.required_cells(rows, ["d", "x"]).count() == 0


def test_dated_rows(spark):
    profile = statements.Profile("p", {"date": "D", "posting_date": "P"})
    make = lambda d, p: spark.createDataFrame([({"D": d, "P": p},)], "cells map<string,string>")
    assert statements.dated_rows(make("2024-01-02", ""), profile).count() == 1
    assert statements.dated_rows(make("", "2024-01-02"), profile).first().cells["P"] == "2024-01-02"
    for d, p, f in (("x", "2024-01-02", "date"), ("2024-01-02", "x", "posting_date"), ("", "", "date")):
        with pytest.raises(Exception, match=f"field={f}"):
            statements.dated_rows(make(d, p), profile).collect()


def test_paths(spark):
    rows = spark.createDataFrame([("/in/a/b.csv",), ("/other/c.csv",)], "p string")
    got = [(r.d, r.l.kind, r.l.text) for r in rows.select(statements.display_path(F.col("p"), "/in").alias("d"), statements.locator(F.col("p"), "/in/").alias("l")).collect()]
    assert got == [("a/b.csv", "workspace", "a/b.csv"), ("c.csv", "external", "/other/c.csv")]


def test_decisions(spark, tmp_path):
    (tmp_path / "a.csv").write_text('transaction_id,decision\nt1,"spend\ning"\nt2\nt3,x,\n')
    got = batches.decisions(spark, str(tmp_path / "a.csv")).orderBy("index").collect()
    assert [(r["index"], r.transaction_id, r.decision, r.problem is None) for r in got] == [(0, "t1", "spend\ning", True), (1, "t2", "", True), (2, "t3", "x", False)]
    (tmp_path / "a.json").write_text('[{"decision": "x", "transaction_id": "t"}, {"decision": 1, "transaction_id": "t"}, {"decision": "x"}, 3]')
    got = batches.decisions(spark, str(tmp_path / "a.json")).orderBy("index").collect()
    assert [(r["index"], r.transaction_id, r.problem is None) for r in got] == [(0, "t", True), (1, None, False), (2, None, False), (3, None, False)]
    (tmp_path / "b.json").write_text("{}")
    with pytest.raises(Exception, match="must be an array"):
        batches.decisions(spark, str(tmp_path / "b.json")).collect()
    (tmp_path / "b.csv").write_text("decision,transaction_id\n")
    with pytest.raises(ValueError):
        batches.decisions(spark, str(tmp_path / "b.csv"))


def test_corrections(spark, tmp_path):
    items = [{"transaction_id": " t1 ", "needs_review": True, "confidence": 0.5, "notes": ""}, {"transaction_id": "t2", "category": " "}, {"transaction_id": "t9", "owner": "o"}, {"transaction_id": "t3"}, {"transaction_id": "t4", "colour": "x", "owner": "o"}, {"owner": "o"}, 5, {"transaction_id": "t5", "owner": "o"}, {"transaction_id": "t5", "owner": "p"}, {"transaction_id": "t6", "needs_review": "maybe"}, {"transaction_id": "t7", "owner": None}]
    (tmp_path / "c.json").write_text(json.dumps(items))
    ids = spark.createDataFrame([(f"t{i}",) for i in range(1, 8)], "transaction_id string")
    got = batches.corrections(spark, str(tmp_path / "c.json"), ids)
    rows = got.orderBy("index").collect()
    assert (rows[0].transaction_id, rows[0].needs_review, rows[0].confidence, rows[0].notes, rows[0].owner, rows[0].problem) == ("t1", "true", "0.5", "", None, None)
    assert [r.problem for r in rows[1:]] == ["category is not valid", "the transaction_id is not in the ledger", "no field is set", "unknown fields: colour", "transaction_id is missing", "a correction must be an object", *["the transaction_id stands more than once"] * 2, "needs_review is not valid", "owner is not valid"]
    assert batches.refused(got.filter("index = 0")).count() == 1
    with pytest.raises(Exception, match="no field is set"):
        batches.refused(got.filter("index = 3")).collect()


def test_categories(spark, tmp_path):
    (tmp_path / "k.csv").write_text("x,category,transaction_id\n1, Food ,t1\n2,,\n3,A,t2\n4,B,t2\n")
    got = {r.transaction_id: (r.category, r.problem is None) for r in batches.categories(spark, str(tmp_path / "k.csv")).collect()}
    assert got == {"t1": ("Food", True), "t2": ("A", False)}
    (tmp_path / "l.csv").write_text("category\nA\n")
    with pytest.raises(ValueError):
        batches.categories(spark, str(tmp_path / "l.csv"))


def test_canonical_json(spark):
    row = spark.createDataFrame([(1, "é\"", None, [Decimal("1.50")])], "b int, a string, c string, d array<decimal(5,2)>")
    assert row.select(canonical_json("b", "a", "c", "d").alias("j")).first().j == '{"a":"é\\"","b":1,"c":null,"d":[1.50]}'


def test_duplicate_decisions(spark):
    from tallyspark.operators import duplicates

    members = spark.createDataFrame([("g", "a"), ("g", "b"), ("h", "a"), ("k", "a"), ("k", "a")], "group_id string, id string")
    ids = {r.group_id: r.review_group_id for r in duplicates.review_groups(members.repartition(3)).collect()}
    assert len(set(ids.values())) == 3 and ids == {r.group_id: r.review_group_id for r in duplicates.review_groups(members.coalesce(1)).collect()}
    groups = spark.createDataFrame([(g, ids[g], "ambiguous_count_mismatch", None) for g in "gh"], "group_id string, review_group_id string, provenance_status string, decision string")
    asked = spark.createDataFrame([(ids["g"], "keep-all"), (ids["h"], "keep-all"), (ids["h"], "same-event"), (ids["k"], "keep-all"), ("x", "keep-all"), (ids["g"], None)], "review_group_id string, choice string")
    judged = duplicates.judged_decisions(asked, groups, spark.createDataFrame([(ids["k"],)], "review_group_id string"))
    assert sorted((r.group_id or "", r.outcome) for r in judged.collect()) == [("", "stale"), ("", "unknown"), ("g", "applied"), ("g", "invalid"), ("h", "applied"), ("h", "applied")]
    assert {r.group_id: r.decision for r in duplicates.decided_groups(groups, judged).collect()} == {"g": "keep-all", "h": None}
