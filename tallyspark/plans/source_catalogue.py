"""Registered queries over statements, batches and files, shaped as lines and cells from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions.text import canonical_json
from tallyspark.operators import duplicates, statement_balances
from tallyspark.plans.catalogue import query
from tallyspark.plans.shapes import table
from tallyspark.sources import sections, statements

LAYOUT = sections.Sections(
    accounts={"Savings": sections.Account("a1", "Savings one", "HKD"), "Card": sections.Account("a2", "Card one", "", True)},
    columns={"description": (100, 200), "deposit": (200, 300), "withdrawal": (300, 400), "currency": (400, 500)},
    date_regex=r"^(?P<day>\d{1,2}) (?P<month>[A-Z][a-z]{2})\b", year_regex=r"Statement (?P<statement_day>\d+) (?P<statement_month>[A-Z][a-z]+) (?P<year>\d{4})", header=["date", "deposit"],
)
_WORD = "named_struct('text', {}, 'x0', CAST({} AS DOUBLE), 'top', 0D)"
_PAGE = "CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS INT)"
_PRICE = "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR(30))"


def _lines(rows, path, page, line, *words):
    shaped = rows.selectExpr(f"{path} AS path", f"{page} AS page", f"CAST({line} AS INT) AS line", f"array({', '.join(_WORD.format(*w) for w in words)}) AS words")
    return shaped.withColumn("text", F.array_join(F.transform("words", lambda w: w["text"]), " "))


@query(f"""SELECT concat('c', CAST(o_custkey AS VARCHAR)) AS path, {_PAGE} AS page, make_date(CASE WHEN month(o_orderdate) > 3 THEN 1997 ELSE 1998 END, month(o_orderdate), least(day(o_orderdate), 28)) AS date, o_orderpriority AS description, CASE WHEN o_orderkey % 2 = 0 THEN {_PRICE} ELSE '' END AS deposit,
    CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE {_PRICE} END AS withdrawal, CASE {_PAGE} WHEN 0 THEN 'a1' ELSE 'a2' END AS account_id, CASE {_PAGE} WHEN 0 THEN 'Savings' ELSE 'Card' END AS section, CASE {_PAGE} WHEN 0 THEN 'HKD' ELSE 'USD' END AS currency FROM orders""")
def sectioned_statements(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").selectExpr("*", f"{_PAGE} AS page", "concat('c', CAST(o_custkey AS STRING)) AS path")
    orders = orders.selectExpr("*", "row_number() OVER (PARTITION BY path, page ORDER BY o_orderkey) + 2 AS n")
    pages = orders.select("path", "page").distinct()
    lines = _lines(pages.select("path").distinct(), "path", "0", 0, ("'Statement'", 0), ("'31 March 1998'", 50))
    lines = lines.unionByName(_lines(pages, "path", "page", 1, ("CASE page WHEN 0 THEN 'Savings' ELSE 'Card' END", 0)))
    lines = lines.unionByName(_lines(pages, "path", "page", 2, ("'Date'", 0), ("'Deposit'", 200)))
    day = "concat(CAST(least(day(o_orderdate), 28) AS STRING), ' ', date_format(o_orderdate, 'MMM'))"
    lines = lines.unionByName(_lines(orders, "path", "page", "n", (day, 0), ("o_orderpriority", 100), (_PRICE, "CASE WHEN o_orderkey % 2 = 0 THEN 200 ELSE 300 END"), ("CASE page WHEN 0 THEN '' ELSE 'USD' END", 400)))
    return sections.section_rows(lines, LAYOUT).drop("line", "account")


_BALANCE = "CAST(abs(c_acctbal) AS DECIMAL(20,2))"
_STATED = [sections.BalanceLine(*(rf"{kind} balance (?P<balance>[\d,.]+) (?P<balance_sign>CR|DR)" for kind in ("opening", "closing")), section="Savings", currency="hkd")]


# Two pages a customer: the second one goes on where the first ends, for every fifth customer it does not.
@query(f"""WITH b AS (SELECT concat('c', CAST(c_custkey AS VARCHAR)) AS file, {_BALANCE} * CASE WHEN c_acctbal < 0 THEN -1 ELSE 1 END AS opening, {_BALANCE} + 100 AS closing, {_BALANCE} + CASE WHEN c_custkey % 5 = 0 THEN 150 ELSE 100 END AS again, {_BALANCE} + 200 AS last, c_custkey % 5 = 0 AS broken FROM customer),
    o AS (SELECT file, 'opening' AS kind, opening AS value, '0' AS pages FROM b UNION ALL SELECT file, 'closing', last, '1' FROM b UNION ALL SELECT file, 'closing', closing, '0' FROM b WHERE broken UNION ALL SELECT file, 'opening', again, '1' FROM b WHERE broken)
    SELECT file, 'a1' AS account_id, 'Savings' AS section, 'HKD' AS currency, kind, CAST(value AS DECIMAL(20,2)) AS value, count(*) AS n, string_agg(pages, ',' ORDER BY pages) AS pages FROM o GROUP BY file, kind, value""")
def stated_balances(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr(
        "concat('c', CAST(c_custkey AS STRING)) AS path", f"concat('Opening balance ', {_BALANCE}, CASE WHEN c_acctbal < 0 THEN ' DR' ELSE ' CR' END) AS opening", f"concat('Closing balance ', {_BALANCE} + 100, ' CR') AS closing",
        f"concat('Opening balance ', {_BALANCE} + CASE WHEN c_custkey % 5 = 0 THEN 150 ELSE 100 END, ' CR') AS again", f"concat('Closing balance ', {_BALANCE} + 200, ' CR') AS last")
    first, second = F.array(F.lit("Savings"), "opening", "closing"), F.array(F.lit("Savings"), "again", "last")
    pages = rows.select("path", F.posexplode(F.array(first, second)).alias("page", "texts"))
    lines = pages.select("path", "page", F.posexplode("texts").alias("line", "text"))
    tables = pages.select("path", "page", F.array(F.transform("texts", lambda t: F.array(t))).alias("tables"))
    seen = sections.balance_observations(sections.balance_lines(tables, lines), LAYOUT, _STATED)
    return statement_balances.merge_observations(statement_balances.reduce_over_pages(seen)).withColumn("pages", F.array_join("pages", ","))


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, concat_ws('/', o_orderpriority, nullif(CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END, '')) AS description FROM orders WHERE o_orderkey % 5 <> 0""")
def statement_cells(spark, sf_dir):
    cells = F.create_map(
        F.lit("Date"), F.date_format("o_orderdate", "dd MMM yyyy"), F.lit("Type"), F.col("o_orderpriority"),
        F.lit("Mark"), F.expr("CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE o_orderstatus END"), F.lit("Amount"), F.expr(f"CASE WHEN o_orderkey % 5 = 0 THEN ' ' ELSE {_PRICE} END"),
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", cells.alias("cells"))
    profile = statements.Profile("p", {"date": "Date", "description": "Text", "amount": "Amount"}, date_formats=["%Y-%m-%d", "%d %b %Y"], currency="HKD")
    rows = statements.dated_rows(statements.joined_cells(statements.required_cells(rows, ["Date", "Amount"]), "Text", ["Type", "Mark"], "/"), profile)
    return statements.normalize(rows, profile).select("o_orderkey", "date", F.col("original_description").alias("description"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN concat('n', CAST(s_nationkey AS VARCHAR), '/', s_name, '.csv') ELSE concat(s_name, '.csv') END AS display, CASE WHEN s_suppkey % 3 = 0 THEN 'workspace' ELSE 'external' END AS kind, concat(CASE WHEN s_suppkey % 3 = 0 THEN 'n' ELSE '/workbook/n' END, CAST(s_nationkey AS VARCHAR), '/', s_name, '.csv') AS locator FROM supplier""")
def source_locators(spark, sf_dir):
    path = F.expr("concat(CASE WHEN s_suppkey % 3 = 0 THEN '/work/n' ELSE '/workbook/n' END, CAST(s_nationkey AS STRING), '/', s_name, '.csv')")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", statements.display_path(path, "/work").alias("display"), statements.locator(path, "/work").alias("l"))
    return rows.select("s_suppkey", "display", F.col("l.kind").alias("kind"), F.col("l.text").alias("locator"))


@query("""SELECT concat('{"amount":', CAST(CAST(s_acctbal AS DECIMAL(18,2)) AS VARCHAR), ',"id":', CAST(s_suppkey AS VARCHAR), ',"name":"', s_name, '","note":null}') AS line FROM supplier""")
def manifest_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "s_name AS name", "CAST(s_acctbal AS DECIMAL(18,2)) AS amount", "CAST(NULL AS STRING) AS note")
    return rows.select(canonical_json("name", "id", "note", "amount").alias("line"))


_LOOK = {
    "provenance_status": "CASE WHEN group_id % 4 = 0 THEN 'single_source' ELSE 'ambiguous_count_mismatch' END",
    "decision": "CASE group_id % 5 WHEN 0 THEN 'keep-all' WHEN 1 THEN 'same-event' END",
    "choice": "CASE WHEN group_id % 7 = 0 THEN 'maybe' WHEN group_id % 2 = 0 THEN 'keep-all' ELSE 'same-event' END",
}


def _duplicates(spark, sf_dir):
    """Line items by supplier as groups of occurrences, the groups now, and those before the seventh lines came."""
    items = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS group_id", "concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS id", "l_linenumber", "l_returnflag AS source", "l_quantity AS amount")
    now, before = duplicates.review_groups(items), duplicates.review_groups(items.filter("l_linenumber < 7"))
    return items, now.selectExpr("group_id", "review_group_id", f"{_LOOK['provenance_status']} AS provenance_status", f"{_LOOK['decision']} AS decision"), before


def _judged(groups, before):
    old = before.select("group_id", F.col("review_group_id").alias("old"))
    asked = groups.join(old, "group_id", "left").selectExpr("group_id AS asked", "CASE group_id % 3 WHEN 0 THEN review_group_id WHEN 1 THEN old ELSE concat('dup_', group_id) END AS review_group_id", f"{_LOOK['choice']} AS choice")
    return duplicates.judged_decisions(asked, groups, before)


_JUDGED = f"""g AS (SELECT l_suppkey AS group_id, count(*) FILTER (WHERE l_linenumber >= 7) AS late, count(*) AS n FROM lineitem GROUP BY 1), l AS (SELECT *, {', '.join(f'{e} AS {c}' for c, e in _LOOK.items())}, CASE WHEN group_id % 3 = 0 OR (group_id % 3 = 1 AND late = 0) THEN 'now' WHEN group_id % 3 = 1 AND late < n THEN 'old' ELSE 'never' END AS seen FROM g),
    j AS (SELECT *, CASE WHEN choice = 'maybe' THEN 'invalid' WHEN seen = 'never' THEN 'unknown' WHEN seen = 'old' OR provenance_status = 'single_source' THEN 'stale' WHEN decision IS NULL THEN 'applied' WHEN decision = choice THEN 'already' ELSE 'conflict' END AS outcome FROM l)"""


@query(f"WITH {_JUDGED} SELECT group_id AS asked, choice, outcome FROM j")
def duplicate_decisions(spark, sf_dir):
    _, groups, before = _duplicates(spark, sf_dir)
    return _judged(groups, before).select("asked", "choice", "outcome")


@query(f"""WITH {_JUDGED} SELECT l_suppkey AS group_id, concat(CAST(l_orderkey AS VARCHAR), '-', CAST(l_linenumber AS VARCHAR)) AS occurrence_id, l_returnflag AS source FROM lineitem JOIN j ON group_id = l_suppkey WHERE provenance_status = 'ambiguous_count_mismatch' AND decision IS NULL AND outcome <> 'applied'""")
def open_duplicates(spark, sf_dir):
    items, groups, before = _duplicates(spark, sf_dir)
    return duplicates.open_occurrences(duplicates.decided_groups(groups, _judged(groups, before)), items, ["source"]).drop("review_group_id")
