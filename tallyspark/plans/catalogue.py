"""Registered queries over the driver tables, each with the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.text import add_reason, csv_safe, direction, merchant_signature
from tallyspark.operators import classify, flows, overlap, review, valuation
from tallyspark.plans.shapes import LEDGER_SQL, ledger, legs, legs_sql, table
from tallyspark.sources.staging import staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def _flow_sums(amount: str = "amount_base") -> str:
    out = []
    for name, when in (("actual", "valuation_status = 'actual'"), ("estimated", "valuation_status = 'estimated'"), ("combined", "TRUE")):
        for measure, flows_in in (("income", "'income'"), ("spending", "'expense'"), ("refunds", "'refund'"), ("net", "'income', 'expense', 'refund'")):
            out.append(f"CAST(coalesce(sum(CASE WHEN {when} AND flow_type IN ({flows_in}) THEN {amount} END), 0) AS DECIMAL(30,2)) AS {measure}_{name}")
    return ", ".join(out)


@query(f"WITH {LEDGER_SQL} SELECT CAST(date_trunc('month', date) AS DATE) AS month, owner, {_flow_sums()} FROM ledger GROUP BY 1, 2")
def cash_flow_monthly(spark, sf_dir):
    return valuation.cash_flow(ledger(spark, sf_dir).withColumn("month", F.trunc("date", "month")), "month", "owner")


@query(f"""WITH {LEDGER_SQL} SELECT owner,
    CAST(coalesce(sum(CASE WHEN flow_type IN ('expense', 'refund') THEN amount_base END), 0) AS DECIMAL(30,2)) AS spending,
    CAST(coalesce(sum(CASE WHEN flow_type = 'income' THEN amount_base END), 0) AS DECIMAL(30,2)) AS income,
    CAST(coalesce(sum(CASE WHEN flow_type IN ('income', 'expense', 'refund') THEN amount_base END), 0) AS DECIMAL(30,2)) AS net,
    CAST(coalesce(sum(CASE WHEN flow_type = 'unresolved' AND amount_base > 0 THEN amount_base END), 0) AS DECIMAL(30,2)) AS unresolved_inflow,
    CAST(coalesce(sum(CASE WHEN flow_type = 'unresolved' AND amount_base < 0 THEN amount_base END), 0) AS DECIMAL(30,2)) AS unresolved_outflow,
    count(*) FILTER (WHERE category IN ('', 'Unknown')) AS uncategorized FROM ledger GROUP BY owner""")
def headline_flow_summary(spark, sf_dir):
    return valuation.headline(ledger(spark, sf_dir), "owner")


@query(f"""WITH {LEDGER_SQL} SELECT owner, count(*) FILTER (WHERE amount_base IS NULL) AS missing,
    count(*) FILTER (WHERE valuation_status = 'estimated') AS estimated,
    count(*) FILTER (WHERE amount_base IS NULL AND flow_type IN ('income', 'expense', 'refund') AND posted_amount <> 0) AS blocking,
    count(*) FILTER (WHERE amount_base IS NULL AND flow_type = 'internal_transfer') AS excluded,
    count(*) FILTER (WHERE amount_base IS NULL AND flow_type = 'unresolved') AS unresolved,
    count(*) FILTER (WHERE amount_base IS NULL AND flow_type IN ('income', 'expense', 'refund') AND posted_amount = 0) AS zero,
    CAST(0 AS BIGINT) AS other,
    count(*) FILTER (WHERE amount_base IS NULL AND flow_type IN ('income', 'expense', 'refund') AND posted_amount <> 0) = 0 AS complete
    FROM ledger GROUP BY owner""")
def missing_valuation_breakdown(spark, sf_dir):
    return valuation.missing_breakdown(ledger(spark, sf_dir), "owner")


STATUSES = ["actual", "estimated", "missing"]


@query(f"""WITH {LEDGER_SQL}, words AS (SELECT unnest(['actual', 'estimated', 'missing']) AS valuation_status)
    SELECT w.valuation_status, count(l.id) AS n FROM words w LEFT JOIN ledger l ON l.valuation_status = w.valuation_status GROUP BY 1""")
def valuation_histogram(spark, sf_dir):
    return valuation.histogram(ledger(spark, sf_dir), "valuation_status", STATUSES)


_DATED = "SELECT DISTINCT CASE o_custkey % 2 WHEN 0 THEN 'USD' ELSE 'EUR' END AS currency, CAST(o_orderdate AS DATE) AS date FROM orders WHERE day(o_orderdate) = 10"
_OBSERVED = "SELECT DISTINCT 'USD' AS currency, CAST(o_orderdate AS DATE) AS date FROM orders WHERE day(o_orderdate) IN (1, 15)"


@query(f"""WITH {LEDGER_SQL}, dated AS (SELECT currency, date, CAST(7.5 + day(date) * 0.01 AS DECIMAL(17,8)) AS rate FROM ({_DATED})),
    observed AS (SELECT currency, date, CAST(7.7 + month(date) * 0.001 AS DECIMAL(17,8)) AS rate FROM ({_OBSERVED})),
    near AS (SELECT * FROM (SELECT l.id, o.date AS rate_date, o.rate, row_number() OVER (PARTITION BY l.id ORDER BY o.date DESC) AS rn
        FROM ledger l JOIN observed o ON o.currency = l.posted_currency AND o.date <= l.date AND o.date >= l.date - 7) WHERE rn = 1),
    j AS (SELECT l.id, l.date, l.posted_amount, l.posted_currency, d.rate AS d_rate, a.rate AS a_rate, a.rate_date AS a_date,
        CASE WHEN l.posted_currency = 'EUR' THEN CAST(8.4 AS DECIMAL(17,8)) END AS f_rate
        FROM ledger l LEFT JOIN dated d ON d.currency = l.posted_currency AND d.date = l.date LEFT JOIN near a ON a.id = l.id)
    SELECT id, CASE WHEN posted_currency = 'HKD' THEN 'same_currency' WHEN d_rate IS NOT NULL THEN 'dated' WHEN a_rate IS NOT NULL THEN 'cached' WHEN f_rate IS NOT NULL THEN 'fixed' ELSE 'missing' END AS valuation_source,
        CASE WHEN posted_currency = 'HKD' THEN 'actual' WHEN d_rate IS NULL AND a_rate IS NULL AND f_rate IS NULL THEN 'missing' ELSE 'estimated' END AS valuation_status,
        CASE WHEN posted_currency = 'HKD' THEN NULL WHEN d_rate IS NOT NULL THEN date WHEN a_rate IS NOT NULL THEN a_date END AS rate_date,
        CAST(CASE WHEN posted_currency = 'HKD' THEN posted_amount ELSE round_even(CAST(posted_amount AS DECIMAL(18,2)) * coalesce(d_rate, a_rate, f_rate), 2) END AS DECIMAL(20,2)) AS amount_base FROM j""")
def valuation_cascade(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    dated = spark.sql(f"SELECT currency, date, CAST(7.5 + day(date) * 0.01 AS DECIMAL(17,8)) AS rate FROM ({_DATED})")
    observed = spark.sql(f"SELECT currency, date, CAST(7.7 + month(date) * 0.001 AS DECIMAL(17,8)) AS rate FROM ({_OBSERVED})")
    fixed = spark.sql("SELECT 'EUR' AS currency, CAST(8.4 AS DECIMAL(17,8)) AS rate")
    rows = ledger(spark, sf_dir).withColumns({"amount_base": F.lit(None).cast("decimal(18,2)"), "valuation_source": F.lit(None).cast("string")})
    return valuation.value_cascade(rows, dated, observed, fixed, "HKD").select("id", "valuation_source", "valuation_status", "rate_date", "amount_base")


_VIEWS = "SELECT user_id AS currency, CAST(ts AS DATE) AS date, CAST(max(value) AS DECIMAL(17,8)) AS rate FROM events WHERE event_type = 'view' GROUP BY 1, 2"


@query(f"""WITH v AS ({_VIEWS}), p AS (SELECT event_id, user_id AS currency, CAST(ts AS DATE) AS date FROM events WHERE event_type = 'purchase')
    SELECT event_id, rate_date, asof_rate FROM (SELECT p.event_id, v.date AS rate_date, v.rate AS asof_rate, row_number() OVER (PARTITION BY p.event_id ORDER BY v.date DESC) AS rn
    FROM p LEFT JOIN v ON v.currency = p.currency AND v.date <= p.date AND v.date >= p.date - 7) WHERE rn = 1""")
def rate_asof_7d(spark, sf_dir):
    table(spark, sf_dir, "events").createOrReplaceTempView("events")
    purchases = spark.sql("SELECT event_id, user_id AS currency, CAST(ts AS DATE) AS date FROM events WHERE event_type = 'purchase'")
    return valuation.asof_rates(purchases, spark.sql(_VIEWS)).select("event_id", "rate_date", "asof_rate")


_CANDIDATES = f"""{legs_sql()}, cand AS (SELECT o.id AS out_id, i.id AS in_id, CAST(abs(i.date - o.date) AS INT) AS days,
    CASE WHEN i.account_type = 'credit_card' THEN 'credit_card_payment' WHEN i.account_type = 'bank' THEN 'internal_transfer' ELSE 'investment_transfer' END AS flow, i.flow_source, i.flow_type
    FROM legs o JOIN legs i ON i.amount_base = -o.amount_base AND o.amount_base < 0 AND abs(i.date - o.date) <= 3 AND i.account_id <> o.account_id),
    ok AS (SELECT out_id, in_id, days, flow FROM cand WHERE flow_source <> 'rule' OR flow_type = flow),
    best AS (SELECT *, min(days) OVER (PARTITION BY out_id) AS od, min(days) OVER (PARTITION BY in_id) AS idd FROM ok),
    ob AS (SELECT out_id, min(in_id) AS in_id FROM best WHERE days = od GROUP BY out_id HAVING count(*) = 1),
    ib AS (SELECT in_id, min(out_id) AS out_id FROM best WHERE days = idd GROUP BY in_id HAVING count(*) = 1),
    pairs AS (SELECT ok.* FROM ok JOIN ob ON ob.out_id = ok.out_id AND ob.in_id = ok.in_id JOIN ib ON ib.out_id = ok.out_id AND ib.in_id = ok.in_id)"""


@query(f"""WITH {_CANDIDATES} SELECT out_id, in_id, days, flow, CAST(CASE WHEN days = 0 THEN 1.00 ELSE 0.95 END AS DECIMAL(4,2)) AS confidence,
    'xfer_' || substr(sha256(least(out_id, in_id) || '|' || greatest(out_id, in_id)), 1, 16) AS group_id FROM pairs""")
def transfer_pairs(spark, sf_dir):
    return flows.transfer_pairs(flows.transfer_candidates(legs(spark, sf_dir)))


def _status(spark, sf_dir):
    rows = legs(spark, sf_dir)
    candidates = staged(flows.transfer_candidates(rows), "candidates")
    return flows.transfer_status(rows, candidates, flows.transfer_pairs(candidates))


_STATUS_SQL = f"""WITH {_CANDIDATES}, had AS (SELECT out_id AS id FROM ok UNION SELECT in_id FROM ok), done AS (SELECT out_id AS id FROM pairs UNION SELECT in_id FROM pairs),
    st AS (SELECT l.id, CASE WHEN l.id IN (SELECT id FROM done) THEN 'paired' WHEN l.id IN (SELECT id FROM had) THEN 'ambiguous' WHEN l.flow_type = 'internal_transfer' THEN 'unmatched' ELSE 'not_applicable' END AS reconciliation_status FROM legs l)"""


@query(_STATUS_SQL + " SELECT id FROM st WHERE reconciliation_status = 'ambiguous'")
def transfer_ambiguous(spark, sf_dir):
    return _status(spark, sf_dir).filter("reconciliation_status = 'ambiguous'").select("id")


@query(_STATUS_SQL + " SELECT id FROM st WHERE reconciliation_status = 'unmatched'")
def transfer_unmatched(spark, sf_dir):
    return _status(spark, sf_dir).filter("reconciliation_status = 'unmatched'").select("id")


@query(_STATUS_SQL + " SELECT reconciliation_status, count(*) AS n FROM st GROUP BY 1")
def reconciliation_summary(spark, sf_dir):
    return _status(spark, sf_dir).groupBy("reconciliation_status").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {LEDGER_SQL} SELECT id, CASE WHEN flow_source = 'rule' THEN flow_type WHEN category = 'Income' THEN CASE WHEN id % 2 = 0 THEN 'income' ELSE 'unresolved' END
    WHEN category = 'Internal Transfer' THEN CASE WHEN id % 2 = 0 THEN 'internal_transfer' ELSE 'unresolved' END
    WHEN coalesce(amount_base, posted_amount) = 0 OR category = 'Unknown' THEN 'unresolved'
    WHEN coalesce(amount_base, posted_amount) > 0 AND (account_type = 'credit_card' OR (account_type = 'bank' AND status = 'F')) THEN 'refund' WHEN coalesce(amount_base, posted_amount) < 0 THEN 'expense' ELSE 'unresolved' END AS flow FROM ledger""")
def derive_flow(spark, sf_dir):
    flow = flows.flow_type(F.col("category"), F.col("amount_base"), F.col("account_type"), F.col("id") % 2 == 0, F.col("status") == "F", F.col("flow_source"), F.col("flow_type"), F.col("posted_amount"))
    return ledger(spark, sf_dir).select("id", flow.alias("flow"))


_STATEMENTS = """SELECT account_id, concat('src_', CAST(year(date) AS VARCHAR(20))) AS source_id, 'main' AS section, CASE WHEN id % 997 = 0 THEN NULL ELSE 'HKD' END AS currency, account_type0 AS account_type, posted_amount,
    CASE WHEN id % 4 = 0 THEN CAST(1000 AS DECIMAL(20,2)) END AS opening, CASE WHEN id % 5 = 0 THEN CAST(2000 AS DECIMAL(20,2)) END AS closing
    FROM (SELECT *, CASE WHEN account_id IN ('acct_1', 'acct_2') THEN 'credit_card' ELSE 'bank' END AS account_type0 FROM ledger)"""
_BALANCES_SQL = f"""WITH {LEDGER_SQL}, rows_ AS ({_STATEMENTS}), s AS (SELECT account_id, source_id, section, currency, CAST(sum(posted_amount) AS DECIMAL(30,2)) AS activity, min(opening) AS opening, min(closing) AS closing, bool_and(account_type = 'credit_card') AS liability
    FROM rows_ GROUP BY ALL), c AS (SELECT *, CAST(CASE WHEN liability AND (opening - activity = closing OR (opening + activity <> closing AND opening >= 0 AND closing >= 0)) THEN opening - activity ELSE opening + activity END AS DECIMAL(31,2)) AS calculated FROM s),
    b AS (SELECT account_id, source_id, section, currency, opening, activity, closing, calculated, CAST(calculated - closing AS DECIMAL(32,2)) AS difference,
    CASE WHEN currency IS NULL THEN 'unavailable' WHEN opening IS NULL AND closing IS NULL THEN 'missing_both' WHEN opening IS NULL THEN 'missing_opening' WHEN closing IS NULL THEN 'missing_closing' WHEN calculated = closing THEN 'matched' ELSE 'mismatched' END AS status FROM c)"""


def _balances(spark, sf_dir):
    ledger(spark, sf_dir).createOrReplaceTempView("ledger")
    return review.balances(spark.sql(_STATEMENTS))


@query(_BALANCES_SQL + " SELECT * FROM b")
def balance_reconciliation(spark, sf_dir):
    return _balances(spark, sf_dir)


@query(_BALANCES_SQL + """ SELECT account_id, count(*) AS statements, count(*) FILTER (WHERE status = 'matched') AS matched,
    CASE WHEN bool_or(status = 'mismatched') THEN 'difference' WHEN bool_and(status = 'matched') THEN 'reconciled' ELSE 'unavailable' END AS status FROM b GROUP BY account_id""")
def balance_rollup(spark, sf_dir):
    return review.balance_rollup(_balances(spark, sf_dir))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45)")
def statement_completion(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return review.complete_statements(rows, rows.filter("l_returnflag = 'R' and l_quantity >= 45"), ["l_orderkey"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("""SELECT l_partkey, CAST(l_shipdate AS DATE) AS day, count(DISTINCT l_suppkey) AS sources, string_agg(CAST(l_orderkey AS VARCHAR), ',' ORDER BY l_orderkey) AS members
    FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_suppkey) >= 2""")
def duplicate_candidates(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("day", F.to_date("l_shipdate"))
    return overlap.duplicate_candidates(rows, ["l_partkey", "day"], "l_suppkey", "l_orderkey").withColumn("members", F.array_join("members", ","))


_COUNTS = """per AS (SELECT l_partkey, l_suppkey % 3 AS source, count(*) AS n FROM lineitem GROUP BY 1, 2),
    c AS (SELECT l_partkey, list(n ORDER BY n) AS counts FROM per GROUP BY 1),
    o AS (SELECT l_partkey, counts, counts[-1] AS keep_all, CASE WHEN len(counts) = 1 THEN counts[1] ELSE counts[-2] END AS same_event,
    CASE WHEN len(counts) = 1 THEN 'single_source' WHEN counts[-1] = 1 THEN 'exact_one_to_one' WHEN counts[1] = counts[-1] THEN 'pooled_equal_count' ELSE 'ambiguous_count_mismatch' END AS status FROM c)"""


def _counts(spark, sf_dir):
    return overlap.overlap_counts(table(spark, sf_dir, "lineitem").withColumn("source", F.col("l_suppkey") % 3), ["l_partkey"], "source")


@query(f"WITH {_COUNTS} SELECT l_partkey, array_to_string(counts, ',') AS source_counts, keep_all, same_event, status FROM o")
def overlap_counts(spark, sf_dir):
    return _counts(spark, sf_dir).withColumn("source_counts", F.array_join("source_counts", ","))


@query(f"""WITH {_COUNTS} SELECT l_partkey, CAST(s AS INT) AS slot, s <= CASE WHEN l_partkey % 2 = 0 THEN same_event ELSE keep_all END AS active FROM o, unnest(generate_series(1, keep_all)) AS t(s)""")
def overlap_slots(spark, sf_dir):
    counts = _counts(spark, sf_dir)
    decided = counts.filter("l_partkey % 2 = 0").select("l_partkey", F.lit("same_event").alias("decision"))
    return overlap.overlap_slots(counts, decided, ["l_partkey"]).select("l_partkey", "slot", "active")


@query(f"WITH {_COUNTS} SELECT l_partkey, CAST(s AS INT) AS slot, CAST(len(list_filter(counts, lambda n: n >= s)) AS INT) AS support FROM o, unnest(generate_series(1, keep_all)) AS t(s)")
def overlap_slot_support(spark, sf_dir):
    return overlap.overlap_slots(_counts(spark, sf_dir)).select("l_partkey", "slot", "support")


def _frame_sql(*parts: str) -> str:
    """The bytes of a frame in hexadecimal: magic, sized domain, count, sized parts."""
    head = (b"tally1\0" + len(b"record").to_bytes(4, "big") + b"record" + len(parts).to_bytes(4, "big")).hex().upper()
    return " || ".join([f"'{head}'", *(f"lpad(hex(octet_length(encode({p}))), 16, '0') || hex(encode({p}))" for p in parts)])


_FINGERPRINT = f"'fp_' || sha256(unhex({_frame_sql('lower(c_name)', 'CAST(c_nationkey AS VARCHAR)', 'lower(c_mktsegment)')}))"


@query(f"SELECT c_custkey, {_FINGERPRINT} AS fingerprint FROM customer")
def record_fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", overlap.record_fingerprint(F.lower("c_name"), F.col("c_nationkey").cast("string"), F.lower("c_mktsegment")).alias("fingerprint"))


@query(f"SELECT fingerprint, count(*) AS n FROM (SELECT {_FINGERPRINT.replace('c_name', 'c_mktsegment')} AS fingerprint FROM customer) GROUP BY 1")
def record_fingerprint_framed(spark, sf_dir):
    made = overlap.record_fingerprint(F.lower("c_mktsegment"), F.col("c_nationkey").cast("string"), F.lower("c_mktsegment"))
    return table(spark, sf_dir, "customer").select(made.alias("fingerprint")).groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"))


RULES = [
    classify.Rule("promo", category="Shopping", patterns=["promo"], fields=["p_type"], priority=5),
    classify.Rule("brand-exact", category="Dining", patterns=["brand#4", "Brand#19"], fields=["p_brand"], match_type="exact", priority=9),
    classify.Rule("small-ring", category="Gifts", conditions=[{"field": "p_type", "match_type": "exact", "patterns": ["SMALL"]}, {"field": "p_name", "match_type": "regex", "patterns": ["ring$"]}], priority=7),
    classify.Rule("off", category="Nothing", patterns=["a"], fields=["p_name"], priority=99, enabled=False),
    classify.Rule("learned", category="Learned", patterns=["medium"], fields=["p_type"], priority=50, managed=True),
    classify.Rule("widget", category="Household", patterns=["widget"], fields=["p_name"], confidence=0.7),
]
_RULES_SQL = """r AS (SELECT p_partkey, CASE WHEN lower(p_brand) IN ('brand#4', 'brand#19') THEN 'brand-exact' WHEN lower(p_type) = 'small' AND regexp_matches(p_name, '(?i)ring$') THEN 'small-ring'
    WHEN contains(lower(p_type), 'promo') THEN 'promo' WHEN contains(lower(p_name), 'widget') THEN 'widget' WHEN contains(lower(p_type), 'medium') THEN 'learned' END AS rule_id FROM part)"""


@query(f"""WITH {_RULES_SQL} SELECT p_partkey, rule_id, CASE rule_id WHEN 'promo' THEN 'Shopping' WHEN 'brand-exact' THEN 'Dining' WHEN 'small-ring' THEN 'Gifts' WHEN 'widget' THEN 'Household' WHEN 'learned' THEN 'Learned' END AS rule_category,
    CAST(CASE WHEN rule_id = 'widget' THEN 0.7 WHEN rule_id IS NOT NULL THEN 0.9 END AS DECIMAL(4,2)) AS rule_confidence FROM r""")
def rules_first_match(spark, sf_dir):
    return classify.apply_rules(table(spark, sf_dir, "part"), RULES).select("p_partkey", "rule_id", "rule_category", "rule_confidence")


@query(f"WITH {_RULES_SQL} SELECT rule_id, count(*) AS n FROM r WHERE rule_id IS NOT NULL GROUP BY 1")
def rule_hit_counts(spark, sf_dir):
    return classify.apply_rules(table(spark, sf_dir, "part"), RULES).filter("rule_id is not null").groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


_EVENT_TEXT = """CASE event_id % 12 WHEN 0 THEN 'Monthly CASHBACK' WHEN 1 THEN 'cash-rebate on card' WHEN 2 THEN 'cash rebate' WHEN 3 THEN 'Interest earned' WHEN 4 THEN 'interesting shop' WHEN 5 THEN 'ATM withdrawal 12'
    WHEN 6 THEN 'Cash withdrawal' WHEN 7 THEN 'ATM fee' WHEN 8 THEN 'Card payment thanks' WHEN 9 THEN 'card settlement' WHEN 10 THEN 'payment received' ELSE 'cash back reward' END"""
_EVENT_SIGN = "CASE WHEN user_id % 2 = 0 THEN 1 ELSE -1 END"


@query(rf"""WITH e AS (SELECT event_id, lower({_EVENT_TEXT}) AS t, {_EVENT_SIGN} AS amount, event_type IN ('view', 'click') AS card FROM events)
    SELECT event_id, CASE WHEN amount > 0 AND regexp_matches(t, '\b(cashback|cash[- ]rebate)\b') THEN 'Other>refund' WHEN amount > 0 AND regexp_matches(t, '\binterest\b') THEN 'Income>income'
    WHEN amount < 0 AND regexp_matches(t, '\b(atm withdrawal|cash withdrawal)\b') THEN 'Cash>expense' WHEN amount > 0 AND card AND regexp_matches(t, '\b(credit card payment|card payment|card settlement)\b') THEN 'Credit Card Payment>credit_card_payment' END AS found FROM e""")
def structural_classification(spark, sf_dir):
    found = classify.structural(F.expr(_EVENT_TEXT), F.expr(_EVENT_SIGN), F.when(F.col("event_type").isin("view", "click"), "credit_card").otherwise("bank"))
    return table(spark, sf_dir, "events").select("event_id", found.alias("found"))


_MEMORY = """src AS (SELECT d.doc_id AS id, d.source, d.lang, CASE WHEN l.doc_id IS NULL THEN NULL WHEN d.source < 'src3' THEN 'steady' WHEN l.quality = 1 THEN 'good' ELSE 'bad' END AS category FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
    mem AS (SELECT source, lang, min(category) AS memory_category, count(DISTINCT id) AS seen FROM src WHERE category IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT category) = 1 AND count(DISTINCT id) >= 2)"""


def _memory_rows(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), table(spark, sf_dir, "labels")
    joined = docs.join(labels.select("doc_id", "quality"), "doc_id", "left")
    category = F.when(F.col("quality").isNull(), None).when(F.col("source") < "src3", "steady").when(F.col("quality") == 1, "good").otherwise("bad")
    return joined.select(F.col("doc_id").alias("id"), "source", "lang", category.alias("category"))


@query(f"WITH {_MEMORY} SELECT * FROM mem")
def memory_build(spark, sf_dir):
    return classify.build_memory(_memory_rows(spark, sf_dir), ["source", "lang"])


@query(f"WITH {_MEMORY} SELECT s.id, coalesce(s.category, m.memory_category) AS category, s.category IS NULL AND m.memory_category IS NOT NULL AS remembered FROM src s LEFT JOIN mem m ON m.source = s.source AND m.lang = s.lang")
def memory_apply(spark, sf_dir):
    rows = _memory_rows(spark, sf_dir)
    return classify.apply_memory(rows, classify.build_memory(rows, ["source", "lang"]), ["source", "lang"]).select("id", "category", "remembered")


_LEARN = "SELECT o_custkey, o_orderpriority AS priority_, o_orderstatus AS status_, CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_custkey % 3 = 0 THEN 'A' ELSE concat('B', o_orderstatus) END AS outcome FROM orders"


@query(f"""WITH x AS ({_LEARN}), g AS (SELECT o_custkey, priority_, count(DISTINCT outcome) AS k, count(*) FILTER (WHERE outcome IS NULL) AS op, count(*) AS covered, min(outcome) AS outcome FROM x GROUP BY 1, 2),
    s AS (SELECT x.o_custkey, x.priority_, x.status_, count(DISTINCT x.outcome) AS k, count(*) FILTER (WHERE x.outcome IS NULL) AS op, count(*) AS covered, min(x.outcome) AS outcome FROM x JOIN g ON g.o_custkey = x.o_custkey AND g.priority_ = x.priority_ AND g.k >= 2 GROUP BY 1, 2, 3)
    SELECT o_custkey, priority_, NULL AS status_, outcome, -1000 AS priority, covered FROM g WHERE k = 1 AND op = 0 UNION ALL SELECT o_custkey, priority_, status_, outcome, -999, covered FROM s WHERE k = 1 AND op = 0""")
def learn_rules(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return classify.learn_rules(spark.sql(_LEARN), ["o_custkey", "priority_"], ["status_"])


_CONFUSION = """ref AS (SELECT doc_id AS id, CASE quality WHEN 1 THEN 'good' ELSE 'bad' END AS category FROM labels), cand AS (SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN '' WHEN toxic = 1 THEN 'bad' ELSE 'good' END AS category FROM labels WHERE doc_id % 7 <> 0),
    m AS (SELECT r.category AS ref, CASE WHEN c.id IS NULL THEN 'Missing' WHEN c.category = '' THEN 'Unknown' ELSE c.category END AS cand, count(*) AS n FROM ref r LEFT JOIN cand c ON c.id = r.id GROUP BY 1, 2)"""


def _confusion(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "id")
    ref = labels.select("id", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("category"))
    cand = labels.filter("id % 7 <> 0").select("id", F.when(F.col("id") % 5 == 0, "").when(F.col("toxic") == 1, "bad").otherwise("good").alias("category"))
    return classify.confusion(ref, cand, "id")


@query(f"WITH {_CONFUSION} SELECT * FROM m")
def evaluation_confusion(spark, sf_dir):
    return _confusion(spark, sf_dir)


@query(f"""WITH {_CONFUSION}, t AS (SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n) FILTER (WHERE cand NOT IN ('Missing', 'Unknown')) AS BIGINT) AS n_covered, CAST(sum(n) FILTER (WHERE ref = cand) AS BIGINT) AS n_correct FROM m)
    SELECT *, round(n_covered / n_rows, 4) AS coverage, round(n_correct / n_rows, 4) AS accuracy, round(n_correct / n_covered, 4) AS covered_accuracy FROM t""")
def evaluation_metrics(spark, sf_dir):
    return classify.metrics(_confusion(spark, sf_dir))


def _review_rows(spark, sf_dir):
    rows = ledger(spark, sf_dir)
    return review.review_reasons(
        rows.withColumns(
            {
                "flags": F.when(F.col("id") % 17 == 0, F.array(F.lit("invalid_amount"))).otherwise(F.array().cast("array<string>")),
                "review_reasons": F.when(F.col("id") % 4 == 0, F.array(F.lit("category_suggestion"), F.lit("ownership"))).otherwise(F.array().cast("array<string>")),
                "needs_review": F.col("id") % 2 == 0,
            }
        )
    )


_REVIEW_SQL = f"""{LEDGER_SQL}, v AS (SELECT *, list_filter([CASE WHEN id % 2 = 0 AND flow_type = 'unresolved' THEN 'accounting_flow' END, CASE WHEN id % 2 = 0 AND category = 'Unknown' THEN 'category_decision' END,
    CASE WHEN id % 4 = 0 AND category <> 'Unknown' THEN 'category_suggestion' END, CASE WHEN id % 4 = 0 AND owner = 'Unknown' THEN 'ownership' END, CASE WHEN id % 17 = 0 THEN 'source_data_issue' END], lambda x: x IS NOT NULL) AS reasons FROM ledger)"""


@query(f"WITH {_REVIEW_SQL} SELECT id, array_to_string(reasons, ';') AS review_reasons, len(reasons) > 0 AS needs_review FROM v")
def review_state(spark, sf_dir):
    return _review_rows(spark, sf_dir).select("id", F.array_join("review_reasons", ";").alias("review_reasons"), "needs_review")


@query(f"WITH {_REVIEW_SQL} SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM v) GROUP BY 1")
def review_reason_histogram(spark, sf_dir):
    return review.reason_histogram(_review_rows(spark, sf_dir))


@query(f"WITH {_REVIEW_SQL} SELECT id, category AS suggested_category, owner AS suggested_owner, '' AS category FROM v WHERE len(reasons) > 0")
def review_queue(spark, sf_dir):
    return _review_rows(spark, sf_dir).filter("needs_review").select("id", F.col("category").alias("suggested_category"), F.col("owner").alias("suggested_owner"), F.lit("").alias("category"))


@query(f"WITH {LEDGER_SQL} SELECT id, date FROM ledger WHERE date BETWEEN DATE '1996-02-01' AND DATE '1996-02-29'")
def period_filter(spark, sf_dir):
    return review.in_period(ledger(spark, sf_dir), "1996-02-01", "1996-02-29").select("id", "date")


@query(f"WITH {LEDGER_SQL} SELECT id, owner FROM ledger WHERE owner IN ('owner_a', 'Household')")
def owner_filter(spark, sf_dir):
    return review.owned_by(ledger(spark, sf_dir), ["owner_a", "Household"]).select("id", "owner")


@query(f"WITH {LEDGER_SQL} SELECT id FROM ledger WHERE coalesce(amount_base, posted_amount) > 0")
def direction_filter(spark, sf_dir):
    return ledger(spark, sf_dir).filter(direction(F.col("amount_base"), F.col("posted_amount")) == "inflow").select("id")


_PATCHES = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'Travel' END AS category, CASE WHEN o_orderkey % 3 = 0 THEN 'owner_b' END AS owner FROM orders"


@query(f"WITH {LEDGER_SQL}, p AS ({_PATCHES}) SELECT l.id, coalesce(p.category, l.category) AS category, coalesce(p.owner, l.owner) AS owner FROM ledger l LEFT JOIN p ON p.id = l.id")
def correction_apply(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return review.apply_patches(ledger(spark, sf_dir), spark.sql(_PATCHES), "id", ["category", "owner"]).select("id", "category", "owner")


@query(f"""WITH a AS ({_PATCHES}), b AS (SELECT o_orderkey * 3 AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'Fees' END AS category, CAST(NULL AS VARCHAR) AS owner FROM orders)
    SELECT coalesce(a.id, b.id) AS id, coalesce(b.category, a.category) AS category, coalesce(b.owner, a.owner) AS owner FROM a FULL JOIN b ON a.id = b.id WHERE coalesce(a.id, b.id) NOT IN (SELECT o_orderkey * 7 FROM orders)""")
def correction_merge(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    orders.createOrReplaceTempView("orders")
    new = orders.select((F.col("o_orderkey") * 3).alias("id"), F.when(F.col("o_orderkey") % 5 == 0, "Fees").alias("category"), F.lit(None).cast("string").alias("owner"))
    removed = orders.select((F.col("o_orderkey") * 7).alias("id"))
    return review.merge_patches(spark.sql(_PATCHES), new, removed, "id", ["category", "owner"])


_MARKED = """SELECT o_orderkey * 2 AS id, CASE WHEN o_orderkey % 4 > 0 THEN concat('m', CAST(o_orderkey AS VARCHAR(20))) END AS marker, 'a' AS account_id, 'HKD' AS posted_currency, CAST(o_totalprice AS DECIMAL(18,2)) AS posted_amount, 'owner_a' AS owner FROM orders
    UNION ALL SELECT o_orderkey * 2 + 1, CASE WHEN o_orderkey % 4 > 0 THEN concat('m', CAST(o_orderkey AS VARCHAR(20))) END, CASE WHEN o_orderkey % 5 = 0 THEN 'b' ELSE 'a' END, 'HKD', CAST(-o_totalprice AS DECIMAL(18,2)), CASE WHEN o_orderkey % 3 = 0 THEN 'owner_b' ELSE 'Household' END FROM orders"""


@query(f"""WITH x AS ({_MARKED}) SELECT marker, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids, count(*) = 2 AND count(DISTINCT account_id) = 1 AND sum(posted_amount) = 0 AND max(posted_amount) > 0
    AND count(DISTINCT owner) FILTER (WHERE owner NOT IN ('', 'Unknown', 'Household')) <= 1 AS valid FROM x WHERE marker IS NOT NULL GROUP BY marker""")
def manual_pairs(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return flows.manual_pairs(spark.sql(_MARKED)).withColumn("ids", F.array_join("ids", ","))


# Every perfect matching of a day and user is spelled out, one outflow after the other; few have more than two of them.
@query("""WITH RECURSIVE l AS (SELECT event_id AS id, user_id AS inst, CAST(ts AS DATE) AS day, event_type = 'purchase' AS base, CAST(CAST(abs(value) AS DECIMAL(18,2)) AS DOUBLE) AS x FROM events WHERE event_type IN ('purchase', 'view')),
    c AS (SELECT inst, day, count(*) FILTER (WHERE base) AS n FROM l GROUP BY 1, 2 HAVING count(*) FILTER (WHERE base) = count(*) FILTER (WHERE NOT base)),
    o AS (SELECT l.*, c.n, row_number() OVER (PARTITION BY l.inst, l.day ORDER BY id) AS k FROM l JOIN c ON c.inst = l.inst AND c.day = l.day WHERE base),
    e AS (SELECT o.inst, o.day, o.n, o.k, o.id AS out_id, i.id AS in_id FROM o JOIN l i ON i.inst = o.inst AND i.day = o.day AND NOT i.base WHERE abs(o.x / i.x - 1.0) <= 0.25),
    m AS (SELECT inst, day, n, k, [in_id] AS used, [out_id] AS outs FROM e WHERE k = 1
        UNION ALL SELECT e.inst, e.day, e.n, e.k, list_append(used, e.in_id), list_append(outs, e.out_id) FROM m JOIN e ON e.inst = m.inst AND e.day = m.day AND e.k = m.k + 1 AND NOT list_contains(used, e.in_id)),
    f AS (SELECT *, count(*) OVER (PARTITION BY inst, day) AS times FROM m WHERE k = n)
    SELECT CAST(unnest(outs) AS VARCHAR) AS out_id, CAST(unnest(used) AS VARCHAR) AS in_id FROM f WHERE times = 1""")
def cross_currency_pairs(spark, sf_dir):
    base = F.col("event_type") == "purchase"
    rows = table(spark, sf_dir, "events").filter("event_type in ('purchase', 'view')").select(
        F.col("event_id").alias("id"), F.to_date("ts").alias("date"), F.col("user_id").alias("institution"), F.when(base, "HKD").otherwise("USD").alias("currency"),
        F.when(base, -F.col("value")).otherwise(F.col("value")).cast("decimal(18,2)").alias("amount"), base.alias("is_base"), F.lit(1.0).alias("reference"),
    )
    return flows.exchange_pairs(rows, 0.25)


_WIDE = "SELECT CAST(ts AS DATE) AS day, CAST(max(CASE WHEN event_type = 'view' THEN value END) AS DECIMAL(17,8)) AS usd, CAST(max(CASE WHEN event_type = 'click' THEN value END) AS DECIMAL(17,8)) AS eur, CAST(max(CASE WHEN event_type = 'none' THEN value END) AS DECIMAL(17,8)) AS gbp FROM events GROUP BY 1"


def _wide(spark, sf_dir):
    table(spark, sf_dir, "events").createOrReplaceTempView("events")
    return valuation.unpivot_rates(spark.sql(_WIDE), "day", ["usd", "eur", "gbp"], "official")


_LONG = f"w AS ({_WIDE}), u AS (SELECT 'USD' AS currency, day AS date, usd AS rate FROM w WHERE usd IS NOT NULL UNION ALL SELECT 'EUR', day, eur FROM w WHERE eur IS NOT NULL)"


@query(f"WITH {_LONG} SELECT currency, date, rate, 'official' AS provider FROM u")
def rate_unpivot(spark, sf_dir):
    return _wide(spark, sf_dir)


@query(f"""WITH {_LONG}, two AS (SELECT currency, date, rate, 'official' AS provider FROM u UNION ALL SELECT currency, date, CASE WHEN day(date) % 5 = 0 THEN CAST(rate + 1 AS DECIMAL(17,8)) ELSE rate END, 'own' FROM u WHERE day(date) % 2 = 0)
    SELECT currency, date, min(rate) AS rate, string_agg(DISTINCT provider, ',' ORDER BY provider) AS providers, count(DISTINCT rate) > 1 AS conflict FROM two GROUP BY 1, 2""")
def rate_merge(spark, sf_dir):
    first = _wide(spark, sf_dir)
    own = first.filter("day(date) % 2 = 0").withColumns({"rate": F.when(F.dayofmonth("date") % 5 == 0, F.col("rate") + 1).otherwise(F.col("rate")).cast("decimal(17,8)"), "provider": F.lit("own")})
    return valuation.merge_rates(first, own).withColumn("providers", F.array_join("providers", ","))


@query("""WITH g AS (SELECT p_type AS category, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(30,2)) AS total, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)
    SELECT category, total, n, round(CAST(abs(total) AS DOUBLE) / CAST((SELECT sum(abs(total)) FROM g) AS DOUBLE), 6) AS share FROM g WHERE abs(total) > 0.005""")
def category_distribution(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_extendedprice").cast("decimal(18,2)").alias("price"))
    by_part = items.groupBy("l_partkey").agg(F.sum("price").alias("price"), F.count(F.lit(1)).alias("n"))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("category"))
    g = by_part.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("category").agg(F.sum("price").cast("decimal(30,2)").alias("total"), F.sum("n").alias("n"))
    whole = g.agg(F.sum(F.abs("total")).cast("double").alias("whole"))
    return g.crossJoin(F.broadcast(whole)).filter(F.abs("total") > 0.005).select("category", "total", "n", F.round(F.abs("total").cast("double") / F.col("whole"), 6).alias("share"))


@query(f"WITH {LEDGER_SQL} SELECT id, date, account_id, posted_amount FROM ledger ORDER BY date DESC, account_id, posted_amount, id LIMIT 100")
def canonical_sort_topk(spark, sf_dir):
    return ledger(spark, sf_dir).select("id", "date", "account_id", "posted_amount").orderBy(F.desc("date"), "account_id", "posted_amount", "id").limit(100)


@query(f"WITH {LEDGER_SQL} SELECT id, date, category FROM ledger ORDER BY id LIMIT 10")
def preview_limit(spark, sf_dir):
    return ledger(spark, sf_dir).select("id", "date", "category").orderBy("id").limit(10)


_INCOMING = "SELECT concat('ns', CAST(s_suppkey AS VARCHAR(20))) AS namespace, concat('rev', CAST(s_suppkey % 7 AS VARCHAR(20))) AS revision FROM supplier WHERE s_suppkey % 2 = 0"
_PRIOR = "SELECT concat('src', CAST(s_suppkey AS VARCHAR(20))) AS source_id, concat('ns', CAST(s_suppkey AS VARCHAR(20))) AS namespace, concat('rev', CAST(s_suppkey AS VARCHAR(20))) AS revision FROM supplier WHERE s_suppkey % 3 = 0"


@query(f"""WITH i AS ({_INCOMING}), p AS ({_PRIOR}), r AS (SELECT revision, count(*) AS n, min(source_id) AS rid FROM p GROUP BY 1)
    SELECT i.namespace, i.revision, CASE WHEN p.source_id IS NOT NULL THEN 'reuse' WHEN r.n = 1 THEN 'reuse_revision' WHEN r.n > 1 THEN 'error_ambiguous' ELSE 'error_not_found' END AS action, coalesce(p.source_id, CASE WHEN r.n = 1 THEN r.rid END) AS source_id
    FROM i LEFT JOIN p ON p.namespace = i.namespace LEFT JOIN r ON r.revision = i.revision""")
def source_resolution(spark, sf_dir):
    table(spark, sf_dir, "supplier").createOrReplaceTempView("supplier")
    return overlap.resolve_sources(spark.sql(_INCOMING), spark.sql(_PRIOR), replace=True)


_NEW = "SELECT concat(CAST(l_orderkey AS VARCHAR(20)), ':', CAST(CASE WHEN l_orderkey % 11 = 0 THEN l_linenumber + 100 ELSE l_linenumber END AS VARCHAR(20))) AS locator, concat(CAST(l_partkey AS VARCHAR(20)), '/', CAST(l_suppkey AS VARCHAR(20)), '/', CAST(CAST(l_shipdate AS DATE) AS VARCHAR(20))) AS fingerprint FROM lineitem WHERE l_orderkey % 13 <> 0"
_OLD = "SELECT concat('rec_', CAST(l_orderkey AS VARCHAR(20)), '_', CAST(l_linenumber AS VARCHAR(20))) AS record_id, concat(CAST(l_orderkey AS VARCHAR(20)), ':', CAST(l_linenumber AS VARCHAR(20))) AS locator, concat(CAST(l_partkey AS VARCHAR(20)), '/', CAST(l_suppkey AS VARCHAR(20)), '/', CAST(CAST(l_shipdate AS DATE) AS VARCHAR(20))) AS fingerprint FROM lineitem WHERE l_orderkey % 17 <> 0"


@query(f"""WITH i AS ({_NEW}), p AS ({_OLD}), k AS (SELECT i.locator, i.fingerprint, p.record_id FROM i JOIN p ON p.locator = i.locator AND p.fingerprint = i.fingerprint),
    ri AS (SELECT * FROM i ANTI JOIN k ON k.locator = i.locator AND k.fingerprint = i.fingerprint), rp AS (SELECT * FROM p ANTI JOIN k ON k.record_id = p.record_id),
    ni AS (SELECT fingerprint, count(*) AS a FROM ri GROUP BY 1), np AS (SELECT fingerprint, count(*) AS b, min(record_id) AS m FROM rp GROUP BY 1)
    SELECT locator, fingerprint, record_id, 'same' AS action FROM k
    UNION ALL SELECT ri.locator, ri.fingerprint, CASE WHEN a = 1 AND b = 1 THEN m END, CASE WHEN a = 1 AND b = 1 THEN 'moved' WHEN b IS NULL THEN 'new' ELSE 'ambiguous' END FROM ri JOIN ni ON ni.fingerprint = ri.fingerprint LEFT JOIN np ON np.fingerprint = ri.fingerprint
    UNION ALL SELECT rp.locator, rp.fingerprint, rp.record_id, 'retired' FROM rp LEFT JOIN ni ON ni.fingerprint = rp.fingerprint WHERE ni.a IS NULL""")
def record_resolution(spark, sf_dir):
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    return overlap.resolve_records(spark.sql(_NEW), spark.sql(_OLD))


@query("""SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'missing_in_ledger' WHEN b.id IS NULL THEN 'missing_in_manifest' ELSE 'different' END AS problem
    FROM (SELECT o_orderkey AS id, o_orderstatus AS s FROM orders WHERE o_orderkey % 19 <> 0) a FULL JOIN (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 23 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 29 <> 0) b ON a.id = b.id
    WHERE a.id IS NULL OR b.id IS NULL OR a.s <> b.s""")
def ledger_manifest_agreement(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("s"))
    manifest = rows.filter("id % 29 <> 0").withColumn("s", F.when(F.col("id") % 23 == 0, "X").otherwise(F.col("s")))
    return overlap.agreement(rows.filter("id % 19 <> 0"), manifest, "id", ["s"])


@query("""WITH c AS (SELECT p_partkey, CAST(30 AS BIGINT) AS source_count FROM part), e AS (SELECT l_partkey, count(*) AS found, string_agg(CAST(l_orderkey * 10 + l_linenumber AS VARCHAR), ',' ORDER BY l_orderkey * 10 + l_linenumber) AS rows_ FROM lineitem GROUP BY 1)
    SELECT p_partkey, coalesce(found, 0) AS found, rows_ AS rows, CASE WHEN coalesce(found, 0) = source_count THEN 'complete' ELSE 'incomplete' END AS provenance FROM c LEFT JOIN e ON e.l_partkey = c.p_partkey""")
def provenance_evidence(spark, sf_dir):
    canonical = table(spark, sf_dir, "part").select("p_partkey", F.lit(30).cast("long").alias("source_count"))
    evidence = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("source_row"))
    return review.provenance(canonical, evidence, "p_partkey")


_CELLS = "SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN concat('=', p_name) WHEN 1 THEN concat(' -', p_name) WHEN 2 THEN concat('@', p_name) WHEN 3 THEN concat(chr(9), p_name) WHEN 4 THEN concat(' ', chr(13), p_name) ELSE p_name END AS cell FROM part"


@query(rf"SELECT p_partkey, CASE WHEN regexp_matches(cell, '^\s*[=+\-@]') OR regexp_matches(cell, '^\s*[\t\r]') THEN '''safe1:' || cell ELSE cell END AS cell FROM ({_CELLS})")
def csv_safe_cells(spark, sf_dir):
    table(spark, sf_dir, "part").createOrReplaceTempView("part")
    return spark.sql(_CELLS).select("p_partkey", csv_safe(F.col("cell")).alias("cell"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name || ' *' || p_brand), '[^a-z0-9]+', ' ', 'g')) AS signature FROM part")
def merchant_signatures(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", merchant_signature(F.concat("p_name", F.lit(" *"), "p_brand")).alias("signature"))


@query(f"WITH {LEDGER_SQL} SELECT id, CASE WHEN contains(status || '; ' || priority, 'HIGH') THEN status || '; ' || priority ELSE status || '; ' || priority || '; HIGH' END AS reason FROM ledger")
def reason_append(spark, sf_dir):
    return ledger(spark, sf_dir).select("id", add_reason(F.concat_ws("; ", "status", "priority"), F.lit("HIGH")).alias("reason"))


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(30,2)) AS total FROM events GROUP BY 1, 2")
def streaming_import_equals_batch(spark, sf_dir):
    from tallyspark.streaming.imports import import_available

    return import_available(spark, f"{sf_dir}/events.parquet", ["event_id"], lambda rows: rows.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("decimal(30,2)").alias("total")))
