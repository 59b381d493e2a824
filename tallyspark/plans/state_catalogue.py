"""Registered queries over the state of ledger rows: policy, identity, review, bindings, balances, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions.text import remove_reason, thousands
from tallyspark.operators import annotations, bindings, decisions, identity, policy, reports, review, statement_balances
from tallyspark.plans.catalogue import query
from tallyspark.plans.shapes import LEDGER_SQL, ledger, table

#: Ledger rows with flags, review reasons (both ';' lists) and texts.
STATE = {
    "flags": """concat_ws(';', CASE WHEN id % 5 = 0 THEN 'duplicate_suspected' END, CASE WHEN id % 9 = 0 THEN 'manual_correction' END, CASE WHEN id % 10 = 1 THEN 'local_memory_categorized' END, CASE WHEN id % 10 = 2 THEN 'model_categorized' END,
        CASE WHEN id % 13 = 0 THEN 'overlap_count_ambiguous' END, CASE WHEN id % 26 = 0 THEN 'overlap_prior_review' END, CASE WHEN id % 31 = 0 THEN 'overlap_history_ambiguous' END, CASE WHEN id % 17 = 0 THEN 'statement_opening_balance_conflict' END, CASE WHEN id % 34 = 0 THEN 'statement_opening_balance_conflict_page_3' END)""",
    "review_reasons": "concat_ws(';', CASE WHEN id % 4 = 0 THEN 'accounting_flow' END, CASE WHEN id % 6 = 0 THEN 'category_decision' END, CASE WHEN id % 13 = 0 THEN 'identity_issue' END)",
    "needs_review": "id % 4 = 0 OR id % 6 = 0 OR id % 13 = 0",
    "reason": "concat_ws('; ', CASE WHEN id % 5 = 0 THEN 'Duplicate candidate [old] of 2' END, CASE WHEN id % 3 = 0 THEN 'noted' END, CASE WHEN id % 8 = 0 THEN 'Batch accounting decision' END)",
    "merchant": "CASE id % 5 WHEN 0 THEN 'Bonus cashback' WHEN 1 THEN 'Bank interest' WHEN 2 THEN 'ATM withdrawal' WHEN 3 THEN 'Card payment' ELSE 'Corner shop' END",
    "original_description": "CASE WHEN id % 12 = 0 THEN 'Transfer' ELSE concat('ref ', status) END",
    "confidence": "CASE id % 3 WHEN 0 THEN '0.00' WHEN 1 THEN '' ELSE '0.90' END",
    "group_id": "CASE WHEN id % 6 <> 1 THEN concat(account_id, '/', CAST(id % 50 AS VARCHAR(20))) END",
    "provenance_status": "CASE WHEN id % 11 = 0 THEN 'ambiguous_count_mismatch' ELSE 'single_source' END",
}
_STATE = f"{LEDGER_SQL}, state AS (SELECT *, " + ", ".join(f"{e} AS {c}" for c, e in STATE.items()) + " FROM ledger)"
_STATE_SQL = _STATE + """, s AS (SELECT * EXCLUDE (flags, review_reasons), list_filter(string_split(flags, ';'), lambda x: x <> '') AS flags, list_filter(string_split(review_reasons, ';'), lambda x: x <> '') AS reasons FROM state)"""


def _state(spark, sf_dir):
    rows = ledger(spark, sf_dir).selectExpr("*", *(f"{e} AS {c}" for c, e in STATE.items()))
    return rows.withColumns({c: F.array_remove(F.split(c, ";"), "") for c in ("flags", "review_reasons")})


def _text(rows, *columns):
    """Arrays as text, in order."""
    return rows.withColumns({c: F.array_join(F.array_sort(c), ";") for c in columns})


_LIST = "array_to_string(list_sort({}), ';')"
_CATEGORIES = "SELECT DISTINCT category FROM (SELECT DISTINCT category FROM ledger UNION ALL SELECT p_type FROM part)"


def _policies(spark, sf_dir):
    categories = ledger(spark, sf_dir).select("category").union(table(spark, sf_dir, "part").select("p_type")).distinct()
    return policy.policies(categories, spark.createDataFrame([("Income", "spending"), ("PROMO", "spending"), ("Dining", "accounting"), ("SMALL", "odd")], "category string, kind string"))


_POLICIES_SQL = f"""c AS ({_CATEGORIES}), o AS (SELECT * FROM (VALUES ('Income', 'spending'), ('PROMO', 'spending'), ('Dining', 'accounting'), ('SMALL', 'odd')) AS t(category, given)),
    pol AS (SELECT c.category, coalesce(o.given, CASE WHEN c.category IN ('Income', 'Credit Card Payment', 'Internal Transfer', 'Savings', 'Investments') THEN 'accounting' WHEN c.category IN ('Other', 'Unknown') THEN 'manual_only' WHEN c.category IN ('Groceries', 'Dining') THEN 'spending' ELSE 'manual_only' END) AS kind,
    CASE WHEN o.given NOT IN ('spending', 'accounting', 'manual_only') THEN 'unknown_kind' WHEN o.given = 'spending' AND c.category IN ('Income', 'Credit Card Payment', 'Internal Transfer', 'Savings', 'Investments') THEN 'relaxes_protected' END AS problem FROM c LEFT JOIN o ON o.category = c.category)"""


@query(f"WITH {LEDGER_SQL}, {_POLICIES_SQL} SELECT category, kind, problem FROM pol")
def category_policies(spark, sf_dir):
    return _policies(spark, sf_dir)


_SUGGESTED = "CASE id % 5 WHEN 0 THEN 'Groceries' WHEN 1 THEN 'Dining' WHEN 2 THEN 'Nowhere' WHEN 3 THEN 'Income' ELSE 'PROMO' END"


@query(f"""WITH {_STATE_SQL}, {_POLICIES_SQL}, g AS (SELECT *, {_SUGGESTED} AS suggested, CAST((id % 100) / 100.0 AS DECIMAL(4,2)) AS conf FROM s)
    SELECT id, suggested, CASE WHEN kind IS NULL THEN 'invalid' WHEN kind <> 'spending' THEN 'rejected' WHEN amount_base IS NULL OR amount_base >= 0 OR owner IN ('', 'Unknown') OR list_contains(flags, 'duplicate_suspected') OR conf < 0.6 THEN 'reviewable' ELSE 'accepted' END AS outcome
    FROM g LEFT JOIN pol ON pol.category = g.suggested""")
def model_suggestions(spark, sf_dir):
    rows = _state(spark, sf_dir).withColumns({"suggested": F.expr(_SUGGESTED), "suggested_confidence": F.expr("CAST((id % 100) / 100.0 AS DECIMAL(4,2))"), "amount": F.col("amount_base")})
    return policy.judged_suggestions(rows, _policies(spark, sf_dir), 0.6).select("id", "suggested", "outcome")


@query(f"""WITH {_STATE_SQL}, f AS (SELECT *, CASE WHEN category = 'Unknown' AND needs_review AND NOT list_contains(flags, 'duplicate_suspected') THEN CASE WHEN amount_base > 0 AND merchant = 'Bonus cashback' THEN 'Other' WHEN amount_base > 0 AND merchant = 'Bank interest' THEN 'Income'
    WHEN amount_base < 0 AND merchant = 'ATM withdrawal' THEN 'Cash' WHEN amount_base > 0 AND merchant = 'Card payment' AND account_type = 'credit_card' THEN 'Credit Card Payment' END END AS found FROM s),
    r AS (SELECT *, CASE WHEN found IS NULL THEN reasons ELSE list_distinct(list_concat(list_filter(reasons, lambda x: x NOT IN ('category_decision', 'category_suggestion', 'ownership')), list_filter([CASE WHEN found = 'Other' THEN 'category_suggestion' END, CASE WHEN owner = 'Unknown' THEN 'ownership' END], lambda x: x IS NOT NULL))) END AS after FROM f)
    SELECT id, coalesce(found, category) AS category, CASE found WHEN 'Other' THEN 'refund' WHEN 'Income' THEN 'income' WHEN 'Cash' THEN 'expense' WHEN 'Credit Card Payment' THEN 'credit_card_payment' ELSE flow_type END AS flow_type,
    CASE WHEN found IS NULL THEN flow_source ELSE 'structural' END AS flow_source, {_LIST.format('after')} AS review_reasons, CASE WHEN found IS NULL THEN needs_review ELSE len(after) > 0 END AS needs_review FROM r""")
def structural_rows(spark, sf_dir):
    rows = policy.structural_rows(_state(spark, sf_dir).withColumn("amount", F.col("amount_base")))
    return _text(rows, "review_reasons").select("id", "category", "flow_type", "flow_source", "review_reasons", "needs_review")


_BUCKET = """CASE WHEN list_contains(flags, 'manual_correction') THEN 'exact_correction' WHEN list_contains(flags, 'local_memory_categorized') THEN 'memory' WHEN list_contains(flags, 'model_categorized') THEN CASE WHEN needs_review THEN 'reviewable_model' ELSE 'accepted_model' END
    WHEN category IN ('', 'Unknown') THEN 'unresolved' ELSE 'deterministic' END"""


@query(f"WITH {_STATE_SQL} SELECT {_BUCKET} AS bucket, count(*) AS n FROM s GROUP BY 1")
def categorization_provenance(spark, sf_dir):
    bucket = policy.provenance_bucket(F.col("flags"), F.col("needs_review"), F.col("category"))
    return _state(spark, sf_dir).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_STATE_SQL} SELECT id FROM s WHERE NOT list_has_any(flags, ['identity_migration_ambiguous', 'overlap_count_ambiguous', 'overlap_history_ambiguous']) AND provenance_status <> 'ambiguous_count_mismatch'
    AND lower(merchant) NOT IN ('', 'card payment', 'transfer') AND lower(original_description) NOT IN ('', 'transfer')""")
def learning_exclusions(spark, sf_dir):
    return policy.learnable(_state(spark, sf_dir), ["merchant", "original_description", "account_id"]).select("id")


_IDS = {"source_id": ("src_", 3), "source_namespace_id": ("ns_", 4), "source_revision": ("rev_", 6), "source_record_id": ("rec_", 12)}


def _ids_sql(digest):
    columns = [f"CASE WHEN c_custkey % {m} > 0 THEN concat('{p}', {digest('c_name')}) WHEN c_custkey % 24 = 0 THEN '' ELSE CASE WHEN c_custkey % 5 = 0 THEN '{p}short' ELSE '' END END AS {c}" for c, (p, m) in _IDS.items()]
    return "SELECT c_custkey, CASE WHEN c_custkey % 12 = 0 THEN concat('old', CAST(c_nationkey AS VARCHAR(20))) ELSE concat('txn_', substr(" + digest("c_mktsegment") + ", 1, 32)) END AS transaction_id, " + ", ".join(columns) + " FROM customer"


def _identities(spark, sf_dir):
    table(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    return spark.sql(_ids_sql(lambda c: f"sha2({c}, 256)"))


_IDS_SQL = f"ids AS ({_ids_sql(lambda c: f'sha256({c})')}), st AS (SELECT *, " + " + ".join(f"CAST({c} <> '' AS INT)" for c in _IDS) + " AS filled FROM ids)"


@query(f"""WITH {_IDS_SQL} SELECT c_custkey, CASE filled WHEN 4 THEN 'full' WHEN 0 THEN 'empty' ELSE 'partial' END AS identity_state,
    {' AND '.join(f"regexp_full_match({c}, '{p}[0-9a-f]{{64}}')" for c, (p, _) in _IDS.items())} AND regexp_full_match(transaction_id, 'txn_[0-9a-f]{{32}}') AS stable FROM st""")
def identity_states(spark, sf_dir):
    return _identities(spark, sf_dir).select("c_custkey", identity.identity_state().alias("identity_state"), identity.is_stable().alias("stable"))


@query(f"WITH {_IDS_SQL} SELECT transaction_id, count(*) AS claims FROM st WHERE filled = 0 AND transaction_id <> '' GROUP BY 1 HAVING count(*) > 1")
def legacy_multiplicity(spark, sf_dir):
    return identity.ambiguous_legacy_ids(_identities(spark, sf_dir))


@query("SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_suppkey, l_quantity ORDER BY l_orderkey, l_linenumber) AS INT) AS ordinal FROM lineitem")
def occurrence_ordinals(spark, sf_dir):
    return identity.ordinals(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_quantity", ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "ordinal")


@query(f"""WITH {_STATE_SQL} SELECT id, category NOT IN ('', 'Unknown') OR flow_source = 'correction' OR list_contains(flags, 'manual_correction') OR confidence NOT IN ('', '0', '0.00') OR NOT needs_review AS processed FROM s""")
def processed_history(spark, sf_dir):
    return _state(spark, sf_dir).select("id", identity.has_history().alias("processed"))


_STORED = "SELECT concat('src', CAST(l_suppkey AS VARCHAR(20))) AS source_id, concat('rec_', CAST(l_orderkey AS VARCHAR(20)), '_', CAST(l_linenumber AS VARCHAR(20))) AS record_id, concat(CAST(l_orderkey AS VARCHAR(20)), ':', CAST(l_linenumber AS VARCHAR(20))) AS locator, CAST(CAST(l_shipdate AS DATE) AS VARCHAR(20)) AS fingerprint FROM lineitem"
_SOURCES = "SELECT concat('src', CAST(s_suppkey AS VARCHAR(20))) AS source_id, concat('ns', CAST(s_suppkey AS VARCHAR(20))) AS namespace, concat('rev', CAST(s_suppkey AS VARCHAR(20))) AS revision FROM supplier"
_ARRIVING = "SELECT concat('ns', CAST(l_suppkey AS VARCHAR(20))) AS namespace, concat('rev', CAST(l_suppkey AS VARCHAR(20))) AS revision, concat(CAST(l_orderkey AS VARCHAR(20)), ':', CAST(CASE WHEN l_orderkey % 11 = 0 THEN l_linenumber + 100 ELSE l_linenumber END AS VARCHAR(20))) AS locator, CAST(CAST(CASE WHEN l_orderkey % 7 = 0 THEN l_shipdate + INTERVAL 1 DAY ELSE l_shipdate END AS DATE) AS VARCHAR(20)) AS fingerprint FROM lineitem WHERE l_suppkey % 3 > 0"


@query(f"""WITH stored AS ({_STORED}), src AS ({_SOURCES}), i AS (SELECT src.source_id, a.locator, a.fingerprint FROM ({_ARRIVING}) a JOIN src ON src.namespace = a.namespace), touched AS (SELECT DISTINCT source_id FROM i),
    p AS (SELECT * FROM stored WHERE source_id IN (SELECT source_id FROM touched)), k AS (SELECT i.*, p.record_id FROM i JOIN p ON p.source_id = i.source_id AND p.locator = i.locator AND p.fingerprint = i.fingerprint),
    ri AS (SELECT * FROM i ANTI JOIN k ON k.source_id = i.source_id AND k.locator = i.locator AND k.fingerprint = i.fingerprint), rp AS (SELECT * FROM p ANTI JOIN k ON k.record_id = p.record_id),
    ni AS (SELECT source_id, fingerprint, count(*) AS a FROM ri GROUP BY 1, 2), np AS (SELECT source_id, fingerprint, count(*) AS b, min(record_id) AS m FROM rp GROUP BY 1, 2),
    al AS (SELECT source_id, 'retained' AS action, record_id FROM stored WHERE source_id NOT IN (SELECT source_id FROM touched) UNION ALL SELECT source_id, 'same', record_id FROM k
    UNION ALL SELECT ri.source_id, CASE WHEN a = 1 AND b = 1 THEN 'moved' WHEN b IS NULL THEN 'new' ELSE 'ambiguous' END, CASE WHEN a = 1 AND b = 1 THEN m END FROM ri JOIN ni ON ni.source_id = ri.source_id AND ni.fingerprint = ri.fingerprint LEFT JOIN np ON np.source_id = ri.source_id AND np.fingerprint = ri.fingerprint
    UNION ALL SELECT rp.source_id, 'retired', rp.record_id FROM rp LEFT JOIN ni ON ni.source_id = rp.source_id AND ni.fingerprint = rp.fingerprint WHERE a IS NULL)
    SELECT source_id, action, count(*) AS n, min(CASE WHEN action <> 'new' THEN record_id END) AS first_id, max(CASE WHEN action <> 'new' THEN record_id END) AS last_id FROM al GROUP BY 1, 2""")
def batch_resolution(spark, sf_dir):
    for name in ("lineitem", "supplier"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    made = identity.resolve_batch(spark.sql(_STORED), spark.sql(_SOURCES), spark.sql(_ARRIVING), replace=True)
    old = F.when(F.col("action") != "new", F.col("record_id"))
    return made.groupBy("source_id", "action").agg(F.count(F.lit(1)).alias("n"), F.min(old).alias("first_id"), F.max(old).alias("last_id"))


_GROUPS = "SELECT account_id, date, count(*) AS n FROM ledger GROUP BY 1, 2 HAVING count(*) >= 2"


@query(f"""WITH {_STATE_SQL}, g AS ({_GROUPS}), m AS (SELECT s.*, g.n AS size_, s.id % 15 = 0 AS final_, list_filter(flags, lambda x: x <> 'duplicate_suspected') AS bare FROM s LEFT JOIN g ON g.account_id = s.account_id AND g.date = s.date),
    c AS (SELECT *, list_has_any(bare, ['identity_migration_ambiguous', 'overlap_count_ambiguous', 'overlap_history_ambiguous']) AS other FROM m), k AS (SELECT *, list_filter(reasons, lambda x: x <> 'identity_issue') AS calm FROM c), d AS (SELECT *, CASE WHEN other THEN list_append(calm, 'identity_issue') ELSE calm END AS cleared FROM k),
    e AS (SELECT *, CASE WHEN size_ IS NOT NULL AND NOT final_ THEN list_distinct(list_append(cleared, 'identity_issue')) ELSE cleared END AS after FROM d)
    SELECT id, {_LIST.format("list_concat(bare, list_filter([CASE WHEN size_ IS NOT NULL AND NOT final_ AND len(cleared) = 0 THEN 'duplicate_review_promoted' END, CASE WHEN size_ IS NOT NULL THEN 'duplicate_suspected' END], lambda x: x IS NOT NULL))")} AS flags,
    {_LIST.format('after')} AS review_reasons, len(after) > 0 AS needs_review,
    concat_ws('; ', CASE WHEN id % 3 = 0 THEN 'noted' END, CASE WHEN id % 8 = 0 THEN 'Batch accounting decision' END, CASE WHEN size_ IS NOT NULL THEN 'Duplicate candidate [' || account_id || ' ' || CAST(date AS VARCHAR) || '] of ' || CAST(size_ AS VARCHAR) END) AS reason FROM e""")
def duplicate_annotation(spark, sf_dir):
    rows = _state(spark, sf_dir)
    groups = rows.groupBy("account_id", "date").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    members = rows.join(groups, ["account_id", "date"]).select("id", F.concat_ws(" ", "account_id", F.col("date").cast("string")).alias("group_id"), "n")
    marked = annotations.annotate_duplicates(rows, members, rows.filter("id % 15 = 0").select("id"))
    return _text(marked, "flags", "review_reasons").select("id", "flags", "review_reasons", "needs_review", "reason")


@query(f"""WITH {_STATE_SQL}, r AS (SELECT DISTINCT group_id FROM s WHERE id % 7 = 0 AND group_id IS NOT NULL), j AS (SELECT s.*, s.provenance_status = 'ambiguous_count_mismatch' AND r.group_id IS NULL AS amb, list_contains(flags, 'overlap_count_ambiguous') AS had, list_contains(flags, 'overlap_prior_review') AS prior_,
    list_contains(flags, 'overlap_history_ambiguous') AS hist, list_contains(flags, 'manual_correction') AS corr, list_filter(flags, lambda x: x NOT IN ('overlap_count_ambiguous', 'overlap_prior_review') AND (coalesce(s.group_id, '') <> '' OR x NOT IN ('duplicate_suspected', 'duplicate_review_promoted'))) AS bare, list_filter(reasons, lambda x: x <> 'identity_issue') AS calm FROM s LEFT JOIN r ON r.group_id = s.group_id),
    k AS (SELECT *, CASE WHEN amb OR hist THEN list_append(calm, 'identity_issue') WHEN had AND NOT corr THEN CASE WHEN prior_ THEN list_append(calm, 'identity_issue') ELSE calm END ELSE reasons END AS after FROM j)
    SELECT id, {_LIST.format("list_concat(bare, list_filter([CASE WHEN amb AND ((NOT had AND needs_review) OR prior_) THEN 'overlap_prior_review' END, CASE WHEN amb THEN 'overlap_count_ambiguous' END], lambda x: x IS NOT NULL))")} AS flags, {_LIST.format('after')} AS review_reasons, CASE WHEN amb OR hist OR (had AND NOT corr) THEN len(after) > 0 ELSE needs_review END AS needs_review, CASE WHEN coalesce(group_id, '') <> '' THEN reason ELSE array_to_string(list_filter(string_split(reason, '; '), lambda x: x <> '' AND x <> 'Possible duplicate transaction' AND NOT starts_with(x, 'Duplicate candidate [')), '; ') END || CASE WHEN amb THEN CASE WHEN reason = '' OR (coalesce(group_id, '') = '' AND reason = 'Duplicate candidate [old] of 2') THEN '' ELSE '; ' END || 'Sources report different numbers of this record' ELSE '' END AS reason FROM k""")
def overlap_review(spark, sf_dir):
    rows = _state(spark, sf_dir)
    resolved = rows.filter("id % 7 = 0 and group_id is not null").select("group_id").distinct()
    return _text(annotations.enforce_overlap_review(rows, resolved), "flags", "review_reasons").select("id", "flags", "review_reasons", "needs_review", "reason")


@query(f"""WITH {_STATE_SQL}, ev AS (SELECT id, list_filter([CASE WHEN id % 3 = 0 THEN 'invalid_amount' END, CASE WHEN id % 6 = 0 THEN 'statement_closing_balance_conflict_page_12' END], lambda x: x IS NOT NULL) AS now_ FROM s),
    j AS (SELECT s.id, now_, list_filter(flags, lambda x: NOT starts_with(x, 'statement_opening_balance_conflict')) AS kept, list_filter(reasons, lambda x: x <> 'source_data_issue') AS calm FROM s JOIN ev ON ev.id = s.id)
    SELECT id, {_LIST.format('list_concat(kept, now_)')} AS flags, {_LIST.format("CASE WHEN len(now_) > 0 THEN list_append(calm, 'source_data_issue') ELSE calm END")} AS review_reasons FROM j""")
def source_flag_repair(spark, sf_dir):
    rows = _state(spark, sf_dir)
    some = F.array_compact(F.array(F.when(F.col("id") % 3 == 0, "invalid_amount"), F.when(F.col("id") % 6 == 0, "statement_closing_balance_conflict_page_12"), F.lit("kept_elsewhere")))
    return _text(annotations.repair_source_flags(rows, rows.select("id", some.alias("flags"))), "flags", "review_reasons").select("id", "flags", "review_reasons")


_MAPPINGS = [("*ring*", "card", "b1"), ("[a-d]*", "bank", "b2"), ("?i*", "card", "b1"), ("*.none", "x", "y")]


@query(f"""WITH h AS (SELECT p_partkey, list_distinct(list_filter([{', '.join(f"CASE WHEN p_name GLOB '{p}' THEN '{a}/{b}' END" for p, a, b in _MAPPINGS)}], lambda x: x IS NOT NULL)) AS hits FROM part)
    SELECT p_partkey, CASE WHEN len(hits) = 1 THEN split_part(hits[1], '/', 1) END AS profile, CASE WHEN len(hits) = 1 THEN split_part(hits[1], '/', 2) END AS binding, CASE WHEN len(hits) = 1 THEN 'mapped' WHEN len(hits) = 0 THEN 'none' ELSE 'conflict' END AS status FROM h""")
def filename_mappings(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", bindings.filename_mapping(F.col("p_name"), _MAPPINGS).alias("m")).select("p_partkey", "m.*")


_BINDINGS = "SELECT concat('bind_', CAST(n_nationkey % 3 AS VARCHAR(20))) AS binding_id, concat('acct_', CAST(n_nationkey AS VARCHAR(20))) AS source_account_id, concat('own_', CAST(n_nationkey AS VARCHAR(20))) AS account_id, n_name AS account, concat('owner_', CAST(n_nationkey % 3 AS VARCHAR(20))) AS owner FROM nation"
_BINDING_OF = "CASE WHEN id % 4 > 0 THEN concat('bind_', CAST(id % 3 AS VARCHAR(20))) END"


@query(f"""WITH {LEDGER_SQL}, b AS ({_BINDINGS}), l AS (SELECT *, {_BINDING_OF} AS binding_id FROM ledger)
    SELECT l.id, coalesce(b.account_id, l.account_id) AS account_id, coalesce(b.owner, l.owner) AS owner, l.binding_id IS NULL OR b.binding_id IS NOT NULL AS covered FROM l LEFT JOIN b ON b.binding_id = l.binding_id AND b.source_account_id = l.account_id""")
def account_bindings(spark, sf_dir):
    return _bound(spark, sf_dir).select("id", "account_id", "owner", "covered")


def _bound(spark, sf_dir):
    table(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    rows = ledger(spark, sf_dir).withColumns({"binding_id": F.expr(_BINDING_OF), "account": F.lit("")})
    return bindings.bind_accounts(rows, spark.sql(_BINDINGS))


@query(f"""WITH {LEDGER_SQL}, b AS ({_BINDINGS}), l AS (SELECT *, {_BINDING_OF} AS binding_id FROM ledger) SELECT l.binding_id, count(DISTINCT l.account_id) AS missing
    FROM l LEFT JOIN b ON b.binding_id = l.binding_id AND b.source_account_id = l.account_id WHERE l.binding_id IS NOT NULL AND b.binding_id IS NULL GROUP BY 1""")
def uncovered_accounts(spark, sf_dir):
    return bindings.uncovered(_bound(spark, sf_dir))


#: Groups of source rows (lineitem by part and quantity) and their canonical rows (as many as the largest line number).
_MEMBERS = "SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey * 100 + CAST(l_quantity AS INT) AS group_id, l_suppkey, l_orderkey, l_linenumber FROM lineitem"
_CANONICAL = "SELECT DISTINCT l_partkey * 100 + CAST(l_quantity AS INT) AS group_id, -(l_partkey * 1000 + CAST(l_quantity AS INT) * 10 + l_linenumber % 2) AS canonical_id FROM lineitem"


def _grouped(spark, sf_dir):
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    return spark.sql(_MEMBERS), spark.sql(_CANONICAL)


@query(f"""WITH m AS ({_MEMBERS}), c AS ({_CANONICAL}), o AS (SELECT group_id, min(w) AS lo, max(w) AS hi FROM (SELECT group_id, CASE WHEN l_suppkey % 4 > 1 THEN concat('owner_', CAST(l_suppkey % 4 AS VARCHAR)) END AS w FROM m) WHERE w IS NOT NULL GROUP BY 1)
    SELECT canonical_id, CASE WHEN lo = hi THEN lo END AS owner, lo <> hi AS conflict FROM c JOIN o ON o.group_id = c.group_id""")
def bound_owner_projection(spark, sf_dir):
    members, canonical = _grouped(spark, sf_dir)
    owner = F.when(F.col("l_suppkey") % 4 > 1, F.concat(F.lit("owner_"), (F.col("l_suppkey") % 4).cast("string")))
    return bindings.bound_owners(members.select("id", "group_id", owner.alias("owner")), canonical)


@query(f"""WITH {LEDGER_SQL} SELECT id FROM ledger WHERE date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' AND category IN ('Groceries', 'Unknown') AND flow_type IN ('refund', 'unresolved') AND coalesce(amount_base, posted_amount) > 0""")
def review_filters(spark, sf_dir):
    return decisions.review_filter(ledger(spark, sf_dir), ["Groceries", "Unknown"], ["refund", "unresolved"], "inflow", "1996-01-01", "1996-12-31").select("id")


_ENTRIES = """SELECT o_orderkey * 2 AS index_, CASE o_orderkey % 9 WHEN 0 THEN ' ' WHEN 1 THEN 'none' WHEN 2 THEN concat('alias', CAST(o_orderkey AS VARCHAR(20))) ELSE CAST(o_orderkey AS VARCHAR(20)) END AS transaction_id, CASE o_orderkey % 8 WHEN 0 THEN 'Income' WHEN 1 THEN ' leave_unresolved' WHEN 2 THEN 'refund' WHEN 3 THEN 'INTERNAL_TRANSFER' WHEN 4 THEN 'income ' WHEN 5 THEN 'what' ELSE 'expense' END AS decision FROM orders
    UNION ALL SELECT o_orderkey * 2 + 1, CAST(o_orderkey AS VARCHAR(20)), 'refund' FROM orders WHERE o_custkey % 2 = 0"""
_ALIASES = "SELECT concat('alias', CAST(o_orderkey AS VARCHAR(20))) AS alias, CAST(o_orderkey AS VARCHAR(20)) AS id FROM orders"
_PLAN_SQL = f"""{_STATE_SQL}, en AS ({_ENTRIES}), g AS (SELECT *, CASE WHEN trim(transaction_id) = '' THEN NULL WHEN starts_with(transaction_id, 'alias') THEN substr(transaction_id, 6) ELSE transaction_id END AS tid, replace(lower(trim(decision)), '_', '-') AS d0 FROM en),
    n AS (SELECT *, CASE d0 WHEN 'leave-unresolved' THEN 'unresolved' ELSE CASE WHEN d0 IN ('income', 'refund', 'internal-transfer', 'credit-card-payment', 'investment-transfer', 'expense', 'unresolved') THEN d0 END END AS d, min(index_) OVER (PARTITION BY tid) AS f FROM g),
    h AS (SELECT n.*, s.id, s.reasons, list_contains(s.reasons, 'accounting_flow') AS pend, coalesce(amount_base, posted_amount) AS amt, s.reason = 'Batch accounting decision' AS batch,
    s.flow_type = CASE d WHEN 'income' THEN 'income' WHEN 'refund' THEN 'refund' WHEN 'internal-transfer' THEN 'internal_transfer' WHEN 'expense' THEN 'expense' WHEN 'unresolved' THEN 'unresolved' END AND coalesce(s.category = CASE d WHEN 'income' THEN 'Income' WHEN 'internal-transfer' THEN 'Internal Transfer' END, TRUE) AS holds FROM n LEFT JOIN s ON CAST(s.id AS VARCHAR) = n.tid),
    plan AS (SELECT index_, tid AS id, d AS decision, reasons, CASE WHEN tid IS NULL THEN 'invalid_transaction_id' WHEN index_ <> f THEN 'duplicate_transaction_id' WHEN id IS NULL THEN 'stale_transaction_id' WHEN d IS NULL THEN 'unsupported_decision'
    WHEN NOT pend THEN CASE WHEN holds THEN 'unchanged' ELSE 'stale_review_state' END WHEN batch AND holds THEN 'unchanged' WHEN d = 'income' AND amt <= 0 THEN 'decision_not_applicable' ELSE 'applied' END AS outcome FROM h)"""


def _plan(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    rows = _state(spark, sf_dir).withColumn("id", F.col("id").cast("string"))
    return decisions.plan_decisions(spark.sql(_ENTRIES).withColumnRenamed("index_", "index"), rows, spark.sql(_ALIASES)), rows


@query(f"WITH {_PLAN_SQL} SELECT index_, id, decision, outcome FROM plan")
def decision_plan(spark, sf_dir):
    return _plan(spark, sf_dir)[0].withColumnRenamed("index", "index_")


@query(f"""WITH {_PLAN_SQL}, q AS (SELECT *, list_filter(reasons, lambda x: x <> 'accounting_flow' AND (decision NOT IN ('income', 'internal-transfer') OR x NOT IN ('category_decision', 'category_suggestion'))) AS calm FROM plan WHERE outcome = 'applied'), w AS (SELECT *, CASE WHEN decision = 'unresolved' THEN list_append(calm, 'accounting_flow') ELSE calm END AS after FROM q)
    SELECT id, CASE decision WHEN 'income' THEN 'Income' WHEN 'internal-transfer' THEN 'Internal Transfer' END AS category, replace(decision, '-', '_') AS flow_type, {_LIST.format('after')} AS review_reasons, len(after) > 0 AS needs_review FROM w""")
def decision_patches(spark, sf_dir):
    plan, rows = _plan(spark, sf_dir)
    return _text(decisions.decision_patches(plan, rows), "review_reasons").select("id", "category", "flow_type", "review_reasons", "needs_review")


@query(f"""WITH m AS ({_MEMBERS}), c AS ({_CANONICAL}), one AS (SELECT group_id, min(canonical_id) AS t FROM c WHERE canonical_id % 3 <> 0 GROUP BY 1 HAVING count(*) = 1) SELECT m.id AS alias, min(one.t) AS id FROM m JOIN one ON one.group_id = m.group_id GROUP BY 1 HAVING count(DISTINCT one.t) = 1""")
def manual_aliases(spark, sf_dir):
    members, canonical = _grouped(spark, sf_dir)
    return decisions.proven_aliases(members, canonical.withColumn("active", F.col("canonical_id") % 3 != 0))


_CORRECTED = "SELECT l_orderkey * 10 + l_linenumber AS id, concat('cat', CAST(l_partkey % 3 AS VARCHAR(20))) AS category, CASE WHEN l_suppkey % 2 = 0 THEN 'a' ELSE 'b' END AS owner FROM lineitem WHERE l_linenumber < 4 UNION ALL SELECT DISTINCT -(l_partkey * 1000 + CAST(l_quantity AS INT) * 10 + l_linenumber % 2), 'own', 'x' FROM lineitem WHERE l_partkey % 5 = 0"


@query(f"""WITH m AS ({_MEMBERS}), c AS ({_CANONICAL}), k AS ({_CORRECTED}), g AS (SELECT m.group_id, count(*) AS n, count(k.id) AS patched, min(k.category || '|' || k.owner) AS lo, max(k.category || '|' || k.owner) AS hi FROM m LEFT JOIN k ON k.id = m.id GROUP BY 1 HAVING count(k.id) > 0),
    z AS (SELECT group_id, count(*) AS slots FROM c GROUP BY 1), j AS (SELECT c.canonical_id, o.id IS NOT NULL AS has_own, o.category AS oc, o.owner AS oo, g.n, lo, lo = hi AND (slots = 1 OR patched = n) AS agreed FROM c LEFT JOIN k o ON o.id = c.canonical_id LEFT JOIN g ON g.group_id = c.group_id JOIN z ON z.group_id = c.group_id)
    SELECT canonical_id AS id, CASE WHEN has_own THEN oc WHEN agreed THEN split_part(lo, '|', 1) END AS category, CASE WHEN has_own THEN oo WHEN agreed THEN split_part(lo, '|', 2) END AS owner, CASE WHEN has_own THEN 'own' WHEN agreed THEN 'projected' ELSE 'ambiguous' END AS how FROM j WHERE has_own OR n IS NOT NULL""")
def correction_projection(spark, sf_dir):
    members, canonical = _grouped(spark, sf_dir)
    return decisions.project_corrections(members, canonical, spark.sql(_CORRECTED), ["category", "owner"])


_PRIOR_STATE = "SELECT account_id, date, posted_amount, concat('old ', category) AS category, owner, reasons FROM s WHERE id % 10 < 7"


@query(f"""WITH {_STATE_SQL}, p AS ({_PRIOR_STATE}), q AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY account_id, date, posted_amount) AS k FROM p) WHERE k = 1 AND len(reasons) > 0), n AS (SELECT *, count(*) OVER (PARTITION BY account_id, date, posted_amount) AS k FROM s)
    SELECT n.id, CASE WHEN n.k = 1 AND q.k = 1 THEN q.category ELSE n.category END AS category, coalesce(n.k = 1 AND q.k = 1, FALSE) AS migrated FROM n LEFT JOIN q ON q.account_id = n.account_id AND q.date = n.date AND q.posted_amount = n.posted_amount""")
def review_migration(spark, sf_dir):
    rows = _state(spark, sf_dir)
    prior = rows.filter("id % 10 < 7").withColumn("category", F.concat(F.lit("old "), "category"))
    return decisions.migrated_reviews(rows, prior, ["account_id", "date", "posted_amount"], ["category", "owner"]).select("id", "category", "migrated")


_OBSERVED = """SELECT concat('r', CAST(l_linenumber % 2 AS VARCHAR(20))) AS reader, concat('f', CAST(l_orderkey AS VARCHAR(20))) AS file, concat('acct_', CAST(l_suppkey % 3 AS VARCHAR(20))) AS account_id, CASE WHEN l_orderkey % 4 = 0 THEN '' ELSE 'main' END AS section, 'HKD' AS currency,
    CASE WHEN l_linenumber % 3 = 0 THEN 'closing' ELSE 'opening' END AS kind, CAST(l_quantity % 4 AS DECIMAL(20,2)) AS value, l_linenumber AS page FROM lineitem"""
_ROWS = """SELECT l_orderkey * 10 + l_linenumber AS id, concat('f', CAST(l_orderkey AS VARCHAR(20))) AS file, concat('acct_', CAST(l_suppkey % 3 AS VARCHAR(20))) AS account_id, CASE WHEN l_orderkey % 8 = 0 AND l_linenumber % 2 = 0 THEN 'other' ELSE 'main' END AS section, 'HKD' AS currency, l_linenumber AS position FROM lineitem"""
_MERGED_SQL = f"o AS ({_OBSERVED}), pr AS (SELECT file, account_id, section, currency, kind, value, reader, count(*) AS n, list(page) AS ps FROM o GROUP BY ALL), mg AS (SELECT file, account_id, section, currency, kind, value, max(n) AS n, list_sort(list_distinct(flatten(list(ps)))) AS pages FROM pr GROUP BY ALL)"


def _merged(spark, sf_dir):
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    return statement_balances.merge_observations(spark.sql(_OBSERVED))


@query(f"WITH {_MERGED_SQL} SELECT file, account_id, section, currency, kind, value, n, array_to_string(pages, ',') AS pages FROM mg")
def balance_observations(spark, sf_dir):
    return _merged(spark, sf_dir).withColumn("pages", F.array_join(F.col("pages").cast("array<string>"), ","))


@query(f"""WITH {_MERGED_SQL}, rw AS ({_ROWS}), ends_ AS (SELECT file, account_id, section, currency, arg_min(id, position) AS opening, arg_max(id, position) AS closing FROM rw GROUP BY ALL), lone AS (SELECT file, account_id, currency, min(opening) AS lo, min(closing) AS lc FROM ends_ GROUP BY ALL HAVING count(*) = 1),
    st AS (SELECT file, account_id, section, currency, kind, min(value) AS low, max(value) AS high, list_sort(list_distinct(flatten(list(pages)))) AS pages FROM mg GROUP BY ALL),
    pl AS (SELECT CASE kind WHEN 'opening' THEN coalesce(e.opening, CASE WHEN st.section = '' THEN lo END) ELSE coalesce(e.closing, CASE WHEN st.section = '' THEN lc END) END AS id, kind, CASE WHEN low = high THEN low END AS value, CASE WHEN low <> high THEN list_concat(['statement_' || kind || '_balance_conflict'], list_transform(pages, lambda p: 'statement_' || kind || '_balance_conflict_page_' || CAST(p AS VARCHAR))) ELSE [] END AS more
    FROM st LEFT JOIN ends_ e ON e.file = st.file AND e.account_id = st.account_id AND e.section = st.section AND e.currency = st.currency LEFT JOIN lone ON lone.file = st.file AND lone.account_id = st.account_id AND lone.currency = st.currency),
    br AS (SELECT id, max(CASE WHEN kind = 'opening' THEN value END) AS opening, max(CASE WHEN kind = 'closing' THEN value END) AS closing, flatten(list(more)) AS more FROM pl WHERE id IS NOT NULL GROUP BY 1)
    SELECT rw.id, br.opening, br.closing, coalesce({_LIST.format('list_distinct(br.more)')}, '') AS flags FROM rw LEFT JOIN br ON br.id = rw.id""")
def balance_attachment(spark, sf_dir):
    merged = _merged(spark, sf_dir)
    rows = spark.sql(_ROWS).withColumn("flags", F.array().cast("array<string>"))
    return _text(statement_balances.attach_balances(rows, merged), "flags").select("id", "opening", "closing", "flags")


_STATEMENT_ROWS = "SELECT *, concat('src_', CAST(id % 40 AS VARCHAR(20))) AS statement, concat('file', CAST(id % 40 AS VARCHAR(20))) AS source_file, CAST(id % 6 AS VARCHAR(20)) AS source_page, 'main' AS section, CASE WHEN id % 40 = 1 THEN CASE WHEN id % 3 = 0 THEN '1.50' ELSE ' 2' END WHEN id % 40 = 2 THEN CASE WHEN id % 3 = 0 THEN 'x' ELSE '2' END WHEN id % 40 = 3 THEN CASE WHEN id % 3 = 0 THEN '2.0' ELSE '2' END ELSE '' END AS statement_opening_balance"


@query(f"""WITH {_STATE_SQL}, r AS ({_STATEMENT_ROWS} FROM s), d AS (SELECT statement FROM r WHERE trim(statement_opening_balance) <> '' GROUP BY 1 HAVING count(*) = count(TRY_CAST(trim(statement_opening_balance) AS DECIMAL(20,4))) AND count(DISTINCT TRY_CAST(trim(statement_opening_balance) AS DECIMAL(20,4))) > 1),
    c AS (SELECT *, list_transform(list_filter(flags, lambda f: regexp_full_match(f, 'statement_opening_balance_conflict_page_[0-9]+')), lambda f: substr(f, 41)) AS marked FROM r WHERE list_contains(flags, 'statement_opening_balance_conflict') OR (statement IN (SELECT statement FROM d) AND trim(statement_opening_balance) <> ''))
    SELECT DISTINCT statement, source_file, unnest(CASE WHEN len(marked) > 0 THEN marked ELSE [source_page] END) AS source_page, section FROM c""")
def balance_conflicts(spark, sf_dir):
    _state(spark, sf_dir).createOrReplaceTempView("state_rows")
    return statement_balances.conflict_contexts(spark.sql(f"{_STATEMENT_ROWS} FROM state_rows"), "opening", ["statement"])


@query(f"""WITH {_STATE_SQL} SELECT id, category AS suggested_category, flow_type AS suggested_flow_type, owner AS suggested_owner, '' AS category, '' AS flow_type, '' AS owner, array_to_string(list_transform(reasons, lambda r: CASE r WHEN 'accounting_flow' THEN 'Resolve the accounting flow' WHEN 'category_decision' THEN 'Choose a category' WHEN 'identity_issue' THEN 'Resolve a transaction identity conflict' END), '; ') AS review_reason_labels
    FROM s WHERE needs_review""")
def review_queue_labels(spark, sf_dir):
    rows = reports.review_queue(_state(spark, sf_dir))
    return rows.select("id", "suggested_category", "suggested_flow_type", "suggested_owner", "category", "flow_type", "owner", "review_reason_labels")


@query(f"WITH {LEDGER_SQL} SELECT DISTINCT posted_currency AS currency, date FROM ledger WHERE posted_currency <> 'HKD'")
def requested_rates(spark, sf_dir):
    return reports.requested_rates(ledger(spark, sf_dir), "HKD")


@query(f"""WITH {_STATE_SQL}, x AS (SELECT *, CASE WHEN id % 20 = 0 THEN NULL ELSE date END AS day, CASE WHEN id % 3 = 0 THEN '' ELSE concat('src', CAST(id % 90 AS VARCHAR)) END AS source_id, concat('file', CAST(id % 60 AS VARCHAR)) AS source_file, coalesce(amount_base, posted_amount) AS amt FROM s), y AS (SELECT *, coalesce(day BETWEEN DATE '1995-01-01' AND DATE '1996-06-30', FALSE) AS inside FROM x)
    SELECT count(*) FILTER (WHERE inside) AS in_period, count(*) FILTER (WHERE day IS NOT NULL AND NOT inside) AS outside, count(*) FILTER (WHERE day IS NULL) AS undated, count(DISTINCT CASE WHEN inside THEN CASE WHEN source_id = '' THEN source_file ELSE source_id END END) AS statements, count(*) FILTER (WHERE inside AND needs_review) AS pending,
    count(*) FILTER (WHERE inside AND category IN ('', 'Unknown')) AS uncategorized, count(*) FILTER (WHERE inside AND flow_type = 'unresolved' AND amt > 0) AS unresolved_in, count(*) FILTER (WHERE inside AND flow_type = 'unresolved' AND amt < 0) AS unresolved_out FROM y""")
def status_summary(spark, sf_dir):
    rows = _state(spark, sf_dir).withColumns(
        {"date": F.when(F.col("id") % 20 != 0, F.col("date")), "source_id": F.when(F.col("id") % 3 == 0, "").otherwise(F.concat(F.lit("src"), (F.col("id") % 90).cast("string"))), "source_file": F.concat(F.lit("file"), (F.col("id") % 60).cast("string"))}
    )
    return reports.status_summary(rows, "1995-01-01", "1996-06-30")


@query(f"""WITH {_STATE_SQL}, x AS (SELECT group_id, id, greatest(id % 4, 1) AS k FROM s), g AS (SELECT group_id, arg_min(k, id) AS k FROM x WHERE group_id IS NOT NULL GROUP BY 1) SELECT CAST((SELECT sum(k) FROM x WHERE group_id IS NULL) + (SELECT sum(k) FROM g) AS BIGINT) AS total""")
def source_occurrence_count(spark, sf_dir):
    return reports.source_occurrences(_state(spark, sf_dir).select("group_id", F.col("id").alias("position"), (F.col("id") % 4).alias("source_occurrence_count")))


_SOURCE_OF = "CASE id % 7 WHEN 0 THEN 'statement_posted' WHEN 1 THEN 'matched_exchange_leg' WHEN 2 THEN 'configured_dated_rate' WHEN 3 THEN 'hkma_daily_reference_rate' WHEN 4 THEN 'configured_fixed_rate' WHEN 5 THEN '' ELSE 'elsewhere' END"


@query(f"""WITH {LEDGER_SQL}, x AS (SELECT *, {_SOURCE_OF} AS src, CASE WHEN id % 2 = 0 THEN CAST(date AS VARCHAR) ELSE '' END AS d, CASE WHEN id % 3 = 0 THEN 'official' ELSE '' END AS p FROM ledger)
    SELECT id, concat_ws(' · ', CASE src WHEN 'statement_posted' THEN 'Statement-posted' WHEN 'matched_exchange_leg' THEN 'Matched exchange leg' WHEN 'configured_dated_rate' THEN 'Dated rate estimate' WHEN 'hkma_daily_reference_rate' THEN 'HKMA reference estimate' WHEN 'configured_fixed_rate' THEN 'Fixed rate estimate' WHEN '' THEN 'Missing' ELSE src END || ' (' || valuation_status || ')', nullif(d, ''), nullif(p, '')) AS label FROM x""")
def valuation_labels(spark, sf_dir):
    date, provider = F.when(F.col("id") % 2 == 0, F.col("date").cast("string")).otherwise(""), F.when(F.col("id") % 3 == 0, "official").otherwise("")
    return ledger(spark, sf_dir).select("id", reports.valuation_label(F.col("valuation_status"), F.expr(_SOURCE_OF), date, provider).alias("label"))


@query(f"""WITH {_STATE_SQL}, e AS (SELECT group_id, string_agg(concat('f', CAST(id % 5 AS VARCHAR), ':', CAST(id AS VARCHAR)), ',' ORDER BY concat('f', CAST(id % 5 AS VARCHAR)), id) AS ev FROM s WHERE group_id IS NOT NULL GROUP BY 1)
    SELECT s.id, coalesce(e.ev, '') AS evidence FROM s LEFT JOIN e ON e.group_id = s.group_id WHERE amount_base IS NULL""")
def missing_valuation_evidence(spark, sf_dir):
    rows = _state(spark, sf_dir)
    evidence = rows.filter("group_id is not null").select("group_id", F.concat(F.lit("f"), (F.col("id") % 5).cast("string")).alias("source_file"), F.col("id").alias("source_row"))
    return reports.missing_valuations(rows, evidence)


@query(f"""WITH m AS ({_MEMBERS}), c AS ({_CANONICAL}), a AS (SELECT group_id, count(*) AS n FROM m GROUP BY 1), b AS (SELECT group_id, count(*) AS k FROM c GROUP BY 1) SELECT count(*) AS groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS occurrences FROM a LEFT JOIN b ON b.group_id = a.group_id WHERE n > coalesce(k, 0)""")
def duplicate_compatibility(spark, sf_dir):
    return reports.duplicate_counts(*_grouped(spark, sf_dir))


@query(f"""WITH m AS ({_MEMBERS}), c AS ({_CANONICAL}), ch AS (SELECT group_id, count(*) AS n_canonical FROM c WHERE canonical_id % 5 = 0 GROUP BY 1) SELECT ch.group_id, (SELECT count(*) FROM m WHERE m.group_id = ch.group_id) AS n_source, n_canonical FROM ch""")
def overlap_restriction(spark, sf_dir):
    members, canonical = _grouped(spark, sf_dir)
    return reports.touching_groups(members, canonical, canonical.filter("canonical_id % 5 = 0").select(F.col("canonical_id").alias("id")))


@query(f"WITH m AS ({_MEMBERS}), c AS ({_CANONICAL}) SELECT m.id FROM m WHERE m.group_id IN (SELECT group_id FROM c WHERE canonical_id % 5 = 0)")
def canonical_support(spark, sf_dir):
    members, canonical = _grouped(spark, sf_dir)
    return reports.supporting_rows(members, canonical, canonical.filter("canonical_id % 5 = 0").select(F.col("canonical_id").alias("id"))).select("id")


@query(f"""WITH {_STATE} SELECT id, format('{{:,.2f}}', CAST(posted_amount AS DOUBLE)) AS amount, concat_ws('; ', CASE WHEN id % 5 = 0 THEN 'Duplicate candidate [old] of 2' END, CASE WHEN id % 8 = 0 THEN 'Batch accounting decision' END) AS reason FROM state""")
def report_texts(spark, sf_dir):
    return _state(spark, sf_dir).select("id", thousands(F.col("posted_amount")).alias("amount"), remove_reason(F.col("reason"), "noted").alias("reason"))


@query(f"WITH {LEDGER_SQL} SELECT DISTINCT owner FROM ledger WHERE owner <> ''")
def owner_list(spark, sf_dir):
    return reports.owner_list(ledger(spark, sf_dir))


@query("SELECT l_returnflag AS code, min(CAST(l_orderkey AS VARCHAR)) AS display FROM lineitem WHERE l_returnflag = (SELECT min(l_returnflag) FROM lineitem) GROUP BY 1")
def first_diagnostic(spark, sf_dir):
    return reports.first_error(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("code"), F.col("l_orderkey").cast("string").alias("display")))


@query("""WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'error'), n AS (SELECT user_id, list_sort(list(CAST(day AS VARCHAR))) AS l FROM d GROUP BY 1) SELECT user_id, array_to_string(l[1:5], ',') AS shown, greatest(len(l) - 5, 0) AS more FROM n""")
def warning_topk(spark, sf_dir):
    errors = table(spark, sf_dir, "events").filter("event_type = 'error'").select("user_id", F.to_date("ts").cast("string").alias("detail"))
    return reports.top_details(errors, ["user_id"]).withColumn("shown", F.array_join("shown", ","))


@query("""WITH p AS (SELECT l_suppkey, l_partkey, count(DISTINCT l_returnflag) AS k, min(l_returnflag) AS v FROM lineitem GROUP BY 1, 2) SELECT l_suppkey, l_partkey, CASE WHEN k = 1 THEN v ELSE 'mixed' END AS agreed_flag FROM p""")
def agreed_values(spark, sf_dir):
    from tallyspark.operators.overlap import agreed

    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(agreed("l_returnflag", F.lit("mixed")).alias("agreed_flag"))


@query("""WITH g AS (SELECT p_type AS category, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(30,2)) AS total FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1) SELECT category, total, CAST(row_number() OVER (ORDER BY abs(total) DESC, category) AS INT) AS place FROM g""")
def category_order(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("price"))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("category"))
    totals = items.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("category").agg(F.sum("price").cast("decimal(30,2)").alias("total"))
    return review.ranked_by_size(totals, "total", "category")
