"""Registered queries over state that lasts: slots over imports, transactions, allocation, reconciliation, rates, profiles."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyspark.functions.text import packed
from tallyspark.operators import allocation, profiles, rates, reconcile, slots, transactions, valuation
from tallyspark.plans.catalogue import query
from tallyspark.plans.shapes import LEDGER_SQL, ledger, legs, legs_sql, table
from tallyspark.sources import documents, statements
from tallyspark.sources.generations import GenerationConflict, Generations
from tallyspark.sources.staging import shared_folder, staged

KEY = b"tally-demonstration-key"

# Lines as reports of records by three sources; an import without the returned lines is a source that shrank.
_OCCURRENCES = {
    "id": "concat(CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(20)))",
    "fingerprint": "CAST(l_partkey * 10 + l_linenumber AS VARCHAR(20))",
    "source": "CAST(l_suppkey % 3 AS VARCHAR(20))",
    "processed": "l_returnflag = 'R'",
    "currency": "CASE l_linestatus WHEN 'O' THEN 'HKD' ELSE 'USD' END",
    "category": "CASE WHEN l_returnflag = 'A' THEN 'Groceries' ELSE 'Dining' END",
    "reason": "''",
}
IMMUTABLE = ["currency"]


def _occurrences(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.selectExpr(*(f"{e} AS {c}" for c, e in _OCCURRENCES.items()), "array() AS raw").withColumn("flags", F.col("raw").cast("array<string>")).drop("raw")


def _mutable():
    return {"category": F.lit("Unknown"), "reason": F.lit("differs"), "flags": F.array().cast("array<string>")}


def _imported(spark, occurrences, state=None):
    return slots.canonicalize(occurrences, state or slots.OverlapState.empty(spark), KEY, IMMUTABLE, _mutable())


_RECORDS = """o AS (SELECT l_partkey * 10 + l_linenumber AS f, l_suppkey % 3 AS s, l_returnflag AS r FROM lineitem),
    a AS (SELECT f, list(n ORDER BY n) AS c FROM (SELECT f, s, count(*) AS n FROM o GROUP BY 1, 2) GROUP BY 1),
    b AS (SELECT f, list(n ORDER BY n) AS c FROM (SELECT f, s, count(*) AS n FROM o WHERE r <> 'R' GROUP BY 1, 2) GROUP BY 1),
    g AS (SELECT a.f, a.c[-1] AS keep, CASE WHEN len(a.c) > 1 THEN a.c[-2] ELSE a.c[-1] END AS same, len(a.c) > 1 AND a.c[-1] > 1 AND a.c[1] <> a.c[-1] AS ambiguous,
        coalesce(b.c[-1], 0) AS keep2, coalesce(list_sum(b.c), 0) = list_sum(a.c) AS unchanged, coalesce(len(b.c) > 1 AND b.c[-1] > 1 AND b.c[1] <> b.c[-1], false) AS ambiguous2
        FROM a LEFT JOIN b ON b.f = a.f)"""


@query(f"""WITH {_RECORDS}
    SELECT CAST(f AS VARCHAR) AS fingerprint, CAST(s AS INT) AS slot, CASE WHEN s <= CASE WHEN unchanged AND ambiguous AND f % 2 = 0 THEN same ELSE keep2 END THEN 'active' ELSE 'retired' END AS second,
        CASE WHEN s <= CASE WHEN ambiguous AND f % 2 = 0 THEN same ELSE keep END THEN 'active' ELSE 'retired' END AS third, true AS same_id,
        ambiguous2 AND NOT unchanged AND ambiguous AND f % 2 = 0 AS changed
    FROM g, unnest(generate_series(1, keep)) AS t(s)""")
def overlap_slots_over_imports(spark, sf_dir):
    """Three imports: all lines, then without the returned ones, then all again; even records are decided after the first."""
    rows = _occurrences(spark, sf_dir)
    first = _imported(spark, rows)
    decisions = first.memberships.filter("CAST(fingerprint AS BIGINT) % 2 = 0").select("membership", F.lit(slots.SAME_EVENT).alias("choice"))
    state = first.state()
    second = _imported(spark, rows.filter("not processed"), slots.OverlapState(state.slots, slots.decided(state.memberships, decisions), state.rows))
    third = _imported(spark, rows, second.state())
    named = lambda c, name: c.slots.select("fingerprint", "slot", packed(F.col("slot_id")).alias(f"{name}_id"), F.col("state").alias(name))
    joined = named(first, "first").join(named(second, "second"), ["fingerprint", "slot"], "full_outer").join(named(third, "third"), ["fingerprint", "slot"], "full_outer")
    same = (F.col("first_id") == F.col("second_id")) & (F.col("second_id") == F.col("third_id"))
    return joined.join(second.groups.select("fingerprint", "changed"), "fingerprint").select("fingerprint", "slot", "second", "third", same.alias("same_id"), "changed")


@query(f"""WITH {_RECORDS}
    SELECT CAST(f AS VARCHAR) AS fingerprint, unnest(list_filter([CASE WHEN f % 13 = 0 THEN 'missing' WHEN f % 23 = 0 THEN 'repeated' WHEN f % 17 = 0 THEN 'altered' END,
        CASE WHEN f % 19 = 0 THEN 'excess' END, CASE WHEN f % 29 = 0 THEN 'slot_missing' END, CASE WHEN f % 31 = 0 THEN 'slot_excess' END], lambda x: x IS NOT NULL)) AS problem FROM g""")
def overlap_agreement(spark, sf_dir):
    """Stored rows and slots with planted faults against what their sources give."""
    rows = _occurrences(spark, sf_dir)
    good = _imported(spark, rows).state()
    f, first = F.col("fingerprint").cast("long"), F.col("slot") == 1
    kept = good.rows.filter(~((f % 13 == 0) & first))
    altered = kept.withColumn("currency", F.when((f % 17 == 0) & first, "ZZZ").otherwise(F.col("currency")))
    extra = good.rows.filter((f % 19 == 0) & first).withColumn("slot_id", F.concat(F.lit("extra-"), "fingerprint"))
    again = altered.filter((f % 23 == 0) & first)
    known = good.slots.filter(~((f % 29 == 0) & first))
    beyond = good.slots.filter((f % 31 == 0) & first).withColumn("fingerprint", F.concat(F.lit("none-"), "fingerprint")).withColumn("slot", F.lit(0))
    stored = slots.OverlapState(known.unionByName(beyond), good.memberships, altered.unionByName(extra).unionByName(again))
    found = slots.agreement(stored, rows, KEY, IMMUTABLE, _mutable())
    named = found.join(good.slots.select("slot_id", "fingerprint"), "slot_id", "left")
    return named.select(F.coalesce("fingerprint", F.substring("slot_id", 7, 20)).alias("fingerprint"), "problem")


@query(f"""WITH {_RECORDS}
    SELECT CAST(f AS VARCHAR) AS fingerprint, CASE
        WHEN keep = same THEN 'clean' WHEN f % 5 = 4 THEN CASE WHEN f % 7 = 0 THEN 'conflict' ELSE 'clean' END
        WHEN same = 1 THEN CASE f % 5 WHEN 0 THEN CASE WHEN keep > 2 THEN 'conflict' ELSE 'removed' END WHEN 1 THEN 'moved' WHEN 2 THEN 'conflict' ELSE 'clean' END
        WHEN f % 7 = 0 OR f % 5 IN (1, 2) THEN 'conflict' WHEN f % 5 = 0 THEN 'removed' ELSE 'clean' END AS verdict,
        CASE WHEN same = 1 AND f % 5 = 1 THEN 2 WHEN f % 5 = 0 AND ((same = 1 AND keep = 2) OR (same > 1 AND f % 7 <> 0)) THEN keep - same ELSE 0 END AS changes
    FROM g WHERE ambiguous""")
def tail_corrections(spark, sf_dir):
    """What becomes of stored corrections if every ambiguous record is decided to be one event."""
    done = _imported(spark, _occurrences(spark, sf_dir))
    f = F.col("fingerprint").cast("long")
    ambiguous = F.col("provenance_status") == slots.AMBIGUOUS
    open_ = done.groups.filter(ambiguous).select("fingerprint", "same_event")
    rows = done.rows.filter(ambiguous).withColumn("category", F.when((f % 7 == 0) & (F.col("slot") == F.col("keep_all")), "Odd").otherwise(F.col("category")))
    last, name = F.col("slot") == F.col("keep_all"), F.concat(F.lit("C"), F.col("slot").cast("string"))
    given = F.when(f % 5 == 0, "X").when((f % 5 == 1) & last, "Y").when(f % 5 == 2, name).when((f % 5 == 3) & (F.col("slot") == 1), "Z")
    patches = rows.select("slot_id", given.alias("category")).filter("category is not null")
    verdicts, changes = slots.tail_corrections(rows, open_, patches, ["category"], ["category", "reason", "flags"])
    counted = changes.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("changes"))
    return verdicts.join(counted, "fingerprint", "left").na.fill(0, ["changes"])


# Suppliers as sources: the stored state has some lines in another place, retired or missing. What has changed of a source
# (nothing, the contract, the revision, or that it was never stored) follows its number.
_CASE = "l_suppkey % 4"
_LINES = "(SELECT l_suppkey, l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_quantity) AS l_quantity FROM lineitem GROUP BY l_suppkey, l_orderkey, l_linenumber) lines"
_ARRIVING_OF = f"""SELECT CAST(l_suppkey AS VARCHAR(20)) AS source_id, CASE WHEN {_CASE} = 2 THEN 'rev2' ELSE 'rev1' END AS revision, CASE WHEN {_CASE} = 1 THEN 'c2' ELSE 'c1' END AS contract,
    CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS locator, concat(CAST(l_partkey AS VARCHAR(20)), '/', CAST(CAST(l_quantity AS INT) AS VARCHAR(20))) AS fingerprint FROM """
_ARRIVING = _ARRIVING_OF + _LINES
_STORED_OF = f"""SELECT CAST(l_suppkey AS VARCHAR(20)) AS source_id, concat('old_', CAST(l_suppkey AS VARCHAR(20)), '_', CAST(l_orderkey * 10 + l_linenumber AS VARCHAR(20))) AS record_id,
    concat(CAST(l_partkey AS VARCHAR(20)), '/', CAST(CAST(l_quantity AS INT) AS VARCHAR(20))) AS fingerprint, CASE WHEN {_CASE} = 2 AND l_orderkey % 13 = 0 THEN 'retired' ELSE 'active' END AS state,
    CAST(CASE WHEN {_CASE} = 2 AND l_orderkey % 13 = 0 THEN NULL WHEN {_CASE} = 1 AND l_orderkey % 11 = 0 THEN l_orderkey * 10 + l_linenumber + 1000000000 ELSE l_orderkey * 10 + l_linenumber END AS BIGINT) AS locator,
    CASE WHEN l_orderkey % 3 = 0 AND {_CASE} = 2 THEN 'rev2' ELSE 'rev1' END AS origin_revision, 'c1' AS origin_contract, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS origin_locator, CAST(1 AS INT) AS ordinal
    FROM %s WHERE {_CASE} <> 3"""
_STORED = _STORED_OF.replace("%s", _LINES)
_SOURCES = f"SELECT DISTINCT CAST(l_suppkey AS VARCHAR(20)) AS source_id, 'rev1' AS revision, 'c1' AS contract FROM lineitem WHERE {_CASE} <> 3"
_ALLOCATED = f"""i AS (SELECT *, CAST(source_id AS BIGINT) % 4 AS kind FROM ({_ARRIVING})), r AS ({_STORED}),
    e AS (SELECT i.source_id, i.fingerprint, i.locator, i.kind, a.record_id AS old_id, b.record_id AS retired_id FROM i
        LEFT JOIN r a ON a.state = 'active' AND a.source_id = i.source_id AND a.fingerprint = i.fingerprint AND a.locator = i.locator AND i.kind IN (0, 1)
        LEFT JOIN r b ON b.state = 'retired' AND b.source_id = i.source_id AND b.fingerprint = i.fingerprint AND b.origin_locator = i.locator AND b.origin_revision = i.revision),
    x AS (SELECT source_id, fingerprint, count(*) AS n FROM e WHERE old_id IS NULL AND retired_id IS NULL GROUP BY 1, 2),
    y AS (SELECT source_id, fingerprint, count(*) AS n, min(record_id) AS moved_id FROM r WHERE state = 'active' AND record_id NOT IN (SELECT old_id FROM e WHERE old_id IS NOT NULL) GROUP BY 1, 2),
    bad AS (SELECT DISTINCT x.source_id FROM x JOIN y ON y.source_id = x.source_id AND y.fingerprint = x.fingerprint WHERE (x.n <> 1 OR y.n <> 1) AND CAST(x.source_id AS BIGINT) % 4 <> 1),
    done AS (SELECT e.source_id, locator, e.fingerprint, CASE WHEN old_id IS NOT NULL THEN 'kept' WHEN retired_id IS NOT NULL THEN 'revived' WHEN x.n = 1 AND y.n = 1 THEN 'moved' ELSE 'new' END AS action,
        coalesce(old_id, retired_id, CASE WHEN x.n = 1 AND y.n = 1 THEN moved_id END) AS known_id,
        row_number() OVER (PARTITION BY e.source_id, e.fingerprint ORDER BY locator) AS ordinal
        FROM e LEFT JOIN x ON x.source_id = e.source_id AND x.fingerprint = e.fingerprint LEFT JOIN y ON y.source_id = e.source_id AND y.fingerprint = e.fingerprint WHERE e.source_id NOT IN (SELECT source_id FROM bad))"""


def _allocated(spark, sf_dir):
    # Dealt by source once, each line once; arriving and stored rows are then read without another shuffle.
    lines = table(spark, sf_dir, "lineitem").repartition("l_suppkey").groupBy("l_suppkey", "l_orderkey", "l_linenumber")
    lines = staged(lines.agg(F.min("l_partkey").alias("l_partkey"), F.min("l_quantity").alias("l_quantity")), "lines")
    lines.createOrReplaceTempView("lineitem")
    arriving, stored = spark.sql(_ARRIVING_OF + "lineitem"), spark.sql(_STORED_OF.replace("%s", "lineitem"))
    return allocation.allocate(arriving, stored, spark.sql(_SOURCES), "replace", allow_upgrade=True)


@query(f"""WITH {_ALLOCATED} SELECT source_id, locator, fingerprint, CAST(ordinal AS INT) AS ordinal, action, known_id FROM done
    UNION ALL SELECT source_id, NULL, '', NULL, 'record_match_ambiguous', NULL FROM bad""")
def identity_allocation(spark, sf_dir):
    """Every line's id and how it came by it, and the sources that are refused."""
    found = _allocated(spark, sf_dir)
    known = F.when(F.col("action") != "new", F.col("record_id"))
    rows = found.rows.select("source_id", "locator", "fingerprint", "ordinal", "action", known.alias("known_id"))
    refused = found.problems.select("source_id", F.lit(None).cast("long").alias("locator"), F.lit("").alias("fingerprint"), F.lit(None).cast("int").alias("ordinal"), F.col("problem").alias("action"), F.lit(None).cast("string").alias("known_id"))
    return rows.unionByName(refused)


@query(f"""WITH {_ALLOCATED}, after_ AS (
        SELECT record_id, state FROM r WHERE source_id IN (SELECT source_id FROM bad) UNION ALL
        SELECT coalesce(known_id, 'new'), 'active' FROM done UNION ALL
        SELECT record_id, 'retired' FROM r WHERE source_id NOT IN (SELECT source_id FROM bad) AND record_id NOT IN (SELECT known_id FROM done WHERE known_id IS NOT NULL))
    SELECT record_id, state, count(*) AS n FROM after_ GROUP BY 1, 2""")
def identity_records_after(spark, sf_dir):
    """The stored records after it; new ids are counted together."""
    named = F.when(F.col("record_id").startswith("rec_"), "new").otherwise(F.col("record_id"))
    return _allocated(spark, sf_dir).records.groupBy(named.alias("record_id"), "state").agg(F.count(F.lit(1)).alias("n"))


# Legs of transfers with what earlier runs and reviews left on them; every tenth order is marked as a pair by hand, and of
# these every second one no longer is one.
_WORKED = """SELECT id, date, CASE WHEN marked AND key % 20 = 0 THEN 'acct_m' ELSE account_id END AS account_id, account_type, 'bank_0' AS institution, CASE WHEN key % 3 = 0 THEN 'Unknown' ELSE 'owner_a' END AS owner, 'Unknown' AS category,
    amount_base AS posted_amount, 'HKD' AS posted_currency, amount_base, CASE WHEN again THEN 'internal_transfer' ELSE flow_type END AS flow_type, CASE WHEN again THEN 'reconciliation' ELSE flow_source END AS flow_source,
    CASE WHEN marked THEN concat('mp_', CAST(key AS VARCHAR(20))) END AS marker, CASE WHEN key % 4 = 0 THEN 'noted; Ambiguous transfer candidates' ELSE '' END AS reason, key % 4 = 0 OR key % 3 = 0 AS needs_review,
    concat_ws(';', CASE WHEN key % 4 = 0 THEN 'reconciliation_ambiguous' END, CASE WHEN key % 8 = 0 THEN 'reconciliation_ambiguous_prior_review' END) AS flags,
    concat_ws(';', CASE WHEN key % 4 = 0 THEN 'accounting_flow;category_decision' END, CASE WHEN key % 3 = 0 THEN 'ownership' END) AS review_reasons, key
    FROM (SELECT *, key % 10 = 0 AND id NOT LIKE 'd%' AS marked, key % 7 = 0 AND id LIKE 'o%' AS again FROM (SELECT *, CAST(substr(id, 2) AS BIGINT) AS key FROM legs) a) b"""


def _worked(spark, sf_dir):
    legs(spark, sf_dir).createOrReplaceTempView("legs")
    rows = spark.sql(_WORKED).drop("key")
    return rows.withColumns({c: F.array_remove(F.split(c, ";"), "") for c in ("flags", "review_reasons")})


def _reconciled(spark, sf_dir):
    return reconcile.reconcile(_worked(spark, sf_dir), F.lit(True), F.lit(False))


def _reconciled_sql(corrected: str) -> str:
    """What reconciliation makes of the worked legs, of which some (a condition) were corrected to an expense without review."""
    return f"""WITH all_legs AS (WITH {legs_sql()} SELECT * FROM legs), w AS (SELECT * FROM ({_WORKED.replace('FROM legs)', 'FROM all_legs)')})),
    n AS (SELECT *, CASE WHEN corr THEN 'expense' WHEN flow_source = 'rule' THEN flow_type ELSE 'unresolved' END AS flow, CASE WHEN corr THEN 'correction' WHEN flow_source = 'rule' THEN 'rule' ELSE 'deterministic' END AS source FROM (SELECT *, {corrected} AS corr FROM w)), f AS (SELECT * FROM n WHERE marker IS NULL),
    cand AS (SELECT o.id AS out_id, i.id AS in_id, CAST(abs(i.date - o.date) AS INT) AS days,
        CASE WHEN i.account_type = 'credit_card' THEN 'credit_card_payment' WHEN i.account_type = 'bank' THEN 'internal_transfer' ELSE 'investment_transfer' END AS flow, i.source, i.flow AS i_flow
        FROM f o JOIN f i ON i.amount_base = -o.amount_base AND o.amount_base < 0 AND abs(i.date - o.date) <= 3 AND i.account_id <> o.account_id AND NOT o.corr),
    ok AS (SELECT out_id, in_id, days, flow FROM cand WHERE source <> 'rule' OR i_flow = flow),
    best AS (SELECT *, min(days) OVER (PARTITION BY out_id) AS od, min(days) OVER (PARTITION BY in_id) AS idd FROM ok),
    ob AS (SELECT out_id, min(in_id) AS in_id FROM best WHERE days = od GROUP BY out_id HAVING count(*) = 1),
    ib AS (SELECT in_id, min(out_id) AS out_id FROM best WHERE days = idd GROUP BY in_id HAVING count(*) = 1),
    p AS (SELECT ok.* FROM ok JOIN ob ON ob.out_id = ok.out_id AND ob.in_id = ok.in_id JOIN ib ON ib.out_id = ok.out_id AND ib.in_id = ok.in_id),
    t AS (SELECT out_id AS id, in_id AS partner, flow AS pair_flow, days FROM p UNION ALL SELECT in_id, out_id, flow, days FROM p), had AS (SELECT out_id AS id FROM ok UNION SELECT in_id FROM ok),
    s AS (SELECT n.*, t.partner, t.pair_flow, t.days, CASE WHEN marker IS NOT NULL THEN CASE WHEN key % 20 = 0 THEN 'manual' ELSE 'invalid' END WHEN t.id IS NOT NULL THEN 'transfer' WHEN had.id IS NOT NULL THEN 'ambiguous' ELSE '' END AS how
        FROM n LEFT JOIN t ON t.id = n.id LEFT JOIN had ON had.id = n.id),
    u AS (SELECT *, CASE WHEN how = 'manual' THEN 'internal_transfer' WHEN how = 'invalid' THEN 'unresolved' WHEN corr OR source = 'rule' THEN flow WHEN how = 'transfer' THEN pair_flow ELSE 'unresolved' END AS new_flow,
        CASE WHEN corr THEN false WHEN how = 'manual' THEN key % 3 = 0 ELSE key % 4 = 0 OR key % 3 = 0 OR how IN ('ambiguous', 'invalid') END AS pending FROM s),
    done AS (SELECT id, CASE WHEN corr THEN 'Dining' WHEN how = 'manual' THEN 'Internal Transfer' ELSE 'Unknown' END AS category, new_flow AS flow_type, CASE WHEN corr OR how = 'manual' THEN 'correction' WHEN how = 'invalid' THEN 'reconciliation' WHEN source = 'rule' THEN 'rule' WHEN how = '' THEN 'deterministic' ELSE 'reconciliation' END AS flow_source,
        CASE WHEN how = 'manual' THEN marker WHEN how = 'transfer' THEN 'xfer_' || substr(sha256(least(id, partner) || '|' || greatest(id, partner)), 1, 16) END AS transfer_group_id,
        CASE WHEN how IN ('manual', 'transfer') THEN 'paired' WHEN how = 'ambiguous' THEN 'ambiguous' WHEN how = 'invalid' OR new_flow NOT IN ('unresolved', 'expense') THEN 'unmatched' ELSE 'not_applicable' END AS reconciliation_status,
        CAST(CASE WHEN how = 'manual' OR days = 0 THEN 1 WHEN how = 'transfer' THEN 0.95 WHEN how <> '' THEN 0 END AS DECIMAL(4,2)) AS reconciliation_confidence,
        concat_ws(';', CASE WHEN corr THEN 'manual_correction' END, CASE WHEN how = 'invalid' THEN 'manual_transfer_pair_invalid' END, CASE WHEN how = 'ambiguous' THEN 'reconciliation_ambiguous' END, CASE WHEN how = 'ambiguous' AND key % 8 <> 0 AND (key % 4 = 0 OR key % 3 = 0) THEN 'reconciliation_ambiguous_prior_review' END) AS flags,
        concat_ws(';', CASE WHEN pending AND new_flow = 'unresolved' THEN 'accounting_flow' END, CASE WHEN pending AND how <> 'manual' THEN 'category_decision' END, CASE WHEN key % 3 = 0 AND NOT corr THEN 'ownership' END) AS review_reasons, pending AS needs_review,
        concat_ws('; ', CASE WHEN key % 4 = 0 THEN 'noted' END, CASE how WHEN 'invalid' THEN 'Manual transfer pair no longer matches current facts' WHEN 'ambiguous' THEN 'Ambiguous transfer candidates' END) AS reason FROM u)"""


_RECONCILED_SQL = _reconciled_sql("false")


@query(_RECONCILED_SQL + " SELECT * FROM done")
def ledger_reconciliation(spark, sf_dir):
    """All rows after it: flow, status, pairs, review reasons, flags and reasons."""
    rows = _reconciled(spark, sf_dir).rows.withColumns({c: F.array_join(F.array_sort(c), ";") for c in ("flags", "review_reasons")})
    return rows.select("id", "category", "flow_type", "flow_source", "transfer_group_id", "reconciliation_status", "reconciliation_confidence", "flags", "review_reasons", "needs_review", "reason")


@query(_RECONCILED_SQL + """ SELECT count(*) AS transactions, count(*) FILTER (WHERE reconciliation_status = 'paired') AS paired, count(DISTINCT transfer_group_id) AS groups, count(*) FILTER (WHERE reconciliation_status = 'ambiguous') AS ambiguous,
    count(*) FILTER (WHERE reconciliation_status = 'unmatched') AS unmatched, count(*) FILTER (WHERE flow_type = 'unresolved') AS unresolved FROM done""")
def ledger_reconciliation_counts(spark, sf_dir):
    return _reconciled(spark, sf_dir).summary()


# Parts as files whose header follows brand, type and size; profiles for the brands and types there are, and a wider one for some types.
_HEADERS = "SELECT CAST(p_partkey AS VARCHAR(20)) AS path, array('date', 'amount', p_brand, p_type, concat('size', CAST(p_size % 5 AS VARCHAR(20)))) AS header FROM part"
_PROFILES = """SELECT DISTINCT concat(p_brand, '/', p_type) AS profile, array('date', p_brand, p_type) AS required FROM part WHERE length(p_type) % 2 = 0
    UNION ALL SELECT DISTINCT concat('any ', p_type), array('amount', p_type, 'size1') FROM part UNION ALL SELECT DISTINCT concat('none ', p_brand), array('date', 'nothing', p_brand) FROM part"""


@query(f"""WITH h AS ({_HEADERS.replace("array('date'", "['date'").replace("VARCHAR(20)))) AS header", "VARCHAR(20)))] AS header")}), p AS ({_PROFILES.replace("array(", "[").replace(") AS required", "] AS required").replace("'size1')", "'size1']").replace("p_brand) FROM part", "p_brand] FROM part")}),
    f AS (SELECT path, list(profile ORDER BY profile) AS c FROM h JOIN p ON list_has_all(header, required) GROUP BY 1)
    SELECT h.path, CASE WHEN CAST(h.path AS BIGINT) % 11 = 0 THEN 'said' WHEN len(c) = 1 THEN c[1] END AS profile, CASE WHEN CAST(h.path AS BIGINT) % 11 = 0 THEN 'mapped' WHEN len(c) = 1 THEN 'matched' WHEN len(c) > 1 THEN 'ambiguous' ELSE 'undetected' END AS status,
    coalesce(array_to_string(c, '|'), '') AS candidates FROM h LEFT JOIN f ON f.path = h.path""")
def profile_selection(spark, sf_dir):
    table(spark, sf_dir, "part").createOrReplaceTempView("part")
    headers = spark.sql(_HEADERS)
    mapped = headers.filter("CAST(path AS BIGINT) % 11 = 0").select("path", F.lit("said").alias("profile"))
    return profiles.select_profiles(headers, spark.sql(_PROFILES), mapped).withColumn("candidates", F.array_join("candidates", "|"))


# Rates of the days on which somebody ordered; every ninth day's rate is corrected, and some days in between get one.
_CACHE = "SELECT DISTINCT posted_currency AS currency, date, CAST(7.7 + month(date) * 0.001 AS DECIMAL(17,8)) AS rate FROM ledger WHERE posted_currency <> 'HKD' AND day(date) % 4 = 1"
_NEWS = "SELECT DISTINCT posted_currency AS currency, date, CAST(7.9 + day(date) * 0.001 AS DECIMAL(17,8)) AS rate FROM ledger WHERE posted_currency = 'USD' AND (day(date) % 9 = 0 OR day(date) = 13)"
_DAYS = "SELECT DISTINCT posted_currency AS currency, date, CAST(7.5 AS DECIMAL(17,8)) AS rate FROM ledger WHERE posted_currency <> 'HKD' AND day(date) = 20"


@query(f"""WITH {LEDGER_SQL}, cache AS ({_CACHE}), news AS ({_NEWS}), days AS ({_DAYS}), after_ AS (SELECT * FROM news UNION ALL SELECT c.* FROM cache c ANTI JOIN news n ON n.currency = c.currency AND n.date = c.date),
    x AS (SELECT l.id, l.date, l.posted_amount, l.posted_currency, d.rate AS d_rate,
        (SELECT max(c.date) FROM cache c WHERE c.currency = l.posted_currency AND c.date BETWEEN l.date - 7 AND l.date) AS was_date, (SELECT max(c.date) FROM after_ c WHERE c.currency = l.posted_currency AND c.date BETWEEN l.date - 7 AND l.date) AS now_date
        FROM ledger l LEFT JOIN days d ON d.currency = l.posted_currency AND d.date = l.date),
    y AS (SELECT x.*, w.rate AS was, n.rate AS now_ FROM x LEFT JOIN cache w ON w.currency = x.posted_currency AND w.date = x.was_date LEFT JOIN after_ n ON n.currency = x.posted_currency AND n.date = x.now_date)
    SELECT id, CASE WHEN posted_currency = 'HKD' THEN 'same_currency' WHEN d_rate IS NOT NULL THEN 'dated' WHEN now_ IS NOT NULL THEN 'cached' ELSE 'missing' END AS valuation_source,
        CAST(CASE WHEN posted_currency = 'HKD' THEN posted_amount ELSE round_even(CAST(posted_amount AS DECIMAL(18,2)) * coalesce(d_rate, now_), 2) END AS DECIMAL(20,2)) AS amount_base,
        posted_currency <> 'HKD' AND d_rate IS NULL AND (was IS DISTINCT FROM now_ OR was_date IS DISTINCT FROM now_date) AS touched FROM y""")
def rate_application(spark, sf_dir):
    """The ledger after new rates, and which rows were valued again for it."""
    rows = ledger(spark, sf_dir).withColumns({"amount_base": F.lit(None).cast("decimal(18,2)"), "valuation_source": F.lit(None).cast("string")})
    rows.createOrReplaceTempView("ledger")
    cache, news, dated = spark.sql(_CACHE), spark.sql(_NEWS), spark.sql(_DAYS)
    fixed = dated.limit(0).select("currency", "rate")
    done = rates.apply_observations(valuation.value_cascade(rows, dated, cache, fixed, "HKD"), dated, cache, news, fixed, "HKD")
    touched = done.touched.withColumn("touched", F.lit(True))
    return done.rows.join(touched, "id", "left").select("id", "valuation_source", "amount_base", F.coalesce("touched", F.lit(False)).alias("touched"))


# Orders of a customer as pages of a file, one word a page.
@query("""SELECT o_custkey, CASE WHEN count(*) > 12 THEN 'more than 12 pages' WHEN sum(length(o_orderpriority)) > 90 THEN 'more than 90 characters' END AS problem FROM orders GROUP BY 1""")
def file_budgets(spark, sf_dir):
    word = F.array(F.struct(F.col("o_orderpriority").alias("text"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("top")))
    pages = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(word).alias("pages"))
    found = pages.select("o_custkey", F.to_json(F.struct("pages")).cast("binary").alias("content"))
    return found.select("o_custkey", statements.over_budget(found, 12, 90).alias("problem"))


_CORRECTED = "key % 11 = 0 AND marker IS NULL AND id LIKE 'o%'"
_STATE = ("category", "flow_type", "flow_source", "transfer_group_id", "reconciliation_status", "reconciliation_confidence", "flags", "review_reasons", "needs_review", "reason")


@query(f"""WITH before_ AS ({_reconciled_sql('false')} SELECT * FROM done), after_ AS ({_reconciled_sql(_CORRECTED)} SELECT * FROM done), legs_ AS ({legs_sql().replace('legs AS (', 'WITH legs AS (', 1)} SELECT * FROM legs),
    stored AS (SELECT id, category, flow_type, flow_source, CAST(NULL AS VARCHAR) AS transfer_group_id, CAST(NULL AS VARCHAR) AS reconciliation_status, CAST(NULL AS DECIMAL(4,2)) AS reconciliation_confidence,
        array_to_string(list_sort(list_filter(string_split(flags, ';'), lambda x: x <> '')), ';') AS flags, array_to_string(list_sort(list_filter(string_split(review_reasons, ';'), lambda x: x <> '')), ';') AS review_reasons, needs_review, reason, {_CORRECTED} AS corr FROM ({_WORKED.replace('FROM legs)', 'FROM legs_)')}))
    SELECT s.id, {', '.join(f'CASE WHEN NOT s.corr AND b = a THEN s.{c} ELSE a.{c} END AS {c}' for c in _STATE)} FROM stored s JOIN before_ b ON b.id = s.id JOIN after_ a ON a.id = s.id""")
def correction_transaction(spark, sf_dir):
    """The ledger after a batch of corrections was committed; a second batch against the same base is refused, a replay
    changes nothing, and rows that the batch neither names nor changes are as they were stored."""
    legs(spark, sf_dir).createOrReplaceTempView("legs")
    keyed = spark.sql(_WORKED).withColumns({c: F.array_remove(F.split(c, ";"), "") for c in ("flags", "review_reasons")})
    none = {c: F.lit(None).cast("decimal(4,2)" if c == "reconciliation_confidence" else "string") for c in reconcile.RESULT}
    batch = keyed.filter(_CORRECTED).select("id", F.lit("Dining").alias("category"), F.lit(None).cast("string").alias("owner"), F.lit("expense").alias("flow_type"), F.lit(False).alias("needs_review"))
    store = Generations(spark, f"{shared_folder(spark)}/transactions-{uuid.uuid4().hex}")
    base = store.commit({"ledger": keyed.drop("key").withColumns(none), "corrections": batch.limit(0)}, None)
    done = transactions.apply_corrections(store, batch, base, F.lit(True), F.lit(False))
    try:
        transactions.apply_corrections(store, batch.withColumn("category", F.lit("Gifts")), base, F.lit(True), F.lit(False))
        raise AssertionError("a second batch against one base was taken")
    except GenerationConflict:
        pass
    if transactions.apply_corrections(store, batch, done.version, F.lit(True), F.lit(False)).changed:
        raise AssertionError("a replay made a generation")
    rows = store.read("ledger").withColumns({c: F.array_join(F.array_sort(c), ";") for c in ("flags", "review_reasons")})
    return rows.select("id", *_STATE)


@query(f"""WITH r AS ({_STORED}), s AS ({_SOURCES}),
    l AS (SELECT source_id, 0 AS kind, '' AS record_id, '{{"contract":"' || contract || '","revision":"' || revision || '","source_id":"' || source_id || '"}}' AS line FROM s UNION ALL
        SELECT source_id, 1, record_id, '{{"fingerprint":"' || fingerprint || '","locator":' || coalesce(CAST(locator AS VARCHAR), 'null') || ',"ordinal":1,"origin_contract":"' || origin_contract || '","origin_locator":' || CAST(origin_locator AS VARCHAR) || ',"origin_revision":"' || origin_revision || '","record_id":"' || record_id || '","source_id":"' || source_id || '","state":"' || state || '"}}' FROM r)
    SELECT line, row_number() OVER (PARTITION BY source_id ORDER BY kind, record_id) AS place FROM l""")
def manifest_order(spark, sf_dir):
    """The lines of a manifest, read back from its files, with their place within their source."""
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    path = f"{shared_folder(spark)}/manifest-{uuid.uuid4().hex}"
    documents.write_manifest(spark.sql(_SOURCES), spark.sql(_STORED), path, "gzip")
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.get_json_object("value", "$.source_id").alias("source_id"), F.coalesce(F.get_json_object("value", "$.record_id"), F.lit("")).alias("record_id"))
    return lines.withColumn("place", F.row_number().over(Window.partitionBy("source_id").orderBy("record_id"))).select("line", "place")


@query(f"""WITH {LEDGER_SQL}, c AS ({_CACHE}), n AS ({_NEWS}), u AS (SELECT currency, date, rate, 'a' AS p FROM c UNION ALL SELECT currency, date, rate, 'b' FROM n)
    SELECT currency, date, CAST(min(rate) AS DECIMAL(17,8)) AS rate, string_agg(DISTINCT p, ',' ORDER BY p) AS providers FROM u GROUP BY 1, 2""")
def rate_cache(spark, sf_dir):
    """The merged cache after it was written as lines and read back."""
    ledger(spark, sf_dir).createOrReplaceTempView("ledger")
    cache = valuation.merge_rates(spark.sql(_CACHE).withColumn("provider", F.lit("a")), spark.sql(_NEWS).withColumn("provider", F.lit("b")))
    path = f"{shared_folder(spark)}/rates-{uuid.uuid4().hex}"
    documents.write_rates(cache, path)
    return documents.read_rates(spark, path).withColumn("providers", F.array_join("providers", ","))


@query("""WITH f AS (SELECT o_custkey, CASE WHEN count(*) > 12 THEN 'refused' WHEN o_custkey % 4 = 0 THEN 'skipped' ELSE 'imported' END AS status, count(*) AS n, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS w, concat('c', CAST(o_custkey AS VARCHAR)) AS path FROM orders GROUP BY o_custkey)
    SELECT status, count(*) AS files, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(w) AS BIGINT) AS warnings, array_to_string(list(path ORDER BY path)[1:5], ',') AS examples FROM f GROUP BY 1
    UNION ALL SELECT 'total', count(*), CAST(sum(n) AS BIGINT), CAST(sum(w) AS BIGINT), '' FROM f""")
def import_report(spark, sf_dir):
    n, urgent = F.count(F.lit(1)), F.collect_list(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderkey").cast("string")))
    files = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(n.alias("rows"), urgent.alias("warnings"))
    status = F.when(F.col("rows") > 12, "refused").when(F.col("o_custkey") % 4 == 0, "skipped").otherwise("imported")
    done = documents.import_report(files.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("path"), status.alias("status"), "rows", "warnings"))
    return done.withColumn("examples", F.array_join("examples", ",")).withColumn("warnings", F.col("warnings").cast("long"))


@query(f"""WITH {_RECORDS}, k AS (SELECT CAST(f AS VARCHAR) AS fingerprint, keep, same FROM g WHERE ambiguous)
    SELECT fingerprint, CAST(keep AS INT) AS keep_all, CAST(same AS INT) AS same_event, CAST(keep AS INT) AS slots, concat(CAST(l_orderkey AS VARCHAR), '-', CAST(l_linenumber AS VARCHAR)) AS occurrence_id, l_returnflag = 'R' AS processed, count(*) AS times
    FROM k JOIN lineitem ON l_partkey * 10 + l_linenumber = CAST(fingerprint AS BIGINT) GROUP BY ALL""")
def duplicate_listing(spark, sf_dir):
    """What is shown of ambiguous records, with the occurrences behind them."""
    rows = _occurrences(spark, sf_dir)
    groups, shown = slots.listing(_imported(spark, rows), rows, ["processed"])
    met = groups.join(shown.drop("membership"), "fingerprint").select("fingerprint", "keep_all", "same_event", F.size("slot_ids").alias("slots"), "occurrence_id", F.col("processed").cast("boolean").alias("processed"))
    return met.groupBy(*met.columns).agg(F.count(F.lit(1)).alias("times"))
