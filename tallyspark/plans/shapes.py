"""Ledgers shaped from the driver tables. Each column is one expression that Spark SQL and ANSI SQL engines share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Orders as ledger rows: a third are inflows, some lack a value, categories follow the priority.
LEDGER = {
    "id": "o_orderkey",
    "date": "CAST(o_orderdate AS DATE)",
    "account_id": "concat('acct_', CAST(o_custkey % 40 AS VARCHAR(20)))",
    "account_type": "CASE o_custkey % 3 WHEN 0 THEN 'bank' WHEN 1 THEN 'credit_card' ELSE 'investment' END",
    "institution": "concat('bank_', CAST(o_custkey % 5 AS VARCHAR(20)))",
    "owner": "CASE o_custkey % 4 WHEN 0 THEN 'owner_a' WHEN 1 THEN 'owner_b' WHEN 2 THEN 'Household' ELSE 'Unknown' END",
    "category": "CASE o_orderpriority WHEN '1-URGENT' THEN 'Income' WHEN '2-HIGH' THEN 'Groceries' WHEN '3-MEDIUM' THEN 'Internal Transfer' WHEN '4-NOT SPECIFIED' THEN 'Unknown' ELSE 'Dining' END",
    "posted_amount": "CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice ELSE -o_totalprice END AS DECIMAL(18,2))",
    "posted_currency": "CASE o_custkey % 4 WHEN 0 THEN 'HKD' WHEN 1 THEN 'USD' WHEN 2 THEN 'EUR' ELSE 'XXX' END",
    "amount_base": "CAST(CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN o_totalprice ELSE -o_totalprice END AS DECIMAL(18,2))",
    "valuation_status": "CASE WHEN o_orderkey % 7 = 0 THEN 'missing' WHEN o_orderkey % 5 = 0 THEN 'estimated' ELSE 'actual' END",
    "flow_type": "CASE WHEN o_orderpriority = '1-URGENT' THEN 'income' WHEN o_orderpriority = '3-MEDIUM' THEN 'internal_transfer' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'unresolved' WHEN o_orderkey % 3 = 0 THEN 'refund' ELSE 'expense' END",
    "flow_source": "CASE WHEN o_orderkey % 11 = 0 THEN 'rule' ELSE 'deterministic' END",
    "status": "o_orderstatus",
    "priority": "o_orderpriority",
}


def sql(columns: dict[str, str], table: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + f" FROM {table}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shaped(spark: SparkSession, sf_dir: str, columns: dict[str, str], name: str) -> DataFrame:
    return table(spark, sf_dir, name).selectExpr(*(f"{e} AS {c}" for c, e in columns.items()))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(spark, sf_dir, LEDGER, "orders")


LEDGER_SQL = f"ledger AS ({sql(LEDGER, 'orders')})"

#: Legs of transfers: outflows, their mirrors some days later in another account, and decoys at equal distance.
LEGS = {
    "out": {
        "id": "concat('o', CAST(o_orderkey AS VARCHAR(20)))", "date": "CAST(o_orderdate AS DATE)", "account_id": "concat('acct_', CAST(o_custkey % 40 AS VARCHAR(20)))",
        "account_type": "'bank'", "amount_base": "CAST(-o_totalprice AS DECIMAL(18,2))", "flow_type": "'unresolved'", "flow_source": "'deterministic'",
    },
    "in": {
        "id": "concat('i', CAST(o_orderkey AS VARCHAR(20)))", "date": "date_add(CAST(o_orderdate AS DATE), CAST(o_orderkey % 6 AS INT))", "account_id": "concat('acct_', CAST((o_custkey + 1) % 40 AS VARCHAR(20)))",
        "account_type": "CASE o_orderkey % 4 WHEN 0 THEN 'credit_card' WHEN 1 THEN 'investment' ELSE 'bank' END", "amount_base": "CAST(o_totalprice AS DECIMAL(18,2))",
        "flow_type": "CASE WHEN o_orderkey % 9 = 0 THEN 'internal_transfer' ELSE 'unresolved' END", "flow_source": "CASE WHEN o_orderkey % 9 = 0 THEN 'rule' ELSE 'deterministic' END",
    },
    "decoy": {
        "id": "concat('d', CAST(o_orderkey AS VARCHAR(20)))", "date": "date_add(CAST(o_orderdate AS DATE), CAST(o_orderkey % 6 AS INT))", "account_id": "concat('acct_', CAST((o_custkey + 2) % 40 AS VARCHAR(20)))",
        "account_type": "'bank'", "amount_base": "CAST(o_totalprice AS DECIMAL(18,2))", "flow_type": "'unresolved'", "flow_source": "'deterministic'",
    },
}


def legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    parts = [orders.filter("o_orderkey % 5 = 0" if k == "decoy" else "true").selectExpr(*(f"{e} AS {c}" for c, e in v.items())) for k, v in LEGS.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def legs_sql() -> str:
    parts = [sql(v, "orders") + (" WHERE o_orderkey % 5 = 0" if k == "decoy" else "") for k, v in LEGS.items()]
    text = " UNION ALL ".join(parts)
    return "legs AS (" + text.replace("date_add(CAST(o_orderdate AS DATE), CAST(o_orderkey % 6 AS INT))", "CAST(o_orderdate AS DATE) + CAST(o_orderkey % 6 AS INT)") + ")"
