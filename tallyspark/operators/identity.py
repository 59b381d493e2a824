"""Identities of ledger rows: their state, legacy ids, ordinals, batches of sources against what is stored."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.text import framed_sha256
from tallyspark.operators.overlap import resolve_records, resolve_sources
from tallyspark.operators.policy import is_unknown

# The id columns of a row and the prefix of each.
ID_COLUMNS = {"source_id": "src_", "source_namespace_id": "ns_", "source_revision": "rev_", "source_record_id": "rec_"}


def _filled(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")) != ""


def identity_state() -> Column:
    """full, empty or partial, by how many of the id columns are filled."""
    filled = reduce(lambda a, b: a + b, (_filled(c).cast("int") for c in ID_COLUMNS))
    return F.when(filled == len(ID_COLUMNS), "full").when(filled == 0, "empty").otherwise("partial")


def is_stable() -> Column:
    """Whether every id column and the transaction id have the form of the present generation."""
    shaped = [F.coalesce(F.col(c), F.lit("")).rlike(f"^{p}[0-9a-f]{{64}}\\z") for c, p in ID_COLUMNS.items()]
    return reduce(lambda a, b: a & b, shaped) & F.coalesce(F.col("transaction_id"), F.lit("")).rlike(r"^txn_[0-9a-f]{32}\z")


def ambiguous_legacy_ids(rows: DataFrame) -> DataFrame:
    """Transaction ids that more than one row without any id column claims."""
    legacy = rows.filter((identity_state() == "empty") & _filled("transaction_id"))
    return legacy.groupBy("transaction_id").agg(F.count(F.lit(1)).alias("claims")).filter("claims > 1")


def ordinals(rows: DataFrame, source: str, fingerprint: str, order: list[str]) -> DataFrame:
    """rows with ordinal: the how-manieth record of its fingerprint in its source, in the order of the locator."""
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy(source, fingerprint).orderBy(*order)))


def has_history() -> Column:
    """Any sign that somebody or something decided about a source row before."""
    return (
        ~is_unknown(F.col("category"))
        | (F.coalesce("flow_source", F.lit("")) == "correction")
        | F.array_contains("flags", "manual_correction")
        | ~F.coalesce("confidence", F.lit("")).isin("", "0", "0.00")
        | ~F.coalesce("needs_review", F.lit(True))
    )


def resolve_batch(ledger: DataFrame, sources: DataFrame, incoming: DataFrame, replace: bool) -> DataFrame:
    """The rows after an import or a replacement: source_id, record_id, locator, fingerprint, action.

    ledger: source_id, record_id, locator, fingerprint; sources: source_id, namespace, revision; incoming: namespace,
    revision, locator, fingerprint. Rows of sources that are not replaced are retained; in a replaced source records keep
    or move their ids as in resolve_records, new records get an id of their own. Sources in error are left out, see
    resolve_sources for them.
    """
    named = resolve_sources(incoming.select("namespace", "revision").distinct(), sources, replace).filter("source_id is not null")
    arriving = incoming.join(named, ["namespace", "revision"]).select("source_id", "locator", "fingerprint")
    stays = ledger.join(named.select("source_id"), "source_id", "left_anti").withColumn("action", F.lit("retained"))
    replaced = ledger.join(named.select("source_id"), "source_id", "left_semi")
    # Records meet within their source: the source is part of both keys.
    within = lambda df: df.withColumn("locator", F.struct("source_id", "locator")).withColumn("fingerprint", F.struct("source_id", "fingerprint")).drop("source_id")
    met = resolve_records(within(arriving), within(replaced)).select("locator.source_id", "record_id", "locator.locator", "fingerprint.fingerprint", "action")
    new = framed_sha256("rec_", "record", F.col("source_id"), F.col("locator"))
    settled = met.withColumn("record_id", F.when(F.col("action") == "new", new).otherwise(F.col("record_id")))
    return stays.select(*settled.columns).unionByName(settled)
