"""A batch of corrections as one transaction over the tables of a workspace."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.text import add_token
from tallyspark.operators import reconcile
from tallyspark.operators.review import merge_patches
from tallyspark.sources.generations import GenerationConflict, Generations, digest
from tallyspark.sources.staging import staged

#: What a correction may set; review_reasons follow from needs_review.
FIELDS = ("category", "owner", "flow_type", "needs_review")


class CorrectionError(ValueError):
    """The batch cannot be applied; nothing was."""


@dataclass(frozen=True)
class Applied:
    """version in force afterwards, and whether the batch changed anything."""

    version: str
    changed: bool


def checked(patches: DataFrame, ledger: DataFrame) -> None:
    """Every id is in the ledger and stands once, and every patch sets something."""
    given = F.lit(False)
    for f in FIELDS:
        given = given | F.col(f).isNotNull()
    known = ledger.select("id", F.lit(True).alias("known"))
    found = patches.groupBy("id").agg(F.count(F.lit(1)).alias("times"), F.bool_and(given).alias("sets")).join(known, "id", "left")
    problem = F.when(F.col("known").isNull(), "is not in the ledger").when(F.col("times") > 1, "stands more than once").when(~F.col("sets"), "sets no field")
    wrong = found.select("id", problem.alias("problem")).filter("problem is not null").orderBy("id").limit(1).collect()
    if wrong:
        raise CorrectionError(f"{wrong[0].id} {wrong[0].problem}")


PATCH = "__patch"


def _patched(ledger: DataFrame, patches: DataFrame) -> DataFrame:
    """ledger with its patch, or null."""
    given = patches.select(F.col("id").alias("__id"), F.struct(*FIELDS).alias(PATCH))
    return ledger.join(given, F.col("id") == F.col("__id"), "left").drop("__id")


def _corrected(rows: DataFrame) -> DataFrame:
    """Rows after their patch: a set flow is a correction, and rows whose review is closed have no review reasons."""
    patch = F.col(PATCH)
    closed = F.coalesce(patch["needs_review"] == False, F.lit(False))  # noqa: E712
    values = {f: F.coalesce(patch[f], F.col(f)) for f in FIELDS} | {
        "flow_source": F.when(patch["flow_type"].isNotNull(), "correction").otherwise(F.col("flow_source")),
        "flags": add_token(F.col("flags"), "manual_correction", patch.isNotNull()),
        "review_reasons": F.when(closed, F.array().cast("array<string>")).otherwise(F.col("review_reasons")),
    }
    return rows.select(*(values[c].alias(c) if c in values else F.col(c) for c in rows.columns))


def corrected(ledger: DataFrame, patches: DataFrame) -> DataFrame:
    """ledger with patches."""
    return _corrected(_patched(ledger, patches)).drop(PATCH)


def least_change(rows: DataFrame) -> DataFrame:
    """The row that is to be stored of rows(stored, baseline, after, touched): as it is, where the batch neither names nor
    changes it.

    baseline is what the same steps make of the ledger without the batch.
    """
    same = ~F.col("touched") & (F.col("baseline") == F.col("after"))
    return rows.select(F.when(same, F.col("stored")).otherwise(F.col("after")).alias("row")).select("row.*")


def _reconciled_beside(ledger: DataFrame, patches: DataFrame, trusted: Column, refund_text: Column, **options) -> DataFrame:
    """stored, baseline, after and touched of every row.

    What pairs is found on narrow columns, with and without the batch. The rows travel once, to their patch and to both
    findings; what these leave on a row is told by the row.
    """
    columns, bare = ledger.columns, [c for c in ledger.columns if c not in reconcile.RESULT]
    prepared = lambda rows: reconcile.prepared(rows, trusted, refund_text)
    plain = reconcile.claims_of(prepared(ledger.select(*bare)), **options)
    changed = reconcile.claims_of(prepared(corrected(ledger.select(*bare), patches)), **options)
    rows = reconcile.met(reconcile.met(_patched(ledger, patches), plain, "__plain_"), changed, "__changed_")
    carried = [c for c in rows.columns if c.startswith("__")]
    rows = rows.select(*carried, F.struct(*columns).alias("__stored"))
    opened = lambda df: df.select(*(c for c in df.columns if c.startswith("__")), *(F.col(f"__stored.{c}").alias(c) for c in bare))
    packed = lambda df, name: df.select(*(c for c in df.columns if c.startswith("__")), F.struct(*columns).alias(name))
    rows = packed(reconcile.settled(prepared(opened(rows)), "__plain_"), "__baseline")
    rows = packed(reconcile.settled(prepared(_corrected(opened(rows))), "__changed_"), "__after")
    return rows.select(F.col("__stored").alias("stored"), F.col("__baseline").alias("baseline"), F.col("__after").alias("after"), F.col(PATCH).isNotNull().alias("touched"))


def apply_corrections(store: Generations, patches: DataFrame, expected: str | None, trusted: Column, refund_text: Column, steps: tuple[Callable[[DataFrame], DataFrame], ...] = (), **options) -> Applied:
    """Merge patches(id, FIELDS) into the stored corrections, bring the ledger in line and commit both with the review queue.

    expected: the version that the batch was made against; if another is in force, or its tables were changed, the batch is
    refused, before anything is made of it where the version tells. steps run on the ledger after reconciliation (duplicates,
    overlap review). A batch that sets nothing new leaves everything as it is, so it can be replayed.
    """
    store.recover(older_than=3600)
    ledger, stored = store.read("ledger", expected), store.read("corrections", expected)
    patches = staged(patches.select("id", *FIELDS), "batch")
    checked(patches, ledger)
    if store.current() != expected:
        raise GenerationConflict("another generation was committed meanwhile")
    merged = staged(merge_patches(stored, patches, stored.select("id").limit(0), "id", list(FIELDS)), "merged")
    if digest(merged) == digest(stored):
        return Applied(expected, False)

    def brought(rows: DataFrame) -> DataFrame:
        done = reconcile.reconcile(rows.drop(*reconcile.RESULT), trusted, refund_text, **options).rows
        for step in steps:
            done = step(done)
        return done.select("id", F.struct(*ledger.columns).alias("row"))

    if steps:
        named = patches.select("id", F.lit(True).alias("named"))
        rows = ledger.select("id", F.struct(*ledger.columns).alias("stored")).join(brought(ledger).withColumnRenamed("row", "baseline"), "id").join(brought(corrected(ledger, patches)).withColumnRenamed("row", "after"), "id").join(named, "id", "left")
        rows = rows.withColumn("touched", F.col("named").isNotNull())
    else:
        rows = _reconciled_beside(ledger, patches, trusted, refund_text, **options)
    after = least_change(rows)
    version = store.commit({"ledger": after, "corrections": merged, "review": lambda written: written("ledger").filter("needs_review")}, expected)
    return Applied(version, version != expected)
