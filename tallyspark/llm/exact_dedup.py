"""Exact deduplication by a tree merge of sorted digest runs.

Every input slice forms a run: one entry per digest, in digest order, with the smallest row (by doc_id) and the number of
rows. Runs are then exchanged in binomial rounds. A round takes the runs of 2**ROUND_BITS slices whose numbers differ only
in the next bits together; the digest space of such a group is divided into as many lanes as it has slices, so a round keeps
the number of tasks and each one merges 2**ROUND_BITS sorted runs over its own part of the space. Spark's sort brings the
runs of a lane into one order (in bounded memory, it spills) and a fold over neighbours leaves one entry per digest: the
first, which is the smallest. After the last round every digest has one entry. A text with any number of copies adds at
most one entry per slice to the first round and ever fewer later; no task holds a group of copies.

Texts are identified by the SHA-256 of the normalised text. Entries also carry its length in characters and a second,
independent 64-bit hash; entries merge only if all three agree, which verifies the smallest identifier at every level.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import SPACE_CLASS, partitions, staged

#: Bits of the slice number that one round consumes: each merge takes 2**4 runs.
ROUND_BITS = 4
KEY = ("text_sha256", "n_chars_norm", "check_hash")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, row (a number of the input row), slice and the identifying columns of every row's normalised text."""
    norm = F.regexp_replace(F.coalesce("text", F.lit("")), SPACE_CLASS + "+", " ")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), norm.alias("norm"), F.spark_partition_id().alias("slice"), F.monotonically_increasing_id().alias("row"))
    return rows.select("doc_id", "row", "slice", *_identity(F.col("norm")))


def _identity(norm: F.Column) -> tuple[F.Column, ...]:
    return F.sha2(norm, 256).alias("text_sha256"), F.length(norm).cast("long").alias("n_chars_norm"), F.xxhash64(norm).alias("check_hash")


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (slice, lane, KEY, keep_id): one row per (slice, lane, KEY), the first, with the sum of group_size."""
    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch]).combine_chunks()
        if not rows.num_rows:
            continue
        new = np.ones(rows.num_rows, bool)
        for name in ("slice", "lane", *KEY):
            column = rows.column(name)
            differs = pc.not_equal(column.slice(1), column.slice(0, rows.num_rows - 1)).to_numpy()
            new[1:] = differs if name == "slice" else new[1:] | differs
        first = np.flatnonzero(new)
        sizes = np.add.reduceat(rows.column("group_size").to_numpy(), first)
        merged = rows.take(pa.array(first)).set_column(rows.schema.get_field_index("group_size"), rows.schema.field("group_size"), pa.array(sizes))
        # The last entry may go on in the next batch.
        held = merged.slice(merged.num_rows - 1)
        yield from merged.slice(0, merged.num_rows - 1).to_batches()
    if held is not None:
        yield from held.to_batches()


def merge_runs(entries: DataFrame, rounds: int) -> DataFrame:
    """The binomial rounds over (slice, KEY, keep_id, group_size, more columns) entries; one entry per KEY at the end.

    More columns are taken from the entry that stays and break ties of keep_id, in their order.
    """
    ties = [c for c in entries.columns if c not in ("slice", "lane", "group_size", "keep_id", *KEY)]
    runs = entries.withColumn("lane", F.lit(0).cast("long"))
    n = partitions(entries.sparkSession)
    for r in range(rounds):
        lane = F.pmod(F.xxhash64(*KEY), F.lit(1 << (ROUND_BITS * (r + 1))))
        dealt = runs.withColumn("slice", F.shiftright("slice", ROUND_BITS)).withColumn("lane", lane)
        ordered = dealt.repartition(n, "slice", "lane").sortWithinPartitions("slice", "lane", *KEY, F.col("keep_id").asc_nulls_last(), *ties)
        runs = ordered.mapInArrow(_folded, ordered.schema)
    return runs.drop("lane")


def _merged(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The runs of the slices and the entries after all rounds, over digests()."""
    slices = (runs.agg(F.max("slice")).first()[0] or 0) + 1
    rounds = max(1, -(-(slices - 1).bit_length() // ROUND_BITS))
    entries = runs.groupBy("slice", *KEY).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("low"), F.count(F.lit(1)).alias("group_size"))
    first = staged(entries.select("slice", *KEY, F.col("low.doc_id").alias("keep_id"), F.col("low.row").alias("keep_row"), "group_size"), "runs")
    return first, merge_runs(first, rounds)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null and empty texts are equal to each other; a text of white space only equals one space. A row without a doc_id counts
    like any other and comes after those that have one: where no row of a group has a doc_id, keep_id is null and the first
    row in the order of the input is kept. Repeated doc_ids with equal texts count as separate rows of the group and are all
    marked as kept if their doc_id is the smallest (doc_id cannot tell them apart; drop_copies leaves one). An empty table
    gives an empty result; extra columns are not read.
    """
    runs = staged(digests(docs), "digests")
    first, merged = _merged(runs)
    # Winners go back by slice: the join has at most one row of each side per digest and slice, however many the copies.
    winners = first.select("slice", *KEY).join(merged.drop("slice"), list(KEY))
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("row") == F.col("keep_row"))
    return runs.join(winners, ["slice", *KEY]).select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns: of equal texts one row, of the smallest doc_id.

    Rows are told apart by a number that is written with them, so repeated doc_ids do no harm. Rows without a doc_id come
    after those that have one.
    """
    key = f"k{uuid.uuid4().hex}"
    rows = staged(docs.withColumn(key, F.monotonically_increasing_id()), "rows")
    norm = F.regexp_replace(F.coalesce("text", F.lit("")), SPACE_CLASS + "+", " ")
    mine = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(key).alias("row"), F.spark_partition_id().alias("slice"), norm.alias("norm"))
    _, merged = _merged(staged(mine.select("doc_id", "row", "slice", *_identity(F.col("norm"))), "digests"))
    return rows.join(merged.select(F.col("keep_row").alias(key)), key, "left_semi").drop(key).select(*(F.col(f"`{c}`") for c in docs.columns))
