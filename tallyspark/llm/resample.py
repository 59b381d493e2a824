"""Quality selection by importance resampling.

Documents are sets of hashed word uni- and bigrams (and one bucket for the share of words that repeat the word before).
Generative models (smoothed multinomials over the hash buckets) are fitted to target text (labelled good and not toxic), to all raw text, and to two raw components that labels name: low
quality and toxic text. A document's importance is the log-ratio of target to raw. Where the n-grams that only a rejected
component explains (CONTRAST times likelier there, with support) add up to EVIDENCE, the ratio to that component is added,
so a few telling words are not drowned by a long ordinary text; for the same reason long texts count by their mean.
Documents are then sampled without replacement by Gumbel top-k: k documents of the largest importance plus Gumbel noise,
which is a fixed function of doc_id.

Two things decide who stays: evidence for a rejected component costs a document its place, and of the others a share is
drawn by importance, so that ratio and noise choose among them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import HASH_BASE, _byte_codes, id_and_text, mix, raw_bytes, slices, span_sums, staged, word_bounds

#: Every n-gram has a bucket in each of two tables; a contrast has to show in both, so that chance collisions do not count.
BUCKETS = 1 << 17
CELLS = 2 * BUCKETS
#: Labelled rows that the component models may use: a bounded sample by a hash of doc_id.
LABEL_SAMPLE = 20_000
SMOOTHING = 0.5
CONTRAST = 30.0
#: A contrast needs so many documents of the component, and so large a share of them.
SUPPORT = 6
SUPPORT_SHARE = 0.03
EVIDENCE = 3.0
#: Long documents count as so many features (their mean ratio times this), and rejection costs this much at least.
LENGTH = 100
REJECTED = 50.0
#: The share of the documents without such evidence that the registered query draws.
SHARE = 0.95
RAW, TARGET, LOW, TOXIC = range(4)
#: The last buckets hold the share of words that repeat the word before.
SHARES = 8
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def features(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct uni- and bigrams of every row: their buckets in either table, and the row of each; sorted by row."""
    data, offsets = raw_bytes(text)
    starts, ends, counts = word_bounds(data, offsets)
    words = mix(span_sums(_byte_codes(True)[data], starts, ends)) if len(starts) else np.empty(0, np.uint64)
    sizes = np.diff(counts)
    row = np.repeat(np.arange(len(sizes)), sizes)
    second = row[1:] == row[:-1]
    pair = mix(words[:-1] * np.uint64(HASH_BASE) + words[1:])[second]
    same = (words[1:] == words[:-1])[second]
    # How much of a text repeats the word before: one feature a document, in eighths.
    repeats = np.bincount(row[1:][second][same], minlength=len(sizes)) if len(words) > 1 else np.zeros(len(sizes), int)
    share = np.minimum(repeats * SHARES // np.maximum(sizes, 1), SHARES - 1)
    full = np.flatnonzero(sizes)
    # Words that end in punctuation count without it too.
    bare = np.flatnonzero(_PUNCTUATION[data[ends - 1]])
    letters = np.where(_PUNCTUATION[data], np.uint64(0), _byte_codes(True)[data])
    plain = mix(span_sums(letters, starts[bare], ends[bare])) if len(bare) else np.empty(0, np.uint64)
    grams, span = np.concatenate((words, plain, pair[~same])), np.uint64(BUCKETS - SHARES)
    first = np.concatenate(((grams % span).astype(np.int64), BUCKETS - SHARES + share[full]))
    other = np.concatenate((((grams >> np.uint64(32)) % span).astype(np.int64), BUCKETS - SHARES + share[full]))
    at = np.concatenate((row, row[bare], row[1:][second][~same], full))
    key = np.sort((at * BUCKETS + first) * BUCKETS + other)
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    return key // BUCKETS % BUCKETS, key % BUCKETS, key // BUCKETS // BUCKETS


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((4, 2, BUCKETS), np.int64)
    for batch in batches:
        for part in slices(batch):
            *tables, row = features(part.column("text"))
            component = part.column("component").to_numpy(zero_copy_only=False)[row]
            for h, bucket in enumerate(tables):
                total[RAW, h] += np.bincount(bucket, minlength=BUCKETS)
                for c in (TARGET, LOW, TOXIC):
                    total[c, h] += np.bincount(bucket[component == c], minlength=BUCKETS)
    total = total.ravel()
    cell = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell])], names=["cell", "n"])


def ratios(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """(3, 2, BUCKETS): log target over raw, and the contrasts of target to low quality and to toxic text."""
    sample = (
        labels.filter("doc_id is not null and quality is not null and toxic is not null")
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("toxic") == 1, TOXIC).when(F.col("quality") == 0, LOW).otherwise(TARGET).alias("component"))
        .groupBy("doc_id")
        .agg(F.max("component").alias("component"))
    )
    total = sample.count()
    if total > LABEL_SAMPLE:
        sample = sample.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(LABEL_SAMPLE / total * (1 << 30)))
    joined = id_and_text(docs).join(F.broadcast(sample), "doc_id", "left").select("text", F.coalesce("component", F.lit(RAW)).alias("component"))
    cells = joined.mapInArrow(_count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most 4 * CELLS rows
    n = np.zeros(4 * CELLS)
    n[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    n = n.reshape(4, 2, BUCKETS)
    rows = n[:, 0, BUCKETS - SHARES :].sum(axis=1)  # every document with words has one of these buckets
    logs = np.log((n + SMOOTHING) / (n.sum(axis=2, keepdims=True) + SMOOTHING * BUCKETS))
    out = np.zeros((3, 2, BUCKETS))
    if n[TARGET].sum():
        out[0] = logs[TARGET] - logs[RAW]
        for k, c in ((1, LOW), (2, TOXIC)):
            contrast = logs[TARGET] - logs[c]
            out[k] = np.where((contrast <= -np.log(CONTRAST)) & (n[c] >= max(SUPPORT, SUPPORT_SHARE * rows[c])), contrast, 0.0)
    return out


def importance(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """doc_id and log_weight of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(table.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for batch in batches:
            for part in slices(batch):
                first, other, row = features(part.column("text"))
                total = lambda weights: np.bincount(row, weights=weights, minlength=part.num_rows)
                raw = total(t[0, 0][first])
                low, toxic = (total(np.maximum(t[k, 0][first], t[k, 1][other])) for k in (1, 2))
                told = np.minimum(low, toxic)
                size = np.bincount(row, minlength=part.num_rows)
                weight = raw * np.minimum(1.0, LENGTH / np.maximum(size, 1)) + np.where(told <= -EVIDENCE, told - REJECTED, 0.0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(weight), pa.array(told)], names=["doc_id", "log_weight", "evidence"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, log_weight double, evidence double")


def top_k(keyed: DataFrame, k: int, bins: int = 4096) -> DataFrame:
    """keyed(doc_id, key) with kept: the k rows of largest key, ties to smaller doc_ids. The cut is found by histograms.

    Each pass counts the rows of `bins` equal ranges between the current bounds and narrows to the range of the k-th row;
    no task sees more than its own rows and the driver sees only counts.
    """
    low, high = keyed.agg(F.min("key"), F.max("key")).first()
    above, n = 0, keyed.count()
    if k <= 0 or n == 0:
        return keyed.withColumn("kept", F.lit(False))
    if k >= n:
        return keyed.withColumn("kept", F.lit(True))
    while True:
        width = (high - low) / bins
        inside = keyed.filter(F.col("key").between(low, high))
        if width <= 0 or low + width == low:
            break
        counts = dict(inside.groupBy(F.least(F.floor((F.col("key") - low) / width), F.lit(bins - 1)).alias("bin")).count().collect())
        b = bins - 1
        while above + counts.get(b, 0) < k:
            above += counts.get(b, 0)
            b -= 1
        edge = keyed.filter(F.col("key").between(low, high)).withColumn("bin", F.least(F.floor((F.col("key") - low) / width), F.lit(bins - 1))).filter(F.col("bin") == b)
        new_low, new_high = edge.agg(F.min("key"), F.max("key")).first()
        if new_low == new_high or (new_low, new_high) == (low, high):
            low = high = new_low
            break
        low, high = new_low, new_high
    # All that is left to decide are rows with one key: the smallest doc_ids, found in the same way over doc_id.
    tied = keyed.filter(F.col("key") == high)
    want = k - keyed.filter(F.col("key") > high).count()
    first, last = tied.agg(F.min("doc_id"), F.max("doc_id")).first()
    while first < last:
        middle = (first + last) // 2
        if tied.filter(F.col("doc_id") <= middle).count() >= want:
            last = middle
        else:
            first = middle + 1
    return keyed.withColumn("kept", (F.col("key") > high) | ((F.col("key") == high) & (F.col("doc_id") <= last)))


#: The standard deviation of Gumbel noise.
NOISE = float(np.pi / np.sqrt(6))


def gumbel(doc_id: F.Column) -> F.Column:
    """Standard Gumbel noise as a fixed function of doc_id."""
    uniform = (F.pmod(F.xxhash64(doc_id, F.lit(41)), F.lit((1 << 52) - 1)) + 1) / F.lit(float(1 << 52))
    return -F.log(-F.log(uniform))


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, share: float = 1.0) -> DataFrame:
    """One row per document: doc_id, log_weight, gumbel_key, kept.

    kept marks the k documents that are sampled; k defaults to a share of the number of documents that no rejected
    component explains better than the target does. Their weights are divided by what brings their standard deviation down
    to that of the noise, where it is larger; those of rejected documents are not, so these are drawn last. Null and empty texts weigh 0. Without labels every weight is 0 and everything
    is kept. doc_id has to be unique. An empty table gives an empty result; other columns are not read.
    """
    weighed = staged(importance(docs, ratios(docs, labels)), "weights")
    if k is None:
        k = round(share * weighed.filter(F.col("evidence") > -EVIDENCE).count())
    open_ = F.col("evidence") > -EVIDENCE
    # Weights of what is not rejected are tempered to the spread of the noise, so that the draw is one and no sort by weight.
    spread = weighed.filter(open_).agg(F.stddev_pop("log_weight")).first()[0] or 0.0
    temper = max(1.0, spread / NOISE)
    keyed = weighed.select("doc_id", "log_weight", (F.when(open_, F.col("log_weight") / temper).otherwise(F.col("log_weight")) + gumbel(F.col("doc_id"))).alias("key"))
    return top_k(staged(keyed, "keys"), k).withColumnRenamed("key", "gumbel_key")
