"""Helpers shared by the corpus operators: staging, word scanning and vectorised hashing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The six characters that separate words everywhere in this package (fixed by the contracts).
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Odd 64-bit base of the positional hash; congruent to 3 modulo 8, so that powers spread in the low bits.
HASH_BASE = 0x9E3779B97F4A7C13
HASH_SEED = 20240229
#: Bytes of text that one numpy pass handles; bounds the memory of a Python worker.
PASS_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where that is unset (a local test session) a folder below the warehouse is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    return base.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/staged/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tokenizer_file(name: str) -> str:
    """Where a public vocabulary file lies; the operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def documents_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, null text as empty; other columns never reach the scan. Rows without a doc_id take no part."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.filter(F.col("doc_id").isNotNull())


def every_row(docs: DataFrame) -> DataFrame:
    """row, doc_id and text of all rows, null text as empty; row tells rows that share a doc_id, or have none, apart by their
    texts. Rows with the same doc_id and text share it: what is found for one holds for the other."""
    text = F.coalesce(F.col("text"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(_row_of(doc_id, text).alias("row"), doc_id.alias("doc_id"), text.alias("text"))


def _row_of(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, F.lit("/"), text)


def keep_by_row(docs: DataFrame, rows: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of docs whose row of every_row is in rows (not in, for left_anti), with all columns, whatever their names."""
    key = f"k{uuid.uuid4().hex}"
    own = _row_of(docs["doc_id"].cast("long"), F.coalesce(docs["text"], F.lit("")))
    return docs.join(rows.select(F.col("row").alias(key)).distinct(), own == F.col(key), how)


def keep_rows(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of docs whose doc_id is in ids (not in, for left_anti), with all columns, whatever their names."""
    key = f"k{uuid.uuid4().hex}"
    return docs.join(ids.select(F.col("doc_id").alias(key)).distinct(), docs["doc_id"] == F.col(key), how)


def range_chunks(rows: DataFrame, key: str, order: Sequence[str | Column], size: int, weight: Column | None = None) -> DataFrame:
    """rows with slice, at and chunk: runs of up to `size` rows (or of that weight, about) that follow each other by order within a key.

    Rows are dealt by ranges of (key, order), so a key with very many rows lies in several slices, in order; no task and no
    group holds all of it. The slices' sums are added up to where each begins, so chunks are of one size however many slices
    there are. chunk counts from 0 within a key; (slice, at) orders the rows of a key.
    """
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), key, *order)
    placed = staged(dealt.withColumn("slice", F.spark_partition_id()).withColumn("__w", F.lit(1).cast("long") if weight is None else weight.cast("long")), "ranges")
    sums = placed.groupBy(key, "slice").agg(F.sum("__w").alias("__sum"))
    earlier = Window.partitionBy(key).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    begins = sums.select(key, "slice", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__begin"))
    by = Window.partitionBy(key, "slice").orderBy(*order)
    before = F.coalesce(F.sum("__w").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = placed.withColumns({"at": F.row_number().over(by), "__before": before})
    return placed.join(begins, [key, "slice"]).withColumn("chunk", F.floor((F.col("__begin") + F.col("__before")) / size)).drop("__w", "__begin", "__before")


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = PASS_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about `limit` bytes of text each; a longer row stands alone."""
    text = batch.column(column)
    if len(text) == 0:
        return
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int32, count=len(text) + 1, offset=4 * text.offset)
    low = 0
    while low < len(text):
        high = int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1
        high = min(max(high, low + 1), len(text))
        yield batch.slice(low, high - low)
        low = high


def raw_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and the offsets of its rows in them."""
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int32, count=len(text) + 1, offset=4 * text.offset).astype(np.int64)
    if offsets[-1] == offsets[0] or text.buffers()[2] is None:
        return np.empty(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(text.buffers()[2], dtype=np.uint8, count=int(offsets[-1] - offsets[0]), offset=int(offsets[0]))
    return data, offsets - offsets[0]


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_bounds(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the number of words before each row (rows + 1 entries).

    between: which of the 256 bytes stand between words.
    """
    solid = np.empty(len(data) + 1, bool)
    np.logical_not(between[data], out=solid[:-1])
    solid[-1] = False
    first = solid[:-1].copy()
    first[1:] &= ~solid[:-2]
    last = solid[:-1] & ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every input bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


_tables: dict[str, np.ndarray] = {}


def _byte_codes(lower: bool) -> np.ndarray:
    key = f"codes{lower}"
    if key not in _tables:
        codes = np.random.default_rng(HASH_SEED).integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        if lower:
            codes[65:91] = codes[97:123]
        _tables[key] = codes
    return _tables[key]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of them."""
    if "up" not in _tables or len(_tables["up"]) < n:
        size = max(n, PASS_BYTES + (1 << 16))
        for name, base in (("up", HASH_BASE), ("down", pow(HASH_BASE, -1, 1 << 64))):
            run = np.full(size, base, np.uint64)
            run[0] = 1
            _tables[name] = np.multiply.accumulate(run)
    return _tables["up"], _tables["down"]


def span_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positional hash of values[start:end] for each span, the same wherever the span stands (arithmetic modulo 2**64)."""
    up, down = _powers(len(values) + 1)
    total = np.empty(len(values) + 1, np.uint64)
    total[0] = 0
    np.cumsum(values * up[: len(values)], out=total[1:])
    return (total[ends] - total[starts]) * down[starts]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of every word; with lower, A-Z count as a-z."""
    if len(starts) == 0:
        return np.empty(0, np.uint64)
    return mix(span_sums(_byte_codes(lower)[data], starts, ends) + (ends - starts).astype(np.uint64))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each start of n consecutive words (fewer entries by n - 1; document ends are the caller's concern)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out *= np.uint64(HASH_BASE)
        out += words[j : j + m]
    return mix(out)


SHINGLE = 5


def shingle_sets(text: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every row; empty without words."""
    data, offsets = raw_bytes(text)
    starts, ends, counts = word_bounds(data, offsets)
    words = word_hashes(data, starts, ends, lower=True)
    grams = gram_hashes(words, SHINGLE)
    out = []
    for a, b in zip(counts[:-1].tolist(), counts[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            g = np.sort(grams[a : b - SHINGLE + 1])
            out.append(g[np.concatenate(([True], g[1:] != g[:-1]))])
        elif b > a:
            whole = span_sums(words[a:b], np.array([0]), np.array([b - a]))
            out.append(mix(whole + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def word_array(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, between: np.ndarray = _IS_SPACE) -> pa.Array:
    """The words as an Arrow string array."""
    keep = ~between[data]
    offsets = np.empty(len(starts) + 1, np.int32)
    offsets[0] = 0
    np.cumsum(ends - starts, out=offsets[1:])
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[keep]))


def kept_words(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray, gone: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Every row's words that are not gone, joined by one space: the bytes of all rows and the offsets of the rows."""
    kept = np.flatnonzero(~gone)
    row = np.searchsorted(counts, kept, side="right")
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts[kept]] += 1
    edge[ends[kept]] -= 1
    mask = np.cumsum(edge, dtype=np.int8).astype(bool)
    gaps = ends[kept[:-1][row[1:] == row[:-1]]]
    mask[gaps] = True
    out = data.copy()
    out[gaps] = 0x20
    mask = mask[:-1]
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return out[mask].tobytes(), total[offsets]
