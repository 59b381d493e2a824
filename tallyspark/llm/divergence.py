"""Divergence of the sources of each language, by a heavy-light split of the terms.

Every (lang, source) group gives each kept term t the rounded probability p(t); two groups differ by the sum over all kept
terms of f(p, q) = floor((p - q)**2 / (p + q)). A term that a group lacks has the group's least probability z, so most of the
sum is known without looking at the term:

* Heavy terms, present in a good part of the language's groups, fill dense tiles of terms by groups; the sums over a
  tile are numpy column operations.
* Light terms are handled by their postings alone. f(z, z') counts once for every light term; a posting of one group adds
  f(p, z') - f(z, z') against every other group, which depends only on its count, so equal counts are taken together;
  and two postings of one term add f(p, p') - f(p, z') - f(z, p') + f(z, z').

Both are partial sums of whole numbers over disjoint terms and are added exactly. Terms are dealt to tasks, so a group
with a third of all text is one column among others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import partitions, raw_bytes, slices, staged, word_array, word_bounds, word_hashes

#: A language keeps the terms that at least so many of its documents have.
MIN_DOCS = 10
SCALE = 1_000_000_000
#: Added to every count; the kept terms add as much to the total.
SMOOTH = 2
TOP = 10
#: Terms in at least one of so many groups of a language are heavy.
HEAVY_OF = 4
#: Cells of one dense tile, and groups that one task has as rows of its sums.
TILE_CELLS = 1 << 18
BLOCK = 1024
#: Text that one counting pass takes, and rows that a merge holds before it adds them up.
PASS_BYTES = 8 << 20
MERGE_ROWS = 2 << 20

_BYTE = np.arange(256)
#: Bytes between terms: ASCII other than letters.
BETWEEN = (_BYTE < 0x80) & ~((_BYTE >= 0x41) & (_BYTE <= 0x5A)) & ~((_BYTE >= 0x61) & (_BYTE <= 0x7A))
_LOWER = np.where((_BYTE >= 0x41) & (_BYTE <= 0x5A), _BYTE + 32, _BYTE).astype(np.uint8)

POSTED = "lang string, term string, total long, postings array<struct<source:string,n:long>>"


def count_terms(buckets: int):
    """Text to the counts of its terms by group, packed by bucket of the term: (bucket, payload)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=PASS_BYTES):
                yield _packed(part, buckets)

    return count


def _packed(part: pa.RecordBatch, buckets: int) -> pa.RecordBatch:
    data, offsets = raw_bytes(part.column("text"))
    data = _LOWER[data]
    starts, ends, counts = word_bounds(data, offsets, BETWEEN)
    terms = word_array(data, starts, ends, BETWEEN).dictionary_encode()
    k = max(1, len(terms.dictionary))
    doc = np.repeat(np.arange(part.num_rows), np.diff(counts))
    of_doc, n = np.unique(doc * k + terms.indices.to_numpy(), return_counts=True)
    lang, source = (part.column(c).dictionary_encode() for c in ("lang", "source"))
    group = lang.indices.to_numpy().astype(np.int64) * max(1, len(source.dictionary)) + source.indices.to_numpy()
    entry, back = np.unique(group[of_doc // k] * k + of_doc % k, return_inverse=True)
    order = np.argsort(back, kind="stable")
    firsts = np.searchsorted(back[order], np.arange(len(entry)))
    docs = np.diff(np.append(firsts, len(back)))
    n = np.add.reduceat(n[order], firsts) if len(entry) else n
    words, bounds = raw_bytes(terms.dictionary)
    bucket = (word_hashes(words, bounds[:-1], bounds[1:])[entry % k] >> np.uint64(20)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    entry, bucket = entry[order], bucket[order]
    of_group, of_term = entry // k, entry % k
    rows = pa.table({
        "lang": lang.dictionary.take(pa.array(of_group // max(1, len(source.dictionary)))),
        "source": source.dictionary.take(pa.array(of_group % max(1, len(source.dictionary)))),
        "term": terms.dictionary.take(pa.array(of_term)),
        "n": pa.array(n[order], pa.int64()),
        "docs": pa.array(docs[order], pa.int64()),
    })
    edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.empty(0, np.int64)
    payloads = [_stream(rows.slice(a, b - a)) for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(bucket)], strict=False)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[edges].astype(np.int32)), pa.array(payloads, pa.binary())], names=["bucket", "payload"])


def _stream(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def _summed(parts: list[pa.Table]) -> pa.Table:
    rows = pa.concat_tables(parts).group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return rows.rename_columns({"n_sum": "n", "docs_sum": "docs"})


def merge_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All payloads of some buckets: one row with postings for each term that enough documents have."""
    held: list[pa.Table] = []
    rows = 0
    for batch in batches:
        for payload in batch.column("payload"):
            held.append(pa.ipc.open_stream(payload.as_buffer()).read_all())
            rows += held[-1].num_rows
            if rows > MERGE_ROWS:
                held = [_summed(held)]
                # What does not shrink is held; the next turn comes only after as many rows again.
                rows = min(held[0].num_rows, MERGE_ROWS // 2)
    if not held:
        return
    found = _summed(held)
    found = found.take(pc.sort_indices(found, [("lang", "ascending"), ("term", "ascending"), ("source", "ascending")])).combine_chunks()
    new = np.ones(found.num_rows, bool)
    for name in ("lang", "term"):
        differs = pc.not_equal(found.column(name).slice(1), found.column(name).slice(0, found.num_rows - 1)).to_numpy()
        new[1:] = differs if name == "lang" else new[1:] | differs
    firsts = np.flatnonzero(new)
    docs, total = (np.add.reduceat(found.column(c).to_numpy(), firsts) for c in ("docs", "n"))
    sizes = np.diff(np.append(firsts, found.num_rows))
    kept = docs >= MIN_DOCS
    rows_kept = found.filter(pa.array(np.repeat(kept, sizes))).combine_chunks()
    lists = np.concatenate(([0], np.cumsum(sizes[kept]))).astype(np.int32)
    postings = pa.ListArray.from_arrays(pa.array(lists), pa.StructArray.from_arrays([rows_kept.column(c).combine_chunks() for c in ("source", "n")], ["source", "n"]))
    at = pa.array(firsts[kept])
    lang, term = (found.column(c).take(at).combine_chunks() for c in ("lang", "term"))
    out = pa.RecordBatch.from_arrays([lang, term, pa.array(total[kept]), postings], names=["lang", "term", "total", "postings"])
    for low in range(0, out.num_rows, 10_000):
        yield out.slice(low, 10_000)


def probability(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * count / total), exact for totals below 2**48."""
    whole, rest = np.divmod(count * 32_000, total)
    return 1 + whole * 31_250 + rest * 31_250 // total


def difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class Sums:
    """The sums of one language over the terms that a task has, for the groups of a block against those after them."""

    def __init__(self, lang: str, block: int, sources: list[str], totals: list[int], terms: int, whole: int):
        self.lang, self.sources = lang, sources
        self.low, self.high = block * BLOCK, min((block + 1) * BLOCK, len(sources))
        self.index = {s: i for i, s in enumerate(sources)}
        self.totals = np.array(totals, np.int64) + SMOOTH * terms
        self.whole = whole + SMOOTH * terms
        self.sums = np.zeros((self.high - self.low, len(sources)), np.int64)
        self.least = probability(np.full(len(sources), SMOOTH, np.int64), self.totals) if terms else np.ones(len(sources), np.int64)
        self.base = difference(self.least[self.low : self.high, None], self.least[None, :])
        self.top: list[list[tuple[int, str]]] = [[] for _ in sources]
        self.held: list[tuple[str, int, list[int], list[int]]] = []
        self.cells = 0

    def add(self, term: str, total: int, groups: list[int], counts: list[int]) -> None:
        self.held.append((term, total, groups, counts))
        self.cells += len(groups) if self.light(len(groups)) else len(self.sources)
        if self.cells >= TILE_CELLS:
            self.settle()

    def light(self, size: int) -> bool:
        return HEAVY_OF * size < len(self.sources)

    def settle(self) -> None:
        if not self.held:
            return
        sizes = np.array([len(x[2]) for x in self.held])
        term = np.repeat(np.arange(len(sizes)), sizes)
        group = np.fromiter((g for x in self.held for g in x[2]), np.int64, sizes.sum())
        count = np.fromiter((n for x in self.held for n in x[3]), np.int64, sizes.sum())
        p = probability(count + SMOOTH, self.totals[group])
        light = HEAVY_OF * sizes < len(self.sources)
        thin = light[term]
        self._dense(np.cumsum(~light)[term[~thin]] - 1, group[~thin], p[~thin], int((~light).sum()))
        self._sparse(term[thin], group[thin], p[thin], int(light.sum()))
        if self.low == 0:
            self._tops(term, group, p)
        self.held, self.cells = [], 0

    def _dense(self, term: np.ndarray, group: np.ndarray, p: np.ndarray, terms: int) -> None:
        if not terms:
            return
        tile = np.repeat(self.least[:, None], terms, axis=1)
        tile[group, term] = p
        for g in range(self.low, self.high):
            self.sums[g - self.low, g + 1 :] += difference(tile[g], tile[g + 1 :]).sum(axis=1)

    def _sparse(self, term: np.ndarray, group: np.ndarray, p: np.ndarray, terms: int) -> None:
        self.sums += terms * self.base
        if not len(term):
            return
        # One posting against a group without the term: by group and probability.
        span = int(p.max()) + 1
        pairs, times = np.unique(group * span + p, return_counts=True)
        g, value = pairs // span, pairs % span
        step = max(1, TILE_CELLS // len(self.sources))
        for low in range(0, len(g), step):
            of, q, n = g[low : low + step], value[low : low + step, None], times[low : low + step, None]
            gain = n * (difference(q, self.least[None, :]) - difference(self.least[of][:, None], self.least[None, :]))
            mine = (of >= self.low) & (of < self.high)
            np.add.at(self.sums, of[mine] - self.low, gain[mine])
            np.add.at(self.sums.T, of, gain[:, self.low : self.high])
        # Two postings of one term.
        for d in range(1, len(term)):
            a = np.flatnonzero(term[d:] == term[:-d])
            if not len(a):
                break
            b = a + d
            a, b = np.where(group[a] < group[b], a, b), np.where(group[a] < group[b], b, a)
            inside = (group[a] >= self.low) & (group[a] < self.high)
            a, b = a[inside], b[inside]
            za, zb = self.least[group[a]], self.least[group[b]]
            gain = difference(p[a], p[b]) - difference(p[a], zb) - difference(za, p[b]) + difference(za, zb)
            np.add.at(self.sums, (group[a] - self.low, group[b]), gain)

    def _tops(self, term: np.ndarray, group: np.ndarray, p: np.ndarray) -> None:
        q = probability(np.array([x[1] for x in self.held], np.int64) + SMOOTH, np.int64(self.whole))[term]
        over = np.flatnonzero(p > q)
        term, group, value = term[over], group[over], difference(p[over], q[over])
        order = np.lexsort((-value, group))
        term, group, value = term[order], group[order], value[order]
        firsts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else np.empty(0, np.int64)
        for a, b in zip(firsts.tolist(), [*firsts[1:].tolist(), len(group)], strict=False):
            cut = np.searchsorted(-value[a:b], -value[min(a + TOP, b) - 1], side="right")
            best = [(-int(v), self.held[t][0]) for v, t in zip(value[a : a + cut], term[a : a + cut], strict=True)]
            self.top[group[a]] = sorted(self.top[group[a]] + best)[:TOP]

    def rows(self) -> Iterator[tuple[str, str, str, str, int]]:
        self.settle()
        for g in range(self.low, self.high):
            for h in range(g + 1, len(self.sources)):
                value = int(self.sums[g - self.low, h])
                yield self.lang, self.sources[g], "pair", self.sources[h], value
                yield self.lang, self.sources[h], "pair", self.sources[g], value
        for g, best in enumerate(self.top):
            for value, term in best:
                yield self.lang, self.sources[g], "term", term, -value


PARTIAL = "lang string, source string, part string, item string, value long"


def partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (lang, block, kind): a language's groups, then its terms. The sums of each (lang, block) of the task."""

    def out(sums: Sums) -> Iterator[pa.RecordBatch]:
        found = list(sums.rows())
        for low in range(0, len(found), 50_000):
            columns = zip(*found[low : low + 50_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(),) * 4 + (pa.int64(),), strict=True)], names=["lang", "source", "part", "item", "value"])

    sums = None
    for batch in batches:
        for lang, block, kind, term, total, terms, postings in zip(*(batch.column(c).to_pylist() for c in ("lang", "block", "kind", "term", "total", "terms", "postings")), strict=True):
            if kind == 0:
                if sums is not None:
                    yield from out(sums)
                sums = Sums(lang, block, [x["source"] for x in postings], [x["n"] for x in postings], terms, total)
            else:
                sums.add(term, total, [sums.index[x["source"]] for x in postings], [x["n"] for x in postings])
    if sums is not None:
        yield from out(sums)


def divergence(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank for every (lang, source) group of docs.

    Part `pair`: every other source of the language. Part `term`: the TOP terms that the group has more often than its
    language. Null text, lang and source count as empty. Equal values are ranked by item. Repeated rows count as
    documents of their own. A language whose terms are all rare gives pairs of value 0; an empty table gives an empty
    result; other columns are not read.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    counted = rows.mapInArrow(count_terms(n), "bucket int, payload binary")
    terms = staged(counted.repartitionById(n, F.col("bucket")).mapInArrow(merge_terms, POSTED), "terms")

    totals = terms.select("lang", F.explode("postings").alias("x")).groupBy("lang", "x.source").agg(F.sum("x.n").alias("n"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").select("lang", F.struct("source", F.coalesce("n", F.lit(0).cast("long")).alias("n")).alias("x"))
    kept = terms.groupBy("lang").agg(F.sum("total").alias("total"), F.count(F.lit(1)).alias("terms"))
    langs = groups.groupBy("lang").agg(F.sort_array(F.collect_list("x")).alias("postings")).join(kept, "lang", "left").na.fill(0, ["total", "terms"])
    # So many tasks for a language that their sums, a row for each pair, stay small beside the work on its terms.
    spread = F.greatest(F.lit(1), F.least(F.lit(n), F.floor(F.col("terms") / F.size("postings")))).cast("long")
    langs = staged(langs.withColumn("spread", spread).withColumn("blocks", F.ceil(F.size("postings") / BLOCK).cast("long")), "langs")
    place = F.pmod(F.xxhash64("lang") + F.col("block") * 7919 + F.col("at"), F.lit(n)).cast("int").alias("place")
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
    columns = ("lang", "block", "kind", "term", "total", "terms", "postings")
    heads = langs.select("lang", "total", "terms", "postings", "spread", blocks).withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("spread") - 1)))
    heads = heads.withColumn("kind", F.lit(0)).withColumn("term", F.lit(None).cast("string")).select(place, *columns)
    shares = langs.select("lang", "spread", "blocks")
    rest = terms.join(shares, "lang").select("lang", "term", "total", "postings", F.pmod(F.xxhash64("term"), "spread").alias("at"), blocks)
    rest = rest.withColumn("kind", F.lit(1)).withColumn("terms", F.lit(0).cast("long")).select(place, *columns)
    dealt = heads.union(rest).repartitionById(n, F.col("place")).sortWithinPartitions("lang", "block", "kind")
    found = staged(dealt.drop("place").mapInArrow(partial_sums, PARTIAL), "sums")

    key = ["lang", "source", "part", "item"]
    whole = found.groupBy(*key).agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return whole.withColumn("rank", rank).filter(f"part = 'pair' or rank <= {TOP}").select(*key, "value", "rank")
